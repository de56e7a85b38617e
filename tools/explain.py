"""Print the formatted physical plan of registered queries.

    python tools/explain.py [sf_dir] query [query ...]

Runs each query once (noop sink) so AQE's final plan is shown, then prints
``explain("formatted")`` and a one-line summary: exchanges, broadcasts,
pushed filters and read schemas of the scans.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    from articlespark.plans.registry import load_all
    from articlespark.session import local_session

    spark = local_session(8, 8)
    reg = load_all()
    for name in args:
        df = reg[name].build(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
        print(f"===== {name} ({reg[name].ops})")
        df.explain("formatted")
        summary = {
            "exchanges": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning", plan)),
            "broadcasts": plan.count("BroadcastExchange"),
            "smj": plan.count("SortMergeJoin"),
            "bhj": plan.count("BroadcastHashJoin"),
            "python": plan.count("Python") + plan.count("MapInPandas"),
        }
        print("summary:", summary)
        for m in re.findall(r"PushedFilters: \[[^\]]*\]", plan):
            print("  ", m)
    spark.stop()


if __name__ == "__main__":
    main()
