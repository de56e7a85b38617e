"""Benchmark the headline queries.

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line:
``{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}``.
Each query is executed completely with the ``noop`` sink (no driver collect);
a warm-up run of a small query first keeps JVM start-up out of the numbers.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "articles_enriched", "source_comparison", "store_stats", "daily_sentiment_ratio",
    "boxplot_stats", "feed_page", "exact_dedupe", "upsert_articles", "alt_sources_fold",
    "trending_keywords", "tfidf_weights", "keyword_frequency", "lexicon_sentiment",
    "similar_pairs", "fuzzy_match_best", "greedy_merge", "extract_pages", "stream_daily",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("ARTICLESPARK_DRIVER_MEMORY", os.environ.get("BENCH_DRIVER_MEMORY", "4g"))
    only = sys.argv[1:]
    from articlespark.plans.registry import load_all
    from articlespark.session import local_session

    n_cpu = int(cpus) if cpus.isdigit() else os.cpu_count() or 8
    spark = local_session(cpus, shuffle_partitions=max(4, n_cpu * 2), app_name="articlespark-bench")
    reg = load_all()
    names = [n for n in (only or HEADLINE) if n in reg]
    reg["distinct_sources"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        reg[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr)
    spark.stop()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
