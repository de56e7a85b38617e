"""Run registered queries on Spark and their SQL on DuckDB; compare results.

Mimics the driver's gate: row count, column names, and an order-insensitive
hash of the values (columns sorted by name).  Usage:

    python tools/check_oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(round(v, 9))
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return canon(v.item())
        except Exception:  # noqa: BLE001
            pass
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return canon(v.tolist())
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(canon(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir = args.pop(0)
    from articlespark.session import local_session
    from articlespark.plans.registry import load_all

    reg = load_all()
    names = args or list(reg)
    spark = local_session(8, 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name in names:
        q = reg[name]
        t0 = time.time()
        try:
            sdf = q.build(spark, sf_dir)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if q.sql is None:
            print(f"rows-only {name}: {len(srows)} rows, cols={scols} ({ts:.1f}s)")
            continue
        try:
            t1 = time.time()
            res = con.execute(q.sql)
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
            td = time.time() - t1
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        hs, ls = digest(srows, scols)
        hd, ld = digest(drows, dcols)
        ok = len(srows) == len(drows) and sorted(scols) == sorted(dcols) and hs == hd
        if ok:
            print(f"ok   {name}: {len(srows)} rows ({ts:.1f}s spark, {td:.1f}s duckdb)")
        else:
            bad += 1
            print(f"FAIL {name}: rows {len(srows)} vs {len(drows)}; cols {sorted(scols)} vs {sorted(dcols)}")
            sd, dd = set(ls), set(ld)
            for x in sorted(sd - dd)[:3]:
                print("   spark only:", x[:300])
            for x in sorted(dd - sd)[:3]:
                print("   duck  only:", x[:300])
    print(f"{len(names) - bad}/{len(names)} passed")
    spark.stop()


if __name__ == "__main__":
    main()
