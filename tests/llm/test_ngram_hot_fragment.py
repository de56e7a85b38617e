"""A fragment that a copy group fills is counted by several tasks."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

SCHEMA = "frag int, rids binary, hashes binary"


def test_hot_fragment_is_spread_and_counted(spark, monkeypatch):
    from articlespark.llm import ngramjoin
    from articlespark.llm.common import ready

    ready(spark)
    monkeypatch.setattr(ngramjoin, "TASK_HASHES", 200)
    rng, rows, held = np.random.default_rng(8), [], []
    for batch in range(200):  # fragment 1: the same hash in each of 2,000 documents
        rids = np.repeat(np.arange(batch * 10, batch * 10 + 10), 2)
        hashes = np.where(np.arange(20) % 2 == 0, 7, rng.integers(100, 3000, 20)).astype("<u8")
        rows.append((1, rids.astype("<i8").tobytes(), hashes.tobytes()))
        held += [(1, r, h) for r, h in zip(rids.tolist(), hashes.tolist())]
    for frag, hashes in ((0, [5, 5, 6]), (2, [9]), (3, [11, 12])):
        rows.append((frag, np.arange(len(hashes), dtype="<i8").tobytes(), np.array(hashes, "<u8").tobytes()))
        held += [(frag, r, h) for r, h in enumerate(hashes)]
    prefixes = spark.createDataFrame([(f, bytearray(r), bytearray(h)) for f, r, h in rows], SCHEMA)
    often, want = Counter((f, h) for f, _, h in held), Counter()
    for f, r, h in held:
        want[r] += often[f, h] > 1
    got = {r["rid"]: r["shared"] for r in ngramjoin.shared_counts(prefixes, 4).collect()}
    assert got == {r: n for r, n in want.items() if n}
    dealt = ngramjoin.dealt_prefixes(prefixes, 4).where("rids is not null").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in dealt) == len(rows) and max(r["count"] for r in dealt) < len(rows) / 4
