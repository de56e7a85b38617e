"""Keep-first over a stream with keyed state, against a plain loop."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from articlespark.streaming import ingest as st
from articlespark.streaming.firstseen import first_seen
from frames import rows

START = datetime(2025, 6, 1)
SCHEMA = "seq long, title string, content string, ingested_at timestamp"


def _run(spark, tmp_path, steps, horizon=72, delay="60 hours"):
    for step in steps:
        spark.createDataFrame(step, SCHEMA).write.mode("append").parquet(str(tmp_path / "raw"))
        stream = st.file_stream(spark, str(tmp_path / "raw"), spark.createDataFrame([], SCHEMA).schema)
        (first_seen(stream, horizon, delay).writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(str(tmp_path / "out"))


def _loop(steps, horizon=72):
    state, kept = {}, []
    for step in steps:
        for seq, _, content, at in sorted(step, key=lambda r: r[0]):
            key, (have, when) = (content or "").strip().lower(), state.get((content or "").strip().lower(), (False, None))
            if not have:
                kept.append(seq)
                state[key] = (True, at)
            elif at is not None and when is not None and abs(at - when) >= timedelta(hours=horizon):
                kept.append(seq)
                state[key] = (True, max(at, when))
    return sorted((s,) for s in kept)


def test_first_seen_over_steps_late_rows_and_expiry(spark, tmp_path):
    rnd, steps, seq = random.Random(9), [], 0
    for k in range(4):
        step = []
        for _ in range(25):
            late = rnd.choice([0] * 6 + [50])  # within the watermark's delay
            at = START + timedelta(hours=60 * (k + 1) - late - rnd.randrange(8))
            step.append((seq, f"t{seq}", rnd.choice(["Alpha", " alpha", "beta", "gamma", "delta", "", None, f"own {seq}"]),
                         at if rnd.random() < 0.95 or k == 0 else None))
            seq += 1
        steps.append(step)
    out = _run(spark, tmp_path, steps)
    assert rows(out, "seq") == _loop(steps)
    assert out.columns == ["seq", "title", "content", "ingested_at", "content_hash"]
    got = {r.seq: (r.title, r.ingested_at) for r in out.collect()}
    assert all(got[r[0]] == (r[1], r[3]) for s in steps for r in s if r[0] in got)


@pytest.mark.parametrize("hours,want", [(71, [(1,)]), (72, [(1,), (3,)])])
def test_smallest_seq_stays_and_the_horizon_ends(spark, tmp_path, hours, want):
    steps = [[(2, "b", "same text", START), (1, "a", "same  text", START)],
             [(9, "x", "other", START + timedelta(hours=hours + 100))],  # the watermark passes the horizon
             [(3, "c", "same text", START + timedelta(hours=hours))]] if hours == 71 else \
            [[(2, "b", "same text", START), (1, "a", "same  text", START)], [(3, "c", "same text", START + timedelta(hours=hours))]]
    out = _run(spark, tmp_path, steps, delay="300 hours")
    assert rows(out.where("content <> 'other'"), "seq") == want


def test_expired_state_is_cleared(spark, tmp_path):
    steps = [[(k, "t", f"text {k}", START) for k in range(5)], [(10, "t", "later", START + timedelta(hours=500))], [(11, "t", "last", START + timedelta(hours=501))]]
    _run(spark, tmp_path, steps, delay="1 hour")
    state = spark.read.format("statestore").option("stateVarName", "kept").load(str(tmp_path / "ckpt"))
    assert state.count() == 2


def test_hashes_share_calls_and_keep_their_own_state(spark, tmp_path, monkeypatch):
    """Fewer calls than hashes; each hash has its own horizon; a seq that is null or beyond 2**53."""
    from articlespark.streaming import firstseen

    monkeypatch.setattr(firstseen, "BUCKETS", 3)
    big, hour = 2 ** 60, timedelta(hours=1)
    steps = [[(big + 2 * k + 1, "t", f"text {k}", START + k * hour) for k in range(40)] + [(None, "t", "no number", START)],
             [(big + 1000 + k, "t", f"text {k}", START + 75 * hour) for k in range(40)],  # 36 hours to 75 later
             [(big + 2000 + k, "t", f"text {k}", START + 160 * hour) for k in range(40)]]
    out = _run(spark, tmp_path, steps, delay="100 hours")
    want = [big + 2 * k + 1 for k in range(40)] + [big + 1000 + k for k in range(4)] + [big + 2000 + k for k in range(40)]
    assert sorted(r.seq for r in out.collect() if r.seq is not None) == want and out.where("seq IS NULL").count() == 1
    state = spark.read.format("statestore").option("stateVarName", "kept").load(str(tmp_path / "ckpt"))
    assert state.select("key").distinct().count() <= 3
