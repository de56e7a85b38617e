"""X2 with keyed state: the first record of each content hash within a horizon.

``first_seen`` holds, for each hash, the smallest ``seq`` of its latest kept record and that
record's event time, in Spark's state store (``transformWithState``), so no micro-batch
reads the store again.  In the order of micro-batches and, inside one, of ``seq``:

* a hash without state is kept;
* a record less than ``horizon`` of event time before or after the kept one is a
  duplicate, in whatever micro-batch it comes;
* a record at least ``horizon`` later is kept, and takes the state over; one that comes late and is
  at least ``horizon`` older is kept too, and leaves it;
* a record without a time is a duplicate wherever there is state; kept, it has no end.

A timer at the kept record's time plus ``horizon`` clears the state, so its size is bounded
by the horizon and the watermark's delay; as records that come after it would be kept
anyway, it does not change the result.  Records later than the delay are dropped by Spark.

Hashes are held together in ``BUCKETS`` lists, so that a micro-batch costs calls of Python and of the
state store for each bucket that it touches, not for each hash; a bucket has one timer, at
the first end among its hashes.  The number of buckets is part of the state: it must not change
under a checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import content_hash
from ..session import ship_package

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


BUCKETS = 4096


class FirstSeen(StatefulProcessor):
    def __init__(self, horizon_ms: int):
        self.horizon = horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "content_hash string, seq bigint, ms bigint")

    def _end(self, held: dict) -> int | None:
        """When the first of these hashes ends."""
        return min((ms + self.horizon for _, ms in held.values() if ms is not None), default=None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows), ignore_index=True)
        seqs = [None if pd.isna(x) else int(x) for x in batch["seq"].tolist()]
        times = [None if pd.isna(x) else int(x) for x in batch["event_ms"].tolist()]
        hashes = batch["content_hash"].tolist()
        before = {h: (seq, ms) for h, seq, ms in self.kept.get()}
        held, first = dict(before), []
        for k in sorted(range(len(seqs)), key=lambda i: (seqs[i] is None, seqs[i] or 0)):
            h, seq, ms = hashes[k], seqs[k], times[k]
            state = held.get(h)
            if state is None:
                held[h] = (seq, ms)
                first.append(k)
            elif ms is None or state[1] is None or abs(ms - state[1]) < self.horizon:
                if seq is not None and (state[0] is None or seq < state[0]):
                    held[h] = (seq, state[1])
            else:
                if ms > state[1]:
                    held[h] = (seq, ms)
                first.append(k)
        if any(held[h] != state for h, state in before.items()):
            self.kept.put([(h, *state) for h, state in held.items()])
        elif len(held) > len(before):
            self.kept.appendList([(h, *state) for h, state in held.items() if h not in before])
        end, had = self._end(held), self._end(before)
        if end is not None and (had is None or end < had):  # else an earlier timer is set
            self.handle.registerTimer(end)
        if first:
            yield batch.iloc[first].drop(columns=["event_ms", "bucket"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = {h: (seq, ms) for h, seq, ms in self.kept.get()}
        left = {h: state for h, state in held.items() if state[1] is None or state[1] + self.horizon > now}
        if not left:
            self.kept.clear()
        elif len(left) < len(held):
            self.kept.put([(h, *state) for h, state in left.items()])
        end = self._end(left)
        if end is not None:
            self.handle.registerTimer(end)
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def first_seen(raw_stream: DataFrame, horizon_hours: float = 72, delay: str = "24 hours",
               event_time: str = "ingested_at") -> DataFrame:
    """``raw_stream`` (``seq, content, <event_time>``, ...) without repeated contents, and
    ``content_hash``; append mode.  Sets the session's state store to RocksDB, which
    timers need (running queries keep the store that their checkpoint names)."""
    spark: SparkSession = raw_stream.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    hashed = raw_stream.withColumn("content_hash", content_hash("content"))
    # Longs go as text: pandas would round them where another row of the bucket has none.
    texts = [T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.LongType) else f.dataType) for f in hashed.schema.fields]
    timed = hashed.select(*(F.col(f.name).cast(f.dataType) if f.dataType != hashed.schema[f.name].dataType else f.name for f in texts),
                          F.unix_millis(event_time).alias("event_ms"),
                          F.pmod(F.xxhash64("content_hash"), F.lit(BUCKETS)).cast("int").alias("bucket")).withWatermark(event_time, delay)
    kept = timed.groupBy("bucket").transformWithStateInPandas(
        FirstSeen(int(horizon_hours * 3_600_000)), T.StructType(texts), "append", "eventTime")
    return kept.select(*(F.col(f.name).cast(f.dataType) for f in hashed.schema.fields))
