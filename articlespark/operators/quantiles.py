"""Exact, distributed per-group quantiles (linear interpolation).

``percentile`` in Spark keeps a value histogram of a whole group in one task;
with one group holding a third of all rows that histogram is unbounded.  Here
the work is spread by a global range sort instead:

1. histogram ``(g, v, c)`` by a normal aggregate (map-side combine);
2. ``repartitionByRange(g, v)``: a hot group is cut across many partitions
   because ``v`` is part of the range key;
3. running counts inside each range partition (a window keyed by the partition
   id, so a window task holds one range partition, never a whole group);
4. per-(partition, group) totals are a tiny table (partitions x groups that
   straddle them); their prefix sums per group give each partition's offset;
5. each wanted rank (floor/ceil of q*(n-1)) is mapped to its range partition
   through that tiny table, then looked up with an equi-join on
   ``(g, partition)`` -- so even the lookup never gathers one group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def ranked_histogram(df: DataFrame, group: str, value: str,
                     partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns ``(ranked, offsets)``.

    ``ranked``: ``(group, value, c, lo, hi, _pid)`` -- the value occupies the
    0-based ranks ``[lo, hi)`` of its group.  ``offsets``: ``(_pid, group,
    _off, _ptot, n)`` -- one small row per range partition and group.
    """
    hist = (df.where(F.col(value).isNotNull())
            .groupBy(group, value).agg(F.count(F.lit(1)).alias("c")))
    ensure_checkpoint_dir(df.sparkSession)
    # checkpointed so the stored partition id is the same for every consumer;
    # without an explicit count AQE may coalesce adjacent (still ordered) ranges
    parted = (hist.repartitionByRange(partitions, group, value) if partitions
              else hist.repartitionByRange(group, value))
    ranged = (parted
              .withColumn("_pid", F.spark_partition_id())
              .checkpoint())
    w_in = (Window.partitionBy("_pid", group).orderBy(value)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ranged.withColumn("_cum_local", F.sum("c").over(w_in))
    part_tot = ranged.groupBy("_pid", group).agg(F.sum("c").alias("_ptot"))
    w_off = (Window.partitionBy(group).orderBy("_pid")
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (part_tot
               .withColumn("_off", F.coalesce(F.sum("_ptot").over(w_off), F.lit(0)))
               .withColumn("n", F.sum("_ptot").over(Window.partitionBy(group))))
    ranked = (local.join(offsets.select("_pid", group, "_off", "n"), ["_pid", group])
              .withColumn("hi", F.col("_off") + F.col("_cum_local"))
              .withColumn("lo", F.col("hi") - F.col("c"))
              .select(group, value, "c", "lo", "hi", "n", "_pid"))
    return ranked, offsets


def exact_quantiles(df: DataFrame, group: str, value: str, qs: Sequence[float],
                    names: Sequence[str] | None = None) -> DataFrame:
    """One row per group: ``n`` and one column per quantile (the 'linear'
    interpolation of pandas ``Series.quantile`` / NumPy)."""
    names = list(names or [f"q{int(q * 100)}" for q in qs])
    ranked, offsets = ranked_histogram(df, group, value)
    groups = offsets.select(group, "n").distinct()
    q_arr = F.array(*[F.struct(F.lit(i).alias("qi"), F.lit(float(q)).alias("q")) for i, q in enumerate(qs)])
    targets = (groups.select(group, "n", F.explode(q_arr).alias("t"))
               .select(group, "n", F.col("t.qi").alias("qi"), (F.col("t.q") * (F.col("n") - 1)).alias("pos"))
               .withColumn("frac", F.col("pos") - F.floor("pos"))
               .select(group, "qi", "frac",
                       F.explode(F.array(
                           F.struct(F.lit(0).alias("side"), F.floor("pos").cast("long").alias("k")),
                           F.struct(F.lit(1).alias("side"), F.ceil("pos").cast("long").alias("k")))).alias("s"))
               .select(group, "qi", "frac", "s.side", "s.k"))
    # rank -> range partition, using the small offsets table only
    t_pid = (targets.alias("t")
             .join(offsets.alias("o"),
                   (F.col(f"t.{group}") == F.col(f"o.{group}"))
                   & (F.col("o._off") <= F.col("t.k"))
                   & (F.col("t.k") < F.col("o._off") + F.col("o._ptot")))
             .select(F.col(f"t.{group}").alias(group), "t.qi", "t.frac", "t.side", "t.k", "o._pid"))
    hit = (t_pid.alias("t")
           .join(ranked.alias("r"),
                 (F.col(f"t.{group}") == F.col(f"r.{group}"))
                 & (F.col("t._pid") == F.col("r._pid"))
                 & (F.col("r.lo") <= F.col("t.k")) & (F.col("t.k") < F.col("r.hi")))
           .select(F.col(f"t.{group}").alias(group), "t.qi", "t.frac", "t.side", F.col(f"r.{value}").alias("v")))
    per_q = (hit.groupBy(group, "qi", "frac")
             .agg(F.max(F.when(F.col("side") == 0, F.col("v"))).alias("v0"),
                  F.max(F.when(F.col("side") == 1, F.col("v"))).alias("v1"))
             .withColumn("qv", F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("frac")))
    out = per_q.groupBy(group).agg(*[
        F.max(F.when(F.col("qi") == i, F.col("qv"))).alias(name) for i, name in enumerate(names)])
    return groups.join(out, group)
