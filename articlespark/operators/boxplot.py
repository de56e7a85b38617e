"""Box-plot statistics (A8) from a sketch and one pass.

A quantile sketch of each group (``percentile_approx``, a bounded summary that is merged
map-side) gives a value range that holds each quartile's rank, and with these ranges in
which each fence lies.  One pass over the values then counts exactly: how many lie
below, inside and above each of the five ranges, with the nearest values outside, and
the distinct values inside.  Quartiles are looked up by rank among the values inside;
fences, whiskers and outliers follow from the same counts.  Values are neither sorted nor
read a third time, and a group never lies in one task: what is left of it is 4 / accuracy of its rows a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

QUARTILES = (0.25, 0.5, 0.75)
NAMES = ("q1", "median", "q3")


def value_ranges(df: DataFrame, group: str, value: str, accuracy: int) -> DataFrame:
    """``(group, n, ranges)``: for each quartile, the lower and the upper fence a range ``(r,
    lo, hi)`` that holds it."""
    v = F.col(value).cast("double")
    widths = sorted({2.0 / accuracy, 0.002, 0.02, 0.2} - {e for e in (0.002, 0.02) if e < 2.0 / accuracy})
    probs = [min(1.0, max(0.0, p)) for e in widths for q in QUARTILES for p in (q - e, q + e)]
    s = df.where(v.isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx(v, probs, accuracy).alias("p"), F.min(v).alias("least"), F.max(v).alias("most"))

    def end(k: int, upper: int) -> Column:
        """Of the k-th quartile's bounds the narrowest that is two ranks away at least, as quartiles lie between two values."""
        out = F.col("most" if upper else "least")
        for level in reversed(range(len(widths))):
            out = F.when(F.col("n") * widths[level] >= 2, F.col("p")[(level * 3 + k) * 2 + upper]).otherwise(out)
        return out

    lo, hi = [end(k, 0) for k in range(3)], [end(k, 1) for k in range(3)]
    slack = (F.abs(lo[0]) + F.abs(hi[2])) * 1e-9 + 1e-300  # rounding of the fences
    fences = [(2.5 * lo[0] - 1.5 * hi[2] - slack, 2.5 * hi[0] - 1.5 * lo[2] + slack),
              (2.5 * lo[2] - 1.5 * hi[0] - slack, 2.5 * hi[2] - 1.5 * lo[0] + slack)]
    ranges = [*zip(lo, hi), *fences]
    return s.select(group, "n", F.array(*(F.struct(F.lit(r).alias("r"), a.alias("lo"), b.alias("hi")) for r, (a, b) in enumerate(ranges))).alias("ranges"))


def _at_rank(k: Column, cells: str = "inside") -> Column:
    """The value of 0-based rank ``k`` from a range's cumulative counts, or the next value outside."""
    hit = F.element_at(F.filter(cells, lambda x: x["hi"] > k), 1)["v"]
    return (F.when(k < F.col("below"), F.when(k == F.col("below") - 1, F.col("last_below")))
            .when(k >= F.col("below") + F.col("within"), F.when(k == F.col("below") + F.col("within"), F.col("first_above")))
            .otherwise(hit))


def box_statistics(df: DataFrame, group: str, value: str, accuracy: int = 10_000) -> DataFrame:
    """``group, n, q1, median, q3, iqr, lower_fence, upper_fence, whisker_low,
    whisker_high, n_outliers``: quartiles by linear interpolation, fences at 1.5 IQR,
    whiskers at the most extreme values inside the fences.  NULL values are left out; a
    group without a value has no row."""
    ensure_checkpoint_dir(df.sparkSession)
    ranges = value_ranges(df, group, value, accuracy).checkpoint()  # a row a group
    v = F.col("v")
    rows = (df.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("v"))
            .join(ranges.select(group, "ranges"), group).select(group, "v", F.explode("ranges").alias("x")))
    side = F.when(v < F.col("x.lo"), F.lit(-1)).when(v > F.col("x.hi"), F.lit(1)).otherwise(F.lit(0))
    cells = (rows.select(group, F.col("x.r").alias("r"), side.alias("side"), "v")
             .groupBy(group, "r", "side", F.when(F.col("side") == 0, v).alias("at"))
             .agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most")).checkpoint())
    outside = cells.groupBy(group, "r").agg(
        F.coalesce(F.sum(F.when(F.col("side") == -1, F.col("c"))), F.lit(0)).alias("below"),
        F.coalesce(F.sum(F.when(F.col("side") == 0, F.col("c"))), F.lit(0)).alias("within"),
        F.coalesce(F.sum(F.when(F.col("side") == 1, F.col("c"))), F.lit(0)).alias("above"),
        F.max(F.when(F.col("side") == -1, F.col("most"))).alias("last_below"),
        F.min(F.when(F.col("side") == 1, F.col("least"))).alias("first_above"))
    # Quartiles: ranks among the few values inside.
    w = Window.partitionBy(group, "r").orderBy("at")
    ranked = (cells.where("side = 0 AND r < 3").join(outside.select(group, "r", "below"), [group, "r"])
              .select(group, "r", F.col("at").alias("v"), (F.col("below") + F.sum("c").over(w)).alias("hi")))
    inside = ranked.groupBy(group, "r").agg(F.sort_array(F.collect_list(F.struct("hi", "v"))).alias("inside"))
    pos = F.element_at(F.array(*(F.lit(q) for q in QUARTILES)), F.col("r") + 1) * (F.col("n") - 1)
    q = (outside.where("r < 3").join(inside, [group, "r"], "left").join(ranges.select(group, "n"), group)
         .withColumn("inside", F.coalesce("inside", F.array().cast("array<struct<hi:bigint,v:double>>"))).withColumn("pos", pos))
    q = q.withColumn("v0", _at_rank(F.floor("pos"))).withColumn("v1", _at_rank(F.ceil("pos")))
    exact = F.when(F.col("v0").isNull() | F.col("v1").isNull(), F.raise_error(F.lit("a quartile lies outside of its range")).cast("double")) \
        .otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("pos") - F.floor("pos")))
    q = q.groupBy(group, "n").agg(*(F.max(F.when(F.col("r") == r, exact)).alias(name) for r, name in enumerate(NAMES)))
    q = (q.withColumn("iqr", F.col("q3") - F.col("q1")).withColumn("lower_fence", F.col("q1") - 1.5 * F.col("iqr"))
         .withColumn("upper_fence", F.col("q3") + 1.5 * F.col("iqr")))
    # Whiskers: the values within a fence's range decide, then the nearest ones behind it.
    low, high = F.col("r") == 3, F.col("r") == 4
    inner = (low & (F.col("at") >= F.col("lower_fence"))) | (high & (F.col("at") <= F.col("upper_fence")))
    beyond = (F.col("side") == 0) & ~inner | low & (F.col("side") == -1) | high & (F.col("side") == 1)
    tails = (cells.where("r >= 3").join(q.select(group, "lower_fence", "upper_fence"), group).groupBy(group).agg(
        F.min(F.when(low & ((F.col("side") == 1) | (F.col("side") == 0) & inner), F.col("least"))).alias("whisker_low"),
        F.max(F.when(high & ((F.col("side") == -1) | (F.col("side") == 0) & inner), F.col("most"))).alias("whisker_high"),
        F.sum(F.when(beyond, F.col("c")).otherwise(0)).alias("n_outliers")))
    return q.join(tails, group)
