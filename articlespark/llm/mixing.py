"""Mixing sources to target weights by subset-sum budget fitting.

Every source has a target number of words: its weight's share of all words, at
most ``max_repeats`` times its own size; what a cap cuts off is shared again by
weight.  A source gives whole epochs first (all its documents, once each); the
budget that remains is fitted on the histogram of exact document lengths: each
length gives its proportional number of documents, rounded down, and bounded
knapsack dynamic programming fits what rounding left over.  A source with texts of
over ``KNAPSACK`` words that is still off its target is fitted without the
proportions: over all its lengths at once, in units that keep the reachable sums within
``FIT_BITS`` (one word, where they are few), then by exchanging single documents as long as that
comes nearer.  Which documents of a length are taken
follows from a seeded hash.

Only histograms meet in one task: a source's rows are counted by length before
any shuffle of groups, and a length's documents are dealt into salted buckets of
about ``BUCKET`` rows; whole buckets are taken, and only the one at the boundary
is ranked.

Defined results: null and empty texts have size 0 and count as no words taken;
a null source is a source of its own, last in order; a null doc_id is an ordinary
row; repeated rows are separate documents; a source without words has target 0;
an empty table gives an empty mix.  ``docs`` must be a stable scan.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ids import dense_ids
from .common import fresh, ready, row_ids, written

WORD = r"[^\x20\x09-\x0D]+"
#: Words that proportional rounding and the greedy passes leave to dynamic programming
#: where the documents allow it; where those that remain are longer, all of it is fitted.
KNAPSACK = 1 << 16
#: Bits that the reachable sums of a free fit may hold; beyond it sizes count in larger units.
FIT_BITS = 1 << 28
BUCKET = 256


def word_count(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def fit_targets(sources: DataFrame, max_repeats: int = 3) -> DataFrame:
    """Adds ``target`` to rows of (weight, source_size): the level L at which the sum
    of min(weight * L, max_repeats * source_size) is the total.  Each round is one
    aggregate over the sources; the level only rises, so rounds end."""
    cap = F.col("source_size") * max_repeats
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level, capped = (total or 0) / (weights or 1), -1
    while True:
        over = F.col("weight") * F.lit(level) >= cap
        n, given, free = sources.agg(F.count_if(over), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == capped or not free:
            break
        level, capped = ((total or 0) - (given or 0)) / free, n
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(float(level)), cap.cast("double")))


def knapsack(lengths: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """How many of each length to take (at most its count) so that their sum comes
    nearest to ``budget``.  Reachable sums are the bits of an integer; counts are
    split into powers of two; it ends once the budget itself is reachable."""
    usable = [(x, c) for x, c in zip(lengths, counts) if c > 0 and x > 0]
    if budget <= 0 or not usable:
        return {}
    reach = 2 * budget  # nothing at all is as near as that
    mask, sums, steps = (1 << (reach + 1)) - 1, 1, []
    for x, c in sorted(usable, reverse=True):
        left, n = min(c, reach // x), 1
        while left > 0 and not sums >> budget & 1:
            n = min(n, left)
            steps.append((x, n, sums))
            sums |= (sums << (x * n)) & mask
            left, n = left - n, n * 2
    below = (sums & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above = sums >> budget
    up = budget + (above & -above).bit_length() - 1 if above else None
    at = up if up is not None and up - budget < budget - below else below
    taken: dict[int, int] = {}
    for x, n, before in reversed(steps):
        if not before >> at & 1:
            taken[x] = taken.get(x, 0) + n
            at -= x * n
    return taken


def fit_rest(sizes: list[int], counts: list[int], rest: int, limit: int = KNAPSACK) -> dict[int, int]:
    """How many of each size come nearest to what the greedy passes left: where ``rest``
    is over ``limit``, every size that remains is over ``rest - limit``."""
    if rest <= 2 * limit:
        return knapsack(sizes, counts, rest)
    # Each is over half the rest: one document, or the two smallest, which are already more.
    left = sorted((s, c) for s, c in zip(sizes, counts) if s and c)
    if not left:
        return {}
    fits = [{}] + [{s: 1} for s, _ in left]
    if left[0][1] > 1:
        fits.append({left[0][0]: 2})
    elif len(left) > 1:
        fits.append({left[0][0]: 1, left[1][0]: 1})
    given = lambda fit: sum(s * n for s, n in fit.items())
    return min(fits, key=lambda fit: (abs(rest - given(fit)), given(fit)))


def fit_lengths(sizes: list[int], counts: list[int], target: float, max_repeats: int = 3,
                limit: int = KNAPSACK) -> tuple[int, list[int]]:
    """(whole epochs, documents of each size taken once more) for one source."""
    total = sum(s * c for s, c in zip(sizes, counts))
    if not total:
        return 0, [0] * len(sizes)
    epochs = min(max_repeats, int(target // total))
    budget = 0 if epochs == max_repeats else min(total, round(target - epochs * total))
    take = [c * budget // total if s else 0 for s, c in zip(sizes, counts)]
    rest = budget - sum(s * t for s, t in zip(sizes, take))
    order = sorted(range(len(sizes)), key=lambda k: (-(counts[k] * budget % total), -sizes[k]))
    for k in order:  # the largest fractions first
        if rest <= limit:
            break
        if sizes[k] and sizes[k] <= rest and take[k] < counts[k]:
            take[k] += 1
            rest -= sizes[k]
    for k in order:
        if rest > limit and sizes[k]:
            more = min(counts[k] - take[k], (rest - limit) // sizes[k])
            take[k] += more
            rest -= more * sizes[k]
    extra = fit_rest(sizes, [c - t for c, t in zip(counts, take)], rest, limit)
    take = [t + extra.get(s, 0) for s, t in zip(sizes, take)]
    off = abs(budget - sum(s * t for s, t in zip(sizes, take)))
    if off and max(sizes) > limit:
        free = exchanged(sizes, counts, free_fit(sizes, counts, budget), budget)
        if abs(budget - sum(s * n for s, n in zip(sizes, free))) < off:
            take = free
    return epochs, take


def free_fit(sizes: list[int], counts: list[int], budget: int, bits: int = FIT_BITS) -> list[int]:
    """Documents of each size whose sum comes near to ``budget``: nearest where the reachable sums fit
    into ``bits``, else up to a unit for each document that is taken."""
    steps = sum(min(c, 2 * budget // s).bit_length() for s, c in zip(sizes, counts) if s)
    unit = max(1, -(-2 * budget * steps // bits))
    rounded = [(s + unit // 2) // unit for s in sizes]
    held: dict[int, int] = {}
    for r, s, c in zip(rounded, sizes, counts):
        held[r] = held.get(r, 0) + (c if s else 0)
    wanted = knapsack(list(held), list(held.values()), (budget + unit // 2) // unit)
    take = []
    for r, s, c in zip(rounded, sizes, counts):
        take.append(min(c, wanted.get(r, 0)) if s else 0)
        wanted[r] = wanted.get(r, 0) - take[-1]
    return take


def exchanged(sizes: list[int], counts: list[int], take: list[int], budget: int) -> list[int]:
    """Takes, leaves or exchanges one document at a time, always the one that brings the sum
    nearest to ``budget``, until none does."""
    take, off = list(take), budget - sum(s * t for s, t in zip(sizes, take))
    while off:
        # -1: nothing taken in, or nothing left out.
        free = sorted([(0, -1)] + [(s, k) for k, s in enumerate(sizes) if s and take[k] < counts[k]])
        best = (abs(off), -1, -1)
        for out, k in [(0, -1)] + [(s, k) for k, s in enumerate(sizes) if take[k]]:
            at = bisect_left(free, (off + out, -1))
            for size, j in free[max(0, at - 1):at + 1]:
                best = min(best, (abs(off + out - size), k, j))
        if best[0] == abs(off):
            break
        _, k, j = best
        for at, n in ((k, -1), (j, 1)):
            if at >= 0:
                take[at] += n
                off -= n * sizes[at]
    return take


def _fit_source(max_repeats: int, limit: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ignore_index=True)
        epochs, take = fit_lengths(rows["size"].tolist(), rows["n"].tolist(), float(rows["target"].iloc[0]),
                                   max_repeats, limit)
        return rows.assign(epochs=epochs, extra=take)[["sid", "size", "n", "epochs", "extra", "source_size", "target"]]
    return run


def mix(docs: DataFrame, row_id: str, weights: Iterable[int] = (1, 2, 3), seed: int = 17,
        max_repeats: int = 3, limit: int = KNAPSACK) -> DataFrame:
    """(row_id, doc_id, size, source_size, target, copies, taken) for each row of
    ``docs`` (columns ``row_id``, doc_id, text, source)."""
    spark = docs.sparkSession
    ready(spark)
    weights = list(weights)
    narrow = written(docs.select(
        F.col(row_id).alias("rid"), "doc_id", F.col("source").isNull().alias("no_source"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("key"), word_count("text").alias("size")), "mix-sizes")
    sizes = narrow.groupBy("no_source", "key", "size").agg(F.count("*").alias("n"))
    sources = sizes.groupBy("no_source", "key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    share = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid"), F.lit(len(weights))) + 1).cast("int"))
    sources = dense_ids(sources, ["no_source", "key"], "sid", start=0).withColumn("weight", share)
    sources = written(fit_targets(written(sources, "mix-sources"), max_repeats), "mix-targets")
    fitted = written(
        sizes.join(sources, ["no_source", "key"])
        .select("sid", "size", "n", F.col("source_size").cast("bigint").alias("source_size"), "target")
        .groupBy("sid").applyInPandas(_fit_source(max_repeats, limit),
                                      "sid bigint, size bigint, n bigint, epochs bigint, extra bigint, "
                                      "source_size bigint, target double")
        .join(sources.select("sid", "no_source", "key"), "sid"), "mix-plan")
    # Salted buckets of each (source, size): whole ones are taken in order.
    salt = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "rid"), F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET)).cast("bigint"))
    dealt = narrow.join(fitted, ["no_source", "key", "size"]).drop("no_source", "key").withColumn("salt", salt)
    partial = dealt.where("extra > 0 and extra < n")
    buckets = partial.groupBy("sid", "size", "salt").agg(F.count("*").alias("here"), F.first("extra").alias("extra"))
    so_far = F.sum("here").over(Window.partitionBy("sid", "size").orderBy("salt"))
    buckets = buckets.withColumn("quota", F.greatest(F.lit(0), F.least("here", F.col("extra") - so_far + F.col("here"))))
    rank = F.row_number().over(Window.partitionBy("sid", "size", "salt").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "rid"), "rid"))
    chosen = (partial.join(buckets.select("sid", "size", "salt", "quota").where("quota > 0"), ["sid", "size", "salt"])
              .withColumn("rank", rank).where("rank <= quota").select(F.col("rid").alias("chosen")))
    once = F.when(F.col("extra") == F.col("n"), 1).when(F.col("chosen").isNotNull(), 1).otherwise(0)
    return (dealt.join(chosen, dealt.rid == chosen.chosen, "left")
            .withColumn("copies", F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("epochs") + once).cast("bigint"))
            .select(F.col("rid").alias(row_id), "doc_id", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each with its columns and, where those names are free,
    ``mix_copies`` (how often it is repeated), ``mix_size`` and ``mix_target``."""
    rid = fresh(docs, "mix_row")
    numbered = row_ids(docs, rid)
    plan = mix(numbered.select(rid, "doc_id", "text", "source"), rid, **options).where("copies > 0")
    plan = plan.select(rid, F.col("copies").alias(fresh(docs, "mix_copies")), F.col("size").alias(fresh(docs, "mix_size")),
                       F.col("target").alias(fresh(docs, "mix_target")))
    return numbered.join(plan, rid).drop(rid)
