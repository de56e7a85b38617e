"""Greedy near-duplicate merge (D5) resolved in parallel rounds.

The sequential rule -- scan ids ascending; a surviving ``i`` deletes every later
surviving ``j`` similar to it -- keeps the lexicographically first maximal
independent set of the similarity graph.  Decided locally, round by round
(Blelloch, Fineman, Shun, SPAA 2012):

* a node without an earlier live neighbour is **kept**;
* its later neighbours are **removed**, each credited to its smallest kept earlier
  neighbour (the ``i`` that deletes it).

Decided nodes leave with their edges: every round reads only the edges between nodes
still undecided, so the edges read fall from round to round and sum up to little more
than the first.  What is left is written to the shared checkpoint folder each
round, so lineage stays short and a lost executor only recomputes one round.  Nodes
without edges never enter.  It is not connected components: with a~b, b~c and a !~ c, b is
merged into a and c survives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, written


def resolve(edges: DataFrame, max_rounds: int = 10_000, read: list[int] | None = None) -> DataFrame:
    """``edges(lo, hi)`` with ``lo < hi`` -> ``(id, kept, merged_into)`` for
    every node that has an edge (``merged_into`` NULL for kept nodes).

    Raises if the graph needs more than ``max_rounds`` rounds (long chains
    need O(length) rounds); never returns a partial result.  ``read``, where given, takes
    the number of edges that each round reads.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    live = e = written(edges.select("lo", "hi").distinct(), "edges")
    removed = e.select("hi").limit(0)
    for _ in range(max_rounds):
        left = live.count()
        if not left:
            break
        if read is not None:
            read.append(left)
        roots = live.select("lo").distinct().join(live.select(F.col("hi").alias("lo")), "lo", "left_anti")
        gone = live.join(roots, "lo", "left_semi").select("hi").distinct().checkpoint()
        # a root's neighbours are all gone, so its edges go with theirs
        live = written(live.join(gone, "hi", "left_anti").join(gone.select(F.col("hi").alias("lo")), "lo", "left_anti")
                       .select("lo", "hi"), "edges")
        removed = removed.unionByName(gone)
    else:
        if not live.isEmpty():
            raise RuntimeError(f"greedy merge did not converge in {max_rounds} rounds")
    # Kept: every node that no round removed.
    removed = removed.checkpoint()
    credit = (e.join(removed.select(F.col("hi").alias("lo")), "lo", "left_anti")
              .join(removed, "hi", "left_semi").groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("merged_into")))
    nodes = e.select(F.col("lo").alias("id")).unionByName(e.select(F.col("hi").alias("id"))).distinct()
    return nodes.join(credit, "id", "left").select("id", F.col("merged_into").isNull().alias("kept"), "merged_into")


def resolve_with_copies(pairs: DataFrame, groups: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """D5 over documents with exact-copy groups collapsed.

    ``pairs(left_id, right_id)`` are similar *representatives*; ``groups(id,
    rep)`` maps every document to its representative.  Copies share their
    representative's neighbourhood, so the representative (smallest id) decides
    for the group: if it is kept, the other members merge into it; if it is
    removed, they merge where it merges.  Returns ``(id, kept, merged_into)``
    for every document in a copy group of size > 1 or with a similar pair.
    """
    res = resolve(pairs.select(F.col("left_id").alias("lo"), F.col("right_id").alias("hi")), max_rounds)
    members = groups.where(F.col("id") != F.col("rep"))
    reps_with_copies = members.select(F.col("rep").alias("id")).distinct()
    # representatives that only have copies (no similar pair) are kept
    rep_res = (reps_with_copies.join(res, "id", "full")
               .select("id", F.coalesce("kept", F.lit(True)).alias("kept"), "merged_into"))
    mem = (members.join(rep_res.select(F.col("id").alias("rep"), F.col("kept").alias("_rk"),
                                       F.col("merged_into").alias("_rm")), "rep")
           .select("id", F.lit(False).alias("kept"),
                   F.when(F.col("_rk"), F.col("rep")).otherwise(F.col("_rm")).alias("merged_into")))
    return rep_res.unionByName(mem)
