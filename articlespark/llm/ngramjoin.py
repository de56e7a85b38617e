"""N-gram Jaccard join by vertical partitioning.

A document's set holds the 64-bit hashes of its word shingles; the order of the hashes
is the global order, cut into ranges: the fragments.

1. Documents with a link share some of their smallest hashes (see ``prefix_length``).
   Every document's smallest hashes go to their fragments, which report how many of a
   document's are shared; documents with too few link with nothing.
2. Equal sets become one representative, its members follow it.
3. The representatives' whole sets go to fragments, which return each hash with its
   number of sets.  A hash of one set overlaps with nothing, so sets with too few
   shared hashes end here.  The others are ordered rarest first, and pairs that may link
   share a hash among the first ones of both (the prefix).
4. In rounds, every prefix hash's sets are paired with one of them only (a star), never
   with each other; links join components.  Sets of a component need no more pairs, so
   a hash whose sets are one component is done, and a group of thousands of near copies
   costs a few pairs each.  In the end the pairs between sets of different components
   that still share a prefix hash are all tested: no link between components is lost.
5. A pair is tested by counting its overlap in every fragment on its own and summing
   the counts.

Defined results: a text without words, or null, has an empty set and links with nothing;
a text of fewer than ``width`` words is one shingle; null doc_ids link, but never name a
component that has an id; repeated rows link with each other; other columns are ignored.
``docs`` must be a stable scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, written
from .components import components
from .words import SPACE_WORDS, Words, iter_words, mix64

WIDTH = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Documents and representatives for each fragment.
FRAGMENT_DOCS, FRAGMENT_SETS, LEAST_FRAGMENTS = 10_000, 4_000, 64
#: Prefix hashes of a fragment that one task looks up, about.
TASK_HASHES = 1 << 19
#: Representatives whose row numbers are broadcast at most; beyond that they are shuffled.
BROADCAST_SETS = 500_000
#: Pairs for each set up to which all pairs between components are tested at once.
PAIRS_PER_SET = 8
#: They are also tested where a round leaves more than this share of them.
STALLED = 0.9


def shingle_sets(words: Words, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    h, first = words.hashes(), words.first
    joined = h[:max(0, len(h) - width + 1)].copy()
    for k in range(1, width):
        joined = mix64(joined * np.uint64(0x9E3779B97F4A7C15)) + h[k:k + len(joined)]
    joined = mix64(joined)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            s = np.sort(joined[a:b - width + 1])
            keep = np.ones(len(s), dtype=bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s if keep.all() else s[keep])
        elif b > a:
            place = np.arange(1, b - a + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            out.append(mix64(mix64(h[a:b] + place).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Hashes that a set of n must share at least to link with any other."""
    return -(-n * percent // 100)


def extra_shared(n):
    """How many shared hashes the prefix of a set of n is made to guarantee."""
    return 1 + n // 10


def prefix_length(n, percent: int):
    """Two linked sets x, y share at least least_overlap of either, m hashes.  The
    l-th smallest of them has m - l after it, so it is among the first n - m + l of its
    set; so prefixes of that length share l hashes, l the smaller guarantee of the two."""
    return np.minimum(n, n - least_overlap(n, percent) + extra_shared(n))


def fragment_of(hashes: np.ndarray, fragments: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)


_PIECE = [("frag", pa.int32()), ("rids", pa.binary()), ("hashes", pa.binary()), ("docs", pa.binary()), ("lens", pa.binary())]
PIECE_SCHEMA = "frag int, rids binary, hashes binary, docs binary, lens binary"


def _pieces(rids: np.ndarray, sets: list[np.ndarray], fragments: int) -> Iterator[pa.RecordBatch]:
    """One row for each fragment: hashes, and which row number each belongs to."""
    lens = np.array([len(s) for s in sets], dtype=np.int64)
    if not lens.sum():
        return
    hashes, owner = np.concatenate(sets), np.repeat(rids, lens)
    frag = fragment_of(hashes, fragments)
    order = np.argsort(frag, kind="stable")
    hashes, owner, frag = hashes[order], owner[order], frag[order]
    cuts = np.searchsorted(frag, np.arange(fragments + 1, dtype=np.uint64))
    rows = [(f, owner[a:b].tobytes(), hashes[a:b].tobytes(), b"", b"")
            for f, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if b > a]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _PIECE)], names=[n for n, _ in _PIECE])


def _prefixes(width: int, percent: int, fragments: int):
    """Rows of fragment -1 describe the documents; others hold prefixes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_rids = batch.column(0).to_numpy()
            for w in iter_words(batch.column(1), SPACE_WORDS):
                sets, rids = shingle_sets(w, width), all_rids[w.lo:w.hi]
                n = np.array([len(s) for s in sets], dtype=np.int64)
                sign = np.array([(mix64(s).sum(dtype=np.uint64), mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                                 for s in sets], dtype=np.uint64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([-1], pa.int32()), pa.array([rids.astype("<i8").tobytes()], pa.binary()),
                     pa.array([sign.tobytes()], pa.binary()), pa.array([b""], pa.binary()), pa.array([n.tobytes()], pa.binary())],
                    names=[x for x, _ in _PIECE])
                keep = prefix_length(n, percent)
                yield from _pieces(rids, [s[:k] for s, k in zip(sets, keep.tolist())], fragments)
    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            sign = np.frombuffer(r["hashes"], "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (np.frombuffer(r["rids"], "<i8"), np.frombuffer(r["lens"], "<i8"), sign[:, 0], sign[:, 1])],
                names=["rid", "n", "s1", "s2"])


def _by_fragment(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Fragments of a partition that is sorted by fragment, with their columns joined."""
    frag, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["frag"] != frag and held:
                yield frag, [np.concatenate(c) for c in zip(*held)]
                held = []
            frag = r["frag"]
            held.append([np.frombuffer(r[x], "<u8" if x == "hashes" else "<i8") for x in names])
    if held:
        yield frag, [np.concatenate(c) for c in zip(*held)]


def _frequency(hashes: np.ndarray) -> np.ndarray:
    """How often each hash occurs, in place."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    new = np.ones(len(h), dtype=bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    group = np.cumsum(new) - 1
    out = np.empty(len(h), dtype=np.int64)
    out[order] = np.bincount(group)[group]
    return out


def _count_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's distinct hashes, and whether it has them more than once."""
    for batch in batches:
        for r in batch.to_pylist():
            hashes, n = np.unique(np.frombuffer(r["hashes"], "<u8"), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["frag"]], pa.int32()), pa.array([hashes.tobytes()], pa.binary()),
                 pa.array([(n > 1).astype("<i8").tobytes()], pa.binary())], names=["frag", "hashes", "lens"])


def _shared_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each fragment the hashes that occur more than once."""
    for frag, (hashes, more) in _by_fragment(batches, ("hashes", "lens")):
        shared = np.unique(hashes[(_frequency(hashes) > 1) | (more > 0)])
        yield pa.RecordBatch.from_arrays([pa.array([frag], pa.int32()), pa.array([shared.tobytes()], pa.binary())],
                                         names=["frag", "hashes"])


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's shared hashes; a fragment's list of them comes before its rows."""
    frag, shared = None, np.zeros(0, dtype=np.uint64)
    for batch in batches:
        for r in batch.to_pylist():
            hashes = np.frombuffer(r["hashes"], "<u8")
            if r["rids"] is None:
                frag, shared = r["frag"], hashes
                continue
            if r["frag"] != frag or not len(shared):
                continue
            found = shared[np.minimum(np.searchsorted(shared, hashes), len(shared) - 1)] == hashes
            rid, count = np.unique(np.frombuffer(r["rids"], "<i8")[found], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(count.astype(np.int64))], names=["rid", "shared"])


def dealt_prefixes(prefixes: DataFrame, fragments: int) -> DataFrame:
    """Rows (frag, rids, hashes) by tasks: those of a large fragment over several, each
    with that fragment's list of shared hashes (rids are null) before its rows.  Hashes
    are counted row by row before they meet."""
    counted = prefixes.select("frag", "hashes").mapInArrow(_count_hashes, "frag int, hashes binary, lens binary")
    lists = (counted.repartition(fragments, "frag").sortWithinPartitions("frag")
             .mapInArrow(_shared_hashes, "frag int, hashes binary"))
    tasks = written(prefixes.groupBy("frag").agg(
        F.ceil(F.sum(F.octet_length("hashes") / 8) / TASK_HASHES).cast("int").alias("tasks")), "ngram-tasks")
    total = tasks.agg(F.sum("tasks")).first()[0] or 1
    tasks = F.broadcast(tasks)  # one row a fragment
    lists = lists.join(tasks, "frag").select(
        "frag", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(None).cast("binary").alias("rids"), "hashes")
    rows = prefixes.join(tasks, "frag").select(
        "frag", F.pmod(F.xxhash64("rids", "hashes"), F.col("tasks")).cast("int").alias("task"), "rids", "hashes")
    both = lists.unionByName(rows).withColumn("late", F.col("rids").isNotNull())
    return (both.repartition(max(fragments, int(total)), "frag", "task").sortWithinPartitions("frag", "task", "late")
            .select("frag", "rids", "hashes"))


def shared_counts(prefixes: DataFrame, fragments: int) -> DataFrame:
    """(rid, shared): how many hashes of a prefix are in another one too."""
    return dealt_prefixes(prefixes, fragments).mapInArrow(_count_shared, "rid bigint, shared bigint") \
        .groupBy("rid").agg(F.sum("shared").alias("shared"))


def _whole_sets(width: int, fragments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch.column(0).to_numpy()
            for w in iter_words(batch.column(1), SPACE_WORDS):
                yield from _pieces(rids[w.lo:w.hi], shingle_sets(w, width), fragments)
    return run


def _with_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each set its hashes in this fragment that other sets share, and their numbers of sets."""
    for _, (rids, hashes) in _by_fragment(batches, ("rids", "hashes")):
        df = _frequency(hashes)
        keep = df > 1
        rids, hashes, df = rids[keep], hashes[keep], df[keep]
        order = np.argsort(rids, kind="stable")
        rids, hashes, df = rids[order], hashes[order], df[order]
        rid, start = np.unique(rids, return_index=True)
        ends = np.append(start[1:], len(rids))
        for lo in range(0, len(rid), 4096):
            span = list(zip(start[lo:lo + 4096].tolist(), ends[lo:lo + 4096].tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid[lo:lo + 4096]), pa.array([hashes[a:b].tobytes() for a, b in span], pa.binary()),
                 pa.array([df[a:b].tobytes() for a, b in span], pa.binary())], names=["rid", "hashes", "lens"])


def _order_sets(percent: int):
    """Sets with enough shared hashes: all of those, and the prefix, rarest first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(rid, n, held):
            hashes = np.concatenate([np.frombuffer(h, "<u8") for h, _ in held])
            df = np.concatenate([np.frombuffer(d, "<i8") for _, d in held])
            if len(hashes) < least_overlap(n, percent):
                return None
            order = np.lexsort((hashes, df))
            alone = n - len(hashes)  # hashes of no other set come first in the order
            size = int(max(0, n - least_overlap(n, percent) + 1 - alone))
            prefix = hashes[order[:size]].view(np.int64)
            return rid, n, np.sort(hashes).tobytes(), prefix.tolist(), list(range(alone, alone + len(prefix)))

        def batch_of(rows):
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                              names=["rid", "n", "hashes", "prefix", "places"])

        now, held, out = None, [], []
        for batch in batches:
            for rid, n, hashes, df in zip(*(c.to_pylist() for c in batch.columns)):
                if now and now[0] != rid:
                    out += filter(None, [close(*now, held)])
                    held = []
                    if len(out) >= 256:
                        yield batch_of(out)
                        out = []
                now = (rid, n)
                held.append((hashes, df))
        if now:
            out += filter(None, [close(*now, held)])
        if out:
            yield batch_of(out)
    return run


def _segments(fragments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                sets = [np.frombuffer(x.as_py(), "<u8") for x in part.column(1)]
                yield from _pieces(part.column(0).to_numpy(), sets, fragments)
    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial overlaps of the pairs of a fragment; its segments come before its pairs."""
    frag, held, index = None, [], None

    def build():
        rids, hashes = (np.concatenate(c) for c in zip(*held))
        docs, doc = np.unique(rids, return_inverse=True)
        _, word = np.unique(hashes, return_inverse=True)
        width = int(word.max()) + 1
        keys = np.sort(doc.astype(np.int64) * width + word)
        return docs, width, keys, np.searchsorted(keys, np.arange(len(docs) + 1, dtype=np.int64) * width)

    for batch in batches:
        for r in batch.to_pylist():
            if r["frag"] != frag:
                frag, held, index = r["frag"], [], None
            if r["hashes"] is not None:
                held.append((np.frombuffer(r["rids"], "<i8"), np.frombuffer(r["hashes"], "<u8")))
                continue
            if not held:
                continue
            if index is None:
                index = build()
            docs, width, keys, at = index
            pairs = np.frombuffer(r["rids"], "<i8").reshape(-1, 2)
            for lo in range(0, len(pairs), 20_000):
                p = pairs[lo:lo + 20_000]
                k = np.minimum(np.searchsorted(docs, p), len(docs) - 1)
                p, k = p[(docs[k] == p).all(axis=1)], k[(docs[k] == p).all(axis=1)]
                n = at[k[:, 0] + 1] - at[k[:, 0]]
                spot = np.repeat(at[k[:, 0]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                pair = np.repeat(np.arange(len(p)), n)
                want = keys[spot] % width + k[pair, 1] * width
                found = keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)] == want
                both = np.bincount(pair[found], minlength=len(p)).astype(np.int64)
                some = both > 0
                yield pa.RecordBatch.from_arrays([pa.array(p[some, 0]), pa.array(p[some, 1]), pa.array(both[some])],
                                                 names=["a", "b", "both"])


def _pack_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1).astype("<i8")
        yield pa.RecordBatch.from_arrays([pa.array([both.tobytes()], pa.binary())], names=["rids"])


class NgramJoin:
    """The join of one table; ``sets`` are the representatives that may link."""

    def __init__(self, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT):
        """``docs``: rid (row number), doc_id, text."""
        self.percent, spark = percent, docs.sparkSession
        ready(spark)
        texts = docs.select("rid", "text")
        fragments = max(LEAST_FRAGMENTS, -(-docs.count() // FRAGMENT_DOCS))
        pieces = written(texts.mapInArrow(_prefixes(width, percent, fragments), PIECE_SCHEMA), "ngram-prefixes")
        self.docs = written(pieces.where("frag = -1").mapInArrow(_unpack, "rid bigint, n bigint, s1 bigint, s2 bigint"), "ngram-docs")
        shared = shared_counts(pieces.where("frag >= 0").select("frag", "rids", "hashes"), fragments)
        least = 1 + F.floor(F.ceil(F.col("n") * percent / 100) / 10)
        alive = self.docs.join(shared, "rid").where(F.col("shared") >= least)
        groups = alive.groupBy("n", "s1", "s2").agg(F.min("rid").alias("rep"))
        self.members = written(alive.join(groups, ["n", "s1", "s2"]).select("rid", "rep", "n"), "ngram-members")
        reps = self.members.where("rid = rep").select("rid", "n")
        n_reps = reps.count()
        few = reps.select("rid") if n_reps > BROADCAST_SETS else F.broadcast(reps.select("rid"))
        fragments = self.fragments = max(LEAST_FRAGMENTS, -(-n_reps // FRAGMENT_SETS))
        listed = (texts.join(few, "rid").mapInArrow(_whole_sets(width, fragments), PIECE_SCHEMA)
                  .repartition(fragments, "frag").sortWithinPartitions("frag")
                  .mapInArrow(_with_frequency, "rid bigint, hashes binary, lens binary"))
        by_set = listed.join(reps, "rid").select("rid", "n", "hashes", "lens").repartition("rid").sortWithinPartitions("rid")
        self.sets = written(by_set.mapInArrow(
            _order_sets(percent), "rid bigint, n bigint, hashes binary, prefix array<bigint>, places array<int>"), "ngram-sets")
        self.segments = written(self.sets.select("rid", "hashes").mapInArrow(_segments(fragments), PIECE_SCHEMA)
                                .select("frag", "rids", "hashes"), "ngram-segments")

    def overlap(self, pairs: DataFrame) -> DataFrame:
        """(a, b, both) for the pairs (a, b) that share a hash."""
        dealt = pairs.select("a", "b").mapInArrow(_pack_pairs, "rids binary") \
            .withColumn("frag", F.explode(F.sequence(F.lit(0), F.lit(self.fragments - 1))))
        both = self.segments.unionByName(dealt.withColumn("hashes", F.lit(None).cast("binary"))) \
            .withColumn("late", F.col("hashes").isNull())
        return (both.repartition(self.fragments, "frag").sortWithinPartitions("frag", "late").drop("late")
                .mapInArrow(_overlaps, "a bigint, b bigint, both bigint").groupBy("a", "b").agg(F.sum("both").alias("both")))

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs that link; ``pairs`` has their set sizes na, nb."""
        found = self.overlap(pairs)
        return pairs.join(found, ["a", "b"]).where(
            F.col("both") * (100 + self.percent) >= (F.col("na") + F.col("nb")) * self.percent).select("a", "b")

    def roots(self) -> DataFrame:
        """(rid, root) of the sets with links."""
        p = self.percent
        posted = written(self.sets.select("rid", "n", F.explode(F.arrays_zip("prefix", "places")).alias("x"))
                         .select(F.col("x.prefix").alias("hash"), F.col("x.places").alias("place"), "rid", "n"), "ngram-postings")
        n_sets = self.sets.count()
        label, links, tested, turn, last = None, None, None, 0, None

        def may_link(na, pa_, nb, pb):
            """By length, and by what can follow the places of a shared hash."""
            low, high = F.least(na, nb), F.greatest(na, nb)
            return (low * 100 >= high * p) & (F.least(na - pa_, nb - pb) * (100 + p) >= (na + nb) * p)

        while True:
            # The first star's middle is the set with the fewest rarer hashes: the most typical one.
            order = F.col("place").cast("bigint") if turn == 0 else F.xxhash64("rid", F.lit(turn))
            here = posted.withColumn("root", F.col("rid")) if label is None else \
                posted.join(label, posted.rid == label.node, "left").withColumn("root", F.coalesce("root", "rid")).drop("node")
            mixed = here.groupBy("hash").agg(F.min("root").alias("lo"), F.max("root").alias("hi"),
                                             F.min(F.struct(order.alias("k"), "rid", "root", "n", "place")).alias("lead")) \
                .where("lo <> hi").select("hash", "lead")
            here = written(here.join(mixed, "hash"), "ngram-mixed")
            size = here.groupBy("hash", "root").agg(F.count("*").alias("c")).groupBy("hash") \
                .agg(F.sum("c").alias("all"), F.max("c").alias("most"), F.max_by("root", F.struct("c", "root")).alias("major"))
            size = written(size, "ngram-sizes")
            work = size.agg(F.sum(F.col("all") * (F.col("all") - F.col("most")))).first()[0] or 0
            if not work:
                break
            complete = turn > 0 and (work <= PAIRS_PER_SET * n_sets or turn > 1 and work > last * STALLED)
            if complete:
                sized = here.select("hash", "rid", "root", "n", "place").join(size.select("hash", "major"), "hash")
                x = sized.where("root <> major").select("hash", F.col("rid").alias("xr"), F.col("root").alias("xc"),
                                                       F.col("n").alias("xn"), F.col("place").alias("xp"))
                y = sized.select("hash", F.col("rid").alias("yr"), F.col("root").alias("yc"), F.col("n").alias("yn"),
                                 F.col("place").alias("yp"), (F.col("root") == F.col("major")).alias("in_major"))
                pairs = x.join(y, "hash").where((F.col("xc") != F.col("yc")) & (F.col("in_major") | (F.col("xr") < F.col("yr")))
                                                & may_link(F.col("xn"), F.col("xp"), F.col("yn"), F.col("yp")))
            else:
                pairs = here.where("root <> lead.root").select(
                    F.col("rid").alias("xr"), F.col("n").alias("xn"), F.col("place").alias("xp"), F.col("lead.rid").alias("yr"),
                    F.col("lead.n").alias("yn"), F.col("lead.place").alias("yp")) \
                    .where(may_link(F.col("xn"), F.col("xp"), F.col("yn"), F.col("yp")))
            first = F.col("xr") < F.col("yr")
            pairs = pairs.select(F.least("xr", "yr").alias("a"), F.greatest("xr", "yr").alias("b"),
                                 F.when(first, F.col("xn")).otherwise(F.col("yn")).alias("na"),
                                 F.when(first, F.col("yn")).otherwise(F.col("xn")).alias("nb")).distinct()
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = written(pairs, "ngram-pairs")
            now = pairs.select("a", "b")
            tested = now if tested is None else tested.union(now)
            found = written(self.links(pairs), "ngram-links")
            links = found if links is None else links.union(found)
            label = written(components(links), "ngram-roots")
            if complete:
                break
            turn, last = turn + 1, work
        self.link_pairs = links
        return label if label is not None else self.sets.select(F.col("rid").alias("node"), F.col("rid").alias("root")).limit(0)


def link_documents(docs: DataFrame, row_id: str, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(row_id, doc_id, n_shingles, component_id, copies) for each row of ``docs``
    (``row_id``, doc_id, text): component_id is the smallest doc_id reachable by links."""
    join = NgramJoin(docs.select(F.col(row_id).alias("rid"), "doc_id", "text"), width, percent)
    roots = join.roots().withColumnsRenamed({"node": "rep", "root": "top"})
    placed = join.members.join(roots, "rep", "left").select("rid", F.coalesce("top", "rep").alias("top"))
    rows = docs.select(F.col(row_id).alias("rid"), "doc_id")
    linked = written(rows.join(placed, "rid"), "ngram-linked")
    names = linked.groupBy("top").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("size"),
                                      F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "rid")).alias("first"))
    named = linked.join(names, "top").select("rid", "component_id", "size", F.col("first.rid").alias("keeper"))
    return (rows.join(join.docs.select("rid", "n"), "rid").join(named, "rid", "left")
            .select(F.col("rid").alias(row_id), "doc_id", F.col("n").alias("n_shingles"),
                    F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("size", F.lit(1)).alias("component_size"),
                    F.coalesce("keeper", "rid").alias("keeper")))
