"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations only.

A line counts as its words in lower case.  It is dropped where an earlier line of any
document (smallest doc_id, then row, then line number) has the same words, or words
within ``MAX_EDITS`` = 1 insertion, deletion or substitution.  Whether the earlier line
is itself dropped does not matter, so the outcome depends on no order of work.

1. Equal lines become one row with their earliest place (hashed, combined before the
   shuffle).
2. Two lines within one edit share their first or their last half; lines that share
   no half with another line need no variants.  This loses no pair.
3. The others emit every variant within the bound as a hashed key: each word left out,
   and the whole line at each place where a word could be missing.  Lines that meet in
   a key are within one edit of each other, so the key's earliest place is all that is
   needed: a hot key is one minimum, never pairs.
4. The earliest line found for each line is compared with it word by word.

Keys are 128 bits wide.  Beginnings and ends are hashed in chained blocks of words, so a
line's variants cost its length, not its square.

Defined results: lines of fewer than ``min_words`` words are kept, and lines of fewer
than ``near_words`` words are only compared for equality; a null text stays null; an
empty text stays empty; null doc_ids come last in order; repeated rows are compared like
any others, so the later one loses its lines; other columns pass through.
``docs`` must be a stable scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, row_ids, written

MIN_WORDS = 4
NEAR_WORDS = 10
#: Live lines that are broadcast at most (about 100 bytes each); beyond that they are shuffled.
BROADCAST_LINES = 200_000
BLANK = r"[\x20\x09-\x0D]+"
LINE_ID = ["x", "y", "n"]
#: Words of a block: a variant's key costs that much, whatever the line's length.
BLOCK_WORDS = 64


def _trimmed(line: Column) -> Column:
    return F.btrim(F.lower(line), F.lit(" \t\n\x0b\x0c\r"))


def line_words(line: Column) -> Column:
    return F.split(_trimmed(line), BLANK)


def text_lines(text: Column) -> Column:
    """A text's lines in lower case, their words parted by single blanks.  Where single blanks
    part all words already, as in most texts, no pattern is needed."""
    lines = F.split(text, "\n")
    odd = F.contains(text, F.lit("  "))
    for c in "\t\x0b\x0c\r":
        odd = odd | F.contains(text, F.lit(c))
    return F.when(odd, F.transform(lines, lambda line: F.regexp_replace(_trimmed(line), BLANK, " "))) \
        .otherwise(F.transform(lines, lambda line: F.btrim(F.lower(line), F.lit(" "))))


def text_words(text: Column) -> Column:
    """The words of each of a text's lines."""
    return F.transform(text_lines(text), lambda line: F.split(line, " "))


def _lines(docs: DataFrame, rid: str, min_words: int) -> DataFrame:
    """The lines that are judged: place (a sortable struct), the line and its number of words n."""
    # Lines are made before the explode: a filter on a column of it would be pushed below and make them again.
    lines = _places(docs, rid, text_lines(F.col("text")), "line")
    n = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    return lines.withColumn("n", n).where(F.col("n") >= min_words)


def _places(docs: DataFrame, rid: str, lines: Column, name: str) -> DataFrame:
    """Each of a row's ``lines`` with its place."""
    place = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("doc"), "rid", "line_no")
    return docs.select(F.col("doc_id"), F.col(rid).alias("rid"), F.posexplode(lines).alias("line_no", name)).select(place.alias("place"), name)


def _halves() -> list[Column]:
    """Hashes of a line's first half (x) and last half (y) of its words, and of the one of both
    that differs where the line is the longer one of a pair (z).  With n, x and y are its id."""
    n, odd = F.col("n"), F.col("n") % 2 == 1
    part = lambda words: F.xxhash64(F.expr(f"substring_index(line, ' ', cast({words} AS int))"))
    return [part("n div 2").alias("x"), part("-(n - n div 2)").alias("y"),
            F.when(odd, part("-(n div 2)")).otherwise(part("n div 2 - 1")).alias("z")]


def _half_keys() -> list[Column]:
    """Keys of the first (P) and last (S) words that an edit in the other half leaves, for a
    pair whose shorter line has n words, then n - 1."""
    n, odd = F.col("n"), F.col("n") % 2 == 1
    return [F.xxhash64(F.lit("P"), n, "x"), F.xxhash64(F.lit("S"), n, "y"),
            F.xxhash64(F.lit("P"), n - 1, F.when(odd, F.col("x")).otherwise(F.col("z"))),
            F.xxhash64(F.lit("S"), n - 1, F.when(odd, F.col("z")).otherwise(F.col("y")))]


def _chain(words: str, k: int) -> Column:
    """Hashes of the first 0, 1, 2 ... whole blocks of ``BLOCK_WORDS`` words."""
    n, start = F.size(words), F.array(F.lit(k).cast("bigint"))
    block = lambda j: F.slice(words, (j * BLOCK_WORDS + 1).cast("int"), F.lit(BLOCK_WORDS))
    return F.when(n < BLOCK_WORDS, start).otherwise(F.aggregate(
        F.sequence(F.lit(0), F.floor(n / BLOCK_WORDS).cast("int") - 1), start,
        lambda t, j: F.concat(t, F.array(F.xxhash64(F.element_at(t, -1), block(j))))))


def _first(words: str, chain: str, m: Column) -> Column:
    """Hash of the first ``m`` words: of whole blocks, and of the rest one by one."""
    j = F.floor(m / BLOCK_WORDS).cast("int")
    return F.xxhash64(F.get(chain, j), F.slice(words, j * BLOCK_WORDS + 1, m - j * BLOCK_WORDS))


def _variants(lines: DataFrame) -> DataFrame:
    """(no, k1, k2) for each variant of the ``lines`` (no, words, p0, s0, p1, s1): a word left
    out at a place, or the whole line with a word missing before a place or at its end."""
    n = F.size("words")

    def places(last, size, first_half, last_half):
        return F.filter(F.sequence(F.lit(0), last), lambda i: F.when(i >= F.floor(size / 2), F.col(first_half)).otherwise(F.col(last_half)))

    lines = lines.select(
        "no", "words", F.reverse("words").alias("back"), n.alias("n"),
        *(_chain("words", k).alias(f"chain{k}") for k in (1, 2)),
        places(n - 1, n, "p0", "s0").alias("whole_0"), places(n - 1, n - 1, "p1", "s1").alias("less"), places(n, n, "p0", "s0").alias("whole"))
    lines = lines.select("*", *(_chain("back", k).alias(f"back{k}") for k in (1, 2)),
                         F.array_union("whole_0", "less").alias("without"))
    at, size = F.col("at"), F.col("size")
    spots = lines.select("*", F.explode("without").alias("at")).withColumn("size", F.col("n") - 1) \
        .unionByName(lines.select("*", F.explode("whole").alias("at")).withColumn("size", F.col("n")))
    x, y = ([_first(words, f"{chain}{k}", m) for k in (1, 2)] for words, chain, m in (("words", "chain", at), ("back", "back", size - at)))
    return spots.select("no", F.xxhash64(size, at, x[0], y[0]).alias("k1"), F.xxhash64(y[1], x[1], at, size).alias("k2"))


def _near_drops(docs: DataFrame, rid: str, distinct: DataFrame, near_words: int) -> DataFrame:
    """Ids of distinct lines with an earlier line within one edit."""
    names = ("p0", "s0", "p1", "s1")
    keys = distinct.where(F.col("n") >= near_words).select("place", F.posexplode(F.array(*_half_keys())).alias("which", "key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("lines")).where("lines > 1").select("key")
    live = keys.join(shared, "key", "left_semi").groupBy("place").agg(
        *(F.max(F.col("which") == k).alias(name) for k, name in enumerate(names)))
    # Numbers in the order of the places: they are shorter.
    live = written(live.orderBy("place").withColumn("no", F.monotonically_increasing_id()), "lines-live")
    few = live.count() <= BROADCAST_LINES
    at = _places(docs, rid, F.split("text", "\n"), "line").withColumnRenamed("place", "at")
    lines = at.join(F.broadcast(live) if few else live, F.col("at") == F.col("place")).drop("at")
    lines = written(lines.withColumn("words", line_words(F.col("line"))).drop("line"), "lines-text")
    variants = written(_variants(lines), "lines-variants")
    first = variants.groupBy("k1", "k2").agg(F.min("no").alias("earlier"), F.count("*").alias("met")) \
        .where("met > 1").drop("met")
    found = variants.join(first, ["k1", "k2"]).where("earlier < no").groupBy("no").agg(F.min("earlier").alias("earlier"))
    mine = found.join(lines.select("no", "place", F.col("words").alias("x")), "no")
    pair = mine.join(lines.select(F.col("no").alias("earlier"), F.col("words").alias("y")), "earlier")
    near = pair.where(within_one_edit(F.col("x"), F.col("y")))
    line = F.array_join("x", " ").alias("line")
    return near.select(line, F.size("x").alias("n"), "place").select(*_halves(), "n", "place").drop("z")


def within_one_edit(x: Column, y: Column) -> Column:
    """Whether two arrays of words are at most one word edit apart."""
    n, m = F.size(x), F.size(y)
    differs = F.zip_with(x, y, lambda a, b: ~a.eqNullSafe(b))
    same = (F.array_position(differs, True) - 1).cast("int")  # length of the common start, -1 if all is equal
    rest = lambda a, k: F.slice(a, same + k, F.lit(2 ** 30))
    return (same < 0) | F.when(n == m, rest(x, 2) == rest(y, 2)).when(n == m + 1, rest(x, 2) == rest(y, 1)) \
        .when(m == n + 1, rest(x, 1) == rest(y, 2)).otherwise(F.lit(False))


def find_repeated_lines(docs: DataFrame, rid: str, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """(rid, dropped): for each row of ``docs`` (doc_id, text, ``rid``) that loses lines,
    their sorted line numbers."""
    lines = written(_lines(docs, rid, min_words).select(*_halves(), "n", "place"), "lines-ids")
    distinct = written(
        lines.groupBy(*LINE_ID).agg(F.min("place").alias("place"), F.count("*").alias("copies"), F.any_value("z").alias("z")),
        "lines-distinct")
    near = _near_drops(docs, rid, distinct, near_words)
    # A line may be both: its numbers are collected as a set.
    judged = written(distinct.where("copies > 1").select(*LINE_ID, F.col("place").alias("first"), F.lit(False).alias("near"))
                     .unionByName(near.select(*LINE_ID, F.col("place").alias("first"), F.lit(True).alias("near"))), "lines-judged")
    drops = lines.select(*LINE_ID, "place").join(judged, LINE_ID).where("near or place <> first")
    return drops.groupBy(F.col("place.rid").alias(rid)).agg(F.sort_array(F.collect_set("place.line_no")).alias("dropped"))


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS,
                        dropped: str = "dropped_lines") -> DataFrame:
    """``docs`` with repeated lines cut from ``text``, and the numbers of the lines cut
    (an empty array if none) in a column named ``dropped``, or like it if that is taken."""
    rid, name = fresh(docs, "line_row"), fresh(docs, dropped)
    docs = row_ids(docs, rid)
    found = find_repeated_lines(docs.select("doc_id", "text", rid), rid, min_words, near_words).withColumnRenamed("dropped", name)
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(name, i)), "\n")
    return docs.join(found, rid, "left").drop(rid) \
        .withColumn("text", F.when(F.col(name).isNull(), F.col("text")).otherwise(kept)) \
        .withColumn(name, F.coalesce(name, F.array().cast("array<int>")))
