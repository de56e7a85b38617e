"""Variants of a line are hashed in blocks of words, in the line's own row."""

import random

from pyspark.sql import functions as F

from articlespark.llm import linededup as m


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1]


def test_long_lines_one_word_apart(spark, tmp_path):
    rng, size = random.Random(5), m.BLOCK_WORDS
    lines = []
    for n in (10, 11, size - 1, size, size + 1, 2 * size - 1, 2 * size, 2 * size + 1, 3 * size + 2):
        line = [f"w{rng.randrange(9)}" for _ in range(n)]
        lines += [line, [*line[:n // 2], *line[n // 2 + 1:]], [*line, "x"], ["x", *line], [*line[:-1], "y"], ["z", *line[1:-1], "z"],
                  [*line[:size - 1], "v", *line[size:]], [*line[1:], "u", "u"]]
    rng.shuffle(lines)
    parted = [rng.choice((" ", "  ", "\t")).join(x) for x in lines]
    spark.createDataFrame([(i, t) for i, t in enumerate(parted)], "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/docs")
    got = {r.doc_id: r.dropped_lines for r in m.drop_repeated_lines(spark.read.parquet(f"{tmp_path}/docs")).collect()}
    for i, x in enumerate(lines):
        gone = any(abs(len(x) - len(y)) <= 1 and edits(x, y) <= 1 for y in lines[:i])
        assert got[i] == ([0] if gone else []), (i, len(x))


def test_variants_need_no_shuffle(spark, capsys):
    words = F.array(*(F.lit(w) for w in "a b c d e f g h i j".split()))
    flags = [F.lit(True).alias(c) for c in ("p0", "s0", "p1", "s1")]
    found = m._variants(spark.range(1).select(F.col("id").alias("no"), words.alias("words"), *flags))
    found.explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Window" not in plan
    assert found.count() == found.distinct().count() == 21


def test_half_keys_are_those_of_the_words_that_an_edit_leaves(spark):
    pairs = [([f"w{i}" for i in range(n)], k) for n in range(4, 14) for k in range(n)]
    rows = [(i, " ".join(a), len(a)) for i, (x, k) in enumerate(pairs) for a in (x, x[:k] + x[k + 1:])]
    df = spark.createDataFrame(rows, "id int, line string, n int").select("id", *m._halves(), "n")
    keys = {(r.id, r.n): r.k for r in df.select("id", F.array(*m._half_keys()).alias("k"), "n").collect()}
    for i, (x, _) in enumerate(pairs):
        longer, shorter = keys[i, len(x)], keys[i, len(x) - 1]
        assert longer[2] == shorter[0] or longer[3] == shorter[1]
