"""Lines are cut into words once, and the same way however their words are parted."""

from pyspark.sql import functions as F

from articlespark.llm.linededup import _lines, line_words, text_words

TEXTS = ["One two\nthree  four\n\n \n a\tb ", "One two\n\n a b \nX", "a\r\nb c\r", "é\u00a0x y\u2003z", "", " ", "\n", "\x0b a\x0cb", None]


def test_words_do_not_depend_on_the_way_they_are_cut(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    for r in df.select(text_words(F.col("text")).alias("x"), F.transform(F.split("text", "\n"), line_words).alias("y")).collect():
        assert r.x == r.y
    assert df.select(text_words(F.col("text"))).first()[0] == [["one", "two"], ["three", "four"], [""], [""], ["a", "b"]]


def test_lines_are_cut_once(spark, capsys):
    df = spark.createDataFrame([(1, "a b c d", 1)], "doc_id bigint, text string, rid bigint")
    _lines(df, "rid", 4).explain()
    plan = capsys.readouterr().out
    assert plan.count("[\\x20\\x09-\\x0D]+") == 1 and "Filter" in plan
