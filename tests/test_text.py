import hashlib

from pyspark.sql import functions as F

from articlespark.functions import text as tx


def one(spark, expr, value, typ="string"):
    df = spark.createDataFrame([(value,)], f"x {typ}")
    return df.select(expr(F.col("x")).alias("y")).first()["y"]


def test_clean_text_cases(spark):
    assert one(spark, tx.clean_text, "  Low \n tide \t leaves   pools.  ") == "Low tide leaves pools."
    assert one(spark, tx.clean_text, "") == ""
    assert one(spark, tx.clean_text, None) == ""
    assert one(spark, tx.clean_text, "a b") == "a b"
    assert one(spark, tx.clean_text, "a\u001cb") == "a b"


def test_normalize_text(spark):
    assert one(spark, tx.normalize_text, " <div>Salt Marsh?</div>  ") == "salt marsh?"
    assert one(spark, tx.normalize_text, "a<br>b") == "ab"
    assert one(spark, tx.normalize_text, None) == ""


def test_fingerprint(spark):
    h = one(spark, tx.fingerprint, "reed bed")
    assert h == one(spark, tx.fingerprint, "reed bed")
    assert len(h) == 64 and h == hashlib.sha256(b"reed bed").hexdigest()
    assert one(spark, tx.fingerprint, "") == ""


def test_snippet_and_url(spark):
    assert one(spark, tx.snippet, "x" * 121) == "x" * 120 + "…"
    assert one(spark, tx.snippet, "short") == "short"
    assert one(spark, lambda c: tx.absolutize_url(c, "https://www.bbc.com"), "/x") == "https://www.bbc.com/x"
    assert one(spark, lambda c: tx.absolutize_url(c, "https://www.bbc.com"), "http://a/b") == "http://a/b"


def test_append_source_substring_rule(spark):
    df = spark.createDataFrame([("BBC Asia", "BBC"), ("", "BBC"), ("BBC", "CNN"), ("BBC", "")], "a string, n string")
    out = [r[0] for r in df.select(tx.append_source(F.col("a"), F.col("n"))).collect()]
    assert out == ["BBC Asia", "BBC", "BBC,CNN", "BBC"]


def test_fold_sources(spark):
    df = spark.createDataFrame([("", ["BBC", "BBC", "CNN"])], "a string, l array<string>")
    assert df.select(tx.fold_sources(F.col("a"), F.col("l"))).first()[0] == "BBC,CNN"


def test_title_words(spark):
    df = spark.createDataFrame([("The (Apple) and an iPhone, of is ok!",)], "t string")
    words = df.select(tx.title_words("t")).first()[0]
    # raw length > 2 and not a stop word, then punctuation stripped from the ends
    assert words == ["Apple", "iPhone", "ok"]  # "ok!" has raw length 3


def test_tokens_and_stopwords(spark):
    df = spark.createDataFrame([("The Apple, the iPhone; a x1 é_é",)], "t string")
    assert df.select(tx.tokens("t", {"the"})).first()[0] == ["apple", "iphone", "x1", "é_é"]
