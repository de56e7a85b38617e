"""Documents in more than four languages keep all of them."""

import random

from pyspark.sql import Row


def test_mixture_of_six_languages(spark):
    from articlespark.llm.langid import identify, learn

    rng = random.Random(2)
    letters = {f"l{k}": "abcdefghijklmnopqrstuvwx"[4 * k:4 * k + 4] for k in range(6)}
    make = lambda s, n: " ".join("".join(rng.choice(s) for _ in range(5)) for _ in range(n))
    rows = [Row(doc_id=100 * k + i, text=make(s, 30), lang=x) for k, (x, s) in enumerate(letters.items()) for i in range(20)]
    model = learn(spark.createDataFrame(rows))
    words = {x: 20 + 10 * k for k, x in enumerate(letters)}  # 270 words, the last language has 70
    docs = [Row(doc_id=1, text=" ".join(make(letters[x], n) for x, n in words.items())), Row(doc_id=2, text=make(letters["l1"], 50))]
    got = {r["row"]["doc_id"]: r for r in identify(spark.createDataFrame(docs), model, ["doc_id"]).collect()}
    shares = {m["lang"]: m["share"] for m in got[1]["mixture"]}
    assert got[1]["lang_pred"] == "l5" and abs(got[1]["score"] - 70 / 270) < 0.01
    assert set(shares) == set(words) and all(abs(shares[x] - n / 270) < 0.01 for x, n in words.items())
    assert [m["lang"] for m in got[2]["mixture"]] == ["l1"] and got[2]["score"] == 1
