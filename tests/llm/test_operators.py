"""Operators against brute force, and their defined results in odd cases."""

import hashlib
import itertools
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

WORDS = "the of and red blue green house river stone walks sees under over small large bird tree cloud".split()


def words_of(rng, n):
    return [rng.choice(WORDS) + rng.choice(["", "", "s", "ed"]) for _ in range(n)]


def save(spark, tmp_path, rows, schema):
    path = str(tmp_path / f"t{random.random()}")
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, rid string, words string, n string"


def doc(i, text, lang="en", source="a"):
    return (i, text, lang, source, None if text is None else len(text), "x", "y", "z")


ODD = [doc(None, "some words without a number"), doc(901, None), doc(902, ""), doc(903, " \n\t "), doc(904, "...!?"),
       doc(905, "x" * 70_000), doc(906, "word " * 30_000, None, None), doc(907, "twice the same row"), doc(907, "twice the same row")]


@pytest.mark.parametrize("pass_bytes", [1 << 20, 300])
def test_contamination_is_found_word_by_word(spark, tmp_path, pass_bytes):
    from articlespark.llm.decontaminate import find_contamination

    rng = random.Random(5)
    items = [(k, " ".join(words_of(rng, rng.choice([3, 10, 14, 25])))) for k in range(12)] + [(12, None), (13, "!"), (None, "the of")]
    rows = []
    for i in range(60):
        w = words_of(rng, rng.randint(0, 60))
        if i % 3 == 0:
            w[len(w) // 2:len(w) // 2] = items[rng.randrange(12)][1].upper().split()
        rows.append(doc(i, " ".join(w)))
    phrases = {}
    for k, t in items:
        w = re.findall("[a-z0-9]+", t.lower()) if t and k is not None else []
        for a in range(max(1, len(w) - 9) if w else 0):
            phrases.setdefault(tuple(w[a:a + 10]), set()).add(str(k))
    found = find_contamination(save(spark, tmp_path, rows + ODD, DOCS), spark.createDataFrame(items, "item_id int, text string"),
                               pass_bytes=pass_bytes)
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in found.collect()), key=str)
    want = []
    for r in rows + ODD:
        w, hit, names = re.findall("[a-z0-9]+", (r[1] or "").lower()), set(), set()
        for p, own in phrases.items():
            for a in range(len(w) - len(p) + 1):
                if tuple(w[a:a + len(p)]) == p:
                    hit |= set(range(a, a + len(p)))
                    names |= own
        want.append((r[0] is None, r[0], len(w), len(hit), tuple(sorted(names))))
    assert got == sorted(want, key=str)


def test_spans_cut_the_passage(spark, tmp_path):
    from articlespark.llm.decontaminate import find_contamination

    passage = "one two three four five six seven eight nine ten eleven"
    docs = save(spark, tmp_path, [doc(1, f"Été, avant. {passage.upper()}; après")], DOCS)
    r = find_contamination(docs, spark.createDataFrame([(1, passage)], "item_id int, text string")).first()
    (span,) = r["spans"]
    assert "Été, avant. ONE".encode()[span["byte_start"]:] == b"ONE" and r["n_hit"] == 11


def test_language_shares(spark, tmp_path):
    from articlespark.llm.langid import identify, learn

    a, b = "abacadaba", "xyzwyxzzy"
    rng = random.Random(1)
    make = lambda s, n: " ".join("".join(rng.choice(s) for _ in range(5)) for _ in range(n))
    rows = [doc(i, make(a, 30), "aa") for i in range(40)] + [doc(100 + i, make(b, 30), "bb") for i in range(40)]
    model = learn(spark.createDataFrame(rows, DOCS))
    assert model.labels == ["aa", "bb"]
    tests = [doc(1, make(a, 20)), doc(2, make(b, 20)), doc(3, make(a, 60) + " " + make(b, 20)), *ODD]
    got = {r["row"]["doc_id"]: r for r in identify(save(spark, tmp_path, tests, DOCS), model, ["doc_id"]).collect()}
    assert (got[1]["lang_pred"], got[2]["lang_pred"], got[3]["lang_pred"]) == ("aa", "bb", "aa")
    assert got[1]["score"] == 1 and abs(got[3]["score"] - 0.75) < 0.05 and len(got[3]["mixture"]) == 2
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (901, 902, 903, 904)] == [("und", 0.0)] * 4
    nothing = learn(spark.createDataFrame([], DOCS))
    assert {r["lang_pred"] for r in identify(spark.createDataFrame(tests, DOCS), nothing, ["doc_id"]).collect()} == {"und"}


def test_top_k_is_exact(spark, tmp_path):
    from articlespark.llm.topk import top_k

    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.random()]) for _ in range(6)], 1) for i in range(120)]
    rows += [(50, rows[7][1], 1), (130, None, 1), (131, [1.0, None], 1), (132, [math.inf] * 6, 1), (None, rows[3][1], 1),
             (150, [0.0] * 6, 1), (250, [0.5, 0.5], 1), (300, [], 1)]
    got = top_k(save(spark, tmp_path, rows, "vec_id bigint, embedding array<double>, query int"), F.col("vec_id") % 50 == 0)
    got = sorted(map(tuple, got.collect()))
    use = [(k, i, [math.floor(256 * x) for x in v]) for k, (i, v, _) in enumerate(rows)
           if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for k, i, q in use:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, j, v in use if m != k and len(v) == len(q))[:5]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    assert got == sorted(want)
    huge = spark.createDataFrame([(50, [1e300, 1.0]), (51, [-1e300, 1.0]), (52, [0.0, 2.0])], "vec_id bigint, embedding array<double>")
    assert top_k(huge, F.col("vec_id") == 50).count() == 2


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        row, old = [i], row
        for j, b in enumerate(y, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (a != b)))
    return row[-1]


def test_line_dedup_matches_pairwise_edit_distance(spark, tmp_path):
    from articlespark.llm.linededup import drop_repeated_lines

    rng = random.Random(3)
    base = [words_of(rng, rng.randint(2, 16)) for _ in range(14)]
    rows = []
    for i in range(70):
        lines = []
        for _ in range(rng.randint(1, 4)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                w[k:k + rng.choice([0, 1])] = rng.choice([[], ["new"], [rng.choice(WORDS)]])
                w = w or ["one"]
            lines.append(" ".join(w).capitalize())
        rows.append(doc(i, "\n".join(lines)))
    out = drop_repeated_lines(save(spark, tmp_path, rows + ODD, DOCS))
    assert out.columns[:8] == [c.split()[0] for c in DOCS.split(", ")]
    got = {r["doc_id"]: (r["text"], r["dropped_lines"]) for r in out.collect()}
    seen, want = [], {}
    for i, text, *_ in rows:
        kept = []
        for line in text.split("\n"):
            w = line.lower().split()
            near = [s for s in seen if s == w and len(w) >= 4 or len(w) >= 10 and len(s) >= 10 and edits(s, w) <= 1]
            if not near:
                kept.append(line)
            seen.append(w)
        want[i] = "\n".join(kept)
    assert {i: t for i, (t, _) in got.items() if i is not None and i < 900} == want
    assert got[901][0] is None and got[902][0] == "" and got[903][0] == " \n\t " and got[None][0] == ODD[0][1]


def test_token_counts_equal_the_library(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from articlespark.llm.tokencount import PairMerger, count_tokens

    path = public.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(4)
    parts = ["a", " ", "  ", "\n", "'s", "99", "é", "<|endoftext|>", "<|end", "ing", "漢字", "😀", " ", "\x1c", "The", "'"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 15))) for _ in range(2000)]
    with open(path, encoding="utf-8") as f:
        merger = PairMerger(json.load(f), cache=50)
    assert [merger.count(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    got = {r["doc_id"]: r for r in count_tokens(save(spark, tmp_path, ODD, DOCS), path).collect()}
    for i, t, *_ in ODD:
        assert (got[i]["n_bytes"], got[i]["n_tokens"]) == (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids))


def test_mix_meets_targets_and_reruns_agree(spark, tmp_path):
    from articlespark.llm.common import row_ids
    from articlespark.llm.mixing import knapsack, mix, mix_documents

    rng = random.Random(6)
    rows = [doc(i, " ".join(words_of(rng, rng.randint(1, 30))), source=rng.choice(["b", "c", "d", "d", "d"])) for i in range(900)]
    rows += [doc(2000 + i, "same size here", source="d") for i in range(700)] + [doc(1, "tiny", source="A")] + ODD
    docs = row_ids(save(spark, tmp_path, rows, DOCS), "number")
    got = sorted((tuple(r) for r in mix(docs, "number").drop("number").collect()), key=str)
    assert got == sorted((tuple(r) for r in mix(docs, "number").drop("number").collect()), key=str)
    assert len(got) == len(rows) and all(t <= 3 * s for _, s, _, _, _, t in got)
    taken = {}
    for _, _, total, target, _, t in got:
        taken[total, target] = taken.get((total, target), 0) + t
    assert sum(total for total, _ in taken) == sum(len((r[1] or "").split()) for r in rows)
    # The source of the one document of 30,000 words can only give it whole.
    assert all(abs(t - target) <= (15_000 if total == 30_000 else 1) for (total, target), t in taken.items())
    assert math.isclose(sum(target for _, target in taken), sum(total for total, _ in taken))
    out = mix_documents(docs.withColumn("mix_size", F.lit("taken")))
    assert out.columns[-3:] == ["mix_copies", "mix_size_", "mix_target"]
    assert mix(row_ids(spark.createDataFrame([], DOCS), "number"), "number").count() == 0
    for _ in range(200):
        sizes = sorted({rng.randint(1, 12) for _ in range(3)})
        counts, budget = [rng.randint(0, 3) for _ in sizes], rng.randint(0, 40)
        sums = {sum(a * b for a, b in zip(sizes, n)) for n in itertools.product(*(range(c + 1) for c in counts))}
        take = knapsack(sizes, counts, budget)
        assert all(take.get(s, 0) <= c for s, c in zip(sizes, counts))
        assert abs(sum(s * n for s, n in take.items()) - budget) == min(abs(s - budget) for s in sums if s <= budget or counts)


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header class=top><h1>Site</h1></header>
<nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div><div class=ad>Buy</div>
<article><h1>A &amp; B</h1><p><b>First   paragraph of the article, long enough.<br><p>Second&nbsp;one, it is also
long enough to count.</p><form><input><button>Go</button></form><p>End.</p><script>var t="</p>";</script>
<section class="comments"><p>A long comment by a reader that says very much about it all.</p></section></article>
<aside><p>Related things to read on and on and on</p></aside><footer>foot</footer>"""


def test_main_text(spark, tmp_path):
    from articlespark.llm.htmltext import content_blocks, extract_main_text

    want = ["A & B", "First paragraph of the article, long enough.", "Second one, it is also long enough to count.", "End."]
    assert content_blocks(PAGE) == want
    plain = "<div class=menu><a href=x>a</a> <a href=y>b</a></div><div><h2>Head</h2><p>%s<p>%s</div><div class=footer>f</div>"
    assert content_blocks(plain % ("long text " * 20, "more text " * 20))[1:] == [("long text " * 20).strip(), ("more text " * 20).strip()]
    assert content_blocks("<p>cut <b>off") == ["cut off"] and content_blocks("<![foo[ x ]]><p>text") != []
    assert len(content_blocks("<div>" * 50_000 + "deep")) == 1
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (4, "w", "<nav>only</nav>"), (1, "u", PAGE)]
    got = extract_main_text(save(spark, tmp_path, rows, "page_id bigint, url string, html string")).collect()
    assert sorted((str(r[0]), r["text"]) for r in got) == sorted(
        [("1", "\n\n".join(want))] * 2 + [("2", ""), ("None", ""), ("4", "")])


def test_ngram_join_matches_brute_force(spark, tmp_path):
    from articlespark.llm.common import row_ids
    from articlespark.llm.ngramjoin import link_documents

    rng = random.Random(8)
    rows, texts = [], [words_of(rng, rng.randint(1, 60)) for _ in range(25)]
    for i in range(160):
        w = list(rng.choice(texts))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append(doc(i, " ".join(w)))
    hub = words_of(rng, 80)
    for i in range(200, 300):  # one large group of near copies
        w = list(hub)
        w[rng.randrange(80)] = f"new{i}"
        rows.append(doc(i, " ".join(w)))
    sets = {}
    for i, t, *_ in rows + [r for r in ODD if r[0] is not None and r[0] != 907]:
        w = (t or "").split()
        sets[i] = {tuple(w[a:a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    top = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and top[a] != top[b]:
            low, high = sorted((top[a], top[b]))
            top = {i: low if c == high else c for i, c in top.items()}
    got = link_documents(row_ids(save(spark, tmp_path, rows + ODD, DOCS), "number"), "number").collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] in sets} == \
        {i: (len(s), top[i]) for i, s in sets.items()}
    assert sorted(r["component_size"] for r in got if r["doc_id"] == 907) == [2, 2]
    assert link_documents(row_ids(spark.createDataFrame([], DOCS), "number"), "number").count() == 0


def test_scores(spark, tmp_path):
    from zlib import crc32

    from articlespark.llm.common import row_ids
    from articlespark.llm.ctxmix import score_documents

    rng = random.Random(9)
    rows = [doc(i, " ".join(words_of(rng, rng.randint(0, 40))).title()) for i in range(150)] + ODD
    counts, total = {}, 0
    for i, t, *_ in rows:
        if i is not None and crc32(str(i).encode()) % 10:
            for w in [*(t or "").lower().split(), None]:
                counts[w] = counts.get(w, 0) + 1
                total += 1
    docs = row_ids(save(spark, tmp_path, rows, DOCS), "number")
    few, many = (sorted((tuple(r) for r in score_documents(docs, "number", held_words=n).collect()), key=str) for n in (20, 10_000))
    for x, y in zip(few, many):
        assert x[:6] == y[:6] and all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(x[6:], y[6:]))
    texts = {i: t for i, t, *_ in rows}
    for _, i, held, n, known, train, base, score, _ in many:
        w = [*(texts[i] or "").lower().split(), None]
        assert (held, n, known, train) == (i is not None and crc32(str(i).encode()) % 10 == 0, len(w), sum(x in counts for x in w), total)
        assert math.isclose(base, sum(math.log10((counts.get(x, 0) + 0.1) / (total + 0.1 * (len(counts) + 1))) for x in w), rel_tol=1e-9)
        assert math.isfinite(score) and score < 0


def test_archives_round_trip(spark, tmp_path):
    from articlespark.llm.warc import LoserTree, archive_and_index, bare_digest, members, parse, record, url_key

    rows = [(5, "http://b.example/x", "same"), (3, "https://www.a.example:443/y?q=1#f", "same"), (9, None, "same"), (1, "u\r\n", None),
            (2, "http://b.example/x", ""), (4, "http://b.example/", "é" * 20_000), (None, "http://c.example", "same"), (4, "z", "other\r\n\r\n")]
    got = archive_and_index(save(spark, tmp_path, rows, "page_id bigint, url string, html string")).collect()
    assert [(r["url_key"], r["ts"]) for r in got] == sorted((r["url_key"], r["ts"]) for r in got)
    want = sorted(((str(i), len((h or "").encode()), bare_digest((h or "").encode()),
                    3 if h == "same" and i in (5, 9) else 1 if i == 2 else None) for i, _, h in rows), key=str)
    assert sorted(((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in got), key=str) == want
    assert url_key("https://WWW.a.example:443/Y?q#f") == "example,a)/y?q"
    head, payload = parse(record(7, None, b"\r\n\r\nbody", None))
    assert payload == b"\r\n\r\nbody" and head["WARC-Payload-Digest"] == f"sha1:{bare_digest(payload)}"
    with pytest.raises(ValueError):
        list(members(b"\x1f\x8b\x08"))
    rng = random.Random(7)
    runs = [sorted((rng.randrange(50),) for _ in range(rng.randrange(9))) for _ in range(7)]
    assert list(LoserTree(runs, key=lambda r: r)) == sorted(x for r in runs for x in r)
    assert list(LoserTree([], key=lambda r: r)) == [] and hashlib.sha1(b"").digest()


def test_pipeline_keeps_columns_and_clean_documents(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(11)
    passage = " ".join(words_of(rng, 30))
    rows = [doc(i, " ".join(words_of(rng, 40)), rng.choice(["en", None]), rng.choice("ab")) for i in range(60)]
    rows += [doc(70, rows[3][1]), doc(71, "start " + passage + " end"), *ODD]
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = save(spark, tmp_path, rows, DOCS)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    kept = {r["doc_id"] for r in docs.collect()}
    assert set(range(60)) <= kept and not kept & {70, 71, 901, 902, 903, 904}
    assert p.STAGES[-1][1](spark, docs, str(tmp_path)).where("mix_copies < 1").count() == 0


def test_components_match_union_find(spark, tmp_path):
    import random

    from articlespark.llm.components import components

    rnd = random.Random(5)
    pairs = [(k, k + 1) for k in range(100, 130)] + [(200, k) for k in range(201, 240)] + [(7, 7), (9, 8), (9, 8)]
    pairs += [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(60)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    alone = {x for x in root if all(a == b for a, b in pairs if x in (a, b))}  # loops are no edges
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if x not in alone}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
