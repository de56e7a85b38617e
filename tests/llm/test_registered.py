"""The registered queries opN_<name> on small tables, by their names, against brute force."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry_mod

WORDS = "the of and red blue green house river stone walks sees under over small large bird tree cloud".split()
GERMAN = "der die das und rot blau haus fluss stein geht sieht unter ueber klein gross vogel baum wolke nicht".split()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    items = [(k, " ".join(rng.choice(WORDS) for _ in range(rng.choice([4, 12, 18])))) for k in range(9)] + [(9, None)]
    docs = []
    for i in range(160):
        lang = "de" if i % 3 == 0 else "en"
        words = [rng.choice(GERMAN if lang == "de" else WORDS) for _ in range(rng.randint(5, 60))]
        if i % 7 == 0:
            words[2:2] = items[i % 9][1].upper().split()
        docs.append((i, " ".join(words), lang if i % 11 else None, rng.choice(["a", "b", "c", None]), 0))
    docs += [(500, None, "en", "a", 0), (501, "", "de", "b", 0), (502, "... 12", "en", None, 0), (503, docs[3][1], None, "z", 0)]
    pages = [(i, f"https://x.example/{i % 4}", f"<p>page {i % 6}</p>" if i % 6 else None) for i in range(20)]
    vectors = np.random.default_rng(3).standard_normal((130, 64)) / 8
    vectors[60:70] = vectors[5] + 0.01 * vectors[60:70]
    emb = [(i, v.astype(np.float32).tolist(), i % 3) for i, v in enumerate(vectors)] + [(200, None, 1), (201, [0.5] * 64, None)]
    base = tmp_path_factory.mktemp("sf")
    for name, rows, schema in (("documents", docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
                               ("benchmark", items, "item_id int, text string"), ("pages", pages, "page_id bigint, url string, html string"),
                               ("embeddings", emb, "vec_id bigint, embedding array<float>, label int")):
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(str(base / f"{name}.parquet"))
    return dict(path=str(base), docs=docs, items=items, pages=pages, emb=emb)


def run(spark, tables, name):
    return entry_mod.queries()[name](spark, tables["path"])


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_op1(spark, tables):
    def words(t):
        return re.findall("[a-z0-9]+", (t or "").lower())

    windows = {}
    for k, t in tables["items"]:
        w = words(t)
        for a in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[a:a + 10]), set()).add(str(k))
    want = []
    for d in tables["docs"]:
        w, hit, found = words(d[1]), set(), set()
        for p, ids in windows.items():
            for a in range(len(w) - len(p) + 1):
                if tuple(w[a:a + len(p)]) == p:
                    hit.update(range(a, a + len(p)))
                    found |= ids
        want.append((d[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    out = run(spark, tables, "op1_decontaminate").select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_op2(spark, tables):
    out = {r.doc_id: r for r in run(spark, tables, "op2_language_id").collect()}
    assert len(out) == len(tables["docs"])
    for d in tables["docs"]:
        r = out[d[0]]
        assert r.held_out == (crc(d[0], 4) == 2) and 0 <= r.score <= 1
        if not d[1] or not re.search("[a-z]", d[1]):
            assert r.lang_pred == "und"
        elif d[0] < 160:
            assert r.lang_pred == ("de" if d[0] % 3 == 0 else "en") or len(d[1].split()) < 30


def test_op3(spark, tables):
    v = {i: np.floor(256 * np.array(e, dtype=np.float64)).astype(np.int64) for i, e, _ in tables["emb"] if e}
    want = []
    for q in v:
        if q % 50 == 0:
            best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:5]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    out = run(spark, tables, "op3_topk")
    assert dict(out.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, out.select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)


def test_op5(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    out = sorted(map(tuple, run(spark, tables, "op5_token_count").select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()))
    want = []
    for d in tables["docs"]:
        n = len(lib.encode(d[1] or "", add_special_tokens=False).ids)
        want.append((d[0], len((d[1] or "").encode()), n, n > 1024))
    assert out == sorted(want)


def test_op6(spark, tables):
    sizes = {}
    for d in tables["docs"]:
        sizes.setdefault((d[3] is None, d[3] or ""), []).append(len((d[1] or "").split()))
    total, weight = sum(map(sum, sizes.values())), {s: k % 3 + 1 for k, s in enumerate(sorted(sizes))}
    target, capped = {}, set()
    while True:  # what a cap cuts off is shared again by weight
        left = total - sum(3 * sum(sizes[s]) for s in capped)
        level = left / sum(w for s, w in weight.items() if s not in capped)
        target = {s: 3 * sum(sizes[s]) if s in capped else weight[s] * level for s in sizes}
        over = {s for s in sizes if target[s] > 3 * sum(sizes[s])} - capped
        if not over:
            break
        capped |= over
    out = run(spark, tables, "op6_mix").collect()
    by_id = {d[0]: d for d in tables["docs"]}
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        d = by_id[r.doc_id]
        s = (d[3] is None, d[3] or "")
        assert r["size"] == len((d[1] or "").split()) and r.source_size == sum(sizes[s]) and abs(r.target - target[s]) < 1e-6
        assert 0 <= r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[s] += r.taken
    assert len(out) == len(tables["docs"])
    assert all(abs(taken[s] - target[s]) <= max(1, min(x for x in sizes[s] if x) / 2 + 1) for s in sizes if len(sizes[s]) > 5)


def test_op9_counts_and_base(spark, tables):
    def toks(t):
        return [w.lower() for w in (t or "").split()] + [None]

    count = {}
    for d in tables["docs"]:
        if crc(d[0], 10):
            for t in toks(d[1]):
                count[t] = count.get(t, 0) + 1
    n, v = sum(count.values()), len(count)
    out = {r.doc_id: r for r in run(spark, tables, "op9_lm_score").collect()}
    for d in tables["docs"]:
        t, r = toks(d[1]), out[d[0]]
        base = sum(math.log10((count.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(d[0], 10) == 0, len(t), sum(x in count for x in t), n)
        assert abs(r.base_score - base) < 1e-6 and r.score < 0


def test_op10(spark, tables):
    first, want = {}, []
    for i, _, html in sorted(tables["pages"]):
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((i, len(data), digest, "revisit" if data in first else "response", first.get(data)))
        first.setdefault(data, i)
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, run(spark, tables, "op10_warc").select(*cols).collect())) == want


def test_op11_op12_op13(spark, tables):
    dups = {r.vec_id: r for r in run(spark, tables, "op11_embedding_dups").collect()}
    v = {i: (np.array(e, dtype=np.float64), lab) for i, e, lab in tables["emb"] if e and lab is not None}
    for i, _, _ in tables["emb"]:
        links = [j for j in v if i in v and j != i and v[i][1] == v[j][1]
                 and v[i][0] @ v[j][0] / (np.linalg.norm(v[i][0]) * np.linalg.norm(v[j][0])) >= 0.93]
        assert dups[i].n_links == len(links) and dups[i].component_id == min([i, *links]) and dups[i].kept == (i == min([i, *links]))
    white = run(spark, tables, "op12_whitening").collect()
    assert len(white) == 8 * (len(tables["emb"]) - 1) and white[0].identity_error < 1e-9
    clusters = run(spark, tables, "op13_centroid_clusters").collect()
    assert sorted(r.vec_id for r in clusters) == sorted(i for i, e, _ in tables["emb"] if e)
    assert len({r.inertia for r in clusters}) == 1 and sum(r.distance for r in clusters) == clusters[0].inertia
