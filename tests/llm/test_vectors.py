"""Operators on embeddings against brute force, and their defined results in odd cases."""

import hashlib
import itertools
import math

import numpy as np
import pytest

VECTORS = "vec_id bigint, embedding array<double>, label int, node string, n_links string, component string"


def frame(spark, rows, schema=VECTORS):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema)


def saved(spark, tmp_path, rows):
    frame(spark, rows).repartition(3).write.parquet(str(tmp_path / "v"))
    return spark.read.parquet(str(tmp_path / "v"))


def near_vectors(seed=3, dims=24, n=120):
    """(vec_id, vector, label): loose ones, chains of small turns, a large group of near copies, copies."""
    rng = np.random.default_rng(seed)
    rows = [(i, rng.standard_normal(dims).tolist(), int(rng.integers(3))) for i in range(n)]
    base = rng.standard_normal(dims)
    rows += [(1000 + i, (base + 0.03 * rng.standard_normal(dims)).tolist(), 1) for i in range(70)]
    rows += [(2000 + i, rows[i % 7][1], rows[i % 7][2]) for i in range(40)]
    walk = rng.standard_normal(dims)
    for i in range(20):
        walk = walk + 0.3 * rng.standard_normal(dims) * np.linalg.norm(walk) / math.sqrt(dims)
        rows.append((3000 + i, (walk * 10.0 ** rng.integers(-150, 150)).tolist(), 2))
    return rows


ODD = [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 24, 1), (9004, [1.0, None] + [0.0] * 22, 1), (9005, [float("nan")] * 24, 1),
       (9006, [float("inf")] + [0.0] * 23, 1), (9007, [1.0] * 24, None), (9008, [1.0] * 24, None), (None, [1.0] * 24, 1),
       (9009, [1.0] * 24, 1), (9010, [1.0] * 12, 1), (9011, [1e200] * 24, 1), (9011, [1e-200] * 24, 1), (9011, [1e-200] * 24, 1)]


def linked(rows, threshold):
    """(row number -> links, component) by comparing every pair."""
    def can(r):
        return r[0] is not None and r[1] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    links, comp = [0] * len(rows), [r[0] for r in rows]
    unit = {i: np.array(r[1]) / np.abs(r[1]).max() for i, r in enumerate(rows) if can(r)}
    edges = []
    for a, b in itertools.combinations(unit, 2):
        if rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]):
            if unit[a] @ unit[b] / (np.linalg.norm(unit[a]) * np.linalg.norm(unit[b])) >= threshold:
                edges.append((a, b))
                links[a] += 1
                links[b] += 1
    while True:
        before = list(comp)
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == before:
            return links, comp


@pytest.mark.parametrize("block_rows", [8192, 9])
def test_near_vectors_equal_every_pair(spark, tmp_path, block_rows):
    from articlespark.llm.neardup import link_vectors

    rows = near_vectors() + ODD
    out = link_vectors(saved(spark, tmp_path, rows), block_rows=block_rows)
    assert out.columns == ["vec_id", "embedding", "label", "node", "n_links", "component", "n_links_", "component_id", "kept"]
    got = sorted((str(r[0]), str(r["embedding"]), r["n_links_"], r["component_id"], r["kept"]) for r in out.collect())
    links, comp = linked(rows, 0.93)
    want = sorted((str(r[0]), str(r[1]), n, c, r[0] is not None and r[0] == c) for r, n, c in zip(rows, links, comp))
    assert got == want
    assert max(links) >= 69 and len(set(comp)) < len(rows) - 100


def test_tables_reach_their_recall():
    from articlespark.llm.neardup import MISS, plan_tables, sign_codes

    rng = np.random.default_rng(1)
    a = rng.standard_normal((4000, 64))
    b = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    at_threshold = 0.93 * a + math.sqrt(1 - 0.93 ** 2) * b
    for rows in (10, 5_000, 10 ** 6):
        tables, bits = plan_tables(rows)
        met = (sign_codes(a, tables, bits) == sign_codes(at_threshold, tables, bits)).any(axis=1).mean()
        assert met >= 1 - 5 * MISS


def test_vector_operators_on_an_empty_table(spark):
    from articlespark.llm.neardup import link_vectors
    from articlespark.llm.whitening import whiten
    from articlespark.llm.zonecluster import cluster

    empty = frame(spark, [])
    assert link_vectors(empty).count() == whiten(empty).count() == cluster(empty).count() == 0
    assert whiten(frame(spark, [(1, [1.0, 2.0], 0)] * 3)).count() == 0


def test_whitening_equals_a_dense_eigensolver(spark, tmp_path):
    from articlespark.llm.whitening import whiten

    rng = np.random.default_rng(2)
    mix = rng.standard_normal((40, 40)) * np.linspace(0.02, 0.3, 40)
    rows = [(i, (rng.standard_normal(40) @ mix).tolist(), 0) for i in range(300)]
    rows += [rows[5], (None, rows[6][1], None)] + [r for r in ODD if r[1] is None or len(r[1]) != 24 or not all(map(lambda x: x is not None and math.isfinite(x), r[1]))]
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and len(r[1]) == 40]
    out = whiten(saved(spark, tmp_path, rows)).toPandas()
    x = np.array([[math.floor(1024 * c) + 100_000 for c in r[1]] for r in kept])
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    v = centred.T @ centred / n
    e, u = (a[..., ::-1] for a in np.linalg.eigh(v))
    out = out[out.n == n]
    assert len(out) == 8 * n and sorted(set(out.component)) == list(range(1, 9))
    deviation = sorted((((n * x - s) ** 2).sum(axis=1)).tolist())
    for k in range(8):
        own = out[out.component == k + 1]
        assert sorted(own.deviation) == deviation
        assert np.allclose(own.explained, e[k] / np.trace(v), rtol=1e-12)
        want = centred @ u[:, k] / math.sqrt(e[k])
        at = {r[0]: w for r, w in zip(kept, want) if r[0] is not None}
        mine = own[own.vec_id.notna()]
        got = mine.whitened.to_numpy()
        want = np.array([at[int(i)] for i in mine.vec_id])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-9
    assert out.identity_error.nunique() == 1 and out.identity_error.iloc[0] < 1e-10


def test_whitening_of_few_dimensions_and_of_several_lengths(spark):
    from articlespark.llm.whitening import whiten

    rows = [(i, [i / 8, (i * i % 7) / 8, 0.25], 0) for i in range(20)] + [(100 + i, [i / 16, 1e300 * (i % 2)], 0) for i in range(9)]
    out = whiten(frame(spark, rows)).toPandas()
    first, second = out[out.vec_id < 100], out[out.vec_id >= 100]
    assert sorted(set(first.component)) == [1, 2] and set(first.n) == {20} and set(second.n) == {9}
    assert abs(first.groupby("component").explained.first().sum() - 1) < 1e-12
    assert second.deviation.isna().all() and second[second.component == 1].whitened.abs().max() < 2


def test_eigenvectors_with_clustered_and_zero_eigenvalues():
    from articlespark.llm.whitening import leading_eigenvectors

    rng = np.random.default_rng(4)
    u = np.linalg.qr(rng.standard_normal((90, 90)))[0]
    for values in (np.r_[1e6, 1e3, 5.0, 4.9, 4.8, 1.0, 0.5, 0.4, np.zeros(82)], np.linspace(2, 1, 90), np.r_[np.ones(3), np.full(87, 0.999)]):
        v = (u * values) @ u.T
        e, q = leading_eigenvectors(lambda b: v @ b, 90)
        assert np.allclose(e, np.sort(values)[::-1][:8], rtol=1e-9, atol=1e-9)
        assert np.abs(v @ q - q * e).max() < 1e-10 * values.max() and np.allclose(q.T @ q, np.eye(8))


def brute_clusters(rows, dims=64, k=16, rounds=3):
    kept = [(r[0], [math.floor(64 * x) for x in r[1]]) for r in rows
            if r[1] is not None and len(r[1]) == dims and all(x is not None and math.isfinite(x) for x in r[1])]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in start]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, own) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    own = assign()
    return sorted((str(i), c, d, sum(x for x, y in own if y == c), sum(x for x, _ in own),
                   hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, own))


@pytest.mark.parametrize("block_rows", [256, 7])
def test_clusters_equal_brute_force(spark, tmp_path, monkeypatch, block_rows):
    from articlespark.llm import zonecluster

    monkeypatch.setattr(zonecluster, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(6)
    middles = rng.standard_normal((9, 64))
    rows = [(i, (middles[i % 9] * (i % 9) + 0.2 * rng.standard_normal(64)).tolist(), 0) for i in range(250)]
    rows += [(500 + i, rows[3][1], 0) for i in range(90)] + [rows[4], rows[4], (None, rows[8][1], None), (700, [-0.0] * 64, 1)]
    rows += [(800, None, 0), (801, [], 0), (802, [1.0] * 63, 0), (803, [None] * 64, 0), (804, [float("inf")] * 64, 0)]
    got = sorted((str(r[0]), *r[1:]) for r in zonecluster.cluster(saved(spark, tmp_path, rows)).collect())
    assert got == brute_clusters(rows)


def test_clusters_of_few_and_of_extreme_vectors(spark):
    from articlespark.llm.zonecluster import cluster

    rows = [(1, [0.5] * 64, 0), (2, [0.5] * 64, 0), (3, [-0.5] * 64, 0)]
    assert sorted((str(r[0]), *r[1:]) for r in cluster(frame(spark, rows)).collect()) == brute_clusters(rows)
    out = cluster(frame(spark, [(i, [1e300 * (-1) ** i] * 64, 0) for i in range(40)])).collect()
    assert len(out) == 40 and {r.distance for r in out} == {0}


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (5, 2)])
def test_places_follow_a_hilbert_curve(dims, bits):
    from articlespark.llm.zonecluster import hilbert_keys

    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = [k.tobytes() for k in hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_boxes_keep_every_nearest_centroid():
    from articlespark.llm.zonecluster import candidates, nearest

    rng = np.random.default_rng(8)
    dropped = 0
    for _ in range(60):
        x = rng.integers(-30, 30, 8) + rng.integers(-6, 7, (40, 8))
        centroids = rng.integers(-40, 40, (16, 8))
        among = candidates(x.min(axis=0), x.max(axis=0), centroids)
        own, distance = nearest(x, centroids, among)
        every = ((x[:, None] - centroids) ** 2).sum(axis=2)
        assert (own == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
        dropped += 16 - len(among)
    assert dropped > 60 * 4
