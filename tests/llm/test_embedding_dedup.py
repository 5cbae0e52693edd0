import numpy as np
import pytest

from gridloom.llm import embedding_dedup
from gridloom.llm.components import components
from gridloom.llm.embedding_dedup import choose_pivots, embedding_links, unit


def brute(rows, threshold):
    ok = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = (np.array(v, float), label)
    links = {i: set() for i, _, _ in rows}
    for a in ok:
        for b in ok:
            if a != b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]):
                x, y = ok[a][0], ok[b][0]
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                    links[a].add(b)
    out = {}
    for i in links:
        seen, stack = {i}, [i]
        while stack:
            for n in links[stack.pop()] - seen:
                seen.add(n)
                stack.append(n)
        root = i if i is None else min(seen)
        out[i] = (len(links[i]), root, i == root)
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS id", "2 AS cell", "'x' AS vector")


def check(spark, rows, **settings):
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_links(table(spark, rows), **settings).collect()}
    assert got == brute(rows, settings.get("threshold", 0.93))


def sample(seed, clustered, n=250, dim=8):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dim)) * 3
    rows = []
    for i in range(n):
        v = centers[rng.integers(12)] + rng.normal(size=dim) * 0.6 if clustered else rng.normal(size=dim)
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3)) if rng.random() > 0.02 else None))
    for k in range(30):  # copies, and scaled ones
        i, v, label = rows[rng.integers(40)]
        rows.append((1000 + k, [x * (1 if k % 2 else 2) for x in v], label))
    return rows


@pytest.mark.parametrize("clustered", [True, False])
@pytest.mark.parametrize("block", [16, 2048])
def test_equals_brute_force(spark, clustered, block):
    check(spark, sample(block, clustered), block=block)


@pytest.mark.parametrize("pivots", [2, 7, 30])
def test_any_number_of_pivots_finds_all_links(spark, monkeypatch, pivots):
    monkeypatch.setattr(embedding_dedup, "choose_pivots", lambda x, reach: x[:pivots])
    check(spark, sample(pivots, True), block=32)


def test_clustered_vectors_get_cells():
    rng = np.random.default_rng(2)
    tight = np.repeat(np.eye(16), 40, axis=0) + rng.normal(size=(640, 16)) * 0.01
    assert len(choose_pivots(unit([v.tobytes() for v in tight]), 0.75)) > 4
    assert len(choose_pivots(unit([v.tobytes() for v in rng.normal(size=(640, 64))]), 0.75)) == 1


def test_a_hot_vector(spark):
    check(spark, [(i, [1.0, 2.0, 3.0], 1) for i in range(200)] + [(500 + i, [1.0, 2.0, 3.0 + i / 100], 1) for i in range(50)], block=20)


def test_vectors_that_link_with_nothing(spark):
    odd = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [float("nan"), 1.0], 0), (6, [float("inf"), 1.0], 0), (7, [1.0, 1.0], None), (8, [1.0, 1.0], 0), (9, [1.0, 1.0, 0.0], 0), (10, [-0.0, 1.0], 1), (11, [0.0, 1.0], 1), (12, [3e38, 3e38], 2), (13, [1e-38, 1e-38], 2)]
    check(spark, odd)
    null = embedding_links(table(spark, [(None, [1.0, 1.0], 0), (2, [1.0, 1.0], 0)])).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["kept"]) for r in null) == [(0, 0, True), (2, 0, True)]
    assert embedding_links(table(spark, [])).count() == 0
    repeated = embedding_links(table(spark, [(1, [1.0, 1.0], 0), (1, [1.0, 1.0], 0), (2, [1.0, 1.0], 0)])).collect()
    assert sorted(tuple(r) for r in repeated) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 700)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1200, (120, 2))]
    order = rng.permutation(len(edges))
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([edges[k] for k in order], "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}
