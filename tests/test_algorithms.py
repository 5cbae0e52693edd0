import math

import numpy as np
import pandas as pd
import pytest

from gridloom.algorithms import glm, glm_control, kmeans, pagerank, random_forest
from gridloom.algorithms.glm import student_two_sided
from gridloom.index import with_row_index
from gridloom.sources import as_darray, as_dframe, sparse_from_dataframe

EDGES = [(2, 1), (2, 3), (3, 1), (3, 2), (3, 4), (4, 5), (4, 6), (5, 4), (5, 6), (6, 4)]
RANKS = [0.05704882, 0.03939800, 0.04393000, 0.38021881, 0.19588465, 0.28351973]


def graph():
    a = np.zeros((6, 6))
    for i, j in EDGES:
        a[i - 1, j - 1] = 1
    return a


def ranks(df):
    return [r["rank"] for r in df.orderBy("id").collect()]


def test_pagerank_gives_the_known_ranks(spark):
    x = as_darray(graph(), (6, 3))
    assert np.allclose(ranks(pagerank(x)), RANKS, atol=1e-8)
    assert np.allclose(ranks(pagerank(x, personalized=as_darray(np.full((1, 6), 1 / 6)))), RANKS, atol=1e-8)
    s = sparse_from_dataframe(spark.createDataFrame([(i, j, 1.0) for i, j in EDGES], "i long, j long, v double"), (6, 6), (6, 3))
    assert np.allclose(ranks(pagerank(s, weights=s)), RANKS, atol=1e-8)


def test_pagerank_checks_its_input(spark):
    a = graph()
    a[5, 4] = np.inf
    x = as_darray(a, (6, 3))
    with pytest.warns(UserWarning):
        assert np.allclose(ranks(pagerank(x, na_action="exclude")), RANKS, atol=1e-8)
    for bad in (dict(), dict(na_action="fail"), dict(na_action="?"), dict(eps=0), dict(niter=0), dict(damping=1)):
        with pytest.raises(ValueError):
            pagerank(x, **bad)
    for bad in (as_darray(np.ones((2, 3))), as_darray(graph(), (3, 6))):
        with pytest.raises(ValueError):
            pagerank(bad)


RNG = np.random.default_rng(3)
POINTS = np.vstack([RNG.normal(c, 0.6, (40, 4)) for c in (0, 3, 6)])


def local_lloyd(x, c, passes):
    for k in range(1, passes + 1):
        label = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        moved = np.array([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(len(c))])
        if (moved == c).all():
            break
        c = moved
    return c, label, k


@pytest.mark.parametrize("kind", ["dense", "sparse", "wide"])
def test_kmeans_equals_the_local_one(spark, kind):
    local = POINTS if kind != "wide" else np.hstack([POINTS, np.zeros((len(POINTS), 200))])
    first = local[[0, 45, 90]]
    if kind == "sparse":
        cells = [(int(i) + 1, int(j) + 1, float(v)) for (i, j), v in np.ndenumerate(local)]
        x = sparse_from_dataframe(spark.createDataFrame(cells, "i long, j long, v double"), local.shape, (40, 4))
    else:
        x = as_darray(local, (50, local.shape[1]))
    centers, label, _ = local_lloyd(local, first, 30)
    model = kmeans(x, first, iter_max=30, complete_model=True)
    assert np.allclose(model.centers, centers) and model.size.tolist() == np.bincount(label).tolist()
    got = [r["label"] - 1 for r in model.cluster.orderBy("__rid").collect()]
    assert got == label.tolist()
    within = [((local[label == j] - centers[j]) ** 2).sum() for j in range(3)]
    assert np.allclose(model.withinss, within) and np.isclose(model.totss, ((local - local.mean(0)) ** 2).sum())
    assert np.isclose(model.betweenss, model.totss - sum(within))
    assert [r["label"] for r in model.predict(as_darray(local[[0, 100]])).orderBy("__rid").collect()] == [1, 3]
    assert model.fitted().count() == len(local) and "3 clusters" in repr(model)


def test_kmeans_with_bad_rows_and_ties(spark):
    x = np.vstack([[[np.nan, 1]], [[0.0, 0]], [[1, 0]], [[0.5, 0]]])
    with pytest.warns(UserWarning):
        model = kmeans(as_darray(x), np.array([[0.0, 0], [1, 0]]), iter_max=1, complete_model=True)
    assert model.size.tolist() == [2, 1]  # the first of two nearest centers
    assert model.cluster.where("__rid = 1").first()["label"] is None
    with pytest.raises(ValueError):
        kmeans(as_darray(x), 2, na_action="fail")
    for bad in (dict(centers=-3), dict(centers=2, iter_max=0), dict(centers=2, nstart=0), dict(centers=2, na_action="pass"), dict(centers=np.array([[1.0, 1], [1, 1]])), dict(centers=99)):
        with pytest.raises(ValueError):
            kmeans(as_darray(x), **bad)
    with pytest.raises(TypeError):
        kmeans(as_dframe(pd.DataFrame(x)), 2)
    best = kmeans(as_darray(POINTS), 3, iter_max=50, nstart=4, complete_model=True, seed=1)
    assert best.size.sum() == 120


def irls(x, y, family, passes=60):
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(passes):
        eta = x @ b
        mu = eta if family == "gaussian" else 1 / (1 + np.exp(-eta)) if family == "binomial" else np.exp(eta)
        w = np.ones(len(x)) if family == "gaussian" else mu * (1 - mu) if family == "binomial" else mu
        b = b + np.linalg.solve(x.T @ (x * w[:, None]), x.T @ (y - mu))
    return b, mu


@pytest.mark.parametrize("family", ["gaussian", "binomial", "poisson"])
@pytest.mark.parametrize("p", [2, 30])
def test_glm_equals_a_local_fit(spark, family, p):
    x = RNG.normal(size=(400, p)) * 0.3
    eta = 0.4 + x[:, 0] - 0.5 * x[:, 1]
    y = {"gaussian": eta + RNG.normal(size=400) * 0.1, "binomial": (RNG.random(400) < 1 / (1 + np.exp(-eta))).astype(float), "poisson": RNG.poisson(np.exp(eta)).astype(float)}[family]
    b, mu = irls(x, y, family)
    model = glm(as_darray(y[:, None]), as_darray(x), family=family)
    assert model.converged and np.allclose(model.coefficients, b, atol=1e-6)
    response = [r["value"] for r in model.predict(as_darray(x), "response").orderBy("__rid").collect()]
    assert np.allclose(response, mu, atol=1e-5)
    assert model.df_null == 399 and model.df_residual == 400 - p - 1
    s = model.summary()
    assert (s["std_error"] > 0).all() and ((0 <= s["p_value"]) & (s["p_value"] <= 1)).all()
    if family == "binomial":
        like = (y * np.log(mu) + (1 - y) * np.log(1 - mu)).sum()
        assert np.isclose(model.deviance, -2 * like, atol=1e-4) and np.isclose(model.aic, -2 * like + 2 * (p + 1), atol=1e-4)
    if family == "poisson":
        like = (y * np.log(mu) - mu - np.array([math.lgamma(v + 1) for v in y])).sum()
        assert np.isclose(model.aic, -2 * like + 2 * (p + 1), atol=1e-4)
    for kind in ("deviance", "pearson", "working", "response", "partial"):
        assert model.residuals(kind).count() == 400
    assert np.isclose(sum(r["value"] ** 2 for r in model.residuals().collect()), model.deviance)


def test_glm_with_weights_offsets_and_holes(spark):
    x = RNG.normal(size=(300, 1)) * 0.4
    y = RNG.poisson(np.exp(0.2 + x[:, 0] + 0.5)).astype(float)
    w = RNG.integers(1, 4, 300).astype(float)
    model = glm(as_darray(y[:, None]), as_darray(x), family="poisson", offset=as_darray(np.full((300, 1), 0.5)), weights=as_darray(w[:, None]))
    repeated, _ = irls(np.repeat(x, w.astype(int), axis=0), np.repeat(y, w.astype(int)), "poisson")
    assert np.allclose(model.coefficients, repeated - [0.5, 0], atol=1e-4)
    started = glm(as_darray(y[:, None]), as_darray(x), family="poisson", mustart=as_darray(y[:, None] + 1), start=np.array([0.1, 0.1]))
    assert np.allclose(started.coefficients, irls(x, y, "poisson")[0], atol=1e-6)
    eta = started.predict(x[:3]).orderBy("__rid").collect()
    assert np.allclose([r["value"] for r in eta], started.coefficients[0] + x[:3, 0] * started.coefficients[1])
    mask = spark.createDataFrame([(1, True), (2, False), (3, True)], "__rid long, keep boolean")
    assert started.predict(x[:3], mask=mask).count() == 2
    x[5] = np.nan
    hole = glm(as_darray(y[:, None]), as_darray(x), family="poisson", control=glm_control(maxit=50))
    assert hole.bad_rows == 1 and np.allclose(hole.coefficients, irls(np.delete(x, 5, 0), np.delete(y, 5), "poisson")[0], atol=1e-6)
    with pytest.raises(ValueError):
        glm(as_darray(y[:, None]), as_darray(x), na_action="fail")
    with pytest.raises(ValueError):
        glm(as_darray(-y[:, None] - 1), as_darray(x), family="poisson")
    with pytest.raises(ValueError):
        glm(as_darray(y[:, None]), as_darray(x), family="gamma")


def test_student_tails():
    assert np.isclose(student_two_sided(2.0, 10), 0.07338803, atol=1e-7)
    assert np.isclose(student_two_sided(0.1, 3), 0.92665, atol=1e-4) and student_two_sided(0.0, 5) == 1


def test_forests(spark):
    n = 300
    a, b = RNG.random(n), RNG.random(n)
    data = as_dframe(pd.DataFrame({"kind": np.where(a > 0.5, "high", "low"), "a": a, "b": b, "c": np.where(b > 0.5, "x", "y"), "y": 3 * a + b}))
    forest = random_forest(data, label="kind", ntree=10, seed=1)
    wrong = forest.confusion(data, "kind").where("label != prediction").agg({"n": "sum"}).first()[0] or 0
    assert wrong < 0.05 * n and forest.classes == ["high", "low"]
    one, two = (random_forest(data, formula="y ~ a + b", ntree=10, seed=5).predict(data).orderBy("__rid").collect() for _ in range(2))
    assert one == two and np.corrcoef([r["prediction"] for r in one], 3 * a + b)[0, 1] > 0.95
    with pytest.warns(UserWarning):
        random_forest(data, formula="y ~ a + b", ntree=2, mtry=9)
    for bad in (dict(label="y", ntree=0), dict(), dict(label="y", formula="y ~ a")):
        with pytest.raises(ValueError):
            random_forest(data, **bad)


def test_row_numbers_are_dense_and_ordered(spark):
    got = with_row_index(spark.range(1000).selectExpr("999 - id AS k"), "k").collect()
    assert sorted((r["k"], r["__rid"]) for r in got) == [(k, k + 1) for k in range(1000)]


def test_glm_warns_at_the_bounds(spark):
    x = np.array([[-30.0], [-20.0], [20.0], [30.0]])
    y = (x > 0).astype(float)
    with pytest.warns(UserWarning, match="fitted probabilities"):
        glm(as_darray(y), as_darray(x), family="binomial", start=np.array([0.0, 2.0]), control=glm_control(maxit=1))
