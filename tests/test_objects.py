import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom import objects, session
from gridloom.grid import Grid
from gridloom.objects import SparseArray, is_darray, is_dframe, is_dlist, is_dobject, is_sparse_darray
from gridloom.operators import cbind, col_means, col_medians, col_sums, element, elementwise, head, index, largest, matmul, mean, rbind, repartition, reverse, row_means, row_sums, smallest, tail, total, transpose, unique, which_max
from gridloom.sources import as_darray, as_dframe, as_dlist, combine, darray, dframe, dlist, from_dataframe, read_dframe, sparse_from_dataframe, write_dframe

COUNTED = np.arange(1, 101, dtype=float).reshape(5, 20).T  # column-major


def values(df, key):
    return [r["value"] for r in df.orderBy(key).collect()]


def test_backends_are_registered_and_unknown_ones_named(spark):
    assert "spark" in session.available_backends()
    with pytest.raises(ValueError, match="spark"):
        session.use_backend("nowhere")
    session.register_driver("mine", lambda: spark)
    assert session.use_backend("mine").executors >= 1
    session.use_session(spark)


def test_lists_hold_anything(spark):
    items = [2, ("fred", "mary", 3), [10, 20, np.full((4, 5), 2.0)]]
    x = dlist(*items)
    assert x.total_parts == 3 and len(x) == 3
    assert x.collect(2) == [("fred", "mary", 3)]
    assert (x.collect()[2][2] == 2).all()
    assert element(x, 2) == ("fred", "mary", 3)
    numbers = as_dlist(range(1, 11), nparts=5)
    assert numbers.collect() == list(range(1, 11)) and all(len(p) == 2 for p in numbers.parts())
    assert numbers.collect([5, 1]) == [9, 10, 1, 2]
    assert as_dlist(numbers.parts([2, 1])).collect() == [3, 4, 1, 2]
    assert reverse(numbers).collect() == list(range(10, 0, -1))
    assert [r["value"] for r in index(numbers, [3, 3, 1]).orderBy("pos").collect()] == [3, 3, 1]
    named = numbers.with_names(list("abcdefghia"))
    assert named.by_name("a") == [1, 10] and named.names()[1] == "b"
    with pytest.raises(ValueError):
        numbers.with_names(["a"])


def test_empty_lists_and_bad_partitions(spark):
    x = dlist(nparts=5)
    assert x.total_parts == 5 and x.collect() == []
    for bad in (6, 0, -100):
        with pytest.raises(IndexError):
            x.collect(bad)
        with pytest.raises(IndexError):
            x.parts(bad)


@pytest.mark.parametrize("psize", [(3, 3), (5, 5), (20, 1), (2, 5)])
def test_arrays_are_cut_into_blocks(spark, psize):
    x = as_darray(COUNTED, psize)
    assert x.dim == (20, 5)
    assert (x.collect() == COUNTED).all()
    for k, view in enumerate(x.parts(), 1):
        r0, r1, c0, c1 = x.grid.block(k)
        assert (view.collect() == COUNTED[r0 - 1 : r1, c0 - 1 : c1]).all() and view.total_parts == 1


def test_the_arguments_of_an_array_are_checked(spark):
    assert darray(nparts=(2, 3)).total_parts == 6 and darray(nparts=3).nparts == (1, 3)
    assert (darray(dim=(4, 4), psize=(2, 2), data=2).collect() == 2).all()
    for bad in (dict(dim=(2, 2), psize=(3, 1)), dict(dim=(2, 2), psize=(-1, 1)), dict(dim=(2, 2), psize=("a", 1)), dict(dim=(2, 2, 2), psize=(1, 1, 1)), dict(dim=(2, 2), psize=(0, 1)), dict(dim=(2, 2)), dict(nparts=1, dim=(2, 2), psize=(1, 1)), dict(dim=(2, 2), psize=(1, 1), sparse=True, data=1)):
        with pytest.raises(ValueError):
            darray(**bad)
    assert dframe(dim=(3, 2), psize=(1, 2), data=1).collect().shape == (3, 2)


def test_kinds(spark):
    a, f, s = darray(dim=(2, 2), psize=(1, 1)), dframe(dim=(2, 2), psize=(1, 1)), darray(dim=(2, 2), psize=(1, 1), sparse=True)
    assert is_darray(a) and is_darray(s) and is_sparse_darray(s) and not is_sparse_darray(a)
    assert is_dframe(f) and is_dlist(dlist(1)) and is_dobject(a) and not is_dobject(3)
    assert len(a) == 4 and len(f) == 2 and len(dlist(1, 2, 3)) == 3
    assert "4 partitions (2 x 2)" in repr(a)


def test_frames_keep_names_and_types(spark):
    local = pd.DataFrame({"dfa": [2.0, 3, 4], "dfb": ["aa", "bb", "cc"], "dfc": [True, False, True]})
    x = as_dframe(local, (1, 1))
    assert x.total_parts == 9 and x.collect().equals(local)
    assert x.parts(5)[0].collect().iloc[0, 0] == "bb"
    y = x.with_colnames(["a", "b", "c"]).with_rownames(["r1", "r2", "r3"])
    assert y.dimnames() == (["r1", "r2", "r3"], ["a", "b", "c"])
    assert list(y.collect().index) == ["r1", "r2", "r3"]
    with pytest.raises(ValueError):
        x.with_colnames(["a"])
    with pytest.raises(ValueError):
        x.with_rownames(["a"])


RNG = np.random.default_rng(7)


def random_sparse(spark, n, p):
    local = np.where(RNG.random((n, p)) < 0.2, RNG.integers(-9, 9, (n, p)), 0).astype(float)
    cells = [(int(i) + 1, int(j) + 1, float(local[i, j])) for i, j in zip(*np.nonzero(local), strict=True)]
    return sparse_from_dataframe(spark.createDataFrame(cells, "i long, j long, v double"), (n, p), (3, 4)), local


@pytest.mark.parametrize("kind", ["array", "frame", "wide", "sparse"])
def test_aggregates_equal_the_local_ones(spark, kind):
    if kind == "sparse":
        x, local = random_sparse(spark, 17, 9)
    else:
        p = 230 if kind == "wide" else 7
        local = RNG.normal(size=(13, p))
        x = as_dframe(pd.DataFrame(local), (4, 3)) if kind == "frame" else as_darray(local, (4, 3))
        assert isinstance(x, objects.WideArray) == (kind == "wide")
    assert np.allclose(x.collect(), local)
    assert np.allclose(values(col_sums(x), "j"), local.sum(0)) and np.allclose(values(col_means(x), "j"), local.mean(0))
    assert np.allclose(values(row_sums(x), "__rid"), local.sum(1)) and np.allclose(values(row_means(x), "__rid"), local.mean(1))
    assert np.isclose(total(x).first()[0], local.sum()) and np.isclose(total(x, x).first()[0], 2 * local.sum())
    assert np.isclose(mean(x).first()[0], local.mean())
    assert np.isclose(largest(x).first()[0], local.max()) and np.isclose(smallest(x).first()[0], local.min())
    for part, whole in ((head(x, 3), local[:3]), (tail(x, 3), local[-3:]), (head(x, 100), local)):
        assert np.allclose(part.collect(), whole)
    assert head(x, 0).dim[0] == 0
    with pytest.raises(ValueError):
        head(x, -1)
    if kind != "sparse":
        got = index(x, [5, 2, 2], [3, 1]).orderBy("pos").drop("pos").toPandas().to_numpy()
        assert np.allclose(got, local[np.ix_([4, 1, 1], [2, 0])])
    else:
        got = index(x, [5, 2], [3, 1]).orderBy("pos", "col").collect()
        assert [r["v"] for r in got] == local[np.ix_([4, 1], [2, 0])].ravel().tolist()
    if kind in ("array", "frame"):
        assert np.isclose(element(x, 3, 2), local[2, 1])
        assert np.allclose(values(col_medians(x), "j"), np.median(local, 0))
    for bad in ([0], [99], [-1], [True]):
        with pytest.raises(IndexError):
            index(x, bad, [1])


def _shuffled(spark) -> int:
    """Bytes that all stages so far have written for others."""
    jvm = spark._jvm
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_medians_shuffle_no_values(spark):
    n = 600_000
    rows = spark.range(1, n + 1).select(F.col("id").alias("__rid"), (F.col("id") * 7919 % n).cast("double").alias("a"), F.rand(3).alias("b"))
    before = _shuffled(spark)
    got = values(col_medians(objects.DFrame(rows, Grid((n,), (2,)), ["a", "b"])), "j")
    assert _shuffled(spark) - before < 2_000_000  # the values take 9.6 MB
    assert got == [(n - 1) / 2, np.median(rows.select("b").toPandas()["b"])]


def test_medians_of_odd_columns(spark):
    inf, nan, rng = float("inf"), float("nan"), np.random.default_rng(5)
    columns = [
        [3.0, 1, 2], [1.0, 2, 4, 8], [5.0] * 6, [1.0, 1, 2, 2], [-3.0, -1, -2, 7], [0.0, -0.0, 0.0, 1], [None, 2.0, None, 4], [None, None], [nan, 1.0, 2], [nan, nan, 1.0], [nan, 1.0],
        [inf, 1.0, inf], [-inf, inf, 1.0, 2], [inf, 1.0], [-inf, -inf, 1.0], [5e-324, 1e-323, 0.0, 1], [1e308, 1.7e308, -1e308, 1.0], [1.7e308, 1.6e308, 1.5e308, 1.4e308], [1.0, 1 + 2**-52, 1 + 2**-51, 1 + 2**-50], [2.0**60 - 2**8, 2.0**60, 2.0**60 + 2**9], [1e-300, 1e300], [-2.5],
        rng.normal(size=501).tolist(), rng.lognormal(0, 20, 500).tolist(), rng.integers(-9, 9, 400).astype(float).tolist(), rng.uniform(1, 1 + 1e-13, 300).tolist(),
    ]
    for some in (columns, columns * 10):  # the second one is wide
        height = max(map(len, some))
        rows = [(i + 1, *(float(c[i]) if i < len(c) and c[i] is not None else None for c in some)) for i in range(height)]
        if len(some) < 200:
            df = spark.createDataFrame(rows, "__rid long, " + ", ".join(f"c{j} double" for j in range(1, len(some) + 1)))
            x = objects.DArray(df, Grid((height,), (len(some),)))
        else:
            df = spark.createDataFrame([(r[0], list(r[1:])) for r in rows], "__rid long, row array<double>")
            x = objects.WideArray(df, Grid((height,), (len(some),)))
        want = [r[0] for r in x.coo().groupBy("j").agg(F.median("v").alias("m")).orderBy("j").select("m").collect()]
        got = col_medians(x).orderBy("j").collect()
        assert [r["name"] for r in got] == x.colnames()
        assert list(map(repr, (r["value"] for r in got))) == list(map(repr, want))
    sparse = objects.SparseArray(spark.createDataFrame([(1, 1, 5.0), (2, 1, 2.0), (3, 3, None)], "i long, j long, v double"), Grid((4,), (3,)))
    assert values(col_medians(sparse), "j") == [3.5, 0.0, None]
    empty = objects.DFrame(spark.createDataFrame([], "__rid long, a double, b int"), Grid((0,), (2,)), ["a", "b"])
    assert [tuple(r) for r in col_medians(empty).orderBy("j").collect()] == [(1, "a", None), (2, "b", None)]


def test_missing_values(spark):
    x = as_darray([[1, 2], [3, 4]])
    x.df = x.df.withColumn("c1", F.when(F.col("__rid") == 1, F.col("c1"))).withColumn("c2", F.when(F.col("__rid") == 2, F.lit(float("nan"))).otherwise(F.col("c2")))
    assert values(col_sums(x), "j")[0] is None and np.isnan(values(col_sums(x), "j")[1])
    assert values(col_sums(x, na_rm=True), "j") == [1, 2]
    assert values(col_means(x, na_rm=True), "j") == [0.5, 1]  # by the number of all rows
    assert values(row_means(x, na_rm=True), "__rid") == [1.5, 0]
    assert mean(x, na_rm=True).first()[0] == 0.75
    assert largest(x).first()[0] is None and largest(x, na_rm=True).first()[0] == 2 and smallest(x, na_rm=True).first()[0] == 1
    with pytest.raises(ValueError):
        mean(x, trim=0.1)
    with pytest.raises(TypeError):
        col_sums(dlist(1, 2))


def test_binding(spark):
    a, b = np.arange(6.0).reshape(3, 2), np.arange(10.0).reshape(5, 2)
    x, y = as_darray(a, (2, 1)), as_darray(b, (2, 2))
    assert (rbind(x, y).collect() == np.vstack([a, b])).all()
    assert (cbind(x, as_darray(a * 2)).collect() == np.hstack([a, a * 2])).all()
    assert is_dframe(rbind(x, as_dframe(pd.DataFrame(b)))) and is_darray(rbind(x, y))
    for bad in (lambda: rbind(x, as_darray(np.ones((2, 3)))), lambda: cbind(x, y)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        rbind(dlist(1), x)
    s, local = random_sparse(spark, 4, 5)
    assert (rbind(s, s).collect() == np.vstack([local, local])).all() and (cbind(s, s).collect() == np.hstack([local, local])).all()
    assert (rbind(s, as_darray(np.ones((2, 5)))).collect() == np.vstack([local, np.ones((2, 5))])).all()
    assert (combine(x.parts([1, 3])).collect() == a[:, :1]).all()


def test_repartition_changes_the_grid_only(spark):
    x = darray(dim=(4, 4), psize=(2, 2), data=1)
    y = repartition(x, darray(dim=(4, 4), psize=(4, 1)))
    assert y.psize() == [(4, 1)] * 4 and (y.collect() == 1).all()
    assert repartition(x, x) is x
    with pytest.raises(ValueError):
        repartition(x, darray(dim=(4, 3), psize=(1, 1)))
    z = repartition(dlist(1, 2, 3, 4), dlist(0, 0, 0, 0, nparts=2))
    assert [p.collect() for p in z.parts()] == [[1, 2], [3, 4]]


def test_products_and_arithmetic(spark):
    a, b = RNG.normal(size=(4, 3)), RNG.normal(size=(3, 5))
    assert np.allclose(matmul(as_darray(a, (2, 2)), as_darray(b, (2, 2))).collect(), a @ b)
    with pytest.raises(ValueError):
        matmul(as_darray(a), as_darray(a))
    s, local = random_sparse(spark, 6, 4)
    assert np.allclose(transpose(s).collect(), local.T)
    assert np.allclose(elementwise(lambda x, y: x - y, as_darray(a), as_darray(2 * a)).collect(), -a)


def test_unique_and_which_max(spark):
    x = as_darray([[3, 1], [1, 3]])
    assert sorted(r[0] for r in unique(x).collect()) == [1, 3]
    m = which_max(x).first()
    assert (m["i"], m["j"], m["v"]) == (1, 1, 3)
    assert unique(as_dframe(pd.DataFrame({"a": [1, 1, 2], "b": ["x", "x", "y"]}))).count() == 2
    s = SparseArray(spark.createDataFrame([(1, 1, 5.0)], "i long, j long, v double"), Grid((2,), (1,)))
    assert sorted(r[0] for r in unique(s).collect()) == [0, 5]


def test_files_and_dataframes(spark, tmp_path):
    rows = spark.range(50).selectExpr("49 - id AS k", "id * 2.0 AS v", "'x' AS unused")
    x = from_dataframe(rows, "k", (20, 1))
    assert x.collect()["k"].tolist() == list(range(50)) and x.nparts == (3, 3)
    write_dframe(x, str(tmp_path / "out"))
    y = read_dframe(str(tmp_path / "out"), order_by="k", columns=["v"])
    assert y.collect()["v"].tolist() == [98.0 - 2 * k for k in range(50)]
    # only what is asked for is read
    assert "unused" not in y.df._jdf.queryExecution().executedPlan().toString()
