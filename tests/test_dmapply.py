import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.grid import Grid
from gridloom.objects import DFrame
from gridloom.operators import dlapply, dmapply, map_cells, map_columns, map_items
from gridloom.sources import as_darray, as_dframe, as_dlist, darray, dlist


def one_to_ten():
    return as_dlist(range(1, 11), nparts=5)


def test_items_and_zips(spark):
    x, y = one_to_ten(), as_dlist(range(5, 15), nparts=10)
    got = dmapply(lambda a, b: a + b, x, y)
    assert got.collect() == list(range(6, 26, 2)) and got.total_parts == 5
    assert dlapply(x, lambda a, z: a * z, z=3).collect() == [3 * k for k in range(1, 11)]
    assert map_items(lambda a, b: a + b, x, y).collect() == list(range(6, 26, 2))


def test_partitions_with_local_values_and_more_args(spark):
    got = dmapply(lambda block, y, z: len(block) + y - z, one_to_ten().parts(), [10, 9, 8, 7, 6], more_args={"z": 3})
    assert got.collect() == [9, 8, 7, 6, 5]
    got = dmapply(lambda block, z: sum(block) + z[1], one_to_ten().parts(), more_args={"z": dlist(0, 100)})
    assert got.collect() == [103, 107, 111, 115, 119]


def test_a_list_an_array_and_a_frame_together(spark):
    x = as_dlist([1, 2, 3, 4], nparts=2)
    y = as_darray(np.array([[1.0, 3], [2, 4]]))
    z = as_dframe(pd.DataFrame(np.arange(1, 9).reshape(4, 2).T, columns=list("abcd")))
    assert dmapply(lambda a, b, c: a + b + sum(c), x, y, z).collect() == [1 + 1 + 3, 2 + 2 + 7, 3 + 3 + 11, 4 + 4 + 15]


def test_arrays_give_cells_and_frames_columns(spark):
    y = as_darray(np.array([[1.0, 3], [2, 4]]), (1, 2))
    assert dmapply(lambda v: v * 10, y).collect() == [10, 20, 30, 40]
    assert map_cells(lambda v: v * 10, y).collect() == [10, 20, 30, 40]
    z = as_dframe(pd.DataFrame({"a": [1, 5], "b": ["x", "y"]}))
    assert dmapply(lambda c: c[-1], z).collect() == [5, "y"]
    got = map_columns(lambda c: F.max(c), as_dframe(pd.DataFrame({"a": [1, 5], "b": [7, 2]})))
    assert [r["value"] for r in got.orderBy("j").collect()] == [5, 7]


def test_a_column_stays_out_of_memory(spark):
    class Watched:
        """The function, which traces memory from before its column arrives."""

        def __setstate__(self, state):
            import tracemalloc

            tracemalloc.start()

        def __getstate__(self):
            return {"on": True}

        def __call__(self, c):
            import tracemalloc

            out = max(c) - min(c) + len(c)
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            return out, peak

    n = 1_000_000
    rows = spark.range(1, n + 1).select(F.col("id").alias("__rid"), (F.col("id") * 0.5).alias("a"))
    (value, peak), = dmapply(Watched(), DFrame(rows, Grid((n,), (1,)), ["a"])).collect()
    assert value == (n - 1) * 0.5 + n and peak < 16_000_000  # a batch of payloads; a list of the values takes 32 MB


def test_a_column_is_in_order_and_does_what_a_list_does(spark):
    n = 40_000
    ids = spark.range(1, n + 1).select(F.col("id").alias("__rid"), F.concat(F.lit("v"), "id").alias("a"), F.when(F.col("id") % 3 != 0, F.repeat(F.lit("x"), F.col("id").cast("int") % 500)).alias("b"))
    frame = DFrame(ids.repartition(7), Grid((n,), (2,)), ["a", "b"])
    a, b = [f"v{k}" for k in range(1, n + 1)], [None if k % 3 == 0 else "x" * (k % 500) for k in range(1, n + 1)]
    assert dmapply(lambda c: c, frame).collect() == [a, b]
    assert dmapply(lambda c: c, frame, combine="c").collect() == a + b
    pick = lambda c: (len(c), c[17_000], c[-1], c[16_383:16_386], c[::-9_000], list(reversed(c))[:2], c.index(c[5]), len(c + [1]), c == list(c), len(np.array(c)))
    assert dmapply(pick, frame).collect() == [pick(a), pick(b)]

    def changed(c):
        c.sort(key=repr)
        c[0] = "first"
        c.append(len(c))
        return c

    assert dmapply(changed, frame).collect() == [changed(list(a)), changed(list(b))]
    numbers = DFrame(spark.range(1, n + 1).select(F.col("id").alias("__rid"), "id"), Grid((n,), (1,)), ["id"])
    assert dmapply(lambda c: float(np.mean(c)), numbers).collect() == [(n + 1) / 2]
    got = dmapply(lambda c: c, numbers, output_type="darray", nparts=1)
    assert got.dim == (n, 1) and (got.collect()[:, 0] == np.arange(1, n + 1)).all()


def test_flattening(spark):
    got = dmapply(lambda v: [v] * v, as_dlist([2, 0, 1]), combine="c")
    assert got.collect() == [2, 2, 1]
    parts = dmapply(lambda b: [sum(b), max(b)], one_to_ten().parts(), combine="c")
    assert parts.collect() == [3, 2, 7, 4, 11, 6, 15, 8, 19, 10] and parts.total_parts == 5
    assert dmapply(lambda v: [v] * v, as_dlist([2, 1])).collect() == [[2, 2], [1]]


def test_blocks_of_two_arrays(spark):
    a = dmapply(lambda k: np.full((2, 4), float(k)), [1, 2], output_type="darray", combine="rbind", nparts=(2, 1))
    assert a.dim == (4, 4) and a.collect()[:, 0].tolist() == [1, 1, 2, 2] and a.psize() == [(2, 4), (2, 4)]
    b = dmapply(lambda x, z: x * 2 + z, a.parts(), more_args={"z": 5}, output_type="darray", combine="rbind", nparts=(2, 1))
    c = dmapply(lambda x, y, z: x + y + z, a.parts(), b.parts(), output_type="darray", combine="rbind", nparts=(2, 1), more_args={"z": 3})
    assert c.collect()[:, 1].tolist() == [11, 11, 14, 14]


def test_a_grid_of_results(spark):
    x = dmapply(lambda k: np.full((2, 3), float(k)), range(6), output_type="darray", combine="cbind", nparts=(3, 2))
    assert x.psize() == [(2, 3)] * 6
    assert (x.collect() == np.block([[np.full((2, 3), 0.0), np.full((2, 3), 1.0)], [np.full((2, 3), 2.0), np.full((2, 3), 3.0)], [np.full((2, 3), 4.0), np.full((2, 3), 5.0)]])).all()
    s = dmapply(lambda k: np.eye(2) * k, [1, 2, 3, 4], output_type="sparse_darray", combine="cbind", nparts=2)
    assert (s.collect() == np.hstack([np.eye(2) * k for k in (1, 2, 3, 4)])).all() and s.df.count() == 8
    columns = dmapply(lambda k: [k, k + 0.5], [1, 2, 3], output_type="darray", nparts=1)
    assert columns.collect().tolist() == [[1, 2, 3], [1.5, 2.5, 3.5]]


def test_frames_of_results(spark):
    x = dmapply(lambda k: pd.DataFrame({"n": [k], "s": [f"v{k}"], "b": [k > 1]}), [1, 2], output_type="dframe", combine="rbind", nparts=(2, 1))
    assert x.collect()["s"].tolist() == ["v1", "v2"] and x.collect()["b"].tolist() == [False, True]


def test_groups_of_partitions_may_be_empty_and_repeat(spark):
    x = darray(dim=(4, 4), psize=(2, 2), data=2)
    groups = [x.parts([1, 2, 3]), [], x.parts([4])]
    got = dmapply(lambda blocks: np.vstack(blocks).shape if blocks else None, groups)
    assert got.collect() == [(6, 2), None, (2, 2)]
    a = as_darray(np.arange(1.0, 10).reshape(3, 3), (1, 1))
    rows = [a.parts([3 * i + k + 1 for k in range(3)]) for i in range(3) for _ in range(3)]
    cols = [a.parts([3 * k + j + 1 for k in range(3)]) for _ in range(3) for j in range(3)]
    got = dmapply(lambda r, c: sum(p @ q for p, q in zip(r, c, strict=True)), rows, cols, output_type="darray", combine="rbind", nparts=(3, 3))
    assert (got.collect() == a.collect() @ a.collect()).all()


def test_sparse_blocks_reach_the_function(spark):
    s = dmapply(lambda k: np.eye(3) * k, [1, 2], output_type="sparse_darray", combine="rbind", nparts=(2, 1))
    assert dmapply(lambda b: float(b.sum()), s.parts([2, 1])).collect() == [6, 3]
    assert dmapply(lambda v: v + 1, s).collect()[:4] == [2, 1, 1, 3]


@pytest.mark.parametrize(
    "bad",
    [
        lambda: dmapply(lambda a, b: a, [1, 2], [1]),
        lambda: dmapply(lambda a: a, []),
        lambda: dmapply(lambda: 1),
        lambda: dmapply(lambda a: a, [1], combine="rbind"),
        lambda: dmapply(lambda a: a, [1], output_type="sparse_darray"),
        lambda: dmapply(lambda a: a, [1], output_type="table"),
        lambda: dmapply(lambda a: a, [1], combine="sum"),
        lambda: dmapply(lambda a: a, [1, 2], nparts=3),
        lambda: dmapply(lambda k: np.ones((k, 1)), [1, 2], output_type="darray", combine="cbind", nparts=1),
        lambda: dmapply(lambda k: np.ones((k, 1)), [1, 2], output_type="darray", combine="cbind", nparts=(1, 2)),
    ],
)
def test_what_cannot_be_mapped(spark, bad):
    with pytest.raises(ValueError):
        bad()


def test_errors_of_the_function_come_back(spark):
    def fail(v):
        raise RuntimeError("on purpose")

    with pytest.raises(Exception, match="on purpose"):
        dmapply(fail, [1, 2]).collect()
    with pytest.raises(Exception, match="no block of an array"):
        dmapply(lambda v: "text", [1], output_type="darray", combine="rbind")
