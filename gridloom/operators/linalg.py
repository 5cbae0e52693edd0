"""Matrix product, transpose and element-wise arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.grid import Grid
from gridloom.index import RID
from gridloom.objects import DArray, DObject, SparseArray, Table, one_backend, quoted


def matmul(a: DObject, b: DObject) -> SparseArray:
    """The product of two arrays over their cells: one join on the inner index and one aggregate."""
    one_backend(a, b)
    if a.dim[1] != b.dim[0]:
        raise ValueError(f"{a.dim} and {b.dim} do not fit")
    left = a.coo().select("i", F.col("j").alias("k"), F.col("v").alias("x")).where("x is null or x != 0")
    right = b.coo().select(F.col("i").alias("k"), "j", F.col("v").alias("y")).where("y is null or y != 0")
    cells = left.join(right, "k").groupBy("i", "j").agg(F.when(F.count(F.col("x") * F.col("y")) == F.count(F.lit(1)), F.sum(F.col("x") * F.col("y"))).alias("v"))
    return SparseArray(cells, Grid(a.grid.rows, b.grid.cols))


def transpose(x: SparseArray) -> SparseArray:
    return SparseArray(x.coo().select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), Grid(x.grid.cols, x.grid.rows))


def elementwise(f: Callable[[Column, Column], Column], a: Table, b: Table) -> DArray:
    """f of the cells at each place."""
    one_backend(a, b)
    if a.dim != b.dim:
        raise ValueError(f"{a.dim} and {b.dim} differ")
    names = [f"c{j}" for j in range(1, a.dim[1] + 1)]
    left = a.df.select(RID, *(v.alias(f"a_{n}") for v, n in zip(a.numbers(), names, strict=True)))
    right = b.df.select(RID, *(v.alias(f"b_{n}") for v, n in zip(b.numbers(), names, strict=True)))
    both = left.join(right, RID)
    return DArray(both.select(RID, *(f(quoted(f"a_{n}"), quoted(f"b_{n}")).alias(n) for n in names)), a.grid, names)
