"""Grids changed without moving data, and objects split by a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.index import RID
from gridloom.objects import DFrame, DList, DObject, SparseArray, WideArray


def _with_grid(x: DObject, grid) -> DObject:
    if isinstance(x, DList):
        return DList(x.df, list(grid.rows), x.pickled, x.named)
    if isinstance(x, SparseArray):
        return SparseArray(x.df, grid)
    return WideArray(x.df, grid) if isinstance(x, WideArray) else x._like(x.df, grid, x.columns)


def repartition(x: DObject, skeleton: DObject) -> DObject:
    """The same data in the grid of another object of the same dimensions: metadata only."""
    if x.dim != skeleton.dim:
        raise ValueError(f"{x.dim} cannot take the partitions of {skeleton.dim}")
    return x if x.grid == skeleton.grid else _with_grid(x, skeleton.grid)


def exchange(x: DObject) -> DObject:
    """One task per grid row, where the next operators are to run so: a shuffle."""
    key = "idx" if isinstance(x, DList) else "i" if isinstance(x, SparseArray) else RID
    block = x.grid.row_block_column(F.col(key))
    moved = x.df.repartition(len(x.grid.rows), block)
    out = _with_grid(x, x.grid)
    out.df = moved
    return out


def block_sizes(x: DObject) -> DataFrame:
    """block (1-based grid row), n: rows counted from the data."""
    key = "idx" if isinstance(x, DList) else RID
    return x.df.groupBy((x.grid.row_block_column(F.col(key)) + 1).alias("block")).agg(F.count(F.lit(1)).alias("n"))


def split(x: DFrame, by: str) -> DataFrame:
    """The rows with a 1-based group number, groups in order of the column."""
    groups = x.df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    rank = groups.select(by, F.expr(f"dense_rank() over (order by `{by}`)").alias("group"))
    return x.df.join(rank, by)
