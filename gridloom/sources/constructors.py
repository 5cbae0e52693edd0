"""Constructors and conversions."""

from __future__ import annotations

import math
import pickle
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom import session
from gridloom.grid import Grid, split_even
from gridloom.index import RID, with_row_index
from gridloom.objects import DArray, DFrame, DList, DObject, SparseArray, Table, WideArray

#: From so many columns on, an array keeps its rows as arrays.
WIDE = 200


def check_dim_and_psize(dim, psize) -> tuple[tuple[int, int], tuple[int, int]]:
    """Both as pairs of whole numbers, or a ValueError that says what is wrong."""
    got = []
    for name, pair in (("dim", dim), ("psize", psize)):
        try:
            numbers = [float(x) for x in pair]
        except (TypeError, ValueError):
            raise ValueError(f"{name} must be numbers") from None
        if len(numbers) != 2:
            raise ValueError(f"{name} must have two numbers")
        if any(x != int(x) or x <= 0 or x > 2**31 - 1 for x in numbers):
            raise ValueError(f"{name} must be positive whole numbers below 2**31")
        got.append((int(numbers[0]), int(numbers[1])))
    if got[1][0] > got[0][0] or got[1][1] > got[0][1]:
        raise ValueError("psize must not exceed dim")
    return got[0], got[1]


def _list(items: list, sizes: list[int]) -> DList:
    spark = session.current().spark
    kinds = {type(x) for x in items}
    if not items:
        return DList(spark.createDataFrame([], "idx long, value binary"), sizes, True)
    if len(kinds) == 1 and kinds <= {int, float, str, bool}:
        kind = {int: "long", float: "double", str: "string", bool: "boolean"}[kinds.pop()]
        return DList(spark.createDataFrame(list(enumerate(items, 1)), f"idx long, value {kind}"), sizes)
    rows = [(i, pickle.dumps(x)) for i, x in enumerate(items, 1)]
    return DList(spark.createDataFrame(rows, "idx long, value binary"), sizes, True)


def dlist(*items, nparts: int | None = None) -> DList:
    """One item per argument; as many partitions as items unless said otherwise."""
    return _list(list(items), split_even(len(items), nparts or max(1, len(items))))


def as_dlist(items, nparts: int | None = None) -> DList:
    """A distributed list of local items, or of the partitions of one."""
    items = list(items)
    if items and all(isinstance(x, DObject) for x in items):
        return combine(items)
    return _list(items, split_even(len(items), nparts or max(1, min(len(items), session.current().executors))))


def _shape(nparts, dim, psize) -> Grid:
    if dim is None and psize is None:
        if nparts is None:
            raise ValueError("give dim and psize, or nparts")
        nparts = (1, nparts) if isinstance(nparts, int) else tuple(nparts)
        if len(nparts) != 2 or any(not isinstance(x, int) or x < 1 for x in nparts):
            raise ValueError("nparts must be one or two positive whole numbers")
        return Grid((0,) * nparts[0], (0,) * nparts[1])
    if nparts is not None:
        raise ValueError("give dim and psize, or nparts, not both")
    if dim is None or psize is None:
        raise ValueError("dim and psize go together")
    return Grid.by_size(*check_dim_and_psize(dim, psize))


def darray(nparts=None, dim=None, psize=None, data: float = 0, sparse: bool = False) -> DArray | SparseArray:
    """A constant array, or an empty one of so many partitions."""
    spark = session.current().spark
    grid = _shape(nparts, dim, psize)
    if sparse:
        if data != 0:
            raise ValueError("a sparse array starts with zeros")
        return SparseArray(spark.createDataFrame([], "i long, j long, v double"), grid)
    n, p = grid.dim
    rows = spark.range(1, n + 1).withColumnRenamed("id", RID)
    value = F.lit(float(data))
    if p >= WIDE:
        return WideArray(rows.withColumn("row", F.array_repeat(value, p)), grid)
    return DArray(rows.select(RID, *(value.alias(f"c{j}") for j in range(1, p + 1))), grid)


def dframe(nparts=None, dim=None, psize=None, data=0) -> DFrame:
    """A constant frame with columns X1, X2, ..., or an empty one of so many partitions."""
    grid = _shape(nparts, dim, psize)
    n, p = grid.dim
    value = F.lit(float(data) if isinstance(data, (int, float)) and not isinstance(data, bool) else data)
    rows = session.current().spark.range(1, n + 1).withColumnRenamed("id", RID)
    return DFrame(rows.select(RID, *(value.alias(f"X{j}") for j in range(1, p + 1))), grid)


def _blocks(n: int, p: int, psize) -> Grid:
    if n == 0 or p == 0:
        return Grid((n,), (p,))
    if psize is None:
        psize = (math.ceil(n / session.current().executors), p)
    return Grid.by_size(*check_dim_and_psize((n, p), psize))


def as_darray(values, psize=None) -> DArray:
    """A local matrix, distributed."""
    values = np.asarray(values, float)
    if values.ndim != 2:
        raise ValueError("an array has two dimensions")
    n, p = values.shape
    grid = _blocks(n, p, psize)
    spark = session.current().spark
    if p >= WIDE:
        rows = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), p).cast(pa.list_(pa.float64()))
        return WideArray(spark.createDataFrame(pa.table({RID: np.arange(1, n + 1), "row": rows})), grid)
    rows = pa.table({RID: pa.array(np.arange(1, n + 1)), **{f"c{j}": pa.array(values[:, j - 1]) for j in range(1, p + 1)}})
    return DArray(_missing(spark.createDataFrame(rows)), grid)


def _missing(df: DataFrame) -> DataFrame:
    """pandas keeps missing numbers as NaN; here they are NULL."""
    doubles = {c for c, kind in df.dtypes if kind == "double"}
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if c in doubles else F.col(f"`{c}`") for c in df.columns))


def as_dframe(values: pd.DataFrame, psize=None) -> DFrame:
    """A local frame, distributed; its index becomes row names unless it only counts."""
    values = pd.DataFrame(values)
    values.columns = [str(c) for c in values.columns]
    frame = values.reset_index(drop=True)
    frame.insert(0, RID, np.arange(1, len(frame) + 1))
    rows = session.current().spark.createDataFrame(pa.Table.from_pandas(frame, preserve_index=False))
    out = DFrame(_missing(rows), _blocks(*values.shape, psize), list(values.columns))
    return out.with_rownames([str(x) for x in values.index]) if values.index.dtype == object else out


def from_dataframe(df: DataFrame, order_by: str | list[str], psize=None, columns: list[str] | None = None, kind: str = "dframe", indexed: bool = False) -> Table:
    """A frame or array of a DataFrame, in the order of unique keys (or of its own __rid)."""
    columns = columns or [c for c in df.columns if c != RID]
    keyed = df if indexed else with_row_index(df, order_by)
    n = keyed.count()
    grid = _blocks(n, len(columns), psize)
    if kind == "dframe":
        return DFrame(keyed.select(RID, *columns), grid, columns)
    names = [f"c{j}" for j in range(1, len(columns) + 1)]
    return DArray(keyed.select(RID, *(F.col(a).cast("double").alias(b) for a, b in zip(columns, names, strict=True))), grid, names)


def sparse_from_dataframe(df: DataFrame, dim: tuple[int, int], psize: tuple[int, int] | None = None) -> SparseArray:
    """A sparse array of i, j, v; equal coordinates add up."""
    cells = df.groupBy("i", "j").agg(F.sum(F.col("v").cast("double")).alias("v"))
    return SparseArray(cells.select(F.col("i").cast("long"), F.col("j").cast("long"), "v"), Grid.by_size(*check_dim_and_psize(dim, psize or dim)))


def combine(items: list[DObject]) -> DObject:
    """Partitions of one kind, one below the other, as one object."""
    first = items[0]
    if any(type(x) is not type(first) for x in items):
        raise ValueError("partitions of one kind are needed")
    if isinstance(first, DList):
        offset, frames, sizes = 0, [], []
        for x in items:
            frames.append(x.df.withColumn("idx", F.col("idx") + offset).select(*first.columns))
            sizes += x.grid.rows
            offset += len(x)
        return DList(reduce(DataFrame.union, frames), sizes, first.pickled, first.named)
    from gridloom.operators.binding import rbind

    return rbind(*items)
