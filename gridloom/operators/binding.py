"""Objects below and beside each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.grid import Grid
from gridloom.index import RID
from gridloom.objects import DArray, DFrame, DList, DObject, SparseArray, Table, WideArray, one_backend, quoted


def _kind(items: tuple[DObject, ...]) -> str:
    if any(isinstance(x, DList) for x in items):
        raise TypeError("lists cannot be bound")
    one_backend(*items)
    if all(isinstance(x, SparseArray) for x in items):
        return "sparse"
    return "dframe" if any(isinstance(x, DFrame) for x in items) else "darray"


def _dense(x: DObject) -> Table:
    """A sparse or wide array as columns."""
    if isinstance(x, (SparseArray, WideArray)):
        cells = x.coo()
        names = [f"c{j}" for j in range(1, x.dim[1] + 1)]
        found = cells.groupBy(F.col("i").alias(RID)).pivot("j", list(range(1, x.dim[1] + 1))).agg(F.first(F.struct("v")))
        every = x.df.sparkSession.range(1, x.dim[0] + 1).withColumnRenamed("id", RID)
        cell = lambda j: F.when(F.col(str(j)).isNull(), F.lit(0.0)).otherwise(F.col(f"`{j}`.v"))
        return DArray(every.join(found, RID, "left").select(RID, *(cell(j).alias(n) for j, n in enumerate(names, 1))), x.grid, names)
    return x


def rbind(*items: DObject) -> DObject:
    """Rows of the first object, then of the next; a frame if any of them is one."""
    kind = _kind(items)
    if len({x.dim[1] for x in items}) != 1:
        raise ValueError("all objects must have as many columns")
    rows = tuple(r for x in items for r in x.grid.rows)
    grid = Grid(rows, items[0].grid.cols)
    offset, frames = 0, []
    if kind == "sparse":
        for x in items:
            frames.append(x.df.withColumn("i", F.col("i") + offset).select("i", "j", "v"))
            offset += x.dim[0]
        return SparseArray(reduce(DataFrame.union, frames), grid)
    if all(isinstance(x, WideArray) for x in items):
        for x in items:
            frames.append(x.df.select((F.col(RID) + offset).alias(RID), "row"))
            offset += x.dim[0]
        return WideArray(reduce(DataFrame.union, frames), grid)
    tables = [_dense(x) for x in items]
    names = next((t.columns for t in tables if isinstance(t, DFrame)), tables[0].columns)
    for t in tables:
        values = t.numbers() if kind == "darray" else [quoted(c) for c in t.columns]
        frames.append(t.df.select((F.col(RID) + offset).alias(RID), *(v.alias(n) for v, n in zip(values, names, strict=True))))
        offset += t.dim[0]
    return (DFrame if kind == "dframe" else DArray)(reduce(DataFrame.union, frames), grid, names)


def cbind(*items: DObject) -> DObject:
    """Columns of the first object, then of the next, row by row."""
    kind = _kind(items)
    if len({x.dim[0] for x in items}) != 1:
        raise ValueError("all objects must have as many rows")
    grid = Grid(items[0].grid.rows, tuple(c for x in items for c in x.grid.cols))
    if kind == "sparse":
        offset, frames = 0, []
        for x in items:
            frames.append(x.df.withColumn("j", F.col("j") + offset).select("i", "j", "v"))
            offset += x.dim[1]
        return SparseArray(reduce(DataFrame.union, frames), grid)
    tables = [_dense(x) for x in items]
    names: list[str] = []
    frames = []
    for t in tables:
        own = []
        for c in t.columns:
            name, k = (f"c{len(names) + 1}" if kind == "darray" else c), 0
            while name in names:
                k += 1
                name = f"{c}.{k}"
            names.append(name)
            own.append(quoted(c).alias(name))
        frames.append(t.df.select(RID, *own))
    return (DFrame if kind == "dframe" else DArray)(reduce(lambda a, b: a.join(b, RID), frames), grid, names)
