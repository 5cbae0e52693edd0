"""Selection by position: indices are 1-based, keep their order and may repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.grid import Grid, split_even
from gridloom.index import RID
from gridloom.objects import DList, DObject, SparseArray, Table, WideArray, quoted


def _checked(wanted, n: int) -> list[int]:
    wanted = [wanted] if isinstance(wanted, int) else list(wanted)
    for k in wanted:
        if isinstance(k, bool) or not isinstance(k, int) or not 1 <= k <= n:
            raise IndexError(f"index {k!r} is not between 1 and {n}")
    return wanted


def _rows(df: DataFrame, key: str, wanted: list[int]) -> DataFrame:
    """The wanted rows with their position in the request; the range of the request prunes the scan."""
    request = df.sparkSession.createDataFrame(list(enumerate(wanted, 1)), f"pos long, {key} long")
    return df.where(F.col(key).between(min(wanted), max(wanted))).join(request, key)


def index(x: DObject, i, j=None) -> DataFrame:
    """x[i, j] (or x[i] of a list): pos and the values, one row per row asked for."""
    if isinstance(x, DList):
        return _rows(x.df, "idx", _checked(i, len(x))).select("pos", "idx", "value")
    if j is None:
        raise TypeError("two indices are needed")
    rows, cols = _checked(i, x.dim[0]), _checked(j, x.dim[1])
    if isinstance(x, SparseArray):
        # absent cells are 0, so the request drives the join
        request = x.df.sparkSession.createDataFrame([(p, r, q, c) for p, r in enumerate(rows, 1) for q, c in enumerate(cols, 1)], "pos long, i long, col long, j long")
        return request.join(x.df, ["i", "j"], "left").select("pos", "col", F.coalesce("v", F.lit(0.0)).alias("v"))
    found = _rows(x.df, RID, rows)
    if isinstance(x, WideArray):
        return found.select("pos", *(F.col("row")[c - 1].alias(f"c{q}") for q, c in enumerate(cols, 1)))
    names, seen = [], {}
    for c in cols:
        name = x.columns[c - 1]
        seen[name] = seen.get(name, 0) + 1
        names.append(quoted(name).alias(name if seen[name] == 1 else f"{name}.{seen[name] - 1}"))
    return found.select("pos", *names)


def element(x: DObject, i: int, j: int | None = None):
    """x[[i]] or x[[i, j]]: one local value."""
    if isinstance(x, DList):
        return x.load(index(x, i).first()["value"])
    row = index(x, i, j).first()
    return row[-1]


def _slice(x: DObject, first: int, last: int) -> DObject:
    if isinstance(x, DList):
        n = max(0, last - first + 1)
        return DList(x.df.where(F.col("idx").between(first, last)).withColumn("idx", F.col("idx") - (first - 1)), split_even(n, 1), x.pickled, x.named)
    n = max(0, last - first + 1)
    grid = Grid((n,), x.grid.cols)
    if isinstance(x, SparseArray):
        return SparseArray(x.df.where(F.col("i").between(first, last)).withColumn("i", F.col("i") - (first - 1)), grid)
    view = x.df.where(F.col(RID).between(first, last)).withColumn(RID, F.col(RID) - (first - 1))
    return WideArray(view, grid) if isinstance(x, WideArray) else x._like(view, grid, x.columns)


def _length(x: DObject) -> int:
    return len(x) if isinstance(x, DList) else x.dim[0]


def head(x: DObject, n: int = 6) -> DObject:
    if n < 0:
        raise ValueError("n must not be negative")
    return _slice(x, 1, min(n, _length(x)))


def tail(x: DObject, n: int = 6) -> DObject:
    if n < 0:
        raise ValueError("n must not be negative")
    size = _length(x)
    return _slice(x, size - min(n, size) + 1, size)


def reverse(x: DList) -> DList:
    """The items from last to first."""
    return DList(x.df.withColumn("idx", F.lit(len(x) + 1).cast("long") - F.col("idx")), list(x.grid.rows[::-1]), x.pickled, x.named)


def by_name(x: DObject, name: str):
    """x$name: the column of a frame, the items of a list."""
    if isinstance(x, (DList, Table)):
        return x.by_name(name)
    raise TypeError("this object has no names")
