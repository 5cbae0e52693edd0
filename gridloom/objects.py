"""Distributed lists, arrays and frames: a DataFrame and a grid.

========== ============================================== ==================
object     rows                                           missing value
========== ============================================== ==================
DList      idx (1-based), value, optionally name          NULL
DFrame     __rid (1-based) and named columns              NULL
DArray     __rid and double columns c1..cp                NULL
WideArray  __rid and one array<double>, for many columns  NULL
SparseArray i, j, v (1-based); what is absent is 0        NULL
========== ============================================== ==================

Everything is lazy until ``collect``.  Heterogeneous list items are pickled.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom import session
from gridloom.grid import Grid
from gridloom.index import RID

ROWNAME = "__rowname"


class DObject:
    """What all distributed objects share."""

    grid: Grid
    kind = "dobject"
    #: Of a view that parts() made: the object and the number of the partition.
    origin: tuple[DObject, int] | None = None

    def __init__(self, df: DataFrame | Callable[[], DataFrame], grid: Grid):
        self._df, self.grid = df, grid

    @property
    def df(self) -> DataFrame:
        """The rows; those of a view are planned when they are first asked for."""
        if not isinstance(self._df, DataFrame):
            self._df = self._df()
        return self._df

    @df.setter
    def df(self, rows: DataFrame) -> None:
        self._df = rows

    @property
    def nparts(self) -> tuple[int, int]:
        return self.grid.nparts

    @property
    def total_parts(self) -> int:
        return self.grid.total

    def psize(self, index: int | list[int] | None = None) -> list[tuple[int, int]]:
        sizes = self.grid.psize()
        if index is None:
            return sizes
        wanted = [index] if isinstance(index, int) else list(index)
        for k in wanted:
            self.grid.check(k)
        return [sizes[k - 1] for k in wanted]

    @property
    def dim(self) -> tuple[int, int]:
        return self.grid.dim

    def __len__(self) -> int:
        return self.dim[0] * self.dim[1]

    def part(self, k: int) -> DObject:
        raise NotImplementedError

    def parts(self, index: int | list[int] | None = None) -> list[DObject]:
        """Views of single partitions, in the order asked for; repeats are honoured."""
        wanted = range(1, self.total_parts + 1) if index is None else [index] if isinstance(index, int) else index
        views = []
        for k in wanted:
            view = self.part(k)
            view.origin = (self, k)
            views.append(view)
        return views

    def _local(self):
        raise NotImplementedError

    def collect(self, index: int | list[int] | None = None):
        """The whole object as a local value, or some partitions of it (more than one for lists only)."""
        if index is None:
            return self._local()
        wanted = [index] if isinstance(index, int) else list(index)
        if len(wanted) > 1 and self.kind != "dlist":
            raise ValueError("one partition, or all, can be collected")
        return self.part(wanted[0])._local() if len(wanted) == 1 else [x for k in wanted for x in self.part(k)._local()]

    def __repr__(self) -> str:
        sizes = ", ".join(f"[{r}, {c}]" for r, c in self.psize()[:5]) + (", ..." if self.total_parts > 5 else "")
        return f"{self.kind}: {self.dim[0]} x {self.dim[1]}, {self.total_parts} partitions ({self.nparts[0]} x {self.nparts[1]}), sizes {sizes}; backend {session.current().name}"


class DList(DObject):
    kind = "dlist"

    def __init__(self, df: DataFrame, sizes: list[int], pickled: bool = False, named: bool = False):
        super().__init__(df, Grid(tuple(sizes), (1,)))
        self.pickled, self.named = pickled, named

    def __len__(self) -> int:
        return self.dim[0]

    @property
    def columns(self) -> list[str]:
        return ["idx", "value"] + ["name"] * self.named

    def part(self, k: int) -> DList:
        first, last, _, _ = self.grid.block(k)
        return DList(lambda: self.df.where(F.col("idx").between(first, last)).withColumn("idx", F.col("idx") - (first - 1)), [last - first + 1], self.pickled, self.named)

    def load(self, value):
        return pickle.loads(value) if self.pickled and value is not None else value

    def _local(self) -> list:
        return [self.load(r["value"]) for r in self.df.orderBy("idx").select("value").collect()]

    def names(self) -> list[str] | None:
        return [r["name"] for r in self.df.orderBy("idx").select("name").collect()] if self.named else None

    def with_names(self, names: list[str]) -> DList:
        if len(names) != len(self):
            raise ValueError(f"{len(names)} names for {len(self)} items")
        table = self.df.sparkSession.createDataFrame(list(enumerate(names, 1)), "idx long, name string")
        return DList(self.df.drop("name").join(table, "idx"), list(self.grid.rows), self.pickled, True)

    def by_name(self, name: str) -> list:
        """The items of that name."""
        if not self.named:
            return []
        return [self.load(r["value"]) for r in self.df.where(F.col("name") == name).orderBy("idx").collect()]


class Table(DObject):
    """Two dimensions, rows numbered by __rid; the columns are DataFrame columns."""

    def __init__(self, df: DataFrame, grid: Grid, columns: list[str] | None = None):
        super().__init__(df, grid)
        self.columns = columns if columns is not None else [c for c in df.columns if c not in (RID, ROWNAME)]

    def _like(self, df: DataFrame, grid: Grid, columns: list[str]) -> Table:
        return type(self)(df, grid, columns)

    @property
    def named_rows(self) -> bool:
        return ROWNAME in self.df.columns

    def part(self, k: int) -> Table:
        r0, r1, c0, c1 = self.grid.block(k)
        columns = self.columns[c0 - 1 : c1]

        def view() -> DataFrame:
            keep = [ROWNAME] if self.named_rows else []
            return self.df.where(F.col(RID).between(r0, r1)).select((F.col(RID) - (r0 - 1)).alias(RID), *keep, *map(quoted, columns))

        return self._like(view, Grid((r1 - r0 + 1,), (c1 - c0 + 1,)), columns)

    def numbers(self) -> list[Column]:
        """All columns as doubles: booleans count as 0 and 1."""
        kinds = {f.name: f.dataType for f in self.df.schema}
        return [(quoted(c).cast("int") if isinstance(kinds[c], T.BooleanType) else quoted(c)).cast("double") for c in self.columns]

    def colnames(self) -> list[str]:
        return list(self.columns)

    def rownames(self) -> list[str] | None:
        return [r[0] for r in self.df.orderBy(RID).select(ROWNAME).collect()] if self.named_rows else None

    def with_colnames(self, names: list[str]) -> Table:
        if len(names) != len(self.columns):
            raise ValueError(f"{len(names)} names for {len(self.columns)} columns")
        keep = [ROWNAME] if self.named_rows else []
        return self._like(self.df.select(RID, *keep, *(quoted(a).alias(b) for a, b in zip(self.columns, names, strict=True))), self.grid, list(names))

    def with_rownames(self, names: list[str]) -> Table:
        if len(names) != self.dim[0]:
            raise ValueError(f"{len(names)} names for {self.dim[0]} rows")
        table = self.df.sparkSession.createDataFrame(list(enumerate(names, 1)), f"{RID} long, {ROWNAME} string")
        return self._like(self.df.drop(ROWNAME).join(table, RID), self.grid, self.columns)

    def dimnames(self) -> tuple[list[str] | None, list[str]]:
        return self.rownames(), self.colnames()

    def by_name(self, name: str) -> DataFrame:
        return self.df.select(RID, quoted(name))

    def _pandas(self) -> pd.DataFrame:
        keep = [ROWNAME] if self.named_rows else []
        got = self.df.orderBy(RID).select(*keep, *map(quoted, self.columns)).toPandas()
        return got.set_index(ROWNAME).rename_axis(None) if keep else got


class DFrame(Table):
    kind = "dframe"

    def __len__(self) -> int:
        return self.dim[1]

    def _local(self) -> pd.DataFrame:
        return self._pandas()


class DArray(Table):
    kind = "darray"

    def _local(self) -> np.ndarray:
        return self._pandas().to_numpy(float).reshape(self.dim)

    def coo(self) -> DataFrame:
        """i, j, v of every cell."""
        cells = F.posexplode(F.array(*self.numbers()))
        return self.df.select(F.col(RID).alias("i"), cells.alias("j", "v")).withColumn("j", F.col("j") + F.lit(1).cast("long"))


class WideArray(DArray):
    """A dense array of many columns: one array per row, so that plans stay small."""

    def __init__(self, df: DataFrame, grid: Grid, columns: list[str] | None = None):
        super().__init__(df, grid, ["row"])

    def part(self, k: int) -> WideArray:
        r0, r1, c0, c1 = self.grid.block(k)
        return WideArray(lambda: self.df.where(F.col(RID).between(r0, r1)).select((F.col(RID) - (r0 - 1)).alias(RID), F.slice("row", c0, c1 - c0 + 1).alias("row")), Grid((r1 - r0 + 1,), (c1 - c0 + 1,)))

    def colnames(self) -> list[str]:
        return [f"c{j}" for j in range(1, self.dim[1] + 1)]

    def _local(self) -> np.ndarray:
        rows = self.df.orderBy(RID).select("row").toPandas()["row"]
        return np.array(rows.tolist(), float).reshape(self.dim)

    def coo(self) -> DataFrame:
        return self.df.select(F.col(RID).alias("i"), F.posexplode("row").alias("j", "v")).withColumn("j", F.col("j") + F.lit(1).cast("long"))


class SparseArray(DObject):
    kind = "sparse_darray"

    def part(self, k: int) -> SparseArray:
        r0, r1, c0, c1 = self.grid.block(k)
        return SparseArray(lambda: self.df.where(F.col("i").between(r0, r1) & F.col("j").between(c0, c1)).select((F.col("i") - (r0 - 1)).alias("i"), (F.col("j") - (c0 - 1)).alias("j"), "v"), Grid((r1 - r0 + 1,), (c1 - c0 + 1,)))

    def _local(self) -> np.ndarray:
        out = np.zeros(self.dim)
        for r in self.df.collect():
            out[r["i"] - 1, r["j"] - 1] = np.nan if r["v"] is None else r["v"]
        return out

    def coo(self) -> DataFrame:
        return self.df


def one_backend(*items: DObject) -> None:
    """Objects can meet only within one application."""
    if len({x.df.sparkSession.sparkContext.applicationId for x in items}) > 1:
        raise ValueError("the objects belong to different backends")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def is_dobject(x) -> bool:
    return isinstance(x, DObject)


def is_dlist(x) -> bool:
    return isinstance(x, DList)


def is_darray(x) -> bool:
    return isinstance(x, (DArray, SparseArray))


def is_sparse_darray(x) -> bool:
    return isinstance(x, SparseArray)


def is_dframe(x) -> bool:
    return isinstance(x, DFrame)
