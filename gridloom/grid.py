"""Partition grids: how a one- or two-dimensional object is cut into blocks.

All blocks of a grid row have one height and all of a grid column one width, so
a grid is two short lists.  Blocks are numbered from 1, row by row.  Grids are
driver-side metadata: changing one moves no data.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_even(n: int, parts: int) -> list[int]:
    """Sizes of ``parts`` near-equal pieces of n; the first n % parts have one more."""
    if parts < 1:
        raise ValueError("at least one part is needed")
    each, more = divmod(n, parts)
    return [each + (k < more) for k in range(parts)]


def cut(n: int, size: int) -> list[int]:
    """n in pieces of ``size``; the last may be smaller."""
    return [min(size, n - a) for a in range(0, n, size)] or [0]


@dataclass(frozen=True)
class Grid:
    rows: tuple[int, ...]
    cols: tuple[int, ...]

    @classmethod
    def by_size(cls, dim: tuple[int, int], psize: tuple[int, int]) -> Grid:
        return cls(tuple(cut(dim[0], psize[0])), tuple(cut(dim[1], psize[1])))

    @classmethod
    def even(cls, dim: tuple[int, int], nparts: tuple[int, int]) -> Grid:
        return cls(tuple(split_even(dim[0], nparts[0])), tuple(split_even(dim[1], nparts[1])))

    @property
    def nparts(self) -> tuple[int, int]:
        return len(self.rows), len(self.cols)

    @property
    def total(self) -> int:
        return len(self.rows) * len(self.cols)

    @property
    def dim(self) -> tuple[int, int]:
        return sum(self.rows), sum(self.cols)

    def psize(self) -> list[tuple[int, int]]:
        return [(r, c) for r in self.rows for c in self.cols]

    def check(self, k: int) -> None:
        if not isinstance(k, int) or not 1 <= k <= self.total:
            raise IndexError(f"partition {k!r} is not between 1 and {self.total}")

    def block(self, k: int) -> tuple[int, int, int, int]:
        """First and last row, first and last column of block k, 1-based and inclusive."""
        self.check(k)
        r, c = divmod(k - 1, len(self.cols))
        r0, c0 = sum(self.rows[:r]), sum(self.cols[:c])
        return r0 + 1, r0 + self.rows[r], c0 + 1, c0 + self.cols[c]

    def row_block(self, row: int) -> int:
        """0-based grid row of a 1-based row, by binary search."""
        return bisect_left(list(accumulate(self.rows)), row)

    def row_block_column(self, rid: Column) -> Column:
        """The 0-based grid row of each row: arithmetic where heights are equal, else a binary search in codegen."""
        heights = self.rows
        if len(heights) == 1:
            return F.lit(0)
        if len(set(heights[:-1])) == 1 and 0 < heights[-1] <= heights[0]:
            return F.floor((rid - 1) / heights[0]).cast("int")
        return _search(rid, list(accumulate(heights)), 0, len(heights) - 1)


def _search(rid: Column, ends: list[int], low: int, high: int) -> Column:
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(rid <= ends[middle], _search(rid, ends, low, middle)).otherwise(_search(rid, ends, middle + 1, high))
