"""A column as a function of ``dmapply`` sees it: a list whose values lie in a file."""

from __future__ import annotations

import os
import pickle
import tempfile
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator, MutableSequence
from operator import index

import numpy as np


class ColumnValues(MutableSequence):
    """Does what a list does, but reads take one piece into memory at a time.

    The file has no name and goes with the object.  Whatever changes the column takes
    all of it into memory first; pickled, it is a list.
    """

    def __init__(self, pieces: Iterable[bytes]):
        """pieces: of ``packed``, in order."""
        self._file = tempfile.TemporaryFile()
        self._first, self._at = array("q", [0]), array("q", [0])
        for piece in pieces:
            self._file.write(piece[8:])
            self._first.append(self._first[-1] + int.from_bytes(piece[:8], "little"))
            self._at.append(self._at[-1] + len(piece) - 8)
        self._file.flush()
        self._last: tuple[int, list] = (-1, [])
        self._own: list | None = None

    @staticmethod
    def packed(values: list) -> bytes:
        return len(values).to_bytes(8, "little") + pickle.dumps(values)

    def _piece(self, k: int) -> list:
        return pickle.loads(os.pread(self._file.fileno(), self._at[k + 1] - self._at[k], self._at[k]))

    def _pieces(self) -> Iterator[list]:
        return (self._piece(k) for k in range(len(self._at) - 1)) if self._own is None else iter([self._own])

    def _owned(self) -> list:
        if self._own is None:
            self._own = list(self)
        return self._own

    def __len__(self) -> int:
        return self._first[-1] if self._own is None else len(self._own)

    def __iter__(self):
        for piece in self._pieces():
            yield from piece

    def __reversed__(self):
        if self._own is not None:
            yield from reversed(self._own)
            return
        for k in range(len(self._at) - 2, -1, -1):
            yield from reversed(self._piece(k))

    def __getitem__(self, i):
        if self._own is not None:
            return self._own[i]
        if isinstance(i, slice):
            return [self[j] for j in range(*i.indices(len(self)))]
        i, n = index(i), len(self)
        if not -n <= i < n:
            raise IndexError("list index out of range")
        i %= n
        k = bisect_right(self._first, i) - 1
        if self._last[0] != k:
            self._last = (k, self._piece(k))
        return self._last[1][i - self._first[k]]

    def __setitem__(self, i, value) -> None:
        self._owned()[i] = value

    def __delitem__(self, i) -> None:
        del self._owned()[i]

    def insert(self, i: int, value) -> None:
        self._owned().insert(i, value)

    def sort(self, **by) -> None:
        self._owned().sort(**by)

    def copy(self) -> list:
        return list(self)

    def __add__(self, other):
        return list(self) + list(other) if isinstance(other, (list, ColumnValues)) else NotImplemented

    def __radd__(self, other):
        return other + list(self) if isinstance(other, list) else NotImplemented

    def __mul__(self, n):
        return list(self) * n

    __rmul__ = __mul__

    def __eq__(self, other):
        if not isinstance(other, (list, ColumnValues)):
            return NotImplemented
        return len(self) == len(other) and all(a is b or a == b for a, b in zip(self, other, strict=True))

    __hash__ = None

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        whole, at = None, 0
        for piece in self._pieces():
            part = np.array(piece)
            if whole is None:
                whole = np.empty(len(self), part.dtype)
            if part.dtype != whole.dtype or part.ndim != 1 or part.dtype.kind not in "biuf":
                whole = None
                break
            whole[at : at + len(part)] = part
            at += len(part)
        return np.array(list(self), dtype) if whole is None else whole if dtype is None else whole.astype(dtype, copy=False)

    def __reduce__(self):
        return list, (list(self),)

    def __repr__(self) -> str:
        return repr(list(self))
