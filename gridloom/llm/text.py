"""Whole Arrow columns of text as numpy arrays: words, hashes, windows.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, so words never
cross a document and texts are used whole.  Null texts are empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], U64)
_M1, _M2, _M3 = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0xBF58476D1CE4E5B9)
_S32, _S29 = U64(32), U64(29)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; returns a new array."""
    x = x ^ (x >> _S32)
    x *= _M2
    x ^= x >> _S29
    x *= _M3
    x ^= x >> _S32
    return x


class Words:
    """The words of a column: byte spans, and which document holds which.

    ``starts``/``ends`` are byte positions in ``data``; the words of document d
    are ``first[d]:first[d + 1]``.
    """

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        raw = column.buffers()[2] if len(column) else None
        low, high = int(offsets[0]), int(offsets[-1])
        self.data = np.zeros(high - low + 8, np.uint8)  # eight spare bytes for whole 64-bit loads
        if high > low:
            self.data[: high - low] = np.frombuffer(raw, np.uint8)[low:high]
        self.offsets = offsets - low
        n = high - low
        separator = _SEPARATOR[self.data[:n]]
        inside = ~separator
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = edge[:n].copy()
        before[1:] |= separator[:-1]
        self.starts = np.flatnonzero(inside & before)
        after = edge[1:].copy()
        after[:-1] |= separator[1:]
        self.ends = np.flatnonzero(inside & after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64 bits for every word, from all of its bytes."""
        loads = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        at, left = self.starts, self.ends - self.starts
        h = left.astype(U64) * _M1
        live = None
        while len(at):
            part = mix((h if live is None else h[live]) ^ (loads[at] & _MASK[np.minimum(left, 8)]))
            if live is None:
                h, more = part, np.flatnonzero(left > 8)
                live = more
            else:
                h[live] = part
                more = np.flatnonzero(left > 8)
                live = live[more]
            at, left = at[more] + 8, left[more] - 8
        return h


def joined(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive entries of h; order counts.  Length len(h) - n + 1."""
    if len(h) < n:
        return np.zeros(0, U64)
    total, done, power, size = None, 0, h, 1
    while True:
        if n & size:
            total = power if total is None else mix(total[: len(total) - size] * _M1 + power[done : done + len(total) - size])
            done += size
        if done == n:
            return total[: len(h) - n + 1]
        power = mix(power[: len(power) - size] * _M2 + power[size:])
        size *= 2


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive entries."""
    size = 1
    while size * 2 <= n:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    if size < n:
        x = np.minimum(x[: len(x) - (n - size)], x[n - size :])
    return x


def by_bytes(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Slices of a batch with about ``most`` bytes of text each; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def gathered(batches, column: str, most: int):
    """Batches of about ``most`` bytes of text, of whole rows: small ones are put together, large ones are cut."""
    held, size = [], 0
    for batch in batches:
        n = pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if held and size + n > most:
            yield from by_bytes(_together(held), column, most)
            held, size = [], 0
        held.append(batch)
        size += n
    if held:
        yield from by_bytes(_together(held), column, most)


def _together(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)
