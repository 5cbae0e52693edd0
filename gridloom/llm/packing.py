"""Packing of token sequences by a configuration linear program.

A configuration is a multiset of lengths that fits one sequence.  The program
covers the histogram of piece lengths, at most ``capacity`` numbers and so the
only thing that reaches the driver, with as few configurations as possible:

* multiplicative weights: a price for each length, l / capacity at first; after
  every covering it is multiplied by a power of what a piece of that length cost
  there, its share of the sequences that held it.  Steps become smaller;
* pricing: a knapsack dynamic program gives the greatest price within every
  capacity.  It scales the prices so that no configuration is worth more than 1,
  which makes their sum over all pieces a lower bound of any packing, and it
  guides the covering, which takes for each length the configurations of the
  greatest price that hold it, until their pieces are used up;
* rounding: configurations are used as often as the floor of their amount, and
  what is left is covered in whole sequences in the same way;
* it ends when the bound proves the rounding optimal, when program and bound
  meet, or when neither moves any more.

Configurations and how often each is used are a table of bounded size.  Pieces
of a length are ranked by hash (slices of a length are numbered apart, so a
length that most pieces have is no hot group) and a binary search gives each
rank its sequence and offset.

Defined cases.  Null texts are empty and still have the end id.  Rows that
repeat an id, and null ids, are pieces of their own.  An empty table gives an
empty result.  Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.ranking import spread_rank
from gridloom.llm.storage import materialise, ship, tidied
from gridloom.llm.text import gathered
from gridloom.llm.tokens import SLICE, encoder, with_end

Pattern = tuple[tuple[int, ...], int]

_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _pieces(vocabulary: str, capacity: int, end: int):
    def run(batches):
        code = encoder(vocabulary)
        for batch in gathered(batches, "text", SLICE):
            ids, counts = with_end(*code.encode_column(batch.column("text")), end)
            n = -(-counts // capacity)  # the first piece has what is over
            of = np.repeat(np.arange(len(counts)), n)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            first = counts - (n - 1) * capacity
            length = np.where(piece == 0, first[of], capacity)
            start = np.where(piece == 0, 0, first[of] + (piece - 1) * capacity)
            at = (np.cumsum(counts) - counts)[of] + start
            view = memoryview(ids.astype("<u4")).cast("B") if len(ids) else b""
            sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(sums, pa.int64())], schema=_PIECE)

    return run


@dataclass
class Program:
    """A fractional covering of the histogram: how often each configuration is used."""

    amounts: dict[tuple[int, ...], float]
    value: float  #: sequences that it uses
    bound: float  #: sequences that no packing can do without, by the prices
    patterns: list[Pattern]  #: its rounding: whole sequences that hold every piece once

    @property
    def sequences(self) -> int:
        return _number(self.patterns)

    @property
    def gap(self) -> float:
        return self.value / self.bound - 1 if self.bound else 0.0


def best_values(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """The knapsack dynamic program: the greatest total price of pieces within each capacity up to this one."""
    best = np.zeros(capacity + 1)
    if not len(lengths):
        return best
    if int((capacity // lengths).sum()) < capacity:  # few lengths, or long ones: a length at a time
        for length, price in zip(lengths.tolist(), prices.tolist(), strict=True):
            for a in range(length, capacity + 1, length):
                b = min(a + length, capacity + 1)
                np.maximum(best[a:b], best[a - length : b - length] + price, out=best[a:b])
        return np.maximum.accumulate(best)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for c in range(int(lengths[0]), capacity + 1):
        got = best[c - lengths[: fits[c]]]
        got += prices[: fits[c]]
        best[c] = max(best[c - 1], got.max())
    return best


class _Covering:
    """One pass over the histogram: each length in turn is covered by the configurations of the greatest price that hold it."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.fits = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()

    def __call__(self, demand: np.ndarray, prices: np.ndarray, best: np.ndarray, order: list[int], tie: float, whole: bool) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
        """Amounts, and the cost of a piece of each length: its share, by price, of the sequences that hold it."""
        left = np.array(demand, np.int64 if whole else float)
        least = np.ones(len(left)) if whole else 1e-9 * demand
        shown = prices + tie * self.lengths
        shown[left < least] = -np.inf
        size, price = self.lengths.tolist(), prices.tolist()
        cost = np.zeros(len(left))
        amounts: dict[tuple[int, ...], float] = {}
        for i in order:
            while left[i] >= least[i]:
                held, c, spent, j = {}, self.capacity, [], i
                while True:
                    held[j] = held.get(j, 0) + 1
                    c -= size[j]
                    if whole and held[j] == left[j]:  # none of these is left for this sequence
                        spent.append(j)
                        shown[j] = -np.inf
                    k = self.fits[c]
                    if not k:
                        break
                    score = best[c - self.lengths[:k]]
                    score += shown[:k]
                    j = int(score.argmax())
                    if score[j] == -np.inf:
                        break
                for j in spent:
                    shown[j] = prices[j] + tie * size[j]
                x = min(left[j] // k if whole else left[j] / k for j, k in held.items())
                value = sum(price[j] * k for j, k in held.items())
                for j, k in held.items():
                    left[j] -= x * k
                    cost[j] += x * k / value
                    if left[j] < least[j]:
                        shown[j] = -np.inf
                pattern = tuple(sorted(size[j] for j, k in held.items() for _ in range(k)))[::-1]
                amounts[pattern] = amounts.get(pattern, 0) + x
        return amounts, cost / np.maximum(demand, 1)


def solve(counts: np.ndarray, capacity: int, tolerance: float = 2e-4, rate: float = 1.0, patience: int = 12) -> Program:
    """The configuration program of a histogram, and its rounding.

    Ends when the dual bound proves the rounding optimal, when the gap is
    closed, or when neither side moves at smaller and smaller steps.
    """
    counts = np.asarray(counts, np.int64)
    lengths = np.flatnonzero(counts) + 1
    demand = counts[lengths - 1].astype(float)
    if not len(lengths):
        return Program({}, 0.0, 0.0, [])
    cover = _Covering(lengths, capacity)
    prices = center = lengths / capacity
    longest = np.argsort(-lengths, kind="stable").tolist()
    order, found, bound, still, n = longest, Program({}, math.inf, 0.0, []), 0.0, 0, 0
    while True:
        best = best_values(lengths, prices, capacity)
        prices, best = prices / best[capacity], best / best[capacity]
        moved = False
        if (dual := float(demand @ prices)) > bound:  # no configuration is worth more than 1 at these prices
            moved, bound, center = dual > bound * (1 + tolerance / 4), dual, prices
        amounts, cost = cover(demand, prices, best, order, (1e-7, 0.0, -1e-7)[n % 3], False)
        value = float(sum(amounts.values()))
        if value < found.value:
            moved = moved or value < found.value * (1 - tolerance / 4)
            found.amounts, found.value = amounts, value
        if not found.patterns or value <= found.sequences:
            patterns = rounded(amounts, counts, capacity, prices)
            if not found.patterns or _number(patterns) < found.sequences:
                moved, found.patterns = True, patterns
        if found.sequences < found.value:  # then the rounding is the better covering
            found.amounts, found.value = {p: float(k) for p, k in found.patterns}, float(found.sequences)
        still = 0 if moved else still + 1
        if found.sequences <= math.ceil(bound - 1e-6) or max(found.value, found.sequences) <= bound * (1 + tolerance):
            break
        n += 1
        if still >= patience:  # from the best prices again, in smaller steps
            rate, still, prices = rate / 4, 0, center
            if rate < 0.05:
                break
        else:
            prices = prices * cost ** (rate / math.sqrt(n))
        order = np.argsort(-cost, kind="stable").tolist() if n % 2 else longest
    found.bound = bound
    return found


def _fullest(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """The longest piece that is left, and with it what fills its sequence best, of long pieces first."""
    left = {int(length): int(counts[length - 1]) for length in np.flatnonzero(counts)[::-1] + 1}
    out: dict[tuple[int, ...], int] = {}
    while left:
        first = next(iter(left))
        room = capacity - first
        reach, steps = 1, []
        limit = (1 << (room + 1)) - 1
        for length, n in left.items():
            n = min(n - (length == first), room // length)
            many = 1
            while n > 0 and not reach >> room & 1:
                many = min(many, n)
                steps.append((length, many, reach))
                reach |= reach << (length * many) & limit
                n, many = n - many, many * 2
        c, pattern = reach.bit_length() - 1, [first]
        for length, many, before in reversed(steps):
            if not before >> c & 1:
                pattern += [length] * many
                c -= length * many
        held = Counter(pattern)
        times = min(left[length] // k for length, k in held.items())
        key = tuple(sorted(pattern, reverse=True))
        out[key] = out.get(key, 0) + times
        for length, k in held.items():
            left[length] -= times * k
            if not left[length]:
                del left[length]
    return list(out.items())


def rounded(amounts: dict[tuple[int, ...], float], counts: np.ndarray, capacity: int, prices: np.ndarray) -> list[Pattern]:
    """Whole numbers of sequences for every piece of the histogram.

    Each configuration is used as often as its amount holds whole.  The pieces
    that are left, fewer than the configurations have, are covered in whole
    sequences at the program's prices (of each length that occurs), short or
    long pieces first, or as full as can be; the least of these roundings is taken.
    """
    whole = [(p, int(x + 1e-9)) for p, x in amounts.items() if x + 1e-9 >= 1]
    rest = counts.copy()
    for p, n in whole:
        np.subtract.at(rest, np.array(p) - 1, n)
    lengths = np.flatnonzero(rest) + 1
    if not len(lengths):
        return whole
    left, prices = rest[lengths - 1], prices[rest[counts > 0] > 0]
    cover, best = _Covering(lengths, capacity), best_values(lengths, prices, capacity)
    order = list(range(len(lengths)))[::-1]
    tries = [_fullest(rest, capacity), *(list(cover(left, prices, best, order, tie, True)[0].items()) for tie in (1e-7, -1e-7))]
    return [(p, int(n)) for p, n in whole + min(tries, key=_number)]


def _number(patterns: list[Pattern]) -> int:
    return int(sum(n for _, n in patterns))


def pack(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """(lengths, how often) so that every piece of the histogram is in one sequence."""
    return solve(counts, capacity).patterns


def _slots(patterns: list[Pattern]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length, first rank), and the first sequence and the offset of each run of ranks."""
    rows, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, n, sequence, offset))
            offset += length
        sequence += n
    if not rows:
        return (np.zeros(0, np.int64),) * 3
    t = np.array(rows, np.int64)
    t = t[np.argsort(t[:, 0], kind="stable")]
    total = np.cumsum(t[:, 1]) - t[:, 1]
    first = np.searchsorted(t[:, 0], t[:, 0])
    return _key(t[:, 0], total - total[first]), t[:, 2], t[:, 3]


def _key(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return (length << 44) | rank


_PLACED = pa.schema([*_PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _place(keys: np.ndarray, sequences: np.ndarray, offsets: np.ndarray):
    def run(batches):
        for batch in batches:
            key = _key(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            at = np.searchsorted(keys, key, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _PIECE.names), pa.array(sequences[at] + key - keys[at]), pa.array(offsets[at])], schema=_PLACED)

    return run


def packed(docs: DataFrame, vocabulary: str, capacity: int = 2048, id: str = "doc_id", text: str = "text", end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    names = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = materialise(rows.mapInArrow(tidied(_pieces(vocabulary, capacity, end)), names), "pieces")
    counts = np.zeros(capacity, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length - 1] = n
    slots = spark.sparkContext.broadcast(_slots(pack(counts, capacity)))
    ranked = spread_rank(pieces.withColumn("_order", F.xxhash64("doc_id", "piece", "ids_crc32")), ["length"], "_order", ["doc_id", "piece", "ids_crc32"])
    return ranked.select(*_PIECE.names, "rank").mapInArrow(tidied(lambda batches: _place(*slots.value)(batches)), f"{names}, sequence_id long, offset long").withColumnRenamed("doc_id", id)
