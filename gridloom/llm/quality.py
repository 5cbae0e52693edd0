"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts, a slice of an Arrow column at a time: shares
of byte classes, shapes of words, and how much words and word triples repeat.
Trees grow on quantile bins by gradients of the logistic loss and are flattened
into arrays, which numpy walks for all documents of a slice at once.

Labels are learned from at most ``sample`` rows (those of least hash of their
id), a documented bound; scoring covers every document in one pass without a
shuffle.  Rows whose crc32 of the id, as text, is 0 modulo ``folds`` are held
out of learning.  Labels, ids, languages and sources are no statistics.

Defined cases.  Null texts are empty; an empty text has statistics (all zero)
and so a score.  Null labels and labels of null id are ignored; of repeated
labels of an id the greatest counts.  Without labels, or with one kind only, the
score is the share of label 1, or 0.5.  Null ids are never held out.  Other
columns pass through ``accepted`` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.storage import ship, tidied
from gridloom.llm.text import U64, Words, by_bytes, joined, mix

_CLASSES = 16
_CLASS = np.full(256, 14, np.uint8)  # 14: other control bytes
_CLASS[128:] = 15
for _byte in range(33, 127):
    _c = chr(_byte)
    _CLASS[_byte] = 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else {"!": 5, "?": 6, ".": 7, ",": 8, "|": 9, ":": 10, "'": 11, '"': 11, "-": 13}.get(_c, 12)
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 3
_CLASS[0x0A] = 4


def statistics(column: pa.Array) -> np.ndarray:
    """One row of numbers per text."""
    words = Words(column)
    n = len(words.first) - 1
    size = np.diff(words.offsets)
    kinds = _CLASS[words.data[: int(words.offsets[-1])]]
    of_byte = np.repeat(np.arange(n), size)
    shares = np.bincount(of_byte * _CLASSES + kinds, minlength=n * _CLASSES).reshape(n, _CLASSES).astype(float)
    lines = shares[:, 4] + 1
    bytes_ = np.maximum(size, 1)
    count = words.counts()
    many = np.maximum(count, 1)
    of = np.repeat(np.arange(n), count)
    length = (words.ends - words.starts).astype(float)
    total = lambda x: np.bincount(of, x, n)
    mean = total(length) / many
    first, last = (kinds[words.starts], kinds[words.ends - 1]) if len(of) else (kinds[:0], kinds[:0])
    capital, second = first == 1, kinds[np.minimum(words.starts + 1, len(kinds) - 1)] if len(of) else kinds[:0]
    h = words.hashes()

    def distinct(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Different hashes of each document."""
        key = mix(hashes ^ mix(at.astype(U64) + U64(1)))
        order = np.argsort(key)
        new = np.ones(len(key), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        return np.bincount(at[order][new], minlength=n)

    triple = joined(h, 3)
    inside = of[: len(triple)] == of[2:] if len(triple) else np.zeros(0, bool)
    triples = np.bincount(of[: len(triple)][inside], minlength=n)
    return np.column_stack(
        [
            shares / bytes_[:, None],
            np.log1p(size),
            np.log1p(count),
            mean,
            np.sqrt(np.maximum(0, total(length * length) / many - mean * mean)),
            total(length <= 2) / many,
            total(length > 12) / many,
            distinct(h, of) / many,
            distinct(triple[inside], of[: len(triple)][inside]) / np.maximum(triples, 1),
            total(capital) / many,
            total(capital & (second == 1)) / many,
            total(np.isin(last, (5, 6))) / many,
            total(np.isin(last, (9, 10, 12, 13))) / many,
            total(np.isin(last, (7, 8))) / many,
            total(last == 2) / many,
            count / lines,
            np.log1p(lines),
        ]
    )


@dataclass
class Trees:
    """All trees in flat arrays: a leaf has feature -1; children are indices; rows with x <= threshold go left."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                go = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[node], self.left[node], self.right[node])
                node = np.where(f < 0, node, go)
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def train(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 5, rate: float = 0.1, bins: int = 64, l2: float = 1.0, least: float = 1.0) -> Trees:
    """Boosted trees by histograms of gradients; y is 0 or 1."""
    n = len(y)
    share = float(np.mean(y)) if n else 0.5
    share = min(max(share, 1e-6), 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    nodes: list[list] = []
    roots: list[int] = []
    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
        margin = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, hess = p - y, p * (1 - p)
            roots.append(len(nodes))
            nodes.append([-1, 0.0, 0, 0, 0.0])
            at = np.full(n, roots[-1])
            level = [roots[-1]]
            for step in range(depth + 1):
                slot = np.full(len(nodes), -1)
                slot[level] = np.arange(len(level))
                mine = slot[at]
                live = np.flatnonzero(mine >= 0)
                m = mine[live]
                gs, hs = np.bincount(m, g[live], len(level)), np.bincount(m, hess[live], len(level))
                for k, node in enumerate(level):
                    nodes[node][4] = -rate * gs[k] / (hs[k] + l2)
                if step == depth:
                    break
                best = np.full(len(level), 1e-6)
                choice: list[tuple[int, int] | None] = [None] * len(level)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    key = m * (len(c) + 1) + binned[live, f]
                    gl = np.bincount(key, g[live], len(level) * (len(c) + 1)).reshape(len(level), -1).cumsum(1)[:, :-1]
                    hl = np.bincount(key, hess[live], len(level) * (len(c) + 1)).reshape(len(level), -1).cumsum(1)[:, :-1]
                    gr, hr = gs[:, None] - gl, hs[:, None] - hl
                    gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + l2) + gr**2 / (hr + l2) - (gs**2 / (hs + l2))[:, None], 0)
                    top = gain.argmax(1)
                    for k in np.flatnonzero(gain[np.arange(len(level)), top] > best):
                        best[k], choice[k] = gain[k, top[k]], (f, int(top[k]))
                after = []
                for k, node in enumerate(level):
                    if choice[k] is None:
                        continue
                    f, b = choice[k]
                    nodes[node][:4] = [f, float(cuts[f][b]), len(nodes), len(nodes) + 1]
                    after += [len(nodes), len(nodes) + 1]
                    nodes += [[-1, 0.0, 0, 0, 0.0], [-1, 0.0, 0, 0, 0.0]]
                    here = live[m == k]
                    at[here] = np.where(binned[here, f] <= b, nodes[node][2], nodes[node][3])
                if not after:
                    break
                level = after
            margin += np.array([x[4] for x in nodes])[at]
    table = list(zip(*nodes, strict=True)) if nodes else [[]] * 5
    return Trees(np.array(table[0], np.int64), np.array(table[1], float), np.array(table[2], np.int64), np.array(table[3], np.int64), np.array(table[4], float), np.array(roots, np.int64), depth, base)


def held_out(id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def _measured(batches):
    for whole in batches:
        for batch in by_bytes(whole, "text"):
            x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, sample: int = 20_000, **settings) -> Trees:
    """Learn from labelled documents that are not held out."""
    ship(docs.sparkSession)
    known = labels.select(F.col(id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    known = known.where(~held_out(F.col("doc_id"), folds)).groupBy("doc_id").agg(F.max("label").alias("label"))
    # at most `sample` pairs of numbers, so they can be broadcast
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    got = rows.mapInArrow(tidied(_measured), "doc_id long, label int, x array<double>").orderBy("doc_id", F.xxhash64("x")).limit(sample).toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), -1 if len(got) else 0)
    return train(x, got["label"].to_numpy().astype(float), **settings)


def scored(docs: DataFrame, model: Trees, id: str = "doc_id", text: str = "text", threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """id, held_out, score, predicted: one row per row of docs."""
    ship(docs.sparkSession)

    def run(batches):
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                s = model.score(statistics(batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id).cast("long").alias("id"), held_out(F.col(id), folds).alias("held_out"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(tidied(run), "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id)


def accepted(docs: DataFrame, model: Trees, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns."""
    ship(docs.sparkSession)

    def run(batches):
        for whole in batches:
            for batch in by_bytes(whole, text):
                s = model.score(statistics(batch.column(text)))
                yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(tidied(run), docs.schema)
