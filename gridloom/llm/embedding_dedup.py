"""Exact near-duplicate links of embeddings: a metric range join over pivot cells.

Vectors of one label link when their cosine, in double precision, reaches
``threshold``; for unit vectors that is a Euclidean distance of at most
r = sqrt(2 - 2 threshold).

1. Equal vectors of a label collapse into one that counts for all.
2. Each label has pivots of its own, and every vector is at home in the cell of
   its nearest pivot.  By the triangle inequality, whatever lies within r of it is
   at home in a cell whose pivot is at most 2 r farther than its own nearest, and
   the plane half-way between the two pivots must lie within r of it.  Where both
   hold it is replicated to that cell as a guest.  The links of a home vector then
   all lie within its cell.
3. Cells join independently, in blocks of about ``block`` home by ``block``
   candidate vectors, so neither a hot label nor a hot cell meets in one task.
   A block returns link counts and a spanning forest, never the pairs.

Pivots come from a bounded sample (``sample`` vectors of least hash), and each
label has as many as cost least on its part of that sample: where its vectors have
no cells to find (independent directions in many dimensions) replication reaches
all cells and one pivot is best, and the work is that of all pairs of the label.
The choice decides speed alone; every vector is joined.

Defined cases.  Vectors that are null, empty, zero or hold null or non-finite
components, and rows of null label or id, link with nothing and are returned.
Vectors of different dimension never link.  Rows that repeat an id are one node
with the links of both, and each is returned.  Ids and labels are cast to long;
one that is no number fails the job.  Very long vectors are used whole.  An empty
table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.components import components
from gridloom.llm.storage import materialise, ship, tidied

_PACKED = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("vector", pa.binary())])


def _pack(batches):
    """Valid vectors as bytes of doubles, minus zero made zero."""
    for batch in batches:
        ids, labels, vectors = batch.columns
        size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        out = []
        flat = vectors.flatten()
        values = pc.fill_null(flat.cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False) + 0.0
        ends = np.cumsum(size)
        for k, (i, label) in enumerate(zip(ids.to_pylist(), labels.to_pylist(), strict=True)):
            v = values[ends[k] - size[k] : ends[k]]
            if i is not None and label is not None and len(v) and np.isfinite(v).all() and v.any():
                out.append((i, label, len(v), v.tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PACKED.types, strict=True)], schema=_PACKED)


def unit(vectors: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # squares must not overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ pivots.T)))


def cells_of(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each unit vector, and all cells that may hold something within the radius of it."""
    dist = distances(x, pivots)
    home = dist.argmin(1)
    inside = dist <= dist.min(1, keepdims=True) + 2 * radius
    apart = distances(pivots, pivots)[home]
    # how far the plane half-way between the home pivot and another lies
    beyond = (dist**2 - dist[np.arange(len(x)), home][:, None] ** 2) / 2
    inside &= beyond <= radius * apart + 1e-9
    inside[np.arange(len(x)), home] = True
    return home, inside


def choose_pivots(x: np.ndarray, reach: float) -> np.ndarray:
    """As many rows of a sample as make the joins of its cells cheapest, replicas included; reach is twice the radius."""
    best, chosen = math.inf, x[:1]
    far = [0]
    d = distances(x, x[:1])[:, 0]
    while len(far) < min(64, len(x)):  # farthest first, so that pivots spread
        far.append(int(d.argmax()))
        d = np.minimum(d, distances(x, x[far[-1:]])[:, 0])
    for n in (1, 2, 4, 8, 16, 32, 64):
        if n > len(far):
            break
        pivots = x[far[:n]]
        home, inside = cells_of(x, pivots, reach / 2)
        homes = np.bincount(home, minlength=n)
        cost = float((homes * inside.sum(0)).sum()) / len(x) ** 2 + 0.01 * float(inside.sum(1).mean())
        if cost < best:
            best, chosen = cost, pivots
    return chosen


_CELLS = pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("cell", pa.int32()), ("home", pa.bool_()), ("id", pa.int64()), ("copies", pa.int64()), ("vector", pa.binary())])


def _cells(pivots: dict[tuple[int, int], np.ndarray], radius: float):
    def run(batches):
        for batch in batches:
            labels, dims = batch.column("label").to_numpy(), batch.column("dim").to_numpy()
            for label, dim in sorted(set(zip(labels.tolist(), dims.tolist(), strict=True))):
                part = batch.filter(pa.array((labels == label) & (dims == dim)))
                p = pivots.get((label, dim))
                if p is None or len(p) == 1:
                    home, inside = np.zeros(len(part), int), np.ones((len(part), 1), bool)
                else:
                    home, inside = cells_of(unit(part.column("vector").to_pylist()), p, radius)
                row, cell = np.nonzero(inside)
                take = pa.array(row)
                got = {c: part.column(c).take(take) for c in ("label", "dim", "id", "copies", "vector")}
                got |= {"cell": pa.array(cell, pa.int32()), "home": pa.array(cell == home[row])}
                yield pa.RecordBatch.from_arrays([got[c] for c in _CELLS.names], schema=_CELLS)

    return run


_FOUND = pa.schema([("id", pa.int64()), ("n_links", pa.int64()), ("root", pa.int64())])


def _join(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        x = unit(table.column("vector").to_pylist())
        h, c = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out = []
        if len(h) and len(c):
            links = np.zeros(len(h), np.int64)
            root_h, root_c = ids[h].copy(), ids[c].copy()
            parts = [slice(a, a + 1024) for a in range(0, len(h), 1024)]
            masks = []
            for p in parts:
                near = (x[h[p]] @ x[c].T) >= threshold
                near &= ids[h[p]][:, None] != ids[c][None, :]
                links[p] = near @ copies[c]
                masks.append(near)
            changed = True
            while changed:
                changed = False
                for p, near in zip(parts, masks, strict=True):
                    low = np.minimum(root_h[p], np.where(near, root_c[None, :], np.iinfo(np.int64).max).min(1))
                    back = np.minimum(root_c, np.where(near, low[:, None], np.iinfo(np.int64).max).min(0))
                    changed |= bool((low != root_h[p]).any() or (back != root_c).any())
                    root_h[p], root_c = low, back
            keep, other = np.flatnonzero(links), np.flatnonzero(root_c != ids[c])
            out = [np.append(ids[h][keep], ids[c][other]), np.append(links[keep], np.zeros(len(other), np.int64)), np.append(root_h[keep], root_c[other])]
        return pa.Table.from_arrays([pa.array(v, pa.int64()) for v in (out or [[], [], []])], schema=_FOUND)

    return run


def embedding_links(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.93, block: int = 2048, sample: int = 4096) -> DataFrame:
    """id, n_links, component_id, kept: one row per row of vectors."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(embedding).alias("vector"))
    packed = rows.mapInArrow(tidied(_pack), "id long, label long, dim int, vector binary").distinct()
    # a row of one id and vector is one node; so are all ids of one vector, until the end
    members = materialise(packed, "vectors")
    classes = materialise(members.groupBy("label", "dim", "vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "distinct-vectors")

    radius = math.sqrt(2 - 2 * threshold) + 1e-9
    groups: dict[tuple[int, int], list[bytes]] = {}
    for r in classes.orderBy(F.xxhash64("vector"), "id").limit(sample).select("label", "dim", "vector").collect():
        groups.setdefault((r["label"], r["dim"]), []).append(bytes(r["vector"]))
    pivots = spark.sparkContext.broadcast({key: choose_pivots(unit(got), 2 * radius) for key, got in groups.items()})
    cells = materialise(classes.mapInArrow(tidied(lambda batches: _cells(pivots.value, radius)(batches)), "label long, dim int, cell int, home boolean, id long, copies long, vector binary"), "cells")
    key = ["label", "dim", "cell"]
    sizes = cells.groupBy(*key).agg(F.ceil(F.sum(F.col("home").cast("int")) / block).alias("homes"), F.ceil(F.count(F.lit(1)) / block).alias("all"))
    dealt = cells.join(sizes, key)
    spread = F.xxhash64("vector")
    home = dealt.where("home").select(*key, "id", "copies", "vector", F.lit(0).alias("side"), F.pmod(spread, F.greatest("homes", F.lit(1))).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") - 1)).alias("j"))
    candidate = dealt.where("homes > 0").select(*key, "id", "copies", "vector", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("homes") - 1)).alias("i"), F.pmod(spread, F.col("all")).alias("j"))
    found = materialise(home.unionByName(candidate).groupBy(*key, "i", "j").applyInArrow(_join(threshold), "id long, n_links long, root long"), "links")

    # copies link with each other, and all of them with what their vector links with
    links = found.groupBy("id").agg(F.sum("n_links").alias("far"))
    of = members.join(classes.select("label", "dim", "vector", F.col("id").alias("class"), "copies"), ["label", "dim", "vector"]).select("id", "class", "copies")
    edges = found.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")).union(of.where("id != class").select(F.col("id"), F.col("class")))
    joined = components(edges)
    counted = of.join(links.withColumnRenamed("id", "class"), "class", "left").groupBy("id").agg(F.sum(F.col("copies") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    ids = rows.select("id").join(counted, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left")
    root = F.coalesce("component", "id")
    return ids.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).alias("n_links"), root.alias("component_id"), F.col("id").eqNullSafe(root).alias("kept"))

