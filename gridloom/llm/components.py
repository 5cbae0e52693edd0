"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.storage import forget, materialise, ship, tidied

#: Edges, at most, that one task merges; more go through the rounds.
_SMALL = 1 << 18


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (least node reachable) for every node that an edge joins to another: a table.

    Each round links every node to its least neighbour, by aggregates that
    combine before the shuffle and joins on the node, and is written to the
    shared folder; the tables of the round before are removed.  It ends when all
    that is left are stars, or so few edges that one task merges them (``_SMALL``,
    4 MB).  Only counts reach the driver.
    """
    ship(edges.sparkSession)
    big, small = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    state = materialise(edges.where(F.col(a) != F.col(b)).select(big, small).distinct(), "edges")
    while True:
        if state.count() <= _SMALL:
            merged = materialise(state.coalesce(1).mapInArrow(tidied(_merged), "node long, component long"), "merged-edges")
            forget(state)
            return merged
        if _stars(state):
            break
        least = state.union(state.select("v", "u")).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = materialise(least, "least")  # tables on both sides, so that the joins can split a hot node
        large = state.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        # the least neighbour of each node is linked to it, too
        large = large.union(least.where("m < u").select("u", F.col("m").alias("v"))).where("u != v").distinct()
        large = materialise(large, "stars")
        root = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "roots")
        before = state
        hop = large.join(root, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = materialise(hop.union(root.select("u", F.col("m").alias("v"))).distinct(), "edges")
        forget(before, least, large, root)
    # a node's one neighbour is its root
    merged = materialise(state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(state.select("v", "v").distinct()), "merged-edges")
    forget(state)
    return merged


def _merged(batches):
    """The components of all edges of one task: roots take the least root that an edge leads to, until no edge joins two."""
    held = [(batch.column("u").to_numpy(), batch.column("v").to_numpy()) for batch in batches]
    if not held:
        return
    u, v = (np.concatenate(x) for x in zip(*held, strict=True))
    nodes, ends = np.unique(np.append(u, v), return_inverse=True)
    u, v = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[u], root[v]
        apart = x != y
        if not apart.any():
            break
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    for k in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + (1 << 16)]), pa.array(nodes[root[k : k + (1 << 16)]])], names=["node", "component"])


def _stars(state: DataFrame) -> bool:
    """Whether no node has two lesser neighbours, or a lesser and a greater one."""
    ends = state.select(F.col("u").alias("node"), F.lit(1).alias("lesser"), F.lit(0).alias("greater")).union(state.select("v", F.lit(0), F.lit(1)))
    counted = ends.groupBy("node").agg(F.sum("lesser").alias("lesser"), F.max("greater").alias("greater"))
    return counted.where("lesser > 1 or lesser = 1 and greater = 1").isEmpty()
