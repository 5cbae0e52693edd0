"""PageRank over an edge table: row i of the array links to column j with weight v."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.objects import DArray, DObject, SparseArray
from gridloom.storage import materialise


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def step(edges: DataFrame, ranks: DataFrame, damping: float) -> DataFrame:
    """id, old, new, teleport: one pass, not normalised.  edges: src, dst, share of src's weight."""
    flow = edges.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy("dst").agg(F.sum(F.col("share") * F.col("rank")).alias("flow"))
    new = damping * F.coalesce("flow", F.lit(0.0)) + (1 - damping) * F.col("teleport")
    return ranks.join(flow.withColumnRenamed("dst", "id"), "id", "left").select("id", F.col("rank").alias("old"), new.alias("new"), "teleport")


def pagerank(graph: DArray | SparseArray, niter: int = 1000, eps: float = 0.001, damping: float = 0.85, personalized: DObject | None = None, weights: DObject | None = None, na_action: str = "pass") -> DataFrame:
    """id, rank (sums to 1).  personalized: one row; weights: an array like the graph.

    Ranks start at 1 - damping, are normalised after each pass, and passes end
    when no rank moves by eps or more, or after niter.  Each pass is written to
    the shared folder, so lineage stays short.
    """
    n, p = graph.dim
    if n != p:
        raise ValueError("the adjacency array must be square")
    if graph.nparts[0] != 1:
        raise ValueError("the graph must be partitioned by column")
    if eps <= 0 or niter < 1 or not 0 < damping < 1:
        raise ValueError("eps and niter must be positive, damping between 0 and 1")
    if na_action not in ("pass", "exclude", "fail"):
        raise ValueError("na_action is pass, exclude or fail")
    if weights is not None and weights.dim != graph.dim or personalized is not None and personalized.dim != (1, n):
        raise ValueError("weights must be like the graph, and personalized one row for its columns")

    cells = graph.coo().select("i", "j", "v")
    if na_action != "pass":
        bad = cells.where(~_finite(F.col("v"))).count()
        if bad and na_action == "fail":
            raise ValueError(f"{bad} values are not finite")
        if bad:
            warnings.warn(f"{bad} values are not finite and count as 0", stacklevel=2)
            cells = cells.withColumn("v", F.when(_finite(F.col("v")), F.col("v")).otherwise(0.0))
    if weights is not None:
        cells = cells.join(weights.coo().select("i", "j", F.col("v").alias("w")), ["i", "j"]).withColumn("v", F.col("v") * F.col("w"))
    links = cells.where("v is null or v != 0")
    # a missing cell makes its row's sum missing
    out = links.groupBy("i").agg(F.when(F.count("v") == F.count(F.lit(1)), F.sum("v")).alias("out"))
    edges = links.join(out, "i").select(F.col("i").alias("src"), F.col("j").alias("dst"), F.when(F.col("out") == 0, F.col("v")).otherwise(F.col("v") / F.col("out")).alias("share"))
    edges = materialise(edges, "edges")
    if edges.where("share is null or isnan(share)").head(1):
        raise ValueError("the graph has values that are not finite")

    spark = edges.sparkSession
    vertices = spark.range(1, n + 1)
    teleport = F.lit(1.0 / n)
    if personalized is not None:
        vertices = vertices.join(personalized.coo().select(F.col("j").alias("id"), F.col("v").alias("_t")), "id", "left")
        teleport = F.coalesce("_t", F.lit(0.0))
    ranks = vertices.select("id", F.lit(1 - damping).alias("rank"), teleport.alias("teleport"))
    for _ in range(niter):
        moved = materialise(step(edges, ranks, damping), "ranks")
        total = moved.agg(F.sum("new")).first()[0]
        delta = moved.agg(F.max(F.abs(F.col("new") / total - F.col("old")))).first()[0]
        ranks = moved.select("id", (F.col("new") / total).alias("rank"), "teleport")
        if delta < eps:
            break
    return ranks.select("id", "rank")
