"""Mixing sources to target weights by subset-sum budget fitting.

Sources, by code point and null last, have the given weights in turn and share
the words of all documents by weight; a target stops at ``most`` times its
source's words and the excess is shared again among the others.  A source is
taken whole as often as its target holds it; the words then missing are a budget
that a choice of its documents must fill:

* documents are counted by exact length, per source;
* every length gives the share of its documents that the budget is of the
  source, rounded down, and longest first one more while much is missing;
* a bounded-knapsack dynamic program over the counts left fills the rest.  Where
  it does not meet the budget to the word, other documents are given (the longest,
  or the shortest, first) and more of the budget, at last all of it, goes to the
  program, so the best sum is found;
* what that leaves open, for want of short documents, takes documents again in
  the same way, as long as none is taken more than ``most`` times;
* documents of each length are taken in the order of a seeded hash.

So each document is taken at most ``most`` times and reruns agree.  The program
counts single words at every size.  It is given at most ``most_room`` words of a
budget, a bound on memory; only where that leaves a larger budget unmet, to the
word, is the best choice found so far not known to be the best of all.

Defined cases.  Null texts have no words.  Documents without words are taken as
often as their source is taken whole, which adds nothing.  Sources without words
have target 0.  Rows that repeat an id are documents of their own, chosen apart.
Ids are cast to long; one that is no number fails the job.  Very long texts count
whole.  An empty table gives an empty result.  Other columns, whatever their
names, pass through ``mixed`` untouched.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.index import with_row_index
from gridloom.llm.ranking import spread_rank
from gridloom.llm.storage import materialise, ship, tidied
from gridloom.llm.text import Words, by_bytes

#: Words of a budget that the dynamic program fills at first; each further try has as many times more.
_ROOM, _WIDER = 1 << 16, 16


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int, most_room: int = 1 << 26) -> np.ndarray:
    """How many documents of each length to take, so that their words come as near the budget as can be and not above."""
    taken = np.zeros(len(lengths), np.int64)
    live = np.flatnonzero((lengths > 0) & (lengths <= budget) & (counts > 0))
    total = sum(int(x) * int(n) for x, n in zip(lengths[live], counts[live], strict=True))
    if budget <= 0 or not len(live):
        return taken
    if budget >= total:
        taken[live] = counts[live]
        return taken
    unit = math.gcd(*lengths[live].tolist())  # sums are multiples of it
    size, n, budget, total = lengths[live] // unit, counts[live], budget // unit, total // unit
    order = np.argsort(-size, kind="stable")
    least, best, room = budget + 1, None, _ROOM
    while True:
        # in proportion, or from one end: some best choice differs from the latter in few documents
        for share, turn in ((True, order), (False, order), (False, order[::-1])):
            given = _given(size, n, max(0, budget - room), total if share else 0, turn)
            left = budget - int((size * given).sum())
            more = _knapsack(size, n - given, left, order)
            if (missing := left - int((size * more).sum())) < least:
                least, best = missing, given + more
            if not least or room >= budget:
                taken[live] = best
                return taken
        if room >= most_room:
            taken[live] = best
            return taken
        room = min(room * _WIDER, most_room)


def _given(size: np.ndarray, n: np.ndarray, goal: int, total: int, order: np.ndarray) -> np.ndarray:
    """Documents of each length for about ``goal`` words and not more: their share of ``total``, if given, then in order."""
    # exact integers: counts times a budget may pass 2**53
    given = np.array([int(c) * goal // total if total else 0 for c in n], np.int64)
    left = goal - int((size * given).sum())
    for i in order:
        if left <= 0:
            break
        more = min(int(n[i] - given[i]), left // int(size[i]))
        given[i] += more
        left -= more * int(size[i])
    return given


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int, order: np.ndarray) -> np.ndarray:
    """Bounded knapsack: the greatest reachable sum up to budget, to the word."""
    via = np.full(budget + 1, -1, np.int32)
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    items: list[tuple[int, int, int]] = []
    for i in order:
        size, n, many = int(lengths[i]), int(counts[i]), 1
        while n > 0 and size * min(many, n) <= budget and not reached[budget]:
            many = min(many, n)
            step = size * many
            at = np.flatnonzero(reached[:-step] & ~reached[step:])
            at += step
            via[at] = len(items)
            reached[at] = True
            items.append((int(i), many, step))
            n -= many
            many *= 2
        if reached[budget]:
            break
    taken = np.zeros(len(lengths), np.int64)
    at = budget - int(reached[::-1].argmax())
    while at:  # items reach a sum in the order they were tried, so none is used twice
        i, many, step = items[via[at]]
        taken[i] += many
        at -= step
    return taken


def _sizes(batches):
    for whole in batches:
        for batch in by_bytes(whole, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("source"), pa.array(Words(batch.column("text")).counts())], names=["id", "source", "size"])


def _targets(sized: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """key, source_size, target: a row per source, however many there are; only sums reach the driver."""
    sources = materialise(sized.groupBy("key").agg(F.sum("size").alias("source_size")), "sources")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_at") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = materialise(with_row_index(sources, "key", "_at").withColumn("weight", turn).drop("_at"), "weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size") * most
    each, over = None, -1  # words for a weight of 1, and how many sources cannot take theirs
    while True:
        stop = F.lit(False) if each is None else F.col("weight") * each > limit
        n, fixed, free = table.agg(F.count_if(stop), F.sum(F.when(stop, limit)), F.sum(F.when(~stop, F.col("weight")))).first()
        if n == over or not free:
            break
        each, over = (total - (fixed or 0)) / free, n
    share = limit if each is None else F.least(limit, F.col("weight") * each)
    return table.select("key", "source_size", share.cast("double").alias("target"))


def _fit(most: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size")
        whole, target = int(part["source_size"].iloc[0]), float(part["target"].iloc[0])
        times = int(target // whole) if whole else 0
        budget = math.floor(target - times * whole + 0.5)
        lengths, counts = part["size"].to_numpy(), part["n"].to_numpy()
        levels = []
        for _ in range(most - times):
            # once more of each document at most; a budget that long documents leave open takes short ones again
            levels.append(fill(lengths, counts, budget))
            budget -= int((levels[-1] * lengths).sum())
        part["times"] = times
        part["levels"] = list(np.array(levels).T.tolist()) if levels else [[] for _ in range(len(part))]
        return part[["key", "size", "n", "source_size", "target", "times", "levels"]]

    return run


def take(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """id, size, source_size, target, taken, copies, source: one row per row of docs."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    key = F.concat(F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.lit("0")), F.coalesce("source", F.lit("")))
    sized = materialise(rows.mapInArrow(tidied(_sizes), "id long, source string, size long").withColumn("key", key), "sizes")

    table = _targets(sized, weights, most)
    histogram = sized.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")).join(table, "key")
    plan = materialise(histogram.groupBy("key").applyInPandas(_fit(most), "key string, size long, n long, source_size long, target double, times long, levels array<long>"), "mix")

    planned = sized.join(plan, ["key", "size"])
    alike = F.forall("levels", lambda k: (k == 0) | (k == F.col("n")))
    clear = planned.where(alike).withColumn("rank", F.lit(0).cast("long"))
    ranked = spread_rank(planned.where(~alike).withColumn("_order", F.xxhash64(F.lit(seed), "id")), ["key", "size"], "_order", ["id"]).drop("_order")
    copies = F.col("times") + F.size(F.filter("levels", lambda k: F.col("rank") < k))
    return clear.unionByName(ranked).select(F.col("id").alias(id), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), F.col("source").alias(source))


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, **settings) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns.

    Rows that repeat an id share what the mix takes of them: each gets the whole
    part of the mean, and by a hash of its text some get one more.
    """
    taken = take(docs, id, text, source, seed=seed, **settings)
    shares = materialise(taken.groupBy(F.col(id).alias("_id")).agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")).where("_copies > 0"), "copies")
    rows = docs.select(F.col(id).cast("long").alias("_key"), F.xxhash64(F.lit(seed), F.col(text)).alias("_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    # a row per document: shuffled at every size, never broadcast
    joined = rows.join(shares.hint("shuffle_merge"), F.col("_key").eqNullSafe(F.col("_id")))
    over = F.pmod("_hash", F.col("_rows")) < F.pmod(F.col("_copies"), F.col("_rows"))
    copies = F.floor(F.col("_copies") / F.col("_rows")) + over.cast("long")
    return joined.select("_row", F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies)).otherwise(F.array().cast("array<bigint>")))).select("_row.*")
