"""Exact deduplication by skew-safe combining.

Texts are equal when identical after each run of 0x20 and 0x09-0x0D becomes one
space.  Digests are counted first (partial counts per task); a text whose digest
nobody shares needs no comparison and never moves.  The others meet in three
stages, each of which compares them in full:

1. locally, in the partial aggregate of each task;
2. in salted groups: the salt is the task's number modulo ``salts``, so that one
   text held by every task is spread over ``salts`` reducers;
3. globally: at most ``salts`` winners of a text meet.

A row then finds its class by digest, checksum and length; the classes are a table
by then, so that the join can split a text that many rows have.  Where two texts
agree in all three but differ, their rows are told apart by the texts themselves.

Defined cases.  A null text equals the empty one.  Null ids come last: such a
row stays only while no equal text has an id.  Rows that repeat an id and a text
each count, and ``exact_groups`` marks them alike; ``deduplicated`` leaves one
row of every group.  Very long texts are compared whole.  An empty table gives an
empty result.  Other columns, whatever their names, pass through ``deduplicated``
untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.storage import flag_probable, materialise

_SPACE = r"[\x20\x09-\x0D]+"
_KEYS = ["_digest", "_check", "_length"]


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), _SPACE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _keyed(docs: DataFrame, id: str, text: str, digest, check, *more: Column) -> DataFrame:
    norm = F.col("_norm")
    base = docs.select(F.col(id).alias("_id"), normalised(text).alias("_norm"), *more)
    return base.withColumns({"_digest": digest(norm), "_check": check(norm), "_length": F.length(norm)})


def _shared(keyed: DataFrame) -> DataFrame:
    """Keys that several rows have."""
    counts = keyed.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").drop("_rows")
    return materialise(counts, "shared-digests")


def _texts(suspects: DataFrame, salts: int) -> DataFrame:
    """keep_id and group_size of every text among the suspects."""
    salted = suspects.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts))).groupBy(*_KEYS, "_salt", "_norm").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return salted.groupBy(*_KEYS, "_norm").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def _classes(suspects: DataFrame, salts: int) -> tuple[DataFrame, DataFrame | None]:
    """keep_id and group_size by key; and by key and text, where a key has several texts (None: nowhere)."""
    one = _texts(suspects, salts).groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("_texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    one = materialise(one, "classes")
    several = one.where("_texts > 1").select(*_KEYS)
    if several.isEmpty():
        return one.drop("_texts"), None
    texts = materialise(_texts(suspects.join(several, _KEYS, "left_semi"), salts), "texts-of-one-key")
    return one.where("_texts = 1").drop("_texts"), texts


def _split(keyed: DataFrame, shared: DataFrame) -> DataFrame:
    return flag_probable(keyed, F.col("_check"), shared, F.col("_check"))


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", salts: int = 32, digest=sha256, check=F.xxhash64) -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256: one row per row of docs."""
    keyed = _keyed(docs, id, text, digest, check)
    rows = materialise(keyed.withColumn("text_sha256", F.lower(F.sha2("_norm", 256))).drop("_norm"), "digests")
    suspects = _split(keyed, _shared(rows)).where("_probable")
    classes, texts = _classes(suspects, salts)
    if texts is None:
        joined = rows.join(classes, _KEYS, "left")
    else:
        several = texts.select(*_KEYS).distinct()
        alone = suspects.join(texts, [*_KEYS, "_norm"]).withColumn("text_sha256", F.lower(F.sha2("_norm", 256)))
        joined = rows.join(several, _KEYS, "left_anti").join(classes, _KEYS, "left")
        joined = joined.select("_id", "keep_id", "group_size", "text_sha256").unionByName(alone.select("_id", "keep_id", "group_size", "text_sha256"))
    keep = F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id"))
    joined = joined.withColumn("_keep", keep)
    return joined.select(F.col("_id").alias(id), F.col("_keep").alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", salts: int = 32, digest=sha256, check=F.xxhash64) -> DataFrame:
    """One row of each group of equal texts, with all the columns of docs: that of the smallest id."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    shared = _shared(_keyed(docs, id, text, digest, check).drop("_norm"))
    marked = _split(_keyed(docs, id, text, digest, check, row), shared)
    suspects = marked.where("_probable")
    classes, texts = _classes(suspects.drop("_row"), salts)
    stays = F.col("_id").eqNullSafe(F.col("keep_id"))
    kept = suspects.drop("_norm").join(classes, _KEYS).where(stays).dropDuplicates(_KEYS).select("_row")
    if texts is not None:
        kept = kept.unionByName(suspects.join(texts, [*_KEYS, "_norm"]).where(stays).dropDuplicates([*_KEYS, "_norm"]).select("_row"))
    return marked.where("not _probable").select("_row.*").unionByName(kept.select("_row.*"))
