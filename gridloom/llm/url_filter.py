"""URL filtering with hashed host-suffix and path-prefix expressions, DataFrame functions only.

Every distinct URL expands into (host suffix, path prefix) expressions: suffixes
at label boundaries, prefixes of the lengths that rules have.  Expressions meet
rules by the first ``prefix_bytes`` bytes of their SHA-256, an equi-join, and
the full digests confirm.  Of the rules that fit, the longest (host and path
together) wins; then the longer host; then block before allow.

Defined cases.  A null URL or one without ``://`` has empty host and path and
the default verdict.  Repeated rows and null ids each return their row.  Rules
of null host or path are ignored, repeated ones count once; with no rules at
all every URL gets the default.  Very long URLs are used whole.  An empty table
gives an empty result.  Other columns are ignored.

The verdicts of distinct URLs are a table when pages meet them, so that the join
can split a URL that many pages have; pages without a host are spread over all
tasks, since none of them can meet a verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.storage import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    front = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    host = F.substring_index(front, "/", 1)
    return F.translate(host, _UPPER, _LOWER), F.substring(front, F.length(host) + 1, F.length(front))


def _hashed(df: DataFrame, prefix_bytes: int) -> DataFrame:
    # the separator cannot occur in a host
    digest = F.unhex(F.sha2(F.concat(F.col("_host"), F.lit("/"), F.col("_path")), 256))
    return df.withColumn("_digest", digest).withColumn("_short", F.substring("_digest", 1, prefix_bytes))


def filter_urls(pages: DataFrame, rules: DataFrame, id: str = "page_id", url: str = "url", default: str = "allow", prefix_bytes: int = 4) -> DataFrame:
    """id, host, path, rule, verdict: one row per page.  rules: verdict, host, path."""
    host, path = split_url(url)
    rows = pages.select(F.col(id).alias("_id"), host.alias("_h"), path.alias("_p"))
    # no host holds a slash
    rows = rows.withColumn("_key", F.when(F.col("_h") == "", F.concat(F.lit("/"), F.xxhash64("_id", F.col("_p"), F.monotonically_increasing_id()).cast("string"))).otherwise(F.col("_h")))

    known = rules.select(F.col("verdict").alias("_verdict"), F.translate("host", _UPPER, _LOWER).alias("_host"), F.col("path").alias("_path")).where("_host is not null and _path is not null")
    known = _hashed(known.groupBy("_host", "_path").agg(F.max("_verdict").alias("_verdict")), prefix_bytes)
    # as many numbers as the longest path of a rule has characters, at most
    lengths = sorted(x[0] for x in known.select(F.length("_path")).distinct().collect())

    distinct = rows.where("_h != ''").select("_h", "_p").distinct()
    labels = F.split("_h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("_p"))
    prefixes = F.transform(fitting, lambda n: F.substring(F.col("_p"), F.lit(1), n))
    expanded = distinct.select("_h", "_p", F.explode(F.array_distinct(suffixes)).alias("_host"), prefixes.alias("_prefixes")).select("_h", "_p", "_host", F.explode("_prefixes").alias("_path"))
    left = _hashed(expanded, prefix_bytes).alias("l")
    right = known.withColumnsRenamed({"_host": "_rule_host", "_path": "_rule_path", "_digest": "_rule_digest"})
    fits = left.join(right, "_short").where(F.col("_digest") == F.col("_rule_digest"))
    rank = F.struct(F.length("_rule_host") + F.length("_rule_path"), F.length("_rule_host"), F.col("_verdict"), F.concat("_rule_host", "_rule_path").alias("rule"))
    best = materialise(fits.groupBy("_h", "_p").agg(F.max(rank).alias("_best")).withColumnRenamed("_h", "_key"), "verdicts")
    return rows.join(best, ["_key", "_p"], "left").select(
        F.col("_id").alias(id), F.col("_h").alias("host"), F.col("_p").alias("path"), F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best._verdict"), F.lit(default)).alias("verdict")
    )
