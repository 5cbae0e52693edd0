"""The registered queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import chat, quality
from gridloom.llm.embedding_dedup import embedding_links
from gridloom.llm.exact_dedup import exact_groups
from gridloom.llm.mixing import take
from gridloom.llm.near_dedup import near_clusters
from gridloom.llm.packing import packed
from gridloom.llm.substring_dedup import remove_repeats
from gridloom.llm.token_files import read_tokens, write_tokens
from gridloom.llm.url_filter import filter_urls

_WORD = r"[^\x20\x09-\x0D]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), window=50)


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_clusters(_table(spark, sf_dir, "documents"), k=5, threshold=0.8)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), label="quality")
    return quality.scored(docs, model, threshold=0.3)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_tokens(_table(spark, sf_dir, "documents"), _vocabulary(), end=0)
    return read_tokens(spark, folder)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return take(_table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    chats = chat.parsed(chat.formatted(chat.text_parts(rows)))
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"), _vocabulary(), capacity=2048, end=0)


#: (verdict, host, path)
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return filter_urls(_table(spark, sf_dir, "pages"), rules, default="allow")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_order_minhash": op2_order_minhash,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_token_files": op5_token_files,
    "op6_source_mixing": op6_source_mixing,
    "op7_chat_format": op7_chat_format,
    "op8_url_filter": op8_url_filter,
    "op9_packing": op9_packing,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLE = {
    "op1_substring_dedup": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM d, unnest(range(1, len(w) - 48)) AS t(i)),
own AS (SELECT s, min(doc_id) AS first_id FROM win GROUP BY s),
bad AS (SELECT win.doc_id, win.i FROM win JOIN own USING (s) WHERE own.first_id < win.doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM bad, unnest(range(0, 50)) AS t(k)),
word AS (SELECT doc_id, pos, w[pos] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(pos)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS s, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op4_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT * FROM v WHERE norm > 0 AND isfinite(norm)),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id != b.vec_id
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
root AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM link GROUP BY x)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, root.component_id, e.vec_id = root.component_id AS kept
FROM embeddings e JOIN root ON e.vec_id = root.x LEFT JOIN n ON e.vec_id = n.x""",
    "op7_chat_format": r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
e AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '([<\[])(/?INST\]|/?SYS\]|/?s>|/?ROLE\]|:\]|IMAGE\]|AUDIO\]|DOCUMENT\])', '\1\\\2', 'g') AS esc FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(esc) + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 + length(role) END)::BIGINT AS formatted_chars,
  0::BIGINT AS n_attachments, 0::BIGINT AS attachment_tokens -- all rows are texts
FROM e GROUP BY conv_id""",
    "op8_url_filter": r"""
WITH rule(action, rule_host, rule_path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
cut AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
part AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fit AS (SELECT page_id, host, path, action, rule_host || rule_path AS rule, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS k
  FROM part LEFT JOIN rule ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fit WHERE k = 1""",
    "op10_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS s FROM documents),
g AS (SELECT s, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY s)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.s) AS text_sha256 FROM n JOIN g USING (s)""",
}
