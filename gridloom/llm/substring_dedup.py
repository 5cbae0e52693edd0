"""Removal of repeated word sequences by De Bruijn compaction.

The edges of the graph are all windows of ``window`` consecutive words.  Edges
are bucketed by their minimizer, the least hash among the ``anchor``-word
grams of the window, which every equal window shares; neighbouring edges of a
document with one minimizer form a path.

1. One pass hashes every text and writes its paths (minimizer, content hash,
   coordinates), never the words.
2. Minimizers are aggregated.  One seen in a single document holds no repeat.
   Where all paths through a minimizer have one content the path does not
   branch and stands for all of its edges: the least document owns them.
3. Where paths branch, only those paths are expanded into single edges, which
   are aggregated in the same way.
4. Repeated paths and edges whose source coordinates advance together compact
   into long spans.  Each span is verified by digests of the words themselves
   at its own and at its source's coordinates; a mismatch fails the job.

Aggregates combine before each shuffle and joins run on plain keys, so that a
passage of every third document is a few partial rows per task.

Defined cases.  Null texts are empty.  Rows of null id keep all their words
and are no source.  Rows that repeat an id are one document: none removes
words of the other, and each row is returned.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.storage import materialise, probably_in, ship, tidied
from gridloom.llm.text import U64, Words, by_bytes, joined, mix, sliding_min

_PATHS = "mkey long, content long, doc_id long, fp long, start long, n long, sha binary"
_EDGES = "mkey long, content long, doc_id long, fp long, start long, n long"


def _joined(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """All words, each followed by one space, and where in that each word begins."""
    lengths = words.ends - words.starts + 1
    total = np.cumsum(lengths)
    begin = total - lengths
    size = int(total[-1]) if len(total) else 0
    out = words.data[np.arange(size) + np.repeat(words.starts - begin, lengths)]
    out[total - 1] = 0x20
    return out, np.append(begin, size)


def _digests(words: Words) -> list[bytes]:
    """SHA-256 of every document's words joined by one space."""
    out, begin = _joined(words)
    view, at = memoryview(out), begin[words.first].tolist()
    return [hashlib.sha256(view[a : max(a, b - 1)]).digest() for a, b in zip(at[:-1], at[1:], strict=True)]


def _windows(words: Words, window: int, anchor: int):
    """Of every window inside one document: word position, document, minimizer and hash."""
    h = words.hashes()
    edge = joined(h, window)
    document = np.repeat(np.arange(len(words.first) - 1), words.counts())
    if not len(edge):
        return np.zeros(0, np.int64), document[:0], edge, edge
    mkey = sliding_min(joined(h, anchor), window - anchor + 1)
    at = np.flatnonzero(document[: len(edge)] == document[window - 1 :])
    return at, document[at], mkey[at], edge[at]


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _paths(window: int, anchor: int):
    def run(batches):
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                words = Words(batch.column("text"))
                ids = batch.column("doc_id")
                sha = _digests(words)
                fp = np.frombuffer(b"".join(x[:8] for x in sha), "<i8")
                yield pa.RecordBatch.from_arrays([pa.nulls(len(ids), pa.int64())] * 2 + [ids, pa.array(fp), pa.array(words.counts()), pa.array(np.zeros(len(ids), np.int64)), pa.array(sha, pa.binary())], schema=_arrow(_PATHS))
                at, document, mkey, edge = _windows(words, window, anchor)
                known = ~np.asarray(ids.is_null())[document] if ids.null_count else slice(None)
                at, document, mkey, edge = at[known], document[known], mkey[known], edge[known]
                if not len(at):
                    continue
                new = np.ones(len(at), bool)
                new[1:] = (mkey[1:] != mkey[:-1]) | (document[1:] != document[:-1])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(at)))
                step = np.arange(len(at)) - np.repeat(first, n)
                content = np.add.reduceat(mix(edge ^ mix(step.astype(U64) + U64(1))), first)
                of = document[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_long(mkey[first])), pa.array(_long(content)), ids.take(pa.array(of)), pa.array(fp[of]), pa.array(at[first] - words.first[of]), pa.array(n), pa.nulls(len(of), pa.binary())],
                    schema=_arrow(_PATHS),
                )

    return run


def _arrow(ddl: str) -> pa.Schema:
    kind = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(c.split()[0], kind[c.split()[1]]) for c in ddl.split(", ")])


def _edges(window: int, anchor: int):
    def run(batches):
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                words = Words(batch.column("text"))
                at, document, mkey, edge = _windows(words, window, anchor)
                base = np.searchsorted(document, np.arange(len(batch) + 1))
                take = []
                for d, spans in enumerate(batch.column("spans").to_pylist()):
                    take += [np.arange(base[d] + x["start"], base[d] + x["start"] + x["n"]) for x in spans]
                t = np.concatenate(take) if take else np.zeros(0, np.int64)
                of = document[t]
                pick = pa.array(of)
                yield pa.RecordBatch.from_arrays([pa.array(_long(mkey[t])), pa.array(_long(edge[t])), batch.column("doc_id").take(pick), batch.column("fp").take(pick), pa.array(at[t] - words.first[of]), pa.array(np.ones(len(t), np.int64))], schema=_arrow(_EDGES))

    return run


def _with_sha(batches):
    """Adds the fingerprint that tells apart rows of one id."""
    for whole in batches:
        for batch in by_bytes(whole, "text"):
            fp = np.frombuffer(b"".join(x[:8] for x in _digests(Words(batch.column("text")))), "<i8")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp), batch.column("text")], names=["doc_id", "fp", "text"])


def _owned(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of which the content also starts in a smaller document, with the source's coordinates."""
    owner = rows.groupBy(*keys).agg(F.min("doc_id").alias("src"), F.max("doc_id").alias("last"), F.min_by("start", "doc_id").alias("src_start"), F.min_by("fp", "doc_id").alias("src_fp")).where("src < last").drop("last")
    owner = materialise(owner, "owners")  # a table, so that the join below can split a hot key
    return probably_in(rows, F.struct(*keys), owner, F.struct(*keys)).join(owner, keys).where("doc_id > src")


def repeated_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = 50, anchor: int = 16) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, documents, spans): spans has doc_id, fp, start, n (words), src, src_fp, src_start."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    table = materialise(texts.mapInArrow(tidied(_paths(window, anchor)), _PATHS), "paths")
    documents = table.where("n = 0").select("doc_id", "fp", F.col("start").alias("n_words"), "sha")
    paths = table.where("n > 0").drop("sha")

    nodes = paths.groupBy("mkey").agg(F.min("doc_id").alias("src"), F.max("doc_id").alias("last"), F.min("content").alias("low"), F.max("content").alias("high"), F.min_by("start", "doc_id").alias("src_start"), F.min_by("fp", "doc_id").alias("src_fp")).where("src < last").drop("last")
    nodes = materialise(nodes, "nodes")
    shared = materialise(probably_in(paths, "mkey", nodes, "mkey").join(nodes, "mkey"), "shared")
    straight = shared.where("low = high and doc_id > src")

    branching = shared.where("low < high")
    wanted = branching.groupBy("doc_id", "fp").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    expand = probably_in(texts, "doc_id", branching, "doc_id").mapInArrow(tidied(_with_sha), "doc_id long, fp long, text string").join(wanted, ["doc_id", "fp"])
    edges = materialise(expand.mapInArrow(tidied(_edges(window, anchor)), _EDGES), "edges")
    single = _owned(edges, ["mkey", "content"])

    columns = ["doc_id", "fp", "start", "n", "src", "src_fp", "src_start"]
    found = straight.select(*columns).unionByName(single.select(*columns)).distinct()
    path = ["doc_id", "fp", "src", "src_fp", "shift"]
    order = Window.partitionBy(*path).orderBy("start")
    compact = (
        found.withColumn("shift", F.col("start") - F.col("src_start"))
        .withColumn("end", F.col("start") + F.col("n") + (window - 1))
        .withColumn("new", (F.col("start") > F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
        .withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*path, "island")
        .agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("n"), F.min("src_start").alias("src_start"))
        .select(*columns)
    )
    return texts, documents, materialise(compact, "spans")


_WORK = "doc_id long, fp long, start long, n long, digest binary"


def _kept(words: Words, kept: np.ndarray) -> Words:
    part = Words.__new__(Words)
    part.data, part.starts, part.ends = words.data, words.starts[kept], words.ends[kept]
    part.first = np.append(0, np.cumsum(kept))[words.first]
    return part


def _apply(batches):
    """Digests of the spans asked for; at n = 0, start words are removed from the document, which leaves digest."""
    for whole in batches:
        for batch in by_bytes(whole, "text"):
            words = Words(batch.column("text"))
            out, begin = _joined(words)
            kept, view, rows = np.ones(len(words.starts), bool), memoryview(out), []
            ids, fps = batch.column("doc_id").to_pylist(), batch.column("fp").to_pylist()
            for d, spans in enumerate(batch.column("spans").to_pylist()):
                for x in spans:
                    a = words.first[d] + x["start"]
                    if x["own"]:
                        kept[a : a + x["n"]] = False
                    rows.append((ids[d], fps[d], x["start"], x["n"], hashlib.blake2b(view[begin[a] : begin[a + x["n"]]], digest_size=16).digest()))
            left = _kept(words, kept)
            rows += zip(ids, fps, (words.counts() - left.counts()).tolist(), [0] * len(ids), _digests(left), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _arrow(_WORK).types, strict=True)], schema=_arrow(_WORK))


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = 50, anchor: int = 16) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, one row per row of docs."""
    texts, documents, spans = repeated_spans(docs, id, text, window, anchor)
    own = spans.select("doc_id", "fp", F.struct(F.lit(True).alias("own"), "start", "n").alias("x"))
    source = spans.select(F.col("src").alias("doc_id"), F.col("src_fp").alias("fp"), F.struct(F.lit(False).alias("own"), F.col("src_start").alias("start"), "n").alias("x"))
    # distinct: a document that a third of all rows copy is asked for each of its spans once
    asked = materialise(own.unionByName(source).distinct(), "asked")
    per_row = asked.groupBy("doc_id", "fp").agg(F.collect_list("x").alias("spans"))
    rows = probably_in(texts, "doc_id", asked, "doc_id").mapInArrow(tidied(_with_sha), "doc_id long, fp long, text string").join(per_row, ["doc_id", "fp"])
    work = materialise(rows.mapInArrow(tidied(_apply), _WORK), "applied")

    digests = materialise(work.where("n > 0").groupBy("doc_id", "fp", "start", "n").agg(F.min("digest").alias("digest")), "digests")
    theirs = digests.select(F.col("doc_id").alias("src"), F.col("fp").alias("src_fp"), F.col("start").alias("src_start"), "n", F.col("digest").alias("theirs"))
    wrong = spans.join(digests, ["doc_id", "fp", "start", "n"], "left").join(theirs, ["src", "src_fp", "src_start", "n"], "left").where("digest is null or theirs is null or digest != theirs")
    if not wrong.isEmpty():
        raise RuntimeError("a repeated span differs from its source: two windows share a 128-bit hash")
    result = work.where("n = 0").groupBy("doc_id", "fp").agg(F.max("start").alias("n_removed"), F.max_by("digest", "start").alias("left_sha"))
    return documents.join(result, ["doc_id", "fp"], "left").select(
        F.col("doc_id").alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.lower(F.hex(F.coalesce("left_sha", "sha"))).alias("kept_sha256")
    )
