"""Token ids in flat binary files with 64-bit document offsets.

Layout of a data set, a folder of shards in ascending order of document id:

* ``shard-NNNNN.ids``: the ids of its documents in a row, little-endian unsigned
  integers of 2 bytes where every id of the vocabulary fits, else of 4;
* ``shard-NNNNN.offsets``: little-endian signed 64-bit integers, where each
  document begins within the shard's ids, and where the last one ends;
* ``shard-NNNNN.docs``: little-endian signed 64-bit document ids;
* ``index`` (a Parquet table): shard, documents, tokens and ``base``, the number
  of tokens in all shards before it: a prefix sum over shards.

Documents are range-partitioned by id, one shard per partition.  A task writes
to the folder itself, under names of its own, and renames at the end, so a task
that is run again, or twice at once, leaves one whole shard.  Readers map the
files into memory.

Folders of a mounted file system (``file:`` or no scheme) are mapped; any other
is reached through ``pyarrow.fs``, and the ranges asked for are read.

Defined cases.  Null texts are empty: such a document has the end id alone.
Null ids are not allowed in a file of ids (the job fails on them).  Rows that
repeat an id follow each other in the order of their texts.  An empty table
gives a data set without shards.  Other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.storage import fresh_path, materialise, ship, tidied
from gridloom.llm.text import gathered
from gridloom.llm.tokens import SLICE, encoder, with_end

_SHARD = pa.schema([("shard", pa.int32()), ("documents", pa.int64()), ("tokens", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _local(folder: str) -> str | None:
    parts = urlsplit(folder)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


class _Out:
    """A file of the folder that appears whole, when it is finished, or not at all."""

    def __init__(self, folder: str, name: str):
        self.local = _local(folder)
        if self.local is not None:
            os.makedirs(self.local, exist_ok=True)
            self.path, self.last = os.path.join(self.local, f".{name}-{uuid.uuid4().hex}"), os.path.join(self.local, name)
            self.file = open(self.path, "wb")  # noqa: SIM115
        else:
            from pyarrow import fs

            self.store, base = fs.FileSystem.from_uri(folder)
            self.store.create_dir(base, recursive=True)
            self.path, self.last = f"{base}/.{name}-{uuid.uuid4().hex}", f"{base}/{name}"
            self.file = self.store.open_output_stream(self.path)

    def write(self, data: bytes) -> None:
        self.file.write(data)

    def end(self, keep: bool) -> None:
        self.file.close()
        if self.local is not None:
            os.replace(self.path, self.last) if keep else os.remove(self.path)
        else:
            self.store.move(self.path, self.last) if keep else self.store.delete_file(self.path)


class _In:
    """Ranges of a file of the folder as arrays; of a mounted one nothing is read before it is used."""

    def __init__(self, folder: str, name: str, dtype: str):
        self.dtype, local = np.dtype(dtype), _local(folder)
        if local is not None:
            path = os.path.join(local, name)
            self.size = os.path.getsize(path) / self.dtype.itemsize
            self.data = np.memmap(path, np.uint8, "r") if self.size else np.zeros(0, np.uint8)
        else:
            from pyarrow import fs

            store, base = fs.FileSystem.from_uri(folder)
            self.data, self.file = None, store.open_input_file(f"{base}/{name}")
            self.size = self.file.size() / self.dtype.itemsize

    def range(self, a: int, b: int) -> np.ndarray:
        a, b = a * self.dtype.itemsize, b * self.dtype.itemsize
        return (self.data[a:b] if self.data is not None else np.frombuffer(self.file.read_at(b - a, a), np.uint8)).view(self.dtype)


def _write(folder: str, vocabulary: str, end: int, dtype: str):
    def run(batches):
        shard = TaskContext.get().partitionId()
        code = encoder(vocabulary)
        documents = tokens = 0
        out: list[_Out] = []
        try:
            for batch in gathered(batches, "text", SLICE // 2):
                if batch.column("doc_id").null_count:
                    raise ValueError("a document without an id cannot be filed")
                if not out:
                    out += [_Out(folder, f"shard-{shard:05d}.{kind}") for kind in ("ids", "offsets", "docs")]
                    out[1].write(np.zeros(1, "<i8").tobytes())
                ids, counts = with_end(*code.encode_column(batch.column("text")), end)
                out[0].write(ids.astype(dtype).tobytes())
                out[1].write((tokens + np.cumsum(counts)).astype("<i8").tobytes())
                out[2].write(batch.column("doc_id").to_numpy().astype("<i8").tobytes())
                documents += len(batch)
                tokens += len(ids)
        except BaseException:
            for file in out:
                file.end(keep=False)
            raise
        for file in out:
            file.end(keep=True)
        if documents:
            yield pa.RecordBatch.from_pylist([{"shard": shard, "documents": documents, "tokens": tokens}], _SHARD)

    return run


def write_tokens(docs: DataFrame, vocabulary: str, folder: str | None = None, id: str = "doc_id", text: str = "text", end: int = 0, partitions: int | None = None) -> str:
    """Encode all documents into a data set; returns its folder."""
    spark = docs.sparkSession
    ship(spark)
    folder = folder or fresh_path(spark, "tokens")
    size = encoder(vocabulary).tokenizer.get_vocab_size()
    dtype = "<u2" if max(size - 1, end) < 1 << 16 else "<u4"
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    shards = materialise(dealt.mapInArrow(tidied(_write(folder, vocabulary, end, dtype)), "shard int, documents long, tokens long"), "shards")
    # a row per shard: the prefix sum of shard sizes, in order of id
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    index = shards.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))).withColumn("dtype", F.lit(dtype))
    index.write.parquet(f"{folder}/index")
    return folder


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the mapped files."""
    ship(spark)
    index = spark.read.schema("shard int, documents long, tokens long, base long, dtype string").parquet(f"{folder}/index")
    n = max(1, index.count())
    return index.repartition(n, "shard").mapInArrow(tidied(_read(folder)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _read(folder: str):
    def run(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                name = f"shard-{shard['shard']:05d}"
                ids, offsets, docs = _In(folder, f"{name}.ids", shard["dtype"]), _In(folder, f"{name}.offsets", "<i8"), _In(folder, f"{name}.docs", "<i8")
                if (ids.size, docs.size, offsets.size) != (shard["tokens"], shard["documents"], shard["documents"] + 1):
                    raise ValueError(f"{name} is not what its index says")
                for a in range(0, shard["documents"], 4096):
                    b = min(a + 4096, shard["documents"])
                    at = np.asarray(offsets.range(a, b + 1))
                    part = ids.range(int(at[0]), int(at[-1])).astype("<u4")
                    cut = (at - at[0]).tolist()
                    view = memoryview(part).cast("B")
                    sums = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(docs.range(a, b))), pa.array(shard["base"] + at[:-1]), pa.array(np.diff(at)), pa.array(sums, pa.int64())], schema=_READ)

    return run
