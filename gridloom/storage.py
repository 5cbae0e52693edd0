"""Shared storage for tables that cut the lineage of loops, and shipping this package.

Tables are written below ``spark.checkpoint.dir``, which the driver and all
executors share.  Where that setting is absent a session on one machine (a local
master) uses a folder of its own; on a cluster it must be set.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_OWN = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{_OWN}/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/gridloom/{spark.sparkContext.applicationId}"


#: Rows of an Arrow batch while a table is written: whole texts, even very long ones, must fit in memory.
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_ROWS = 1024
_LOCK, _WRITING = threading.Lock(), []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and return a DataFrame that reads it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with _LOCK:  # the first of several threads sets the batch size, the last one resets it
        if not _WRITING:
            before = spark.conf.get(_BATCH)
            spark.conf.set(_BATCH, str(min(_ROWS, int(before)) if int(before) > 0 else _ROWS))
            _WRITING.append(before)
        _WRITING.append(path)
    try:
        df.write.parquet(path)
    finally:
        with _LOCK:
            _WRITING.remove(path)
            if len(_WRITING) == 1:
                spark.conf.set(_BATCH, _WRITING.pop())
    found = spark.read.schema(df.schema).parquet(path)
    found._gridloom_path = path
    return found


def forget(*tables: DataFrame) -> None:
    """Remove tables that nothing reads any more."""
    for table in tables:
        _remove(table.sparkSession, table._gridloom_path)


def forget_all(spark: SparkSession) -> None:
    """Remove every table of this application: for when no result of it is read any more."""
    _remove(spark, _tables(spark))


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application, so that they need no install of it."""
    sc = spark.sparkContext
    if getattr(sc, "_gridloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(), "gridloom.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("gridloom", os.path.relpath(full, root)))
    sc.addPyFile(target)
    sc._gridloom_shipped = True
