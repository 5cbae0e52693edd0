"""Files: whatever Spark reads becomes a frame, and a frame is written by Spark."""

from __future__ import annotations

from gridloom import session
from gridloom.index import RID
from gridloom.objects import DFrame
from gridloom.sources.constructors import from_dataframe


def read_dframe(path: str | list[str], order_by: str | list[str], format: str = "parquet", schema: str | None = None, psize=None, columns: list[str] | None = None, **options) -> DFrame:
    """A frame of Parquet, CSV, JSON or ORC files, in the order of unique keys; only the columns asked for are read."""
    reader = session.current().spark.read.format(format).options(**options)
    df = (reader.schema(schema) if schema else reader).load(path)
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    if columns:
        df = df.select(*dict.fromkeys([*keys, *columns]))
    return from_dataframe(df, keys, psize, columns)


def write_dframe(frame: DFrame, path: str, format: str = "parquet", mode: str = "error", **options) -> None:
    """Write the rows, in order within each file."""
    frame.df.repartitionByRange(RID).sortWithinPartitions(RID).select(*frame.columns).write.format(format).mode(mode).options(**options).save(path)
