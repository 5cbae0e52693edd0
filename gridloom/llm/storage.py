"""Intermediate tables in shared storage, prefilters, and workers of this package.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, which every
executor and the driver share, so that a lost executor loses nothing.
"""

from __future__ import annotations

import ctypes

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.storage import forget, fresh_path, materialise, shared_dir, ship

__all__ = ["flag_probable", "forget", "fresh_path", "materialise", "probably_in", "shared_dir", "ship", "tidied"]


def tidied(stage):
    """The stage, which gives the memory that it freed back to the system when a partition ends.

    Workers live on between tasks; without this each would keep the most that
    any stage needed, beside the JVM.
    """

    def run(batches):
        try:
            yield from stage(batches)
        finally:
            import pyarrow

            pyarrow.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


#: A bitmap has 2 to the power of these many slots, at least and at most: 64 MB at 29.
_LEAST_BITS, _MOST_BITS = 16, 29


def _bits(keys: DataFrame) -> int:
    """About eight slots for each key; a table's own rows are counted from its footers."""
    if not hasattr(keys, "_gridloom_path"):
        return 23
    return min(_MOST_BITS, max(_LEAST_BITS, keys.count().bit_length() + 3))


def flag_probable(df: DataFrame, key, keys: DataFrame, keys_key, flag: str = "_probable", bits: int | None = None) -> DataFrame:
    """df with a boolean column: false only where the key is surely not in keys.

    A bitmap of 2**bits hash slots (by the number of keys, 64 MB at most) is built
    by an aggregate and broadcast.  It only spares rows that cannot match the
    shuffle of the exact join that must follow.
    """
    bits = bits or _bits(keys)
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    bitmaps = keys.select(slot(keys_key).alias("_s")).groupBy(F.bitmap_bucket_number("_s").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_s")).alias("_bitmap"))
    position = F.bitmap_bit_position("_s")
    byte = F.conv(F.hex(F.substring("_bitmap", (F.shiftright(position, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.pow(F.lit(2), position.bitwiseAND(F.lit(7))).cast("int")) != 0
    marked = df.withColumn("_s", slot(key)).withColumn("_bucket", F.bitmap_bucket_number("_s"))
    return marked.join(F.broadcast(bitmaps), "_bucket", "left").withColumn(flag, F.coalesce(hit, F.lit(False))).drop("_s", "_bucket", "_bitmap")


def probably_in(df: DataFrame, key, keys: DataFrame, keys_key, bits: int | None = None) -> DataFrame:
    """Rows of df whose key may be in keys: no row that is in keys is lost."""
    return flag_probable(df, key, keys, keys_key, "_probable", bits).where("_probable").drop("_probable")
