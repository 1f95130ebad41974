"""What several of the operators share."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the key filter: 2**26 bits are 8 MB, whatever the size of the input.
FILTER_BITS = 26


_HELD: dict = {}


def held(key, make):
    """What an operator keeps in a Python worker between tasks (tables, caches); another operator's goes when it comes, so that workers hold one at a time."""
    if key not in _HELD:
        _HELD.clear()
        tidy()
        _HELD[key] = make()
    return _HELD[key]


def tidy() -> None:
    """Gives memory that a worker has freed back to the machine; called when a partition is done, as workers live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, other C libraries need not
    if trim is not None:
        trim(0)


def text_of(column: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def _bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << FILTER_BITS))


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap of hashed keys: at most 2**FILTER_BITS / 32768 rows of 4 KB, so 8 MB at any input."""
    bit = _bit(F.col(key))
    return (
        keys.select(bit.alias("bit"))
        .groupBy(F.expr("bitmap_bucket_number(bit)").alias("_bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("_bitmap"))
    )


def collected_filter(keys: DataFrame, key: str):
    """A bitmap of the lowest FILTER_BITS bits of keys (long), as bytes for Python workers: 8 MB at any input, in the driver too."""
    rows = (
        keys.select((F.col(key).bitwiseAND((1 << FILTER_BITS) - 1) + 1).alias("bit"))
        .groupBy(F.expr("bitmap_bucket_number(bit)").alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits"))
    )
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for bucket, bits in rows.collect():  # 2**FILTER_BITS / 32768 rows of 4 KB at most
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bits, np.uint8)
    return out


def mark_possible(df: DataFrame, bitmap: DataFrame, key: str, mark: str) -> DataFrame:
    """Adds the boolean column mark: false where the key is certainly not among the filter's keys.

    The bitmap has a fixed upper size (see key_filter), hence the broadcast. A filter
    filled up by very many keys only marks more rows than needed, it never misses one.
    """
    bit = _bit(F.col(key))
    out = df.withColumn("_bit", bit).withColumn("_bucket", F.expr("bitmap_bucket_number(_bit)"))
    out = out.join(F.broadcast(bitmap), "_bucket", "left")
    hit = F.expr(
        "coalesce(shiftright(cast(conv(hex(substring(_bitmap, cast(bitmap_bit_position(_bit) div 8 + 1 as int), 1)), 16, 10) as int),"
        " cast(bitmap_bit_position(_bit) % 8 as int)) & 1, 0) = 1"
    )
    return out.withColumn(mark, hit).drop("_bit", "_bucket", "_bitmap")
