"""Rows whose key occurs on the other side of a join, known before either side is shuffled.

A search among few points moves a whole catalog to meet them, unless the catalog learns first which cells the points
touch. The cells are sent to the scan: themselves while they are few, else as a bitmap of hashed cells. The bitmap lets
some rows through in vain; it never holds one back that has a partner.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almagest.operators.skew import BROADCAST_BYTES

# Bytes that a key takes when it is sent as it is, and bits that it gets in a bitmap.
KEY_BYTES = 32
KEY_BITS = 8
# A bitmap travels in rows of this many words of 64 bits.
WORDS = 512
ROW_BITS = 64 * WORDS


def key_count(df: DataFrame, keys: Sequence[str]) -> int:
    """Different keys, roughly: one aggregate row."""
    return df.agg(F.approx_count_distinct(F.xxhash64(*keys)).alias("n")).first()["n"]


def bitmap_bits(keys: int, limit: int = BROADCAST_BYTES) -> int:
    """Size of the bitmap for so many keys, a power of two; at most ``limit`` bytes."""
    return max(ROW_BITS, min(1 << (8 * limit).bit_length() - 1, 1 << (KEY_BITS * keys).bit_length()))


def _place(keys: Sequence[str], bits: int) -> Column:
    return F.xxhash64(*keys).bitwiseAND(F.lit(bits - 1))


def key_bitmap(df: DataFrame, keys: Sequence[str], bits: int) -> DataFrame:
    """(__row, __words): the bitmap in rows of ``WORDS`` words, those without a bit as zeros."""
    place = _place(keys, bits)
    bit = F.expr("shiftleft(1L, int(__place & 63L))").alias("__bit")
    marked = df.select(place.alias("__place")).select(F.shiftright("__place", 6).alias("__word"), bit)
    empty = df.sparkSession.range(bits // 64).select(F.col("id").alias("__word"), F.lit(0).cast("bigint").alias("__bit"))
    words = marked.unionByName(empty).groupBy("__word").agg(F.bit_or("__bit").alias("__bit"))
    listed = F.sort_array(F.collect_list(F.struct("__word", "__bit")))
    rows = words.groupBy(F.floor(F.col("__word") / WORDS).alias("__row")).agg(listed.alias("__list"))
    return rows.select("__row", F.col("__list.__bit").alias("__words"))


def with_occurring_keys(df: DataFrame, other: DataFrame, keys: Sequence[str], limit: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``other``, and when there are too many keys to send them, a few more.

    ``limit`` bounds the bytes that are sent. With more keys than a bitmap of that size has bits, it would hold
    back little, and all rows stay.
    """
    n = key_count(other, keys)
    if n * KEY_BYTES <= limit:
        return df.join(F.broadcast(other.select(*keys).distinct()), list(keys), "left_semi")
    bits = bitmap_bits(n, limit)
    if n > bits:
        return df
    bitmap = F.broadcast(key_bitmap(other, keys, bits))
    word = F.get("__words", F.shiftright(_place(keys, bits), 6).bitwiseAND(F.lit(WORDS - 1)).cast("int"))
    held = df.withColumn("__row", F.shiftright(_place(keys, bits), 15)).join(bitmap, "__row")
    bit = F.call_function("bit_get", word, _place(keys, bits).bitwiseAND(F.lit(63)).cast("int"))
    return held.where(bit == 1).drop("__row", "__words")
