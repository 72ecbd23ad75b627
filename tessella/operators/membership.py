"""Whether a value can be among given ones: a bitmap that goes before an exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap at most (32 MB); with more values, more rows pass and nothing else changes.
MOST_BITS = 1 << 28


def _numbers(bitmap: Column) -> Column:
    """A block's bytes as numbers of 32 bits, so that a row takes one by its place instead of making a text of a byte."""
    return F.transform(F.sequence(F.lit(0), (F.length(bitmap) / 4 - 1).cast("int")), lambda k: F.conv(F.hex(F.substring(bitmap, (k * 4 + 1).cast("int"), F.lit(4))), 16, 10).cast("long"))


def _is_set(numbers: Column, slot: Column) -> Column:
    place = F.bitmap_bit_position(slot + 1)
    byte, bit = F.shiftright(place, 3), place.bitwiseAND(F.lit(7))
    return F.getbit(F.get(numbers, F.shiftright(place, 5).cast("int")), (24 - byte.bitwiseAND(F.lit(3)) * 8 + bit).cast("int")) == 1


def among(rows: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """The rows whose long `key` is one of values (one long column, distinct), and few others; none that is gets lost.

    16 bits for each value as long as that is at most MOST_BITS, in blocks of 4 KB that are broadcast."""
    bits = min(MOST_BITS, 1 << max(20, (16 * values.count()).bit_length()))
    slots = values.select(F.pmod(F.col(values.columns[0]), F.lit(bits)).alias("__slot")).distinct()
    maps = slots.groupBy(F.bitmap_bucket_number(F.col("__slot") + 1).alias("__block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("__slot") + 1)).alias("__bitmap"))
    maps = maps.select("__block", _numbers(F.col("__bitmap")).alias("__numbers"))
    slot = F.pmod(F.col(key), F.lit(bits))
    return rows.join(F.broadcast(maps), F.bitmap_bucket_number(slot + 1) == F.col("__block")).where(_is_set(F.col("__numbers"), slot)).select(rows.columns)
