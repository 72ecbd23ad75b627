"""Reading the input tables and cutting lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as spark.checkpoint.dir names it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = context.getConf().get("spark.checkpoint.dir")
        if not configured:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def written(df: DataFrame, *parts: str) -> DataFrame:
    """df, written as Parquet in the shared folder (a folder for each value of parts) and read again."""
    at = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*parts).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: Rows of a batch of whole texts on its way to Python, unless the session has a number of its own (Spark's is 10,000).
TEXT_ROWS = 2_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def texts_in_small_batches(df: DataFrame) -> DataFrame:
    """df; from now on its session sends TEXT_ROWS rows at a time to Python, where that number hasn't been set."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == "10000":
        conf.set(_BATCH, str(TEXT_ROWS))
    return df


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder, so that lost executors don't bring back its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: A group is hot if it holds more than this part of all rows, so there are at most so many of them.
HOT_GROUPS = 4_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows, left-joined with groups (one row per value of the string column key; size: how many rows have it, of total in all).

    At most HOT_GROUPS groups can be hot; they are broadcast, and their rows are dealt out evenly instead of by key."""
    values = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) * HOT_GROUPS > total).select(F.col(key).alias("__key"), F.struct(*values).alias("__hot"))
    rest = groups.where(F.col(size) * HOT_GROUPS <= total).select(F.col(key).alias("__own"), F.struct(*values).alias("__rest"))
    rows = rows.join(F.broadcast(hot), F.col(key) == F.col("__key"), "left")
    rows = rows.withColumn("__dealt", F.when(F.col("__hot").isNull(), F.col(key)).otherwise(F.concat(F.lit("hot "), F.monotonically_increasing_id().cast("string"))))
    rows = rows.join(rest, F.col("__dealt") == F.col("__own"), "left")
    return rows.select(*[c for c in rows.columns if not c.startswith("__")], *[F.coalesce(F.col("__hot")[v], F.col("__rest")[v]).alias(v) for v in values])


#: Rows that may be broadcast as a bitmap's positions are set in at most so many bits (32 MB).
BITMAP_BITS = 1 << 28


def bitmaps(slots: DataFrame) -> DataFrame:
    """Of rows (slot, from 0): (bucket, bitmap)."""
    slot = F.col("slot") + 1
    return slots.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bitmap"))


def bit(bitmap: Column, slot: Column) -> Column:
    """Whether slot, from 0, is set in the bitmap of its bucket."""
    at = F.bitmap_bit_position(slot + 1)
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int")) == 1


def among(rows: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """The rows whose long key is in values (written down; distinct), and few others: a filter to go before a join.

    16 bits for each value, as long as that is at most BITMAP_BITS; beyond, more rows pass."""
    bits = min(BITMAP_BITS, 1 << max(20, (16 * values.count()).bit_length()))
    slot = F.pmod(F.col(key), F.lit(bits))
    found = F.broadcast(cut(bitmaps(values.select(slot.alias("slot")).distinct())))
    return rows.join(found, F.bitmap_bucket_number(slot + 1) == F.col("bucket")).where(bit(F.col("bitmap"), slot)).select(rows.columns)


def numbered(rows: DataFrame, number: str, numbers: DataFrame) -> DataFrame:
    """The rows whose number is in numbers (nth, distinct, written down), and perhaps others: a filter to go before a join, as bitmaps of up to 32 MB."""
    maps = cut(bitmaps(numbers.select(F.col("nth").alias("slot"))))
    if maps.count() * (1 << 15) > BITMAP_BITS:
        return rows
    found = rows.join(F.broadcast(maps), F.bitmap_bucket_number(F.col(number) + 1) == F.col("bucket"))
    return found.where(bit(F.col("bitmap"), F.col(number))).select(rows.columns)


def without(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """The rows of a table or of files whose monotonically_increasing_id() isn't in numbers (nth, distinct, written down).

    The numbers of a partition follow each other, so bitmaps hold them in a bit a row; they are broadcast up to 32 MB."""
    held = rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("row"), F.monotonically_increasing_id().alias("nth"))
    maps = cut(bitmaps(numbers.select(F.col("nth").alias("slot"))))
    if maps.count() * (1 << 15) <= BITMAP_BITS:
        held = held.join(F.broadcast(maps), F.bitmap_bucket_number(F.col("nth") + 1) == F.col("bucket"), "left")
        return held.where(F.col("bitmap").isNull() | ~bit(F.col("bitmap"), F.col("nth"))).select("row.*")
    return held.join(numbers.select(F.col("nth").alias("dropped")), F.col("nth") == F.col("dropped"), "left_anti").select("row.*")
