"""Structured Streaming over event files: windows by event time, sessions, and a job queue with state."""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TTL_US = 900_000_000


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared one that spark.checkpoint.dir names."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = context.getConf().get("spark.checkpoint.dir")
        if not configured:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(configured)
    return f"{context.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def run_once(df: DataFrame, mode: str, close: Callable[[], None] | None = None) -> DataFrame:
    """Run the stream over what there is, and read what its last batch (complete) or all its batches (append, update) wrote.

    close adds rows that end the input, for which the stream runs once more."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    how = "overwrite" if mode == "complete" else "append"

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode(how).parquet(f"{folder}/out")

    for end in (None, close) if close else (None,):
        if end:
            end()
        df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def tumbling(spark: SparkSession, sf_dir: str, width: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Events and their whole values by window and type; rows later than the watermark are dropped in a running stream."""
    rows = read_events(spark, sf_dir).withWatermark("ts", late)
    counts = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor("value")).alias("total"))
    return counts.select(F.unix_micros("w.start").alias("start"), "event_type", "n", "total")


def sessions(spark: SparkSession, sf_dir: str, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    rows = read_events(spark, sf_dir).withWatermark("ts", late)
    found = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.unix_micros("w.start").alias("start"), "n")


def _claims(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A user's queue: a signup queues a job, a purchase claims the oldest job that is at most TTL_US old, others have gone stale.

    Rows come in any order, so they wait in the state and are taken in order of time once the watermark has passed them.
    A job that no row to come can claim leaves the state, and a user without jobs and waiting rows has none; a timer sees to it."""
    queue, at, ids, signups = (list(x) for x in state.get) if state.exists else ([], [], [], [])
    for batch in batches:
        batch = batch[batch["event_type"].isin(["signup", "purchase"])]
        at.extend(batch["at"].tolist())
        ids.extend(batch["event_id"].tolist())
        signups.extend((batch["event_type"] == "signup").tolist())
    passed = state.getCurrentWatermarkMs()
    waiting = sorted(zip(at, ids, signups, strict=True))
    ready = bisect_left(waiting, passed * 1000, key=lambda row: row[0])
    out = []
    for now, _, signup in waiting[:ready]:
        if signup:
            queue.append(now)
        else:
            queue = [t for t in queue if now - t <= TTL_US]
            if queue:
                out.append((key[0], queue.pop(0), now))
    waiting = waiting[ready:]
    queue = [t for t in queue if passed * 1000 - t <= TTL_US]
    if queue or waiting:
        state.update((queue, *([int(row[k]) for row in waiting] for k in range(2)), [bool(row[2]) for row in waiting]))
        due = min([row[0] // 1000 for row in waiting[:1]] + [(t + TTL_US) // 1000 + 1 for t in queue[-1:]])
        state.setTimeoutTimestamp(max(passed, due) + 1)
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=["user_id", "queued", "claimed"])


def job_queue(spark: SparkSession, rows: DataFrame, late: str = "1 day") -> DataFrame:
    """Claims of queued jobs: (user_id, queued, claimed), in microseconds; rows later than the watermark are dropped in a running stream."""
    rows = rows.withWatermark("ts", late).select("user_id", "event_id", "event_type", "ts", F.unix_micros("ts").alias("at"))
    return rows.groupBy("user_id").applyInPandasWithState(_claims, "user_id long, queued long, claimed long", "queue array<long>, at array<long>, ids array<long>, signups array<boolean>", "append", GroupStateTimeout.EventTimeTimeout)


def all_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims of all events there are: a last row far ahead (pandas holds years up to 2262) moves the watermark past them."""
    rows = read_events(spark, sf_dir).where("event_type in ('signup', 'purchase')").select("user_id", "event_id", "event_type", "ts")
    ends = shared_folder(spark)
    spark.createDataFrame([], rows.schema).write.parquet(ends)
    last = spark.range(1).select(*[F.lit("2260-01-01" if f.name == "ts" else "end" if f.name == "event_type" else None).cast(f.dataType).alias(f.name) for f in rows.schema])
    claims = job_queue(spark, rows.unionByName(spark.readStream.schema(rows.schema).parquet(ends)))
    return run_once(claims, "append", lambda: last.write.mode("append").parquet(ends))
