"""The domain's tables as fixed projections of the stored ones (words, spans, videos, measures)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import text as T


#: Turns whose words make a part: about a hundred thousand words.
PART_TURNS = 1_000
#: Rows of other tables that make a part.
PART_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_out(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """rows dealt out by key once, a part for each PART_ROWS of the n rows that they come from: what sorts or gathers a part in a task doesn't grow with the table."""
    return rows.repartition(max(1, -(-n // PART_ROWS)), *by)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the conversations: conv_id, idx (from 1), word, norm, start_ms, end_ms, ends_sentence, ends_clause.

    A word takes as long as saying it should, then comes a pause of 700 ms after a sentence and 250 ms
    after a clause.  Words without an ASCII letter or digit are dropped.

    Words are dealt out by conversation once, a part for each PART_TURNS turns, so a task's share doesn't grow with the table; they go out bare, so all that a
    query makes of them reads the same shuffle.  The hint goes with whatever is made of the words up to the next join: Spark's estimate for them is the size of the stored texts, or of what was
    shuffled once it is compressed, and by either it broadcasts far more rows than the driver holds."""
    turns = table(spark, sf_dir, "conversations")
    parts = -(-turns.count() // PART_TURNS)
    split = turns.where("text is not null").select("conv_id", "turn", F.posexplode(F.split("text", r"[ \t\n\r\f]+")).alias("pos", "word"))
    split = split.where(F.lower("word").rlike("[a-z0-9]")).repartition(max(1, parts), "conv_id")
    split = split.withColumn("norm", F.regexp_replace(F.lower("word"), "[^a-z0-9']", ""))
    split = split.select("*", T.plausible_ms(F.col("word")).alias("ms"), F.col("word").rlike("[.?!]$").alias("ends_sentence"), F.col("word").rlike("[.?!,;:]$").alias("ends_clause"))
    pause = F.when(F.col("ends_sentence"), 700).when(F.col("ends_clause"), 250).otherwise(0)
    order = W.partitionBy("conv_id").orderBy("turn", "pos")
    start = F.coalesce(F.sum(F.col("ms") + pause).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    split = split.select("*", F.row_number().over(order).cast("long").alias("idx"), start.alias("start_ms"))
    split = split.select("conv_id", "idx", "word", "norm", "start_ms", (F.col("start_ms") + F.col("ms")).alias("end_ms"), "ends_sentence", "ends_clause")
    return split.hint("merge")


WORDS_SQL = r"""
split AS (
  SELECT conv_id, turn, unnest(string_split_regex(text, '[ \t\n\r\f]+')) AS word, generate_subscripts(string_split_regex(text, '[ \t\n\r\f]+'), 1) AS pos
  FROM conversations WHERE text IS NOT NULL),
normed AS (
  SELECT *, regexp_replace(lower(word), '[^a-z0-9'']', '', 'g') AS norm,
         CAST(100 + 65 * length(regexp_replace(lower(word), '[^a-z0-9]', '', 'g')) AS BIGINT) AS ms,
         regexp_matches(word, '[.?!]$') AS ends_sentence, regexp_matches(word, '[.?!,;:]$') AS ends_clause
  FROM split),
words AS (
  SELECT conv_id, CAST(row_number() OVER o AS BIGINT) AS idx, word, norm,
         CAST(coalesce(sum(ms + CASE WHEN ends_sentence THEN 700 WHEN ends_clause THEN 250 ELSE 0 END) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms,
         CAST(coalesce(sum(ms + CASE WHEN ends_sentence THEN 700 WHEN ends_clause THEN 250 ELSE 0 END) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + ms AS BIGINT) AS end_ms,
         ends_sentence, ends_clause
  FROM normed WHERE regexp_matches(norm, '[a-z0-9]') WINDOW o AS (PARTITION BY conv_id ORDER BY turn, pos))"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the events: kind, id, b, e (microseconds; e = b + value seconds, at least b)."""
    events = table(spark, sf_dir, "events").where("value is not null")
    begin = F.unix_micros(F.col("ts").cast("timestamp"))
    length = F.greatest(F.floor(F.col("value") * 1000000), F.lit(0)).cast("long")
    return events.select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"), F.col("user_id"), begin.alias("b"), (begin + length).alias("e"))


SPANS_SQL = """
spans AS (
  SELECT event_type AS kind, event_id AS id, user_id, epoch_us(ts) AS b,
         epoch_us(ts) + CAST(greatest(floor(value * 1000000), 0) AS BIGINT) AS e
  FROM events WHERE value IS NOT NULL)"""


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos of creators: creator, video, views, published."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_custkey").alias("creator"), F.col("o_orderkey").alias("video"), F.floor("o_totalprice").cast("long").alias("views"), F.col("o_orderdate").alias("published"))


VIDEOS_SQL = """
videos AS (SELECT o_custkey AS creator, o_orderkey AS video, CAST(floor(o_totalprice) AS BIGINT) AS views, o_orderdate AS published FROM orders)"""


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of videos: video, nr, category, entrance, hold (whole seconds), x0, y0, x1, y1 (percent of the frame)."""
    items = table(spark, sf_dir, "lineitem")
    x0, y0 = F.floor(F.col("l_discount") * 100 + 0.5).cast("long"), F.floor(F.col("l_tax") * 100 + 0.5).cast("long")
    return items.select(
        F.col("l_orderkey").alias("video"), F.col("l_linenumber").cast("long").alias("nr"), F.col("l_returnflag").alias("category"),
        F.col("l_linestatus").alias("entrance"), F.col("l_quantity").cast("long").alias("hold"), x0.alias("x0"), y0.alias("y0"),
        (x0 + 20 + F.col("l_partkey") % 60).alias("x1"), (y0 + 20 + F.col("l_suppkey") % 60).alias("y1"),
    )


MEASURES_SQL = """
measures AS (
  SELECT l_orderkey AS video, CAST(l_linenumber AS BIGINT) AS nr, l_returnflag AS category, l_linestatus AS entrance, CAST(l_quantity AS BIGINT) AS hold,
         CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS x0, CAST(floor(l_tax * 100 + 0.5) AS BIGINT) AS y0,
         CAST(floor(l_discount * 100 + 0.5) AS BIGINT) + 20 + l_partkey % 60 AS x1, CAST(floor(l_tax * 100 + 0.5) AS BIGINT) + 20 + l_suppkey % 60 AS y1
  FROM lineitem)"""
