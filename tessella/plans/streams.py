"""Streams over the events, run once over what there is, and lines of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources import documents
from tessella.sources.views import table
from tessella.streaming import events


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.run_once(events.tumbling(spark, sf_dir), "complete")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.run_once(events.sessions(spark, sf_dir), "complete")


def stream_job_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.all_claims(spark, sf_dir)


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.page_lines(table(spark, sf_dir, "pages"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's title, and how many links and paragraphs it has."""
    rows = table(spark, sf_dir, "pages")
    return rows.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<a ")).cast("long").alias("links"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"))


QUERIES = {q.__name__: q for q in (stream_tumbling, stream_sessions, stream_job_queue, page_lines, page_titles)}

ORACLE_SQL = {
    "stream_tumbling": "SELECT epoch_us(ts) // 21600000000 * 21600000000 AS start, event_type, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS total FROM events GROUP BY 1, 2",
    "stream_sessions": """WITH g AS (SELECT user_id, epoch_us(ts) AS b, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
        s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY b, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g)
        SELECT user_id, min(b) AS start, count(*) AS n FROM s GROUP BY user_id, s""",
    "stream_job_queue": """WITH RECURSIVE v AS (SELECT user_id, event_type = 'signup' AS signup, epoch_us(ts) AS at_, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events WHERE event_type IN ('signup', 'purchase')),
        r AS (SELECT user_id, 0 AS k, CAST([] AS BIGINT[]) AS queue, CAST(NULL AS BIGINT) AS queued, CAST(NULL AS BIGINT) AS claimed FROM (SELECT DISTINCT user_id FROM v)
              UNION ALL SELECT user_id, k, CASE WHEN signup THEN list_append(queue, at_) ELSE live[2:] END, CASE WHEN NOT signup THEN live[1] END, CASE WHEN NOT signup AND len(live) > 0 THEN at_ END
              FROM (SELECT v.*, r.queue, list_filter(r.queue, lambda t: v.at_ - t <= 900000000) AS live FROM r JOIN v ON v.user_id = r.user_id AND v.k = r.k + 1))
        SELECT user_id, queued, claimed FROM r WHERE claimed IS NOT NULL""",
    "page_titles": "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST((length(html) - length(replace(html, '<a ', ''))) // 3 AS BIGINT) AS links, CAST((length(html) - length(replace(html, '<p>', ''))) // 3 AS BIGINT) AS paragraphs FROM pages",
}
