"""A job log's state: who may write, what is stale, who is busy, steps, waits, phases and liveness.

Jobs are orders: the owner is the customer (none for every seventh), the kind the first digit of the priority, the state O (queued), P (taken) or F (done), and the last touch the order's date; now is the last date there is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators import intervals
from tessella.operators.islands import islands
from tessella.sources.views import SPANS_SQL, spans, table

STALE_DAYS, LIVE_DAYS, KEPT_STEPS = 900, 120, 30
DAY = 86_400_000_000


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job, owner, kind, state, key, touched): owner is null where nobody has taken it; with age, in days before now."""
    rows = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "taken").otherwise("done")
    rows = rows.select(F.col("o_orderkey").alias("job"), F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("owner"), (F.col("o_orderkey") % 4).alias("kind"), state.alias("state"), (F.col("o_custkey") % 50).alias("key"), F.to_date("o_orderdate").alias("touched"))
    now = rows.agg(F.max("touched").alias("now"))
    return rows.crossJoin(F.broadcast(now)).withColumn("age", F.date_diff("now", "touched").cast("long")).drop("now", "touched")  # one row


JOBS_SQL = """jobs AS (SELECT o_orderkey AS job, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS owner, o_orderkey % 4 AS kind, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'taken' ELSE 'done' END AS state,
  o_custkey % 50 AS key, date_diff('day', CAST(o_orderdate AS DATE), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)) AS age FROM orders)"""


def writable_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For sessions 1 to 5: how many jobs each may write to (its own, nobody's, and stale ones), and how many of these it would take over from another."""
    rows = jobs(spark, sf_dir).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))).alias("session"))
    stale = (F.col("state") == "taken") & (F.col("age") > STALE_DAYS)
    rows = rows.where(F.col("owner").isNull() | (F.col("owner") == F.col("session")) | stale)
    return rows.groupBy("session").agg(F.count("*").alias("n"), F.count_if(F.col("owner").isNotNull() & (F.col("owner") != F.col("session"))).alias("adopted"))


def busy_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job each owner is on: its latest taken one that isn't of kind 0, else its latest done one of kind 1 touched lately."""
    rows = jobs(spark, sf_dir).where("owner is not null and kind != 0")
    taken = F.col("state") == "taken"
    editing = (F.col("kind") == 1) & (F.col("state") == "done") & (F.col("age") <= LIVE_DAYS)
    found = rows.groupBy("owner").agg(F.max(F.when(taken, F.col("job"))).alias("taken"), F.max(F.when(editing, F.col("job"))).alias("editing"))
    return found.select("owner", F.coalesce("taken", "editing").alias("job"), F.when(F.col("taken").isNotNull(), "taken").when(F.col("editing").isNotNull(), "editing").alias("why")).where("job is not null")


def reported_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job that a report on a kind and key belongs to, among the taken ones: the latest; and by kind and owner alone, only if there is one."""
    rows = jobs(spark, sf_dir).where("state = 'taken'")
    by_key = rows.groupBy("kind", "key").agg(F.max("job").alias("job")).select("kind", F.lit("key").alias("by"), "key", "job")
    alone = rows.where("owner is not null").groupBy("kind", "owner").agg(F.count("*").alias("n"), F.max("job").alias("job")).where("n = 1")
    return by_key.unionByName(alone.select("kind", F.lit("owner").alias("by"), F.col("owner").alias("key"), "job"))


def live_and_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs(spark, sf_dir)
    kind = F.when(F.col("age") <= LIVE_DAYS, "live").when((F.col("state") == "taken") & (F.col("age") > STALE_DAYS), "stale").otherwise("idle")
    return rows.groupBy("state", kind.alias("liveness")).agg(F.count("*").alias("n"), F.min("age").alias("youngest"))


def open_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's activity: the same step again in a row only refreshes it; the last 30 steps stay, and only the last is open."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    w = W.partitionBy("user_id").orderBy("event_id")
    runs = islands(rows, ["user_id"], ["event_id"], F.lag("event_type").over(w) != F.col("event_type"), "step")
    runs = runs.groupBy("user_id", "step", "event_type").agg(F.min("event_id").alias("first"), F.max("event_id").alias("refreshed"))
    last = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("step")))
    return runs.withColumn("from_last", last).where(F.col("from_last") <= KEPT_STEPS).select("user_id", "event_type", "first", "refreshed", (F.col("from_last") == 1).alias("open"))


def stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's stages (views) less the time in which one of the user's errors or purchases was open, waits counted once."""
    rows = spans(spark, sf_dir)
    waits = intervals.union(rows.where("kind in ('error', 'purchase')").select("user_id", "b", "e"), ["user_id"], width=365 * DAY)
    stages = rows.where("kind = 'view'").select("user_id", "id", "b", "e")
    found = intervals.overlap_sum(stages, waits.select("user_id", "b", "e"), ["user_id"], ["id"], 600_000_000)
    return stages.join(found, ["user_id", "id"]).select("user_id", "id", (F.col("e") - F.col("b") - F.col("covered")).alias("busy"))


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each user's work is, from its events: by the last one, and whether there has been a purchase at all."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last"), F.count_if(F.col("event_type") == "purchase").alias("sent"), F.count("*").alias("n"))
    phase = F.when(F.col("last") == "error", "ask").when(F.col("sent") == 0, "cutting").when(F.col("last") == "purchase", "done").when((F.col("last") == "signup") & (F.col("sent") > 0), "making").otherwise("ready")
    return rows.select("user_id", phase.alias("phase"), "n")


def next_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stalls: events of a user that no other follows within two days."""
    rows = spans(spark, sf_dir).select("user_id", "id", "b")
    after = F.lead("b").over(W.partitionBy("user_id").orderBy("b", "id"))
    return rows.withColumn("after", after).where(F.col("after") - F.col("b") > 2 * DAY).groupBy("user_id").agg(F.count("*").alias("stalls"), F.max(F.col("after") - F.col("b")).alias("longest"))


def hedged_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks (clicks) that run over twice the median of their user's: they would be started again; the first to end counts."""
    rows = spans(spark, sf_dir).where("kind = 'click'").select("user_id", "id", (F.col("e") - F.col("b")).alias("took"))
    middle = rows.groupBy("user_id").agg(F.percentile("took", F.lit(0.5)).alias("median"))
    return rows.join(middle, "user_id").where("took > 2 * median").groupBy("user_id").agg(F.count("*").alias("hedged"), F.max("took").alias("longest"), F.first("median").alias("median"))


def recent_distinct(spark: SparkSession, sf_dir: str, most: int = 5) -> DataFrame:
    """A user's last five distinct values (floored), by when they came last; newest first."""
    rows = table(spark, sf_dir, "events").where("value is not null").groupBy("user_id", F.floor("value").cast("long").alias("value")).agg(F.max("event_id").alias("last"))
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("last")))
    return rows.withColumn("place", rank.cast("long")).where(F.col("place") <= most).select("user_id", "place", "value")


def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests (clicks, by user and whole value) that the same request within the last three days had answered already: hits of a cache that forgets."""
    rows = spans(spark, sf_dir).where("kind = 'click'").select("user_id", "id", "b", F.floor((F.col("e") - F.col("b")) / 20_000_000).alias("asked"))
    before = F.lag("b").over(W.partitionBy("user_id", "asked").orderBy("b", "id"))
    return rows.withColumn("hit", F.coalesce(F.col("b") - before <= 3 * DAY, F.lit(False))).groupBy("user_id").agg(F.count_if("hit").alias("hits"), F.count("*").alias("n"))


QUERIES = {q.__name__: q for q in (writable_jobs, busy_sessions, reported_jobs, live_and_stale, open_steps, stage_times, phases, next_waits, hedged_tasks, recent_distinct, cached_answers)}

ORACLE_SQL = {
    "writable_jobs": f"""WITH {JOBS_SQL}, s AS (SELECT *, unnest(range(1, 6)) AS session FROM jobs) SELECT session, count(*) AS n, count(*) FILTER (WHERE owner <> session) AS adopted FROM s
        WHERE owner IS NULL OR owner = session OR (state = 'taken' AND age > {STALE_DAYS}) GROUP BY 1""",
    "busy_sessions": f"""WITH {JOBS_SQL}, b AS (SELECT owner, max(job) FILTER (WHERE state = 'taken') AS t, max(job) FILTER (WHERE kind = 1 AND state = 'done' AND age <= {LIVE_DAYS}) AS d FROM jobs WHERE owner IS NOT NULL AND kind <> 0 GROUP BY 1)
        SELECT owner, coalesce(t, d) AS job, CASE WHEN t IS NOT NULL THEN 'taken' ELSE 'editing' END AS why FROM b WHERE coalesce(t, d) IS NOT NULL""",
    "reported_jobs": f"WITH {JOBS_SQL}, t AS (SELECT * FROM jobs WHERE state = 'taken') SELECT kind, 'key' AS by, key, max(job) AS job FROM t GROUP BY kind, key UNION ALL SELECT kind, 'owner', owner, max(job) FROM t WHERE owner IS NOT NULL GROUP BY kind, owner HAVING count(*) = 1",
    "live_and_stale": f"WITH {JOBS_SQL} SELECT state, CASE WHEN age <= {LIVE_DAYS} THEN 'live' WHEN state = 'taken' AND age > {STALE_DAYS} THEN 'stale' ELSE 'idle' END AS liveness, count(*) AS n, min(age) AS youngest FROM jobs GROUP BY 1, 2",
    "open_steps": f"""WITH f AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS c FROM events),
        s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS step FROM f), g AS (SELECT user_id, step, event_type, min(event_id) AS first, max(event_id) AS refreshed FROM s GROUP BY 1, 2, 3)
        SELECT user_id, event_type, first, refreshed, row_number() OVER (PARTITION BY user_id ORDER BY step DESC) = 1 AS open FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY step DESC) <= {KEPT_STEPS}""",
    "stage_times": f"""WITH {SPANS_SQL}, w AS (SELECT user_id, b, e, max(e) OVER (PARTITION BY user_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM spans WHERE kind IN ('error', 'purchase')),
        r AS (SELECT *, sum(CASE WHEN pe IS NULL OR b > pe THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS run FROM w), m AS (SELECT user_id, min(b) AS b, max(e) AS e FROM r GROUP BY user_id, run)
        SELECT s.user_id, s.id, s.e - s.b - CAST(coalesce(sum(least(s.e, m.e) - greatest(s.b, m.b)) FILTER (WHERE m.b IS NOT NULL), 0) AS BIGINT) AS busy FROM spans s LEFT JOIN m ON m.user_id = s.user_id AND s.b < m.e AND m.b < s.e WHERE s.kind = 'view' GROUP BY s.user_id, s.id, s.b, s.e""",
    "phases": """WITH u AS (SELECT user_id, arg_max(event_type, event_id) AS last, count(*) FILTER (WHERE event_type = 'purchase') AS sent, count(*) AS n FROM events GROUP BY 1)
        SELECT user_id, CASE WHEN last = 'error' THEN 'ask' WHEN sent = 0 THEN 'cutting' WHEN last = 'purchase' THEN 'done' WHEN last = 'signup' THEN 'making' ELSE 'ready' END AS phase, n FROM u""",
    "next_waits": f"WITH {SPANS_SQL}, a AS (SELECT user_id, lead(b) OVER (PARTITION BY user_id ORDER BY b, id) - b AS wait FROM spans) SELECT user_id, count(*) AS stalls, max(wait) AS longest FROM a WHERE wait > {2 * DAY} GROUP BY 1",
    "hedged_tasks": f"WITH {SPANS_SQL}, c AS (SELECT user_id, e - b AS took, median(e - b) OVER (PARTITION BY user_id) AS median FROM spans WHERE kind = 'click') SELECT user_id, count(*) AS hedged, max(took) AS longest, any_value(median) AS median FROM c WHERE took > 2 * median GROUP BY 1",
    "recent_distinct": "WITH v AS (SELECT user_id, CAST(floor(value) AS BIGINT) AS value, max(event_id) AS last FROM events WHERE value IS NOT NULL GROUP BY 1, 2) SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY last DESC) AS place, value FROM v QUALIFY place <= 5",
    "cached_answers": f"""WITH {SPANS_SQL}, c AS (SELECT user_id, coalesce(b - lag(b) OVER (PARTITION BY user_id, (e - b) // 20000000 ORDER BY b, id) <= {3 * DAY}, false) AS hit FROM spans WHERE kind = 'click') SELECT user_id, count(*) FILTER (WHERE hit) AS hits, count(*) AS n FROM c GROUP BY 1""",
}
