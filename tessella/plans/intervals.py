"""Interval algebra and as-of lookups over the events' spans, and kept and cut words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators import intervals
from tessella.operators.asof import asof
from tessella.operators.islands import following, integer_runs, islands, previous, value_runs
from tessella.sources.views import SPANS_SQL, WORDS_SQL, spans, table, words

SECOND = 1_000_000
BUCKET = 600 * SECOND
CLICKS, CUTS = ("click", "view"), ("error",)


def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union(spans(spark, sf_dir), ["kind"])


def interval_union_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals at most a minute apart are one."""
    return intervals.union(spans(spark, sf_dir), ["kind"], 60 * SECOND)


def interval_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.complement(spans(spark, sf_dir), ["kind"])


def _day(rows: DataFrame) -> DataFrame:
    return rows.withColumn("day", F.floor(F.col("b") / (86_400 * SECOND)))


_DAYS_SQL = f"{SPANS_SQL}, days AS (SELECT *, b // 86400000000 AS day FROM spans)"
_MERGED_SQL = """merged AS (
  SELECT {by}, run, min(b) AS b, max(e) AS e, count(*) AS n FROM (
    SELECT *, sum(CASE WHEN pe IS NULL OR b > pe + {tol} THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS run
    FROM (SELECT *, max(e) OVER (PARTITION BY {by} ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM {src})) GROUP BY {by}, run)"""


def interval_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a day's clicks and views no error span of that day covers."""
    rows = _day(spans(spark, sf_dir))
    keep, cut = rows.where(F.col("kind").isin(*CLICKS)), rows.where(F.col("kind").isin(*CUTS))
    return intervals.difference(keep, cut, ["day"], ["id"], BUCKET)


def kept_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each click or view the day's purchases overlap."""
    rows = _day(spans(spark, sf_dir))
    return intervals.overlap_sum(rows.where(F.col("kind").isin(*CLICKS)), rows.where("kind = 'purchase'"), ["day"], ["id"], BUCKET)


def longest_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest overlap of any signup with each error of its day; 0 if none."""
    rows = _day(spans(spark, sf_dir))
    errors = rows.where("kind = 'error'").select("day", "id", "b", "e")
    found = intervals.overlap_join(errors, rows.where("kind = 'signup'").select("day", "b", "e"), ["day"], BUCKET)
    most = found.groupBy("id").agg(F.max(F.least("e", "re") - F.greatest("b", "rb")).alias("longest"))
    return errors.select("id").join(most, "id", "left").select("id", F.coalesce("longest", F.lit(0).cast("long")).alias("longest"))


def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spans of one kind that overlap."""
    rows = spans(spark, sf_dir).select("kind", "id", "b", "e")
    pairs = intervals.overlap_join(rows, rows.withColumnRenamed("id", "other"), ["kind"], BUCKET).where("id < other")
    return pairs.select("kind", "id", "other", (F.least("e", "re") - F.greatest("b", "rb")).alias("shared"))


def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors' starts inside a view of the same day: the view with the smallest id."""
    rows = _day(spans(spark, sf_dir))
    points = rows.where("kind = 'error'").select("day", "id", "b", F.col("b").alias("e"))
    views = rows.where("kind = 'view'").select("day", F.col("id").alias("view"), "b", "e")
    found = intervals.overlap_join(points, views, ["day"], BUCKET, touching=True).where("b >= rb and b < re")
    return found.groupBy("id").agg(F.min("view").alias("view"))


def exists_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day, the share of errors with a click starting within 30 minutes."""
    rows = _day(spans(spark, sf_dir))
    errors = rows.where("kind = 'error'").select("day", "id", (F.col("b") - 1800 * SECOND).alias("b"), (F.col("b") + 1800 * SECOND).alias("e"))
    clicks = rows.where("kind = 'click'").select("day", "b", F.col("b").alias("e"))
    near = intervals.overlap_join(errors, clicks, ["day"], BUCKET, touching=True).select("day", "id").distinct().withColumn("hit", F.lit(1))
    return errors.select("day", "id").join(near, ["day", "id"], "left").groupBy("day").agg(F.count("*").alias("n"), (F.count("hit") / F.count("*")).alias("share"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = spans(spark, sf_dir).select("user_id", "id", "kind", "b")
    return rows.where("kind = 'purchase'").drop("kind"), rows.where("kind = 'click'").select("user_id", F.col("id").alias("click"), F.col("b").alias("at"))


def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    return asof(left, right, ["user_id"], "b", "at", "click").select("user_id", "id", F.col("found.click").alias("click"), (F.col("b") - F.col("found.at")).alias("wait"))


def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    return asof(left, right, ["user_id"], "b", "at", "click", "forward", strict=True).select("user_id", "id", F.col("found.click").alias("click"), (F.col("found.at") - F.col("b")).alias("wait"))


def nearest_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A purchase's time snapped to the user's nearest click within six hours, else kept."""
    left, right = _sides(spark, sf_dir)
    found = asof(left, right, ["user_id"], "b", "at", "click", "nearest")
    return found.select("user_id", "id", F.when(F.abs(F.col("found.at") - F.col("b")) <= 6 * 3600 * SECOND, F.col("found.at")).otherwise(F.col("b")).alias("snapped"))


def session_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's sessions: a new one after 12 hours without an event."""
    rows = spans(spark, sf_dir).withColumn("gap", F.col("b") - previous("b", ["user_id"], ["b", "id"]))
    found = islands(rows, ["user_id"], ["b", "id"], F.col("gap") > 12 * 3600 * SECOND, "session").groupBy("user_id", F.col("session").cast("long").alias("session"))
    return found.agg(F.count("*").alias("n"), F.min("b").alias("b"), F.max("b").alias("e"))


def consecutive_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive ids within a kind."""
    return integer_runs(spans(spark, sf_dir), ["kind"], "id")


def still_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three or more events of a user in a row with a value under 60."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), (F.col("value") < 60).alias("low"))
    found = value_runs(rows, ["user_id"], ["id"], F.col("low")).where("low").groupBy("user_id", "run")
    return found.agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last")).where("n >= 3").drop("run")


def isolated_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with at least three times the value of the two neighbours on each side."""
    w = W.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), "value", F.max("value").over(w.rowsBetween(-2, -1)).alias("before"), F.max("value").over(w.rowsBetween(1, 2)).alias("after"))
    return rows.where("before is not null and after is not null and value >= 3 * greatest(before, after)").select("user_id", "id", "value")


def rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred median of seven events of a user."""
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(-3, 3)
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), F.percentile("value", F.lit(0.5)).over(w).alias("median"))


def direction_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a user's values turn between rising and falling; equal ones are passed over."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), "value")
    rows = rows.withColumn("way", F.signum(F.col("value") - previous("value", ["user_id"], ["id"]))).where("way != 0")
    rows = rows.withColumn("turn", F.col("way") != previous("way", ["user_id"], ["id"]))
    return rows.groupBy("user_id").agg(F.count_if("turn").alias("turns"))


def _cut(rows: DataFrame) -> DataFrame:
    """Words to be cut: every eleventh, and hesitations."""
    return rows.withColumn("cut", (F.col("idx") % 11 == 0) | F.col("norm").isin("um", "uh", "er", "the"))


def retime_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept words on the time line without the cut ones: pieces of kept words close up."""
    rows = _cut(words(spark, sf_dir))
    w = W.partitionBy("conv_id").orderBy("idx")
    lost = F.coalesce(F.sum(F.when(F.col("cut"), F.col("end_ms") - F.col("start_ms")).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("lost", lost).where("not cut").select("conv_id", "idx", (F.col("start_ms") - F.col("lost")).alias("start_ms"), (F.col("end_ms") - F.col("lost")).alias("end_ms"))


def kept_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of kept words: their bounds, and where they begin in the cut version."""
    rows = value_runs(_cut(words(spark, sf_dir)), ["conv_id"], ["idx"], F.col("cut")).where("not cut")
    runs = rows.groupBy("conv_id", F.col("run").cast("long").alias("run")).agg(F.min("start_ms").alias("b"), F.max("end_ms").alias("e"), F.count("*").alias("n"))
    before = F.sum(F.col("e") - F.col("b")).over(W.partitionBy("conv_id").orderBy("b").rowsBetween(W.unboundedPreceding, -1))
    return runs.select("conv_id", "run", "b", "e", "n", F.coalesce(before, F.lit(0).cast("long")).alias("offset"))


def splice_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The silence left around each cut word: to the kept word before it, and to the one after it."""
    rows = _cut(words(spark, sf_dir))
    w = W.partitionBy("conv_id").orderBy("idx")
    before = F.last(F.when(~F.col("cut"), F.col("end_ms")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.first(F.when(~F.col("cut"), F.col("start_ms")), ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    return rows.withColumn("left_ms", F.col("start_ms") - before).withColumn("right_ms", after - F.col("end_ms")).where("cut").select("conv_id", "idx", "left_ms", "right_ms")


def silence_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pauses over 0.6 s shrunk to 0.25 s: the part to cut out of each."""
    rows = words(spark, sf_dir).withColumn("next_ms", following("start_ms", ["conv_id"], ["idx"]))
    return rows.where(F.col("next_ms") - F.col("end_ms") > 600).select("conv_id", "idx", (F.col("end_ms") + 125).alias("b"), (F.col("next_ms") - 125).alias("e"))


def frame_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept runs in frames at 30 a second: starts rounded down, ends up but not past the next word's frame."""
    rows = kept_runs(spark, sf_dir)
    after = F.floor(F.lead("b").over(W.partitionBy("conv_id").orderBy("b")) * 30 / 1000)
    end = F.ceil(F.col("e") * 30 / 1000)
    return rows.select("conv_id", "run", F.floor(F.col("b") * 30 / 1000).cast("long").alias("first_frame"), F.least(end, F.coalesce(after, end)).cast("long").alias("last_frame"))


def raw_to_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 20th second of each conversation, mapped into its cut version; null where it is cut away."""
    runs = kept_runs(spark, sf_dir)
    ends = runs.groupBy("conv_id").agg(F.max("e").alias("last"))
    points = ends.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"), F.lit(20_000).cast("long"))).alias("at"))
    found = intervals.overlap_join(points.select("conv_id", F.col("at").alias("b"), F.col("at").alias("e")), runs.select("conv_id", "b", "e", "offset"), ["conv_id"], 20_000, touching=True)
    found = found.where("b >= rb and b < re").select("conv_id", F.col("b").alias("at"), (F.col("offset") + F.col("b") - F.col("rb")).alias("in_cut"))
    return points.join(found, ["conv_id", "at"], "left")


_CUT_SQL = f"{WORDS_SQL}, marked AS (SELECT *, idx % 11 = 0 OR norm IN ('um', 'uh', 'er', 'the') AS cut FROM words)"
_RUNS_SQL = f"""{_CUT_SQL},
flagged AS (SELECT *, CASE WHEN lag(cut) OVER o IS DISTINCT FROM cut THEN 1 ELSE 0 END AS flag FROM marked WINDOW o AS (PARTITION BY conv_id ORDER BY idx)),
numbered AS (SELECT *, sum(flag) OVER (PARTITION BY conv_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM flagged),
grouped AS (SELECT conv_id, CAST(run AS BIGINT) AS run, min(start_ms) AS b, max(end_ms) AS e, count(*) AS n FROM numbered WHERE NOT cut GROUP BY conv_id, run),
runs AS (SELECT conv_id, run, b, e, n, CAST(coalesce(sum(e - b) OVER (PARTITION BY conv_id ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM grouped)"""
_SIDES_SQL = f"{SPANS_SQL}, p AS (SELECT user_id, id, b FROM spans WHERE kind = 'purchase'), c AS (SELECT user_id, id AS click, b AS at FROM spans WHERE kind = 'click')"

QUERIES = {
    q.__name__: q
    for q in (interval_union, interval_union_tolerant, interval_complement, interval_difference, kept_overlap, longest_overlap, overlap_pairs, point_in_interval, exists_share, asof_backward, asof_forward, nearest_snap, session_gap, consecutive_runs, still_runs, isolated_spikes, rolling_median, direction_changes, retime_words, kept_runs, splice_gaps, silence_cuts, frame_bounds, raw_to_cut)
}

ORACLE_SQL = {
    "interval_union": f"WITH {SPANS_SQL}, {_MERGED_SQL.format(by='kind', tol=0, src='spans')} SELECT kind, b, e, n FROM merged",
    "interval_union_tolerant": f"WITH {SPANS_SQL}, {_MERGED_SQL.format(by='kind', tol=60 * SECOND, src='spans')} SELECT kind, b, e, n FROM merged",
    "interval_complement": f"WITH {SPANS_SQL}, {_MERGED_SQL.format(by='kind', tol=0, src='spans')}, g AS (SELECT kind, lag(e) OVER (PARTITION BY kind ORDER BY b) AS b, b AS e FROM merged) SELECT * FROM g WHERE e > b",
    "interval_difference": f"""WITH {_DAYS_SQL}, cuts AS (SELECT day, b, e FROM days WHERE kind IN ('error')), {_MERGED_SQL.format(by='day', tol=0, src='cuts')},
        keep AS (SELECT day, id, b, e FROM days WHERE kind IN ('click', 'view')),
        hits AS (SELECT k.day, k.id, k.b, k.e, m.b AS rb, m.e AS re FROM keep k JOIN merged m ON k.day = m.day AND k.b < m.e AND m.b < k.e),
        pieces AS (SELECT day, id, coalesce(lag(re) OVER o, b) AS pb, rb AS pe FROM hits WINDOW o AS (PARTITION BY day, id ORDER BY rb)
                   UNION ALL SELECT day, id, max(re), max(e) FROM hits GROUP BY day, id
                   UNION ALL SELECT day, id, b, e FROM keep k WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.day = k.day AND h.id = k.id))
        SELECT day, id, pb AS b, pe AS e FROM pieces WHERE pb < pe""",
    "kept_overlap": f"""WITH {_DAYS_SQL} SELECT l.day, l.id, CAST(coalesce(sum(least(l.e, r.e) - greatest(l.b, r.b)) FILTER (WHERE r.b IS NOT NULL), 0) AS BIGINT) AS covered
        FROM (SELECT * FROM days WHERE kind IN ('click', 'view')) l LEFT JOIN days r ON r.kind = 'purchase' AND l.day = r.day AND l.b < r.e AND r.b < l.e GROUP BY l.day, l.id""",
    "longest_overlap": f"""WITH {_DAYS_SQL} SELECT l.id, coalesce(max(least(l.e, r.e) - greatest(l.b, r.b)) FILTER (WHERE r.b IS NOT NULL), 0) AS longest
        FROM (SELECT * FROM days WHERE kind = 'error') l LEFT JOIN days r ON r.kind = 'signup' AND l.day = r.day AND l.b < r.e AND r.b < l.e GROUP BY l.id""",
    "overlap_pairs": f"WITH {SPANS_SQL} SELECT l.kind, l.id, r.id AS other, least(l.e, r.e) - greatest(l.b, r.b) AS shared FROM spans l JOIN spans r ON l.kind = r.kind AND l.id < r.id AND l.b < r.e AND r.b < l.e",
    "point_in_interval": f"WITH {_DAYS_SQL} SELECT l.id, min(r.id) AS view FROM days l JOIN days r ON l.kind = 'error' AND r.kind = 'view' AND l.day = r.day AND l.b >= r.b AND l.b < r.e GROUP BY l.id",
    "exists_share": f"""WITH {_DAYS_SQL}, x AS (SELECT l.day, l.id, EXISTS (SELECT 1 FROM days r WHERE r.kind = 'click' AND r.day = l.day AND abs(r.b - l.b) <= {1800 * SECOND}) AS hit FROM days l WHERE kind = 'error')
        SELECT day, count(*) AS n, count(*) FILTER (WHERE hit) / count(*) AS share FROM x GROUP BY day""",
    "asof_backward": f"WITH {_SIDES_SQL}, r AS (SELECT p.user_id, p.id, c.click, p.b - c.at AS wait, row_number() OVER (PARTITION BY p.id ORDER BY c.at DESC, c.click DESC) AS k FROM p LEFT JOIN c ON p.user_id = c.user_id AND c.at <= p.b) SELECT user_id, id, click, wait FROM r WHERE k = 1",
    "asof_forward": f"WITH {_SIDES_SQL}, r AS (SELECT p.user_id, p.id, c.click, c.at - p.b AS wait, row_number() OVER (PARTITION BY p.id ORDER BY c.at, c.click) AS k FROM p LEFT JOIN c ON p.user_id = c.user_id AND c.at > p.b) SELECT user_id, id, click, wait FROM r WHERE k = 1",
    "nearest_snap": f'WITH {_SIDES_SQL}, r AS (SELECT p.user_id, p.id, p.b, c."at" AS "at", row_number() OVER (PARTITION BY p.id ORDER BY abs(c."at" - p.b), c."at") AS k FROM p LEFT JOIN c ON p.user_id = c.user_id) SELECT user_id, id, CASE WHEN abs("at" - b) <= {6 * 3600 * SECOND} THEN "at" ELSE b END AS snapped FROM r WHERE k = 1',
    "session_gap": f"""WITH {SPANS_SQL}, g AS (SELECT *, b - lag(b) OVER (PARTITION BY user_id ORDER BY b, id) AS gap FROM spans),
        s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {12 * 3600 * SECOND} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY b, id ROWS UNBOUNDED PRECEDING) AS session FROM g)
        SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(b) AS b, max(b) AS e FROM s GROUP BY user_id, session""",
    "consecutive_runs": f"WITH {SPANS_SQL}, r AS (SELECT kind, id, id - row_number() OVER (PARTITION BY kind ORDER BY id) AS run FROM (SELECT DISTINCT kind, id FROM spans)) SELECT kind, min(id) AS lo, max(id) AS hi, count(*) AS n FROM r GROUP BY kind, run",
    "still_runs": """WITH f AS (SELECT user_id, event_id AS id, value < 60 AS low, CASE WHEN lag(value < 60) OVER o IS DISTINCT FROM (value < 60) THEN 1 ELSE 0 END AS flag FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
        r AS (SELECT *, sum(flag) OVER (PARTITION BY user_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS run FROM f)
        SELECT user_id, count(*) AS n, min(id) AS first, max(id) AS last FROM r WHERE low GROUP BY user_id, run HAVING count(*) >= 3""",
    "isolated_spikes": """WITH n AS (SELECT user_id, event_id AS id, value, max(value) OVER (o ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS before, max(value) OVER (o ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS after FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id))
        SELECT user_id, id, value FROM n WHERE before IS NOT NULL AND after IS NOT NULL AND value >= 3 * greatest(before, after)""",
    "rolling_median": "SELECT user_id, event_id AS id, median(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS median FROM events",
    "direction_changes": """WITH w AS (SELECT user_id, event_id AS id, sign(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) AS way FROM events),
        t AS (SELECT user_id, way <> lag(way) OVER (PARTITION BY user_id ORDER BY id) AS turn FROM w WHERE way <> 0) SELECT user_id, count(*) FILTER (WHERE turn) AS turns FROM t GROUP BY user_id""",
    "retime_words": f"""WITH {_CUT_SQL}, l AS (SELECT *, CAST(coalesce(sum(CASE WHEN cut THEN end_ms - start_ms ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lost FROM marked)
        SELECT conv_id, idx, start_ms - lost AS start_ms, end_ms - lost AS end_ms FROM l WHERE NOT cut""",
    "kept_runs": f"WITH {_RUNS_SQL} SELECT * FROM runs",
    "splice_gaps": f"""WITH {_CUT_SQL}, n AS (SELECT *, last_value(CASE WHEN NOT cut THEN end_ms END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
            first_value(CASE WHEN NOT cut THEN start_ms END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM marked)
        SELECT conv_id, idx, start_ms - before AS left_ms, after - end_ms AS right_ms FROM n WHERE cut""",
    "silence_cuts": f"WITH {WORDS_SQL}, n AS (SELECT *, lead(start_ms) OVER (PARTITION BY conv_id ORDER BY idx) AS nxt FROM words) SELECT conv_id, idx, end_ms + 125 AS b, nxt - 125 AS e FROM n WHERE nxt - end_ms > 600",
    "frame_bounds": f"""WITH {_RUNS_SQL}, n AS (SELECT *, floor(lead(b) OVER (PARTITION BY conv_id ORDER BY b) * 30 / 1000) AS nxt FROM runs)
        SELECT conv_id, run, CAST(floor(b * 30 / 1000) AS BIGINT) AS first_frame, CAST(least(ceil(e * 30 / 1000), coalesce(nxt, ceil(e * 30 / 1000))) AS BIGINT) AS last_frame FROM n""",
    "raw_to_cut": f"""WITH {_RUNS_SQL}, ends AS (SELECT conv_id, max(e) AS last FROM runs GROUP BY conv_id), points AS (SELECT conv_id, unnest(range(0, last + 1, 20000)) AS at FROM ends)
        SELECT p.conv_id, p.at, r."offset" + p.at - r.b AS in_cut FROM points p LEFT JOIN runs r ON p.conv_id = r.conv_id AND p.at >= r.b AND p.at < r.e""",
}
