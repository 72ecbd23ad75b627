"""Videos against their creator's usual: reach, roles, picks, winners and control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.sources.views import MEASURES_SQL, VIDEOS_SQL, measures, videos

WINNER, CONTROL, OUTLIER = 2.0, 0.5, 3
TOP, NEAR = 3, 3


def role(vs_median: Column) -> Column:
    """winner, control or low; null stays null."""
    return F.when(vs_median >= WINNER, "winner").when(vs_median >= CONTROL, "control").when(vs_median.isNotNull(), "low")


def against_median(rows: DataFrame) -> DataFrame:
    """rows with median_views, vs_median, outlier and role: one shuffle by creator."""
    medians = rows.groupBy("creator").agg(F.percentile("views", F.lit(0.5)).alias("median_views"))
    rows = rows.join(medians, "creator")
    vs = F.when(F.col("median_views") > 0, F.col("views") / F.col("median_views"))
    rows = rows.withColumn("vs_median", vs).withColumn("outlier", (F.col("median_views") > 0) & (F.col("views") >= OUTLIER * F.col("median_views")))
    return rows.withColumn("role", role(F.col("vs_median")))


_AGAINST_SQL = f"""{VIDEOS_SQL},
medians AS (SELECT creator, median(views) AS median_views FROM videos GROUP BY creator),
against AS (
  SELECT v.*, m.median_views, CASE WHEN m.median_views > 0 THEN v.views / m.median_views END AS vs_median,
         m.median_views > 0 AND v.views >= {OUTLIER} * m.median_views AS outlier
  FROM videos v JOIN medians m USING (creator)),
roles AS (SELECT *, CASE WHEN vs_median >= {WINNER} THEN 'winner' WHEN vs_median >= {CONTROL} THEN 'control' WHEN vs_median IS NOT NULL THEN 'low' END AS role FROM against)"""


def video_vs_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return against_median(videos(spark, sf_dir)).select("creator", "video", "views", "median_views", "vs_median", "role")


def outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return against_median(videos(spark, sf_dir)).where("outlier").select("creator", "video", "views", "median_views")


def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return against_median(videos(spark, sf_dir)).groupBy("role").agg(F.count("*").alias("n"), F.max("views").alias("most"))


def reach_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views, else the number of cards, else 0; a 0 counts as missing."""
    cards = measures(spark, sf_dir).groupBy("video").agg(F.count("*").alias("likes"))
    found = videos(spark, sf_dir).withColumn("views", F.col("views") % 5).join(cards, "video", "left")
    reach = F.coalesce(F.nullif(F.col("views"), F.lit(0)), F.nullif(F.col("likes"), F.lit(0)), F.lit(0))
    return found.select("video", reach.alias("reach"))


def pick(rows: DataFrame, top: int = TOP, control: int = NEAR, spare: int = NEAR) -> DataFrame:
    """Each creator's top by reach, the control nearest its median among the rest with reach, and spares: (creator, video, picked, place)."""
    order = W.partitionBy("creator").orderBy(F.desc("views"), "video")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    near = W.partitionBy("creator", (F.col("rank") > top) & (F.col("views") > 0)).orderBy(F.abs(F.col("views") - F.col("median_views")), "rank")
    ranked = ranked.withColumn("near", F.when((F.col("rank") > top) & (F.col("views") > 0), F.row_number().over(near)))
    picked = F.when(F.col("rank") <= top, "top").when(F.col("near") <= control, "control").otherwise("spare")
    ranked = ranked.withColumn("picked", picked)
    place = F.row_number().over(W.partitionBy("creator", "picked").orderBy(F.when(F.col("picked") == "control", F.col("near")).otherwise(F.col("rank"))))
    return ranked.withColumn("place", place.cast("long")).where((F.col("picked") != "spare") | (F.col("place") <= spare)).select("creator", "video", "picked", "place")


def pick_top_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(against_median(videos(spark, sf_dir)))


def usual_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos within half to double their creator's median length, where at least max(3, half) of them have one."""
    lengths = measures(spark, sf_dir).groupBy("video").agg(F.sum("hold").alias("duration"))
    rows = videos(spark, sf_dir).join(lengths, "video", "left")
    bands = rows.groupBy("creator").agg(F.count("*").alias("n"), F.count("duration").alias("timed"), F.percentile("duration", F.lit(0.5)).alias("usual"))
    bands = bands.where(F.col("timed") >= F.greatest(F.lit(3.0), F.col("n") / 2))
    return rows.join(bands, "creator").where(F.col("duration").between(F.col("usual") / 2, F.col("usual") * 2)).select("creator", "video", "duration", "usual")


#: Fields compared between winners and control; those in seconds are apart at half a second.
FIELDS = ("cards", "hold_median", "first_hold", "boxes_wide")


def fields(cards: DataFrame) -> DataFrame:
    """One row per video and field: (video, field, value)."""
    rows = cards.groupBy("video").agg(
        F.count("*").cast("double").alias("cards"), F.percentile("hold", F.lit(0.5)).alias("hold_median"),
        F.min(F.struct("nr", "hold"))["hold"].cast("double").alias("first_hold"), F.count_if(F.col("x1") - F.col("x0") >= 60).cast("double").alias("boxes_wide"),
    )
    return rows.unpivot("video", list(FIELDS), "field", "value")


def compare(rows: DataFrame, by: str) -> DataFrame:
    """Of (by, role, field, value): winners' and control's medians and counts, and the verdict; under two a side is not enough."""
    side = {r: F.when(F.col("role") == r, F.col("value")) for r in ("winner", "control")}
    found = rows.groupBy(by, "field").agg(
        *[F.percentile(v, F.lit(0.5)).alias(f"{r}_median") for r, v in side.items()], *[F.count(v).alias(f"n_{r}") for r, v in side.items()],
        *[F.min(v).alias(f"{r}_min") for r, v in side.items()], *[F.max(v).alias(f"{r}_max") for r, v in side.items()],
    )
    a, b = F.col("winner_median"), F.col("control_median")
    least = F.when(F.col("field").endswith("_hold"), F.lit(0.5)).otherwise(F.lit(0.25) * F.greatest(F.abs(a), F.abs(b), F.lit(1e-9)))
    every = (F.col("winner_min") > F.col("control_max")) | (F.col("winner_max") < F.col("control_min"))
    verdict = F.when((F.col("n_winner") < 2) | (F.col("n_control") < 2), "not enough").when(F.abs(a - b) < least, "same").when(every, "differs, every winner").otherwise("differs, overlaps")
    return found.select(by, "field", "n_winner", "n_control", "winner_median", "control_median", verdict.alias("verdict"))


def winners_vs_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = against_median(videos(spark, sf_dir)).where("role in ('winner', 'control')").select("creator", "video", "role")
    return compare(roles.join(fields(measures(spark, sf_dir)), "video"), "creator")


_COMPARE_SQL = f"""{_AGAINST_SQL}, {MEASURES_SQL},
per_video AS (
  SELECT video, CAST(count(*) AS DOUBLE) AS cards, median(hold) AS hold_median, CAST(min(nr * 100000 + hold) % 100000 AS DOUBLE) AS first_hold,
         CAST(count(*) FILTER (WHERE x1 - x0 >= 60) AS DOUBLE) AS boxes_wide
  FROM measures GROUP BY video),
long AS (
  SELECT video, 'cards' AS field, cards AS value FROM per_video UNION ALL SELECT video, 'hold_median', hold_median FROM per_video
  UNION ALL SELECT video, 'first_hold', first_hold FROM per_video UNION ALL SELECT video, 'boxes_wide', boxes_wide FROM per_video),
sides AS (
  SELECT r.creator, l.field, median(value) FILTER (WHERE role = 'winner') AS winner_median, median(value) FILTER (WHERE role = 'control') AS control_median,
         count(value) FILTER (WHERE role = 'winner') AS n_winner, count(value) FILTER (WHERE role = 'control') AS n_control,
         min(value) FILTER (WHERE role = 'winner') AS wmin, max(value) FILTER (WHERE role = 'winner') AS wmax,
         min(value) FILTER (WHERE role = 'control') AS cmin, max(value) FILTER (WHERE role = 'control') AS cmax
  FROM roles r JOIN long l USING (video) WHERE role IN ('winner', 'control') GROUP BY r.creator, l.field)
SELECT creator, field, n_winner, n_control, winner_median, control_median,
       CASE WHEN n_winner < 2 OR n_control < 2 THEN 'not enough'
            WHEN abs(winner_median - control_median) < CASE WHEN field LIKE '%\\_hold' ESCAPE '\\' THEN 0.5 ELSE 0.25 * greatest(abs(winner_median), abs(control_median), 1e-9) END THEN 'same'
            WHEN wmin > cmax OR wmax < cmin THEN 'differs, every winner' ELSE 'differs, overlaps' END AS verdict
FROM sides"""

QUERIES = {
    "video_vs_median": video_vs_median, "outliers": outliers, "role_counts": role_counts, "reach_fallback": reach_fallback,
    "pick_top_control": pick_top_control, "usual_length_filter": usual_length_filter, "winners_vs_control": winners_vs_control,
}

ORACLE_SQL = {
    "video_vs_median": f"WITH {_AGAINST_SQL} SELECT creator, video, views, median_views, vs_median, role FROM roles",
    "outliers": f"WITH {_AGAINST_SQL} SELECT creator, video, views, median_views FROM roles WHERE outlier",
    "role_counts": f"WITH {_AGAINST_SQL} SELECT role, count(*) AS n, max(views) AS most FROM roles GROUP BY role",
    "reach_fallback": f"""WITH {VIDEOS_SQL}, {MEASURES_SQL}, cards AS (SELECT video, count(*) AS likes FROM measures GROUP BY video)
        SELECT video, coalesce(nullif(views % 5, 0), nullif(likes, 0), 0) AS reach FROM videos LEFT JOIN cards USING (video)""",
    "pick_top_control": f"""WITH {_AGAINST_SQL},
        ranked AS (SELECT *, row_number() OVER (PARTITION BY creator ORDER BY views DESC, video) AS rnk FROM roles),
        near AS (SELECT *, CASE WHEN rnk > {TOP} AND views > 0 THEN row_number() OVER (PARTITION BY creator, rnk > {TOP} AND views > 0 ORDER BY abs(views - median_views), rnk) END AS nearest FROM ranked),
        named AS (SELECT *, CASE WHEN rnk <= {TOP} THEN 'top' WHEN nearest <= {NEAR} THEN 'control' ELSE 'spare' END AS picked FROM near),
        placed AS (SELECT creator, video, picked, row_number() OVER (PARTITION BY creator, picked ORDER BY CASE WHEN picked = 'control' THEN nearest ELSE rnk END) AS place FROM named)
        SELECT * FROM placed WHERE picked <> 'spare' OR place <= {NEAR}""",
    "usual_length_filter": f"""WITH {VIDEOS_SQL}, {MEASURES_SQL}, lengths AS (SELECT video, CAST(sum(hold) AS BIGINT) AS duration FROM measures GROUP BY video),
        r AS (SELECT v.*, l.duration FROM videos v LEFT JOIN lengths l USING (video)),
        bands AS (SELECT creator, median(duration) AS usual FROM r GROUP BY creator HAVING count(duration) >= greatest(3.0, count(*) / 2))
        SELECT r.creator, r.video, r.duration, b.usual FROM r JOIN bands b USING (creator) WHERE r.duration BETWEEN b.usual / 2 AND b.usual * 2""",
    "winners_vs_control": f"WITH {_COMPARE_SQL}",
}
