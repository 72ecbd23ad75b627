"""Checks over cards and cuts, as rows of one shape (video, level, rule, nr), and what becomes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.plans.boxes import CARDS_SQL, area, cards
from tessella.plans.cuts import ORACLE_SQL as CUTS_ORACLE
from tessella.plans.cuts import lead_first
from tessella.plans.intervals import ORACLE_SQL as INTERVALS_ORACLE
from tessella.plans.intervals import frame_bounds
from tessella.sources.views import table

#: Cards of each category a minute that a style asks for, how far from its word a card may land, and the rules a brand may allow.
RATES = {"A": 1, "N": 2, "R": 1}
ALLOWED, BRAND = ("one entrance",), "A"
TICKS = 30


def card_findings(rows: DataFrame) -> DataFrame:
    """Each card's faults and each video's: cards out of bounds, tiny, off their place, too dense, all alike, or without what a style asks for."""
    own = rows.withColumn("length", F.max("b").over(W.partitionBy("video")) + 40)
    of_video = rows.groupBy("video").agg(
        F.count("*").alias("n"), (F.min("entrance") == F.max("entrance")).alias("one"), (F.max("e") / 60).alias("minutes"),
        F.count_if(F.col("category") == "R").alias("typed"), *[F.count_if(F.col("category") == k).alias(f"of_{k}") for k in RATES],
    )
    each = [
        ("FAIL", "out of bounds", F.col("e") > F.col("length")),
        ("WARN", "lands off its word", F.abs(F.col("x0") - 5) > 5),
        ("LOOK", "tiny", area() < 600),
    ]
    whole = [
        ("BAN", "one entrance", (F.col("n") >= 4) & F.col("one")),
        ("BAN", "half typed", F.col("typed") * 2 > F.col("n")),
        ("WARN", "too dense", F.col("n") > 5 * F.col("minutes")),
        *[("FAIL", f"no cards of {k}", (F.col(f"of_{k}") == 0) & (F.col("minutes") * rate >= 1)) for k, rate in RATES.items()],
        *[("WARN", f"rate of {k}", (F.col(f"of_{k}") > 0) & (F.abs(F.col(f"of_{k}") - F.col("minutes") * rate) >= 1) & ~F.col(f"of_{k}").between(F.col("minutes") * rate / 2, F.col("minutes") * rate * 2 + 0.5)) for k, rate in RATES.items()],
    ]

    def broken(found: DataFrame, checks: list, nr: Column) -> DataFrame:
        """A row for each check that a row breaks: all are looked at in one pass."""
        faults = F.array_compact(F.array(*[F.when(where, F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"))) for level, rule, where in checks]))
        return found.select("video", nr.alias("nr"), F.explode(faults).alias("x")).select("video", "x.level", "x.rule", "nr")

    return broken(own, each, F.col("nr")).unionByName(broken(of_video, whole, F.lit(None).cast("long")))


def plan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return card_findings(cards(spark, sf_dir))


def brand_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with bans that a style allows, or that name what is the brand's, as warnings: how many of each."""
    rows = card_findings(cards(spark, sf_dir))
    allowed = (F.col("level") == "BAN") & (F.col("rule").isin(*ALLOWED) | F.col("rule").endswith(f" {BRAND}"))
    return rows.withColumn("level", F.when(allowed, "WARN").otherwise(F.col("level"))).groupBy("level", "rule").agg(F.count("*").alias("n"))


def first_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding per rule and video: the first card that it names."""
    return card_findings(cards(spark, sf_dir)).groupBy("video", "rule").agg(F.min("nr").alias("nr"), F.count("*").alias("n"))


def short_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept runs of under 15 frames between two splices, with where they begin in the cut."""
    rows = frame_bounds(spark, sf_dir).withColumn("size", F.col("last_frame") - F.col("first_frame"))
    w = W.partitionBy("conv_id").orderBy("run")
    rows = rows.withColumn("at", F.coalesce(F.sum("size").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))).withColumn("inner", F.lag("run").over(w).isNotNull() & F.lead("run").over(w).isNotNull())
    return rows.where((F.col("size") < 15) & F.col("inner")).select("conv_id", "run", "size", "at")


def moved_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pieces a cut with its lead first has, and how many of them play out of the source's order."""
    rows = lead_first(spark, sf_dir).withColumn("before", F.lag("b").over(W.partitionBy("conv_id").orderBy("place")))
    return rows.groupBy("conv_id").agg(F.count("*").alias("pieces"), F.count_if(F.col("b") < F.col("before")).alias("back"))


def unknown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose container isn't among those that ten parts or more have: a value outside the reference set."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    known = rows.groupBy("p_brand", "p_size").agg(F.count("*").alias("n")).where("n >= 2").select("p_brand", "p_size")
    return rows.join(known, ["p_brand", "p_size"], "left_anti").groupBy("p_brand").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


def bad_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that a card names (its hold less 20) and its video hasn't: negative, or not below the number of its cards."""
    rows = cards(spark, sf_dir).withColumn("step", F.col("hold") - 20).withColumn("n", F.count("*").over(W.partitionBy("video")))
    return rows.where("step < 0 or step >= n").groupBy("video").agg(F.count("*").alias("bad"), F.min("nr").alias("first"))


QUERIES = {q.__name__: q for q in (plan_findings, brand_findings, first_findings, short_pieces, moved_pieces, unknown_values, bad_references)}


def _findings_sql() -> str:
    each = [("FAIL", "out of bounds", "e > length"), ("WARN", "lands off its word", "abs(x0 - 5) > 5"), ("LOOK", "tiny", "(x1 - x0) * (y1 - y0) < 600")]
    whole = [("BAN", "one entrance", "n >= 4 AND entrances = 1"), ("BAN", "half typed", "of_R * 2 > n"), ("WARN", "too dense", "n > 5 * minutes")]
    whole += [("FAIL", f"no cards of {k}", f"of_{k} = 0 AND minutes * {r} >= 1") for k, r in RATES.items()]
    whole += [("WARN", f"rate of {k}", f"of_{k} > 0 AND abs(of_{k} - minutes * {r}) >= 1 AND NOT (of_{k} BETWEEN minutes * {r} / 2 AND minutes * {r} * 2 + 0.5::DOUBLE)") for k, r in RATES.items()]
    own = "SELECT *, max(b) OVER (PARTITION BY video) + 40 AS length FROM cards"
    of_video = f"SELECT video, count(*) AS n, count(DISTINCT entrance) AS entrances, max(e) / 60 AS minutes, {', '.join(f'''count(*) FILTER (WHERE category = '{k}') AS of_{k}''' for k in RATES)} FROM cards GROUP BY video"
    parts = [f"SELECT video, '{level}' AS level, '{rule}' AS rule, nr FROM own WHERE {where}" for level, rule, where in each] + [f"SELECT video, '{level}', '{rule}', NULL FROM of_video WHERE {where}" for level, rule, where in whole]
    return f"{CARDS_SQL}, own AS ({own}), of_video AS ({of_video}), findings AS ({' UNION ALL '.join(parts)})"


ORACLE_SQL = {
    "plan_findings": f"WITH {_findings_sql()} SELECT * FROM findings",
    "brand_findings": f"WITH {_findings_sql()} SELECT CASE WHEN level = 'BAN' AND (rule = 'one entrance' OR rule LIKE '% {BRAND}') THEN 'WARN' ELSE level END AS level, rule, count(*) AS n FROM findings GROUP BY 1, 2",
    "first_findings": f"WITH {_findings_sql()} SELECT video, rule, min(nr) AS nr, count(*) AS n FROM findings GROUP BY 1, 2",
    "short_pieces": f"""WITH f AS ({INTERVALS_ORACLE['frame_bounds']}), s AS (SELECT conv_id, run, last_frame - first_frame AS size, CAST(coalesce(sum(last_frame - first_frame) OVER (PARTITION BY conv_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos,
        lag(run) OVER (PARTITION BY conv_id ORDER BY run) IS NOT NULL AND lead(run) OVER (PARTITION BY conv_id ORDER BY run) IS NOT NULL AS inside FROM f) SELECT conv_id, run, size, pos AS at FROM s WHERE size < 15 AND inside""",
    "moved_pieces": f"WITH l AS ({CUTS_ORACLE['lead_first']}), b AS (SELECT *, lag(b) OVER (PARTITION BY conv_id ORDER BY place) AS before FROM l) SELECT conv_id, count(*) AS pieces, count(*) FILTER (WHERE b < before) AS back FROM b GROUP BY 1",
    "unknown_values": "WITH k AS (SELECT p_brand, p_size FROM part GROUP BY 1, 2 HAVING count(*) >= 2) SELECT p_brand, count(*) AS n, min(p_partkey) AS first FROM part ANTI JOIN k USING (p_brand, p_size) GROUP BY 1",
    "bad_references": f"WITH {CARDS_SQL}, s AS (SELECT video, nr, hold - 20 AS step, count(*) OVER (PARTITION BY video) AS n FROM cards) SELECT video, count(*) AS bad, min(nr) AS first FROM s WHERE step < 0 OR step >= n GROUP BY 1",
}
