"""Roll-ups of cards, listings and votes: shares, modes, medians, mixes, gates, schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators import aggregates as A
from tessella.operators.asof import asof
from tessella.operators.prefix import middle
from tessella.sources.views import MEASURES_SQL, SPANS_SQL, VIDEOS_SQL, measures, spans, table, videos


def ordered_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's commonest return flag; ties go to the lowest order."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return A.ordered_mode(rows, ["part"], "flag", "seq")


def lower_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = videos(spark, sf_dir)
    return A.lower_percentiles(rows, ["creator"], "views", {"p90": 0.9, "p99": 0.99}, 100_000).join(middle(rows, ["creator"], "views", 100_000), "creator")


def kind_time_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent of a video's card time by category."""
    return A.shares(measures(spark, sf_dir), ["video"], "category", F.col("hold"))


def category_rates_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each category's median number of cards over all videos, 0 where a video has none."""
    rows = measures(spark, sf_dir)
    counts = rows.groupBy("video", "category").agg(F.count("*").alias("n_cards"))
    found = A.median_with_zeros(counts, "category", "n_cards", rows.agg(F.count_distinct("video").alias("n")))
    return found.withColumnsRenamed({"median": "median_n", "rows": "videos"})


def median_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The element-wise median box of each category and entrance."""
    rows = measures(spark, sf_dir)
    return rows.groupBy("category", "entrance").agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in ("x0", "y0", "x1", "y1")], F.count("*").alias("n"))


def grid_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.grid_heat(measures(spark, sf_dir), ["category"], 10, "hold")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards by zone: full from 60% of the area on, else by the third in which the box's middle lies."""
    middle = (F.col("y0") + F.col("y1")) / 2
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    zone = F.when(area >= 4000, "full").when(middle < 33, "top").when(middle < 66, "middle").otherwise("bottom")
    return measures(spark, sf_dir).groupBy(zone.alias("zone")).agg(F.count("*").alias("n"), F.sum("hold").alias("hold"))


def entrance_groups_topk(spark: SparkSession, sf_dir: str, most: int = 2) -> DataFrame:
    """Each video's commonest pairs of category and entrance, with their median hold; ties: the longer, then by name."""
    groups = measures(spark, sf_dir).groupBy("video", "category", "entrance").agg(F.count("*").alias("n"), F.percentile("hold", F.lit(0.5)).alias("hold"))
    rank = F.row_number().over(W.partitionBy("video").orderBy(F.desc("n"), F.desc("hold"), "category", "entrance"))
    return groups.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)


def box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a video's cards whose boxes share at least half of their union."""
    rows = measures(spark, sf_dir).distinct()
    a, b = (rows.select("video", *[F.col(c).alias(f"{c}_{s}") for c in ("nr", "hold", "x0", "y0", "x1", "y1")]) for s in "ab")
    wide = F.greatest(F.lit(0), F.least("x1_a", "x1_b") - F.greatest("x0_a", "x0_b"))
    high = F.greatest(F.lit(0), F.least("y1_a", "y1_b") - F.greatest("y0_a", "y0_b"))
    both = (F.col("x1_a") - F.col("x0_a")) * (F.col("y1_a") - F.col("y0_a")) + (F.col("x1_b") - F.col("x0_b")) * (F.col("y1_b") - F.col("y0_b")) - wide * high
    pairs = a.join(b, "video").where("nr_a < nr_b").withColumn("iou", wide * high / both)
    return pairs.where("iou >= 0.5").select("video", "nr_a", "nr_b", "hold_a", "hold_b", "iou")


def vote_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's fields by majority of its items: kept where three quarters agree."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_linestatus").alias("status"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    mode = A.ordered_mode(rows, ["supplier"], "status", "seq", "status")
    total = rows.groupBy("supplier").agg(F.count("*").alias("total"))
    return mode.join(total, "supplier").select("supplier", "status", "n", "total", (F.col("n") * 4 >= F.col("total") * 3).alias("sure"))


def weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand's sizes as a mean weighted by whole prices."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("path"), F.col("p_size").cast("long").alias("value"), F.floor("p_retailprice").cast("long").alias("weight"))
    return A.weighted_mix(rows, ["brand"], "path", "value", "weight")


def judge_precision_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, how often a flag (20 or fewer words of text before a new line are shouted) was right; gated from 5 on under 0.6."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").rlike("!!").alias("flagged"))
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id").where("flagged")
    found = rows.groupBy("source").agg(F.count_if(F.col("quality") == 0).alias("right"), F.count_if(F.col("quality") == 1).alias("wrong"))
    n = F.col("right") + F.col("wrong")
    return found.select("source", "right", "wrong", (F.col("right") / F.nullif(n, F.lit(0))).alias("precision"), ((n >= 5) & (F.col("right") / n < 0.6)).alias("gated"))


def densest_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer, the start of the 30,000 wide band of prices with the most orders; ties: the lowest."""
    rows = videos(spark, sf_dir)
    count = F.count("*").over(W.partitionBy("creator").orderBy("views").rangeBetween(0, 30_000))
    return rows.withColumn("n", count).groupBy("creator").agg(F.max(F.struct("n", (-F.col("views")).alias("low"))).alias("x")).select("creator", F.col("x.n").alias("n"), (-F.col("x.low")).alias("low"))


def feature_match_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's medians against all customers' medians: pass, FAIL or n/a by a relative and an absolute tolerance."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("creator")).agg(F.count("*").cast("double").alias("orders"), F.percentile(F.floor("o_totalprice"), F.lit(0.5)).alias("price"))
    long = rows.unpivot("creator", ["orders", "price"], "feature", "value")
    wanted = middle(long, ["feature"], "value", 5_000, "want")
    long = long.join(F.broadcast(wanted), "feature")  # one row per feature
    near = F.abs(F.col("want") - F.col("value")) <= F.greatest(F.when(F.col("feature") == "orders", 2.0).otherwise(5000.0), F.abs("want") * 0.25)
    return long.select("creator", "feature", "value", "want", F.when(F.col("value").isNull() | F.col("want").isNull(), "n/a").when(near, "pass").otherwise("FAIL").alias("verdict"))


def layered_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's setting: the nation's, overridden by the segment's, overridden by the customer's own if it is not negative."""
    c = table(spark, sf_dir, "customer")
    cents = F.floor(F.col("c_acctbal") * 100 + 0.5).cast("long")
    own = c.select("c_custkey", F.lit(3).alias("rank"), F.when(F.col("c_acctbal") >= 0, cents).alias("value"))
    segment = c.groupBy("c_mktsegment").agg(F.max(cents).alias("value"))
    nation = c.groupBy("c_nationkey").agg(F.min(cents).alias("value"))
    rows = own.unionByName(c.join(segment, "c_mktsegment").where("c_custkey % 2 = 0").select("c_custkey", F.lit(2).alias("rank"), "value"))
    rows = rows.unionByName(c.join(nation, "c_nationkey").select("c_custkey", F.lit(1).alias("rank"), "value")).withColumn("path", F.lit("limit"))
    return A.layered(rows, ["c_custkey"], "path", "rank", "value").select("c_custkey", "value", F.col("rank").cast("long").alias("rank"))


def evenly_thinned(spark: SparkSession, sf_dir: str, keep: int = 3) -> DataFrame:
    """Of each customer's orders by date, `keep` evenly spread ones: those at floor(k * n / keep)."""
    w = W.partitionBy("creator")
    rows = videos(spark, sf_dir).withColumn("at", F.row_number().over(w.orderBy("published", "video")) - 1).withColumn("n", F.count("*").over(w))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(keep - 1)), lambda k: F.floor(k * F.col("n") / keep).cast("long"))
    return rows.where(F.array_contains(wanted, F.col("at").cast("long"))).select("creator", "video", F.col("at").cast("long").alias("place"))


def claimable_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups as jobs: the oldest of each user that no purchase within 900 s has claimed."""
    rows = spans(spark, sf_dir)
    jobs = rows.where("kind = 'signup'").select("user_id", "id", "b")
    claims = rows.where("kind = 'purchase'").select("user_id", F.col("b").alias("claimed"))
    found = asof(jobs, claims, ["user_id"], "b", "claimed", "claimed", "forward")  # the first purchase from the signup on
    found = found.where(F.col("found").isNull() | (F.col("found.claimed") >= F.col("b") + 900_000_000))
    return found.groupBy("user_id").agg(F.min(F.struct("b", "id")).alias("x"), F.count("*").alias("open")).select("user_id", F.col("x.id").alias("id"), "open")


def regression_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user, errors that come after a click since the last error: a fix that went back."""
    rows = table(spark, sf_dir, "events").where("event_type in ('click', 'error')").select("user_id", "event_id", "event_type")
    before = F.lag("event_type").over(W.partitionBy("user_id").orderBy("event_id"))
    rows = rows.withColumn("again", (F.col("event_type") == "error") & (before == "click"))
    return rows.groupBy("user_id").agg(F.count_if("again").alias("regressions"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max(F.when(F.col("again"), F.col("event_id"))).alias("last"))


def latest_forty(spark: SparkSession, sf_dir: str, most: int = 40, slices: int = 64) -> DataFrame:
    """Each event type's last rows with a running number of the type: the last ones of each slice of a type first, then of those."""
    rows = table(spark, sf_dir, "events").select("event_type", "event_id").withColumn("slice", F.pmod(F.xxhash64("event_id"), F.lit(slices)))
    rows_of = rows.groupBy("event_type").agg(F.count("*").alias("n"))
    for by in (["event_type", "slice"], ["event_type"]):
        rows = rows.withColumn("from_last", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("event_id")))).where(F.col("from_last") <= most)
    return rows.join(rows_of, "event_type").select("event_type", "event_id", (F.col("n") - F.col("from_last") + 1).alias("nr"))


def plan_row_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the cards (the second without every seventh part, and with other holds for every fifth): typed changes."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("video"), F.col("l_partkey").alias("part")).agg(F.max("l_quantity").cast("long").alias("hold"))
    new = rows.where("part % 7 != 0").withColumn("hold", F.when(F.col("part") % 5 == 0, F.col("hold") + 1).otherwise(F.col("hold"))).unionByName(rows.where("part % 11 = 0").withColumn("part", F.col("part") + 1_000_000))
    both = rows.withColumnRenamed("hold", "was").join(new, ["video", "part"], "full_outer")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("hold").isNull(), "removed").when(F.col("was") != F.col("hold"), "changed")
    return both.withColumn("change", kind).where("change is not null").select("video", "part", "change", "was", F.col("hold").alias("now"))


QUERIES = {
    q.__name__: q
    for q in (ordered_mode, lower_percentile, kind_time_shares, category_rates_dense, median_box, grid_heatmap, zones, entrance_groups_topk, box_overlap, vote_merge, weighted_mix, judge_precision_gate, densest_band, feature_match_table, layered_settings, evenly_thinned, claimable_jobs, regression_counts, latest_forty, plan_row_diff)
}

ORACLE_SQL = {
    "ordered_mode": """WITH c AS (SELECT l_partkey AS part, l_returnflag AS flag, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS f FROM lineitem GROUP BY 1, 2)
        SELECT part, flag AS mode, n FROM c QUALIFY row_number() OVER (PARTITION BY part ORDER BY n DESC, f, flag DESC) = 1""",
    "lower_percentile": f"""WITH {VIDEOS_SQL} SELECT creator, list_sort(list(views))[CAST(floor(0.9::DOUBLE * (count(*) - 1)) AS BIGINT) + 1] AS p90,
        list_sort(list(views))[CAST(floor(0.99::DOUBLE * (count(*) - 1)) AS BIGINT) + 1] AS p99, median(views) AS median FROM videos GROUP BY creator""",
    "kind_time_shares": f"WITH {MEASURES_SQL}, s AS (SELECT video, category, CAST(sum(hold) AS BIGINT) AS weight FROM measures GROUP BY 1, 2) SELECT *, weight * 100 / CAST(sum(weight) OVER (PARTITION BY video) AS BIGINT) AS share FROM s",
    "category_rates_dense": f"""WITH {MEASURES_SQL}, c AS (SELECT video, category, count(*) AS n FROM measures GROUP BY 1, 2),
        d AS (SELECT category, coalesce(n, 0) AS n FROM (SELECT DISTINCT video FROM measures) CROSS JOIN (SELECT DISTINCT category FROM measures) LEFT JOIN c USING (video, category))
        SELECT category, median(n) AS median_n, count(*) AS videos, count(*) FILTER (WHERE n > 0) AS used FROM d GROUP BY category""",
    "median_box": f"WITH {MEASURES_SQL} SELECT category, entrance, median(x0) AS x0, median(y0) AS y0, median(x1) AS x1, median(y1) AS y1, count(*) AS n FROM measures GROUP BY 1, 2",
    "grid_heatmap": f"""WITH {MEASURES_SQL}, x AS (SELECT category, hold, y0, y1, unnest(range(x0 // 10, (x1 - 1) // 10 + 1)) AS x FROM measures), c AS (SELECT category, hold, x, unnest(range(y0 // 10, (y1 - 1) // 10 + 1)) AS y FROM x),
        s AS (SELECT category, x, y, CAST(sum(hold) AS BIGINT) AS s FROM c GROUP BY 1, 2, 3) SELECT category, x, y, s * 100 / max(s) OVER (PARTITION BY category) AS heat FROM s""",
    "zones": f"""WITH {MEASURES_SQL} SELECT CASE WHEN (x1 - x0) * (y1 - y0) >= 4000 THEN 'full' WHEN (y0 + y1) / 2 < 33 THEN 'top' WHEN (y0 + y1) / 2 < 66 THEN 'middle' ELSE 'bottom' END AS zone,
        count(*) AS n, CAST(sum(hold) AS BIGINT) AS hold FROM measures GROUP BY 1""",
    "entrance_groups_topk": f"""WITH {MEASURES_SQL}, g AS (SELECT video, category, entrance, count(*) AS n, median(hold) AS hold FROM measures GROUP BY 1, 2, 3)
        SELECT *, row_number() OVER (PARTITION BY video ORDER BY n DESC, hold DESC, category, entrance) AS rank FROM g QUALIFY rank <= 2""",
    "box_overlap": f"""WITH {MEASURES_SQL}, d AS (SELECT DISTINCT * FROM measures),
        p AS (SELECT a.video, a.nr AS nr_a, b.nr AS nr_b, a.hold AS hold_a, b.hold AS hold_b, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS both_,
              (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS sum_ FROM d a JOIN d b ON a.video = b.video AND a.nr < b.nr)
        SELECT video, nr_a, nr_b, hold_a, hold_b, both_ / (sum_ - both_) AS iou FROM p WHERE both_ / (sum_ - both_) >= 0.5""",
    "vote_merge": """WITH c AS (SELECT l_suppkey AS supplier, l_linestatus AS status, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS f, CAST(sum(count(*)) OVER (PARTITION BY l_suppkey) AS BIGINT) AS total FROM lineitem GROUP BY 1, 2)
        SELECT supplier, status, n, total, n * 4 >= total * 3 AS sure FROM c QUALIFY row_number() OVER (PARTITION BY supplier ORDER BY n DESC, f, status DESC) = 1""",
    "weighted_mix": "SELECT p_brand AS brand, p_type AS path, CAST(sum(CAST(p_size AS BIGINT) * CAST(floor(p_retailprice) AS BIGINT)) AS BIGINT) / CAST(sum(CAST(floor(p_retailprice) AS BIGINT)) AS BIGINT) AS mix FROM part WHERE p_size IS NOT NULL AND floor(p_retailprice) > 0 GROUP BY 1, 2",
    "judge_precision_gate": """WITH r AS (SELECT source, count(*) FILTER (WHERE quality = 0) AS "right", count(*) FILTER (WHERE quality = 1) AS wrong FROM documents JOIN labels USING (doc_id) WHERE contains(text, '!!') GROUP BY source)
        SELECT source, "right", wrong, "right" / nullif("right" + wrong, 0) AS precision, "right" + wrong >= 5 AND "right" / nullif("right" + wrong, 0) < 0.6 AS gated FROM r""",
    "densest_band": f"""WITH {VIDEOS_SQL}, n AS (SELECT creator, views, count(*) OVER (PARTITION BY creator ORDER BY views RANGE BETWEEN CURRENT ROW AND 30000 FOLLOWING) AS n FROM videos)
        SELECT creator, n, views AS low FROM (SELECT DISTINCT * FROM n) QUALIFY row_number() OVER (PARTITION BY creator ORDER BY n DESC, views) = 1""",
    "feature_match_table": """WITH r AS (SELECT o_custkey AS creator, CAST(count(*) AS DOUBLE) AS orders, median(floor(o_totalprice)) AS price FROM orders GROUP BY 1),
        l AS (SELECT creator, 'orders' AS feature, orders AS value FROM r UNION ALL SELECT creator, 'price', price FROM r), w AS (SELECT feature, median(value) AS want FROM l GROUP BY 1)
        SELECT creator, feature, value, want, CASE WHEN value IS NULL OR want IS NULL THEN 'n/a' WHEN abs(want - value) <= greatest(CASE WHEN feature = 'orders' THEN 2.0::DOUBLE ELSE 5000.0::DOUBLE END, abs(want) * 0.25::DOUBLE) THEN 'pass' ELSE 'FAIL' END AS verdict FROM l JOIN w USING (feature)""",
    "layered_settings": """WITH c AS (SELECT *, CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT) AS cents FROM customer),
        r AS (SELECT c_custkey, 3 AS rank, CASE WHEN c_acctbal >= 0 THEN cents END AS value FROM c
              UNION ALL SELECT c_custkey, 2, max(cents) OVER (PARTITION BY c_mktsegment) FROM c QUALIFY c_custkey % 2 = 0
              UNION ALL SELECT c_custkey, 1, min(cents) OVER (PARTITION BY c_nationkey) FROM c)
        SELECT c_custkey, value, CAST(rank AS BIGINT) AS rank FROM r WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY rank DESC) = 1""",
    "evenly_thinned": f"""WITH {VIDEOS_SQL}, r AS (SELECT creator, video, row_number() OVER (PARTITION BY creator ORDER BY published, video) - 1 AS place, count(*) OVER (PARTITION BY creator) AS n FROM videos)
        SELECT creator, video, place FROM r WHERE place IN (0, n // 3, 2 * n // 3)""",
    "claimable_jobs": f"""WITH {SPANS_SQL}, j AS (SELECT * FROM spans s WHERE kind = 'signup' AND NOT EXISTS (SELECT 1 FROM spans p WHERE p.kind = 'purchase' AND p.user_id = s.user_id AND p.b >= s.b AND p.b < s.b + 900000000))
        SELECT user_id, id, count(*) OVER (PARTITION BY user_id) AS open FROM j QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY b, id) = 1""",
    "regression_counts": """WITH r AS (SELECT user_id, event_id, event_type = 'error' AS bad, event_type = 'error' AND lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = 'click' AS again FROM events WHERE event_type IN ('click', 'error'))
        SELECT user_id, count(*) FILTER (WHERE again) AS regressions, count(*) FILTER (WHERE bad) AS errors, max(event_id) FILTER (WHERE again) AS last FROM r GROUP BY user_id""",
    "latest_forty": "WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS nr, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, event_id, nr FROM r WHERE nr > n - 40",
    "plan_row_diff": """WITH r AS (SELECT l_orderkey AS video, l_partkey AS part, CAST(max(l_quantity) AS BIGINT) AS hold FROM lineitem GROUP BY 1, 2),
        n AS (SELECT video, part, CASE WHEN part % 5 = 0 THEN hold + 1 ELSE hold END AS hold FROM r WHERE part % 7 <> 0 UNION ALL SELECT video, part + 1000000, hold FROM r WHERE part % 11 = 0),
        d AS (SELECT video, part, CASE WHEN r.hold IS NULL THEN 'added' WHEN n.hold IS NULL THEN 'removed' WHEN r.hold <> n.hold THEN 'changed' END AS change, r.hold AS was, n.hold AS now FROM r FULL JOIN n USING (video, part))
        SELECT * FROM d WHERE change IS NOT NULL""",
}
