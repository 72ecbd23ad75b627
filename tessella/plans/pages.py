"""Text tables of pages, and choices over cards and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators import sequential
from tessella.plans.boxes import CARDS_SQL, cards, shared_area
from tessella.sources.views import VIDEOS_SQL, table, videos

#: Sorts of phrases: tag and the pattern of its content.
TAGS = (("title", "<title>([^<]*)</title>"), ("heading", "<h[1-3]>([^<]*)</h[1-3]>"), ("link", '<a href="[^"]*">([^<]*)</a>'))
BRIDGE, LONGEST_RUN, BREAK, LEAST = 3, 45, 2, 5


def page_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every phrase of a page's title, headings and links, as one column: distinct, of 3 to 260 characters."""
    html = table(spark, sf_dir, "pages").where("html is not null")
    found = [html.select("page_id", F.lit(tag).alias("tag"), F.explode(F.regexp_extract_all("html", F.lit(pattern), 1)).alias("text")) for tag, pattern in TAGS]
    rows = found[0].unionByName(found[1]).unionByName(found[2]).withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))
    return rows.where(F.length("text").between(3, 260)).groupBy("page_id", "text").agg(F.min("tag").alias("tag"), F.count("*").alias("n"))


def headings_to_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of 2 to 14 words and 110 characters at most that no other page has."""
    html = table(spark, sf_dir, "pages")
    rows = html.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(TAGS[1][1]), 1)).alias("text")).withColumn("text", F.trim("text"))
    rows = rows.withColumn("words", F.size(F.split("text", " +")).cast("long")).where(F.col("words").between(2, 14) & (F.length("text") <= 110))
    return rows.groupBy("text").agg(F.min("page_id").alias("page_id"), F.count_distinct("page_id").alias("pages"), F.first("words").alias("words")).where("pages = 1").drop("pages")


def linked_paths(spark: SparkSession, sf_dir: str, most: int = 20) -> DataFrame:
    """The paths that pages link, those that most pages link first, 20 of each language at most."""
    html = table(spark, sf_dir, "pages")
    rows = html.select("page_id", F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("lang"), F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), 1)).alias("path"))
    counts = rows.groupBy("lang", "path").agg(F.count_distinct("page_id").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), F.encode("path", "utf-8")))
    return counts.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)


def merged_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of several sources in one schema, each with what it has: labels, benchmark lines and conversations' first turns."""
    labels = table(spark, sf_dir, "labels").select(F.lit("label").alias("source"), F.col("doc_id").alias("id"), F.col("quality").cast("long").alias("quality"))
    lines = table(spark, sf_dir, "benchmark").select(F.lit("line").alias("source"), F.col("item_id").cast("long").alias("id"), F.length("text").cast("long").alias("length"))
    turns = table(spark, sf_dir, "conversations").where("turn = 0").select(F.lit("turn").alias("source"), F.col("conv_id").alias("id"), F.length("text").cast("long").alias("length"), "role")
    every = labels.unionByName(lines, allowMissingColumns=True).unionByName(turns, allowMissingColumns=True)
    return every.groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("quality"), F.sum("length").alias("length"), F.count_distinct("role").alias("roles"))


def video_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of features a video: pace, the commonest category (ties: by name), where its boxes sit, how long they hold; and how many of these are measured."""
    rows = cards(spark, sf_dir)
    common = rows.groupBy("video", "category").agg(F.count("*").alias("n")).groupBy("video").agg(F.min(F.struct((-F.col("n")).alias("n"), "category"))["category"].alias("kind"))
    found = rows.groupBy("video").agg((F.count("*") * 60 / F.max("e")).alias("per_minute"), F.percentile(F.when(F.col("entrance") == "O", F.col("hold")), F.lit(0.5)).alias("hold"), F.percentile(F.col("y0") + F.col("y1"), F.lit(0.5)).alias("middle"))
    found = found.join(common, "video")
    pace = F.when(F.col("per_minute") >= 4, "fast").when(F.col("per_minute") < 3, "slow").otherwise("even")
    place = F.when(F.col("middle") < 70, "top").when(F.col("middle") > 110, "bottom").otherwise("middle")
    return found.select("video", pace.alias("pace"), "kind", place.alias("place"), "hold", (F.lit(3) + F.col("hold").isNotNull().cast("int")).cast("long").alias("measured"))


def video_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of each video with its views: cards a minute by category, the share of time covered, the mean lag of cards, views a card."""
    rows = cards(spark, sf_dir)
    minutes = F.max("e") / 60
    of = [(F.count_if(F.col("category") == k) / minutes).alias(f"{k.lower()}_per_minute") for k in "ANR"]
    found = rows.groupBy("video").agg(*of, (F.sum("hold") / F.max("e")).alias("cover"), (F.sum("x0") / F.count("*")).alias("lag"), F.count("*").alias("n"))
    return found.join(videos(spark, sf_dir).select("video", "views"), "video").withColumn("views_a_card", F.col("views") / F.col("n")).drop("views")


def decided_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do with each video by its length (its views in seconds, over 500) and whether it is one's own (even keys): own, long, or a question with options."""
    rows = videos(spark, sf_dir).select("video", F.floor(F.col("views") / 500).alias("s"), (F.col("video") % 2 == 0).alias("own"))
    kind = F.when(F.col("s") >= 480, F.when(F.col("own"), "ask: long, own").otherwise("long")).when(F.col("own"), "own").when(F.col("s") >= 180, "ask: creator, own, long").otherwise("ask: creator, own")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.min("s").alias("shortest"), F.max("s").alias("longest"))


def repeated_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards that show the same as the one before: the same category and entrance, and boxes that share 80% of the smaller one."""
    w = W.partitionBy("video").orderBy("nr")
    rows = cards(spark, sf_dir)
    before = [F.lag(c).over(w).alias(f"p_{c}") for c in ("nr", "category", "entrance", "x0", "y0", "x1", "y1")]
    rows = rows.select("video", "nr", "category", "entrance", *[F.col(c).alias(f"c_{c}") for c in ("x0", "y0", "x1", "y1")], *before).where("p_nr = nr - 1 and p_category = category and p_entrance = entrance")
    small = F.least((F.col("c_x1") - F.col("c_x0")) * (F.col("c_y1") - F.col("c_y0")), (F.col("p_x1") - F.col("p_x0")) * (F.col("p_y1") - F.col("p_y0")))
    return rows.where(shared_area("c_", "p_") * 5 >= small * 4).select("video", "nr", "category")


def face_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards less than 3 s apart are one run of at most 45 s: one that would make it longer begins 2 s after the run has ended, and goes if that leaves it under 5 s."""
    rows = cards(spark, sf_dir).select("video", "nr", "b", "e")

    def make() -> sequential.Step:
        def step(state: dict, row: tuple) -> int | None:
            begin, last, first = row.b, state.get("last"), state.get("first")
            if last is not None and begin - last < BRIDGE and row.e - first > LONGEST_RUN:
                begin = last + BREAK
                if row.e - begin < LEAST:
                    return None
            if last is None or begin - last >= BRIDGE:
                state["first"] = begin
            state["last"] = max(last or 0, row.e)
            return begin

        return step

    found = sequential.sequential(rows, ["video"], ["b", "nr"], make, "begins", "long")
    return found.where("begins is not null").select("video", "nr", F.col("begins").alias("b"), "e")


def missing_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos whose creator's style has cards of category R on half of its videos or more, and that have none."""
    own = cards(spark, sf_dir).groupBy("video").agg(F.count_if(F.col("category") == "R").alias("typed")).join(videos(spark, sf_dir).select("creator", "video"), "video")
    style = own.groupBy("creator").agg((F.count_if(F.col("typed") > 0) * 2 >= F.count("*")).alias("asks"))
    return own.join(style, "creator").where("asks and typed = 0").select("creator", "video")


QUERIES = {q.__name__: q for q in (page_phrases, headings_to_use, linked_paths, merged_suggestions, video_features, video_rates, decided_items, repeated_looks, face_breaks, missing_parts)}

_PHRASES = " UNION ALL ".join(f"SELECT page_id, '{tag}' AS tag, unnest(regexp_extract_all(html, '{pattern}', 1)) AS text FROM pages" for tag, pattern in TAGS)
_BOX = "least(({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0), ({1}.x1 - {1}.x0) * ({1}.y1 - {1}.y0))"

ORACLE_SQL = {
    "page_phrases": f"WITH p AS ({_PHRASES}), t AS (SELECT page_id, tag, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM p) SELECT page_id, text, min(tag) AS tag, count(*) AS n FROM t WHERE length(text) BETWEEN 3 AND 260 GROUP BY 1, 2",
    "headings_to_use": f"""WITH h AS (SELECT page_id, trim(unnest(regexp_extract_all(html, '{TAGS[1][1]}', 1))) AS text FROM pages), w AS (SELECT *, CAST(len(string_split_regex(text, ' +')) AS BIGINT) AS words FROM h)
        SELECT text, min(page_id) AS page_id, any_value(words) AS words FROM w WHERE words BETWEEN 2 AND 14 AND length(text) <= 110 GROUP BY text HAVING count(DISTINCT page_id) = 1""",
    "linked_paths": """WITH l AS (SELECT page_id, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS path FROM pages), c AS (SELECT lang, path, count(DISTINCT page_id) AS n FROM l GROUP BY 1, 2)
        SELECT lang, path, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, encode(path)) AS rank FROM c QUALIFY rank <= 20""",
    "merged_suggestions": """SELECT 'label' AS source, count(*) AS n, CAST(sum(quality) AS BIGINT) AS quality, NULL AS length, 0 AS roles FROM labels UNION ALL SELECT 'line', count(*), NULL, CAST(sum(length(text)) AS BIGINT), 0 FROM benchmark
        UNION ALL SELECT 'turn', count(*), NULL, CAST(sum(length(text)) AS BIGINT), count(DISTINCT role) FROM conversations WHERE turn = 0""",
    "video_features": f"""WITH {CARDS_SQL}, k AS (SELECT video, category AS kind FROM (SELECT video, category, count(*) AS n FROM cards GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY video ORDER BY n DESC, category) = 1),
        f AS (SELECT video, count(*) * 60 / max(e) AS pm, median(hold) FILTER (WHERE entrance = 'O') AS hold, median(y0 + y1) AS mid FROM cards GROUP BY 1)
        SELECT video, CASE WHEN pm >= 4 THEN 'fast' WHEN pm < 3 THEN 'slow' ELSE 'even' END AS pace, kind, CASE WHEN mid < 70 THEN 'top' WHEN mid > 110 THEN 'bottom' ELSE 'middle' END AS place, hold, CAST(3 + (hold IS NOT NULL)::INT AS BIGINT) AS measured FROM f JOIN k USING (video)""",
    "video_rates": f"""WITH {CARDS_SQL}, {VIDEOS_SQL}, r AS (SELECT video, {', '.join(f"count(*) FILTER (WHERE category = '{k}') / (max(e) / 60) AS {k.lower()}_per_minute" for k in 'ANR')}, CAST(sum(hold) AS BIGINT) / max(e) AS cover, CAST(sum(x0) AS BIGINT) / count(*) AS lag, count(*) AS n FROM cards GROUP BY 1)
        SELECT r.*, views / n AS views_a_card FROM r JOIN videos USING (video)""",
    "decided_items": f"""WITH {VIDEOS_SQL}, s AS (SELECT views // 500 AS s, video % 2 = 0 AS own FROM videos) SELECT CASE WHEN s >= 480 AND own THEN 'ask: long, own' WHEN s >= 480 THEN 'long' WHEN own THEN 'own' WHEN s >= 180 THEN 'ask: creator, own, long' ELSE 'ask: creator, own' END AS kind,
        count(*) AS n, min(s) AS shortest, max(s) AS longest FROM s GROUP BY 1""",
    "repeated_looks": f"""WITH {CARDS_SQL} SELECT c.video, c.nr, c.category FROM cards c JOIN cards p ON p.video = c.video AND p.nr = c.nr - 1 AND p.category = c.category AND p.entrance = c.entrance
        WHERE greatest(0, least(c.x1, p.x1) - greatest(c.x0, p.x0)) * greatest(0, least(c.y1, p.y1) - greatest(c.y0, p.y0)) * 5 >= {_BOX.format('c', 'p')} * 4""",
    "face_breaks": f"""WITH RECURSIVE {CARDS_SQL}, n AS (SELECT video, nr, b, e, row_number() OVER (PARTITION BY video ORDER BY b, nr) AS k FROM cards),
        r AS (SELECT video, nr, k, b AS begins, e, b AS first, e AS last FROM n WHERE k = 1
              UNION ALL SELECT video, nr, k, begins, e, CASE WHEN begins IS NOT NULL AND begins - last >= {BRIDGE} THEN begins ELSE first END, CASE WHEN begins IS NOT NULL THEN greatest(last, e) ELSE last END
              FROM (SELECT n.video, n.nr, n.k, n.e, r.first, r.last, CASE WHEN n.b - r.last < {BRIDGE} AND n.e - r.first > {LONGEST_RUN} THEN CASE WHEN n.e - (r.last + {BREAK}) < {LEAST} THEN NULL ELSE r.last + {BREAK} END ELSE n.b END AS begins FROM r JOIN n ON n.video = r.video AND n.k = r.k + 1))
        SELECT video, nr, begins AS b, e FROM r WHERE begins IS NOT NULL""",
    "missing_parts": f"""WITH {CARDS_SQL}, {VIDEOS_SQL}, o AS (SELECT video, count(*) FILTER (WHERE category = 'R') AS typed FROM cards GROUP BY 1), v AS (SELECT creator, video, typed, count(*) FILTER (WHERE typed > 0) OVER (PARTITION BY creator) * 2 >= count(*) OVER (PARTITION BY creator) AS asks FROM o JOIN videos USING (video))
        SELECT creator, video FROM v WHERE asks AND typed = 0""",
}
