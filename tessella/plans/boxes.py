"""Boxes on a frame over time: what lies inside, across or under them, where they may sit, and how cards follow each other.

A card is a measure with a time: the nr-th card of a video begins 15 s after the one before and stays for its hold.  Boxes are whole percents of the frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators import aggregates as A
from tessella.operators import intervals
from tessella.sources.views import MEASURES_SQL, VIDEOS_SQL, dealt_out, measures, table, videos

EVERY, WIDTH, SLACK, LEAST = 15, 60, 2, 5
#: Margins that the platform's controls cover: left, top, right, bottom.
SAFE = (6, 12, 8, 20)
BOX = ("x0", "y0", "x1", "y1")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, nr, category, entrance, hold, x0, y0, x1, y1, b, e); boxes end at 100.  They are dealt out by video once."""
    rows = dealt_out(measures(spark, sf_dir), table(spark, sf_dir, "lineitem").count(), "video").groupBy("video", "nr").agg(*[F.min(F.struct("category", "entrance", "hold", *BOX)).alias("x")]).select("video", "nr", "x.*")
    begin = (F.col("nr") - 1) * EVERY
    return rows.withColumns({"x1": F.least("x1", F.lit(100)), "y1": F.least("y1", F.lit(100)), "b": begin, "e": begin + F.col("hold")})


CARDS_SQL = f"""{MEASURES_SQL}, cards AS (SELECT video, nr, category, entrance, hold, x0, y0, least(x1, 100) AS x1, least(y1, 100) AS y1, (nr - 1) * {EVERY} AS b, (nr - 1) * {EVERY} + hold AS e FROM measures
  QUALIFY row_number() OVER (PARTITION BY video, nr ORDER BY category, entrance, hold, x0, y0, x1, y1) = 1)"""


def area(p: str = "") -> Column:
    return (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))


def shared_area(p: str, q: str) -> Column:
    wide = F.least(F.col(f"{p}x1"), F.col(f"{q}x1")) - F.greatest(F.col(f"{p}x0"), F.col(f"{q}x0"))
    high = F.least(F.col(f"{p}y1"), F.col(f"{q}y1")) - F.greatest(F.col(f"{p}y0"), F.col(f"{q}y0"))
    return F.greatest(F.lit(0), wide) * F.greatest(F.lit(0), high)


def _with_lines(rows: DataFrame) -> DataFrame:
    """Boxes (entrance F) with the text lines (entrance O, sampled when they begin) that are sampled while the box is up."""
    boxes = rows.where("entrance = 'F'").select("video", "nr", "b", "e", *BOX)
    lines = rows.where("entrance = 'O'").select("video", F.col("b").alias("t"), (F.col("category") == "R").alias("caption"), *[F.col(c).alias(f"l_{c}") for c in BOX])
    return intervals.overlap_join(boxes, lines.withColumn("b", F.col("t")).withColumn("e", F.col("t")), ["video"], WIDTH, touching=True)


def text_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each box: the median number of lines centred in it, the median share of it that they fill (percent), and how many lines run across its edge; captions don't count."""
    rows = _with_lines(cards(spark, sf_dir))
    x, y = F.col("l_x0") + F.col("l_x1"), F.col("l_y0") + F.col("l_y1")  # twice the centre
    inside = ~F.col("caption") & x.between(2 * (F.col("x0") - SLACK), 2 * (F.col("x1") + SLACK)) & y.between(2 * (F.col("y0") - SLACK), 2 * (F.col("y1") + SLACK))
    across = ~F.col("caption") & ~inside & (shared_area("", "l_") > 0)
    samples = rows.groupBy("video", "nr", "t").agg(F.count_if(inside).alias("lines"), (F.coalesce(F.sum(F.when(inside, area("l_"))), F.lit(0)) / F.first(area())).alias("fill"), F.count_if(across).alias("across"))
    return samples.groupBy("video", "nr").agg(F.floor(F.percentile("lines", F.lit(0.5))).alias("lines"), F.floor(F.least(F.lit(1.0), F.percentile("fill", F.lit(0.5))) * 100 + 0.5).alias("fill"), F.sum("across").alias("across"))


def boxes_during(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of the boxes of category A that begin from 5 s before a card until it ends, for cards of other categories."""
    rows = cards(spark, sf_dir)
    up = rows.where("category != 'A'").select("video", "nr", (F.col("b") - 5).alias("b"), "e")
    heads = rows.where("category = 'A'").select("video", "b", F.col("b").alias("e"), *BOX)
    found = intervals.overlap_join(up, heads, ["video"], WIDTH, touching=True)
    return found.groupBy("video", "nr").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def nested_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a video's boxes: the smaller is at least 70% inside the bigger (part), or wholly inside it with 8 to spare on each side (held)."""
    rows = cards(spark, sf_dir)
    a, b = (rows.select("video", *[F.col(c).alias(f"{s}{c}") for c in ("nr", *BOX)]) for s in ("a_", "b_"))
    pairs = a.join(b, "video").where("a_nr != b_nr")
    part = (area("a_") < area("b_")) & (shared_area("a_", "b_") * 10 >= area("a_") * 7)
    held = (F.col("a_x0") >= F.col("b_x0") - 8) & (F.col("a_y0") >= F.col("b_y0") - 8) & (F.col("a_x1") <= F.col("b_x1") + 8) & (F.col("a_y1") <= F.col("b_y1") + 8)
    return pairs.select("video", F.col("a_nr").alias("nr"), F.col("b_nr").alias("other"), part.alias("part"), held.alias("held")).where("part or held")


def bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards(spark, sf_dir).groupBy("video").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"))


def safe_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percent of a video's boxes (but for those of 60% of the frame or more) that are inside the margins, with 1 to spare; null without any."""
    left, top, right, bottom = SAFE
    ok = (F.col("x0") >= left - 1) & (F.col("y0") >= top - 1) & (F.col("x1") <= 101 - right) & (F.col("y1") <= 101 - bottom)
    small = area() < 6000
    return cards(spark, sf_dir).groupBy("video").agg(F.floor(F.count_if(small & ok) * 100 / F.nullif(F.count_if(small), F.lit(0)) + 0.5).alias("safe"))


def safe_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes shrunk to what the margins leave (at most 45 high in the upper half), then moved into them."""
    left, top, right, bottom = SAFE
    rows = cards(spark, sf_dir).select("video", "nr", "x0", "y0", (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))
    rows = rows.withColumn("w", F.least("w", F.lit(100 - left - right))).withColumn("h", F.least("h", F.lit(100 - top - bottom), F.when(F.col("y0") < 50, 45).otherwise(100)))
    x = F.least(F.greatest("x0", F.lit(left)), 100 - right - F.col("w"))
    return rows.select("video", "nr", x.alias("x"), F.least(F.greatest("y0", F.lit(top)), 100 - bottom - F.col("h")).alias("y"), "w", "h")


def fitted_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a picture (4:3, 1:1 or 9:16 by category) lands in its box on a 1920 x 1080 frame: at its aspect, centred, in tenths of a percent."""
    rows = cards(spark, sf_dir).withColumn("w", (F.col("x1") - F.col("x0")) * 19.2).withColumn("h", (F.col("y1") - F.col("y0")) * 10.8)
    aspect = F.when(F.col("category") == "A", 4 / 3).when(F.col("category") == "N", 1.0).otherwise(9 / 16)
    wide = aspect > F.col("w") / F.col("h")
    rows = rows.withColumn("cw", F.when(wide, F.col("w")).otherwise(F.col("h") * aspect) / 19.2).withColumn("ch", F.when(wide, F.col("w") / aspect).otherwise(F.col("h")) / 10.8)
    tenths = lambda x: F.floor(x * 10 + 0.5 + 1e-6)
    return rows.select("video", "nr", tenths(F.col("x0") + (F.col("x1") - F.col("x0") - F.col("cw")) / 2).alias("x"), tenths(F.col("y0") + (F.col("y1") - F.col("y0") - F.col("ch")) / 2).alias("y"), tenths(F.col("cw")).alias("w"), tenths(F.col("ch")).alias("h"))


def heat_under_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean heat of its category's grid (cells of 10) under each box of the other entrance, in hundredths."""
    rows = cards(spark, sf_dir)
    cells = A.grid_heat(rows.where("entrance = 'O'"), ["category"], 10, "hold").select("category", F.col("x").alias("cx"), F.col("y").alias("cy"), F.floor(F.col("heat") * 1000 + 0.5).cast("long").alias("heat"))
    x = F.explode(F.sequence(F.floor(F.col("x0") / 10), F.greatest(F.floor(F.col("x0") / 10), F.ceil(F.col("x1") / 10) - 1))).alias("cx")
    y = F.explode(F.sequence(F.floor(F.col("y0") / 10), F.greatest(F.floor(F.col("y0") / 10), F.ceil(F.col("y1") / 10) - 1))).alias("cy")
    under = rows.where("entrance = 'F'").select("video", "nr", "category", "y0", "y1", x).select("video", "nr", "category", "cx", y)
    return under.join(F.broadcast(cells), ["category", "cx", "cy"], "left").groupBy("video", "nr").agg(F.floor(F.coalesce(F.sum("heat"), F.lit(0)) / F.count("*") / 10).alias("heat"))  # at most 100 cells a category


def on_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At every 20th second of a video: how many cards are up, the first of them, and whether one has come up with it."""
    rows = cards(spark, sf_dir)
    ends = rows.groupBy("video").agg(F.max("e").alias("last"))
    points = ends.select("video", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"), F.lit(20).cast("long"))).alias("t")).withColumn("b", F.col("t")).withColumn("e", F.col("t"))
    found = intervals.overlap_join(points, rows.select("video", "nr", "b", "e"), ["video"], WIDTH, touching=True).where("b >= rb and b < re")
    return found.groupBy("video", "t").agg(F.count("*").alias("n"), F.min("nr").alias("first"), (F.max("rb") == F.col("t")).alias("lands"))


def placed_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards in two lanes by entrance: never two at once in a lane (the next one ends it), and none under 5 s."""
    end = F.least("e", F.coalesce(F.lead("b").over(W.partitionBy("video", "entrance").orderBy("b", "nr")), F.col("e")))
    return cards(spark, sf_dir).withColumn("e", end).where(F.col("e") - F.col("b") >= LEAST).select("video", "nr", "entrance", "b", "e")


def under_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards give way to a video's first card of category N: they end as it lands, or begin when it ends; under 5 s they go."""
    rows = cards(spark, sf_dir)
    title = rows.where("category = 'N'").groupBy("video").agg(F.min(F.struct("b", "e", "nr")).alias("t"))
    rows = rows.join(title, "video", "left").where("t is null or nr != t.nr")
    meets = F.coalesce((F.col("e") > F.col("t.b")) & (F.col("b") < F.col("t.e")), F.lit(False))
    early = F.col("b") < F.col("t.b")
    rows = rows.select("video", "nr", F.when(meets & ~early, F.col("t.e")).otherwise(F.col("b")).alias("b"), F.when(meets & early, F.col("t.b")).otherwise(F.col("e")).alias("e"))
    return rows.where(F.col("e") - F.col("b") >= LEAST)


def pans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two slow drifts a minute over a video, each 1.5 s, evenly spread, out and back in turn; in milliseconds."""
    ends = cards(spark, sf_dir).groupBy("video").agg((F.max("e") * 1000).alias("ms"))
    rows = ends.withColumn("n", F.floor(F.col("ms") / 30_000 + 0.5)).where("n > 0").select("video", "ms", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    start = F.floor((2 * F.col("k") + 1) * F.col("ms") / (2 * F.col("n"))) - 750
    return rows.select("video", "k", F.greatest(F.lit(0), start).alias("b"), F.least("ms", start + 1500).alias("e"), F.when(F.col("k") % 2 == 0, "out").otherwise("back").alias("way"))


def frame_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A video's frames (a tenth of its views) in equal ranges of about 30 s at 30 a second, 20 at most: how many, the longest, and the minutes that are billed (20 s to start and 0.2 s a frame, each range rounded up)."""
    rows = videos(spark, sf_dir).select("video", F.floor(F.col("views") / 10).alias("frames")).where("frames > 0")
    k = F.greatest(F.lit(1), F.least(F.lit(20), F.ceil(F.col("frames") / 900)))
    rows = rows.withColumn("step", F.ceil(F.col("frames") / k))
    rows = rows.select("video", "frames", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1, F.col("step"))).alias("a"))
    size = F.least("frames", F.col("a") + F.col("step")) - F.col("a")
    return rows.groupBy("video").agg(F.count("*").alias("chunks"), F.max(size).alias("longest"), (2 + F.sum(F.ceil((200 + 2 * size) / 600))).alias("minutes"))


def still_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames at 4, 25, 50, 75 and 96 percent of each card at 30 a second, within the video."""
    rows = cards(spark, sf_dir).withColumn("last", F.max("e").over(W.partitionBy("video")) * 30 - 1)
    at = F.explode(F.array(*map(F.lit, (4, 25, 50, 75, 96)))).alias("percent")
    rows = rows.select("video", "nr", "b", "e", "last", at)
    frame = F.floor((F.col("b") * 100 + (F.col("e") - F.col("b")) * F.col("percent")) * 30 / 100 + 0.5)
    return rows.select("video", "nr", F.col("percent").cast("long").alias("percent"), F.least("last", F.greatest(F.lit(0), frame)).alias("frame"))


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A video's markers: its cards of category R, else all its cards."""
    rows = cards(spark, sf_dir).withColumn("beats", F.count_if(F.col("category") == "R").over(W.partitionBy("video")))
    return rows.where("beats = 0 or category = 'R'").select("video", "nr", "b", F.when(F.col("beats") > 0, "beat").otherwise("card").alias("kind"))


def caption_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a video's lines (entrance O) sit against its boxes of category A, by medians: above, on or below; null unless both are measured."""
    rows = cards(spark, sf_dir)
    middle, high = F.col("y0") + F.col("y1"), F.col("y1") - F.col("y0")
    line, face = F.when(F.col("entrance") == "O", middle), F.col("category") == "A"
    found = rows.groupBy("video").agg(F.percentile(line, F.lit(0.5)).alias("line"), F.percentile(F.when(face, middle), F.lit(0.5)).alias("face"), F.percentile(F.when(face, high), F.lit(0.5)).alias("high"))
    side = F.when(F.col("line").isNull() | F.col("face").isNull(), None).when(F.col("line") < F.col("face") - F.col("high"), "above").when(F.col("line") > F.col("face") + F.col("high"), "below").otherwise("on")
    return found.select("video", side.alias("side"))


def personalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A video's manner by the first rule that fits: from cards a minute, the share of entrance O (as ease), the median hold and cards of category R a minute."""
    rows = cards(spark, sf_dir).groupBy("video").agg((F.count("*") * 60 / F.max("e")).alias("cpm"), (F.count_if(F.col("entrance") == "O") / F.count("*")).alias("ease"), F.percentile("hold", F.lit(0.5)).alias("hold"), (F.count_if(F.col("category") == "R") * 60 / F.max("e")).alias("punch"))
    kind = F.when(F.col("ease") >= 0.3, "smooth").when((F.col("punch") >= 1) & (F.col("cpm") >= 3), "punchy").when(F.col("cpm") >= 4, "snappy").when((F.col("cpm") < 3) & (F.col("hold") >= 25), "calm").when(F.col("ease") <= 0.1, "snappy").otherwise("smooth")
    return rows.select("video", kind.alias("kind"))


def split_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seam of a split screen, from 35 to 60, for videos whose boxes are in the upper half most of the time; null for others."""
    rows = cards(spark, sf_dir)
    top = F.sum(F.when(F.col("y0") + F.col("y1") < 100, F.col("hold")).otherwise(0)) / F.sum("hold")
    found = rows.groupBy("video").agg(top.alias("top"), F.percentile("y1", F.lit(0.5)).alias("end"))
    return found.select("video", F.when((F.col("top") >= 0.6) & (F.col("end") <= 70), F.least(F.lit(60), F.greatest(F.lit(35), F.floor(F.col("end") + 2.5)))).cast("long").alias("seam"))


QUERIES = {q.__name__: q for q in (text_in_boxes, boxes_during, nested_boxes, bounding_boxes, safe_shares, safe_boxes, fitted_content, heat_under_boxes, on_screen, placed_cards, under_titles, pans, frame_chunks, still_frames, markers, caption_sides, personalities, split_layouts)}

_SHARED = "greatest(0, least({0}.x1, {1}.x1) - greatest({0}.x0, {1}.x0)) * greatest(0, least({0}.y1, {1}.y1) - greatest({0}.y0, {1}.y0))"
_AREA = "({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0)"
_INSIDE = f"l.category <> 'R' AND l.x0 + l.x1 BETWEEN 2 * (k.x0 - {SLACK}) AND 2 * (k.x1 + {SLACK}) AND l.y0 + l.y1 BETWEEN 2 * (k.y0 - {SLACK}) AND 2 * (k.y1 + {SLACK})"

ORACLE_SQL = {
    "text_in_boxes": f"""WITH {CARDS_SQL}, p AS (SELECT k.video, k.nr, l.b AS t, {_INSIDE} AS inside, l.category <> 'R' AND NOT ({_INSIDE}) AND {_SHARED.format('k', 'l')} > 0 AS across, {_AREA.format('l')} AS la, {_AREA.format('k')} AS ka FROM cards k JOIN cards l ON k.video = l.video AND k.entrance = 'F' AND l.entrance = 'O' AND l.b BETWEEN k.b AND k.e),
        s AS (SELECT video, nr, t, count(*) FILTER (WHERE inside) AS lines, CAST(coalesce(sum(la) FILTER (WHERE inside), 0) AS BIGINT) / any_value(ka) AS fill, count(*) FILTER (WHERE across) AS across FROM p GROUP BY 1, 2, 3)
        SELECT video, nr, CAST(floor(median(lines)) AS BIGINT) AS lines, CAST(floor(least(1.0::DOUBLE, median(fill)) * 100 + 0.5::DOUBLE) AS BIGINT) AS fill, CAST(sum(across) AS BIGINT) AS across FROM s GROUP BY 1, 2""",
    "boxes_during": f"WITH {CARDS_SQL} SELECT k.video, k.nr, min(h.x0) AS x0, min(h.y0) AS y0, max(h.x1) AS x1, max(h.y1) AS y1 FROM cards k JOIN cards h ON k.video = h.video AND k.category <> 'A' AND h.category = 'A' AND h.b BETWEEN k.b - 5 AND k.e GROUP BY 1, 2",
    "nested_boxes": f"""WITH {CARDS_SQL}, p AS (SELECT a.video, a.nr, b.nr AS other, {_AREA.format('a')} < {_AREA.format('b')} AND {_SHARED.format('a', 'b')} * 10 >= {_AREA.format('a')} * 7 AS part, a.x0 >= b.x0 - 8 AND a.y0 >= b.y0 - 8 AND a.x1 <= b.x1 + 8 AND a.y1 <= b.y1 + 8 AS held
        FROM cards a JOIN cards b ON a.video = b.video AND a.nr <> b.nr) SELECT * FROM p WHERE part OR held""",
    "bounding_boxes": f"WITH {CARDS_SQL} SELECT video, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM cards GROUP BY 1",
    "safe_shares": f"WITH {CARDS_SQL}, s AS (SELECT video, (x1 - x0) * (y1 - y0) < 6000 AS small, x0 >= {SAFE[0] - 1} AND y0 >= {SAFE[1] - 1} AND x1 <= {101 - SAFE[2]} AND y1 <= {101 - SAFE[3]} AS ok FROM cards) SELECT video, CAST(floor(count(*) FILTER (WHERE small AND ok) * 100 / nullif(count(*) FILTER (WHERE small), 0) + 0.5::DOUBLE) AS BIGINT) AS safe FROM s GROUP BY 1",
    "safe_boxes": f"""WITH {CARDS_SQL}, s AS (SELECT video, nr, x0, y0, least(x1 - x0, {100 - SAFE[0] - SAFE[2]}) AS w, least(y1 - y0, {100 - SAFE[1] - SAFE[3]}, CASE WHEN y0 < 50 THEN 45 ELSE 100 END) AS h FROM cards)
        SELECT video, nr, least(greatest(x0, {SAFE[0]}), {100 - SAFE[2]} - w) AS x, least(greatest(y0, {SAFE[1]}), {100 - SAFE[3]} - h) AS y, w, h FROM s""",
    "fitted_content": f"""WITH {CARDS_SQL}, s AS (SELECT *, (x1 - x0) * 19.2::DOUBLE AS w, (y1 - y0) * 10.8::DOUBLE AS h, CASE category WHEN 'A' THEN 4.0::DOUBLE / 3 WHEN 'N' THEN 1.0::DOUBLE ELSE 9.0::DOUBLE / 16 END AS a FROM cards),
        c AS (SELECT *, CASE WHEN a > w / h THEN w ELSE h * a END / 19.2::DOUBLE AS cw, CASE WHEN a > w / h THEN w / a ELSE h END / 10.8::DOUBLE AS ch FROM s), o AS (SELECT video, nr, x0 + (x1 - x0 - cw) / 2 AS x, y0 + (y1 - y0 - ch) / 2 AS y, cw AS w, ch AS h FROM c)
        SELECT video, nr, CAST(floor(x * 10 + 0.500001::DOUBLE) AS BIGINT) AS x, CAST(floor(y * 10 + 0.500001::DOUBLE) AS BIGINT) AS y, CAST(floor(w * 10 + 0.500001::DOUBLE) AS BIGINT) AS w, CAST(floor(h * 10 + 0.500001::DOUBLE) AS BIGINT) AS h FROM o""",
    "heat_under_boxes": f"""WITH {CARDS_SQL}, x AS (SELECT category, hold, y0, y1, unnest(range(x0 // 10, (x1 - 1) // 10 + 1)) AS cx FROM cards WHERE entrance = 'O'), c AS (SELECT category, hold, cx, unnest(range(y0 // 10, (y1 - 1) // 10 + 1)) AS cy FROM x),
        s AS (SELECT category, cx, cy, CAST(sum(hold) AS BIGINT) AS s FROM c GROUP BY 1, 2, 3), g AS (SELECT category, cx, cy, CAST(floor(s * 100 / max(s) OVER (PARTITION BY category) * 1000 + 0.5::DOUBLE) AS BIGINT) AS heat FROM s),
        u AS (SELECT video, nr, category, y0, y1, unnest(range(x0 // 10, greatest(x0 // 10, (x1 + 9) // 10 - 1) + 1)) AS cx FROM cards WHERE entrance = 'F'), v AS (SELECT video, nr, category, cx, unnest(range(y0 // 10, greatest(y0 // 10, (y1 + 9) // 10 - 1) + 1)) AS cy FROM u)
        SELECT video, nr, CAST(floor(CAST(coalesce(sum(heat), 0) AS BIGINT) / count(*) / 10) AS BIGINT) AS heat FROM v LEFT JOIN g USING (category, cx, cy) GROUP BY 1, 2""",
    "on_screen": f"""WITH {CARDS_SQL}, p AS (SELECT video, unnest(range(0, last + 1, 20)) AS t FROM (SELECT video, max(e) AS last FROM cards GROUP BY 1)) SELECT p.video, p.t, count(*) AS n, min(c.nr) AS first, max(c.b) = p.t AS lands FROM p JOIN cards c ON c.video = p.video AND p.t >= c.b AND p.t < c.e GROUP BY 1, 2""",
    "placed_cards": f"WITH {CARDS_SQL}, n AS (SELECT video, nr, entrance, b, least(e, coalesce(lead(b) OVER (PARTITION BY video, entrance ORDER BY b, nr), e)) AS e FROM cards) SELECT * FROM n WHERE e - b >= {LEAST}",
    "under_titles": f"""WITH {CARDS_SQL}, t AS (SELECT video, nr AS tn, b AS tb, e AS te FROM cards WHERE category = 'N' QUALIFY row_number() OVER (PARTITION BY video ORDER BY b, e, nr) = 1), j AS (SELECT c.*, tb, te, coalesce(c.e > tb AND c.b < te, false) AS meets FROM cards c LEFT JOIN t USING (video) WHERE tn IS NULL OR c.nr <> tn),
        m AS (SELECT video, nr, CASE WHEN meets AND b >= tb THEN te ELSE b END AS b, CASE WHEN meets AND b < tb THEN tb ELSE e END AS e FROM j) SELECT * FROM m WHERE e - b >= {LEAST}""",
    "pans": f"""WITH {CARDS_SQL}, d AS (SELECT video, max(e) * 1000 AS ms FROM cards GROUP BY 1), n AS (SELECT *, CAST(floor(ms / 30000 + 0.5::DOUBLE) AS BIGINT) AS n FROM d), k AS (SELECT *, unnest(range(0, n)) AS k FROM n), s AS (SELECT *, (2 * k + 1) * ms // (2 * n) - 750 AS s FROM k)
        SELECT video, k, greatest(0, s) AS b, least(ms, s + 1500) AS e, CASE WHEN k % 2 = 0 THEN 'out' ELSE 'back' END AS way FROM s""",
    "frame_chunks": f"""WITH {VIDEOS_SQL}, f AS (SELECT video, views // 10 AS frames FROM videos WHERE views >= 10), s AS (SELECT *, CAST(ceil(frames / greatest(1, least(20, ceil(frames / 900)))) AS BIGINT) AS step FROM f), a AS (SELECT *, unnest(range(0, frames, step)) AS a FROM s), z AS (SELECT video, least(frames, a + step) - a AS size FROM a)
        SELECT video, count(*) AS chunks, max(size) AS longest, CAST(2 + sum(ceil((200 + 2 * size) / 600)) AS BIGINT) AS minutes FROM z GROUP BY 1""",
    "still_frames": f"""WITH {CARDS_SQL}, s AS (SELECT video, nr, b, e, max(e) OVER (PARTITION BY video) * 30 - 1 AS last, unnest([4, 25, 50, 75, 96]) AS percent FROM cards)
        SELECT video, nr, CAST(percent AS BIGINT) AS percent, CAST(least(last, greatest(0, floor((b * 100 + (e - b) * percent) * 30 / 100 + 0.5::DOUBLE))) AS BIGINT) AS frame FROM s""",
    "markers": f"WITH {CARDS_SQL}, m AS (SELECT *, count(*) FILTER (WHERE category = 'R') OVER (PARTITION BY video) AS beats FROM cards) SELECT video, nr, b, CASE WHEN beats > 0 THEN 'beat' ELSE 'card' END AS kind FROM m WHERE beats = 0 OR category = 'R'",
    "caption_sides": f"""WITH {CARDS_SQL}, m AS (SELECT video, median(y0 + y1) FILTER (WHERE entrance = 'O') AS line, median(y0 + y1) FILTER (WHERE category = 'A') AS face, median(y1 - y0) FILTER (WHERE category = 'A') AS high FROM cards GROUP BY 1)
        SELECT video, CASE WHEN line IS NULL OR face IS NULL THEN NULL WHEN line < face - high THEN 'above' WHEN line > face + high THEN 'below' ELSE 'on' END AS side FROM m""",
    "personalities": f"""WITH {CARDS_SQL}, m AS (SELECT video, count(*) * 60 / max(e) AS cpm, count(*) FILTER (WHERE entrance = 'O') / count(*) AS ease, median(hold) AS hold, count(*) FILTER (WHERE category = 'R') * 60 / max(e) AS punch FROM cards GROUP BY 1)
        SELECT video, CASE WHEN ease >= 0.3 THEN 'smooth' WHEN punch >= 1 AND cpm >= 3 THEN 'punchy' WHEN cpm >= 4 THEN 'snappy' WHEN cpm < 3 AND hold >= 25 THEN 'calm' WHEN ease <= 0.1 THEN 'snappy' ELSE 'smooth' END AS kind FROM m""",
    "split_layouts": f"""WITH {CARDS_SQL}, m AS (SELECT video, CAST(sum(CASE WHEN y0 + y1 < 100 THEN hold ELSE 0 END) AS BIGINT) / CAST(sum(hold) AS BIGINT) AS top, median(y1) AS ends FROM cards GROUP BY 1)
        SELECT video, CASE WHEN top >= 0.6 AND ends <= 70 THEN CAST(least(60, greatest(35, floor(ends + 2.5))) AS BIGINT) END AS seam FROM m""",
}
