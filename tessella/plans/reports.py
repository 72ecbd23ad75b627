"""What a recording or a set of videos comes to: openings, text views, rates, styles, clip scores, recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import sequential
from tessella.operators.islands import islands
from tessella.operators.prefix import middle
from tessella.plans.boxes import CARDS_SQL, cards
from tessella.plans.texts import _tokens_sql
from tessella.plans.words import ORACLE_SQL as WORDS_ORACLE
from tessella.plans.words import phrase_islands, sentence_spans
from tessella.sources.views import VIDEOS_SQL, WORDS_SQL, table, videos, words

OPENING_MS, OPENING_S = 3_000, 20
#: Words before "like" that make it a hesitation, and what a sentence that leans on the one before begins with.
BEFORE_LIKE = ("and", "so", "was", "is", "just", "but")
CONNECTIVE = "^(?i)(and|but|so|because|which|that)\\b"


def openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three seconds of each conversation: the first word's time, what is said, and how many words."""
    rows = words(spark, sf_dir).where(F.col("start_ms") < OPENING_MS)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]), " ")
    return rows.groupBy("conv_id").agg(F.min("start_ms").alias("first_ms"), text.alias("line"), F.count("*").alias("n"))


def card_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 s of each video: the share of cards with a face (category A), the first card of each sort and its kind, and how many begin."""
    rows = cards(spark, sf_dir)
    inside = F.col("b") < OPENING_S
    first = F.min(F.struct("b", "nr", "category"))
    found = rows.groupBy("video").agg(
        (F.count_if(inside & (F.col("category") == "A")) * 100 / F.nullif(F.count_if(inside), F.lit(0))).alias("face"), first.alias("x"),
        F.min(F.when(F.col("category") == "R", F.col("b"))).alias("caption"), F.min(F.when(F.col("entrance") == "O", F.col("b"))).alias("line"), F.count_if(inside).alias("n"),
    )
    return found.select("video", "face", F.col("x.b").alias("graphic"), F.col("x.category").alias("kind"), "caption", "line", "n")


def timed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each sentence or pause over 0.6 s: [m:ss.s] and the words."""
    rows = words(spark, sf_dir)
    w = W.partitionBy("conv_id").orderBy("idx")
    rows = islands(rows, ["conv_id"], ["idx"], F.lag("ends_sentence").over(w) | (F.col("start_ms") - F.lag("end_ms").over(w) > 600), "line")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]), " ")
    rows = rows.groupBy("conv_id", F.col("line").cast("long").alias("line")).agg(F.min("start_ms").alias("ms"), text.alias("text"))
    tenths = F.floor(F.col("ms") / 100)
    return rows.select("conv_id", "line", F.concat(F.format_string("[%d:%02d.%d] ", F.floor(tenths / 600), F.floor(tenths / 10) % 60, tenths % 10), "text").alias("text"))


def phrase_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases as text, with the pause before one of a second or more."""
    rows = phrase_islands(spark, sf_dir)
    gap = F.col("start_ms") - F.lag("end_ms").over(W.partitionBy("conv_id").orderBy("phrase"))
    pause = F.when(gap >= 600, F.format_string("(+%d.%ds) ", F.floor(gap / 1000), F.floor(gap / 100) % 10)).otherwise("")
    return rows.select("conv_id", "phrase", F.concat(pause, F.format_string("[%d-%d] ", "start_ms", "end_ms"), "text").alias("text"))


def hesitant_likes(spark: SparkSession, sf_dir: str, said: str = "the") -> DataFrame:
    """Where a word ("the" here, in place of "like") is a hesitation: first of all, after a mark or before one, set off by 0.3 s, or after one of a few words."""
    rows = words(spark, sf_dir)
    w = W.partitionBy("conv_id").orderBy("idx")
    rows = rows.withColumn("prev", F.lag("word").over(w)).withColumn("gap", F.greatest(F.col("start_ms") - F.lag("end_ms").over(w), F.lead("start_ms").over(w) - F.col("end_ms"))).withColumn("before", F.lag("norm").over(w))
    loose = F.col("prev").isNull() | F.col("prev").rlike("[.?!,]$") | F.col("word").endswith(",") | F.coalesce(F.col("gap") >= 300, F.lit(False)) | F.col("before").isin(*BEFORE_LIKE)
    return rows.where(F.col("norm") == said).groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(loose).alias("loose"))


def stressed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest-held word of each phrase (a pause of over 0.2 s ends one; ties: the first), where a zoom may come, and whether a sentence begins there."""
    rows = words(spark, sf_dir)
    w = W.partitionBy("conv_id").orderBy("idx")
    starts = (F.col("idx") == 1) | F.lag("ends_sentence").over(w) | (F.col("start_ms") - F.lag("end_ms").over(w) > 500)
    rows = islands(rows.withColumn("starts", F.coalesce(starts, F.lit(False))), ["conv_id"], ["idx"], F.col("start_ms") - F.lag("end_ms").over(w) > 200, "phrase")
    best = rows.groupBy("conv_id", "phrase").agg(F.max(F.struct((F.col("end_ms") - F.col("start_ms")).alias("held"), (-F.col("idx")).alias("early"), "start_ms", "starts")).alias("x"))
    return best.select("conv_id", (-F.col("x.early")).alias("idx"), "x.start_ms", "x.held", "x.starts")


def chapter_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters (each conversation's sentences with numbers 1, 6, 11, ... by their first two words): where each phrase stands first from its sentence on."""
    rows = words(spark, sf_dir)
    w = W.partitionBy("conv_id").orderBy("idx")
    pairs = rows.select("conv_id", "idx", "start_ms", "norm", F.lead("norm").over(w).alias("next"))
    opens = sentence_spans(spark, sf_dir).where("sentence % 5 = 1 and n_words >= 2").select("conv_id", "sentence", F.col("start_ms").alias("at"))
    opens = opens.join(pairs, (opens["conv_id"] == pairs["conv_id"]) & (opens["at"] == pairs["start_ms"])).select(opens["conv_id"], "sentence", "at", "norm", "next")
    hits = opens.join(pairs.withColumnRenamed("start_ms", "ms"), ["conv_id", "norm", "next"])
    return hits.groupBy("conv_id", "sentence").agg(F.min(F.when(F.col("ms") >= F.col("at"), F.col("idx"))).alias("idx"), F.count("*").alias("places"))


def named_in_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that say a name of a dictionary (the nations' names in lower case, or "of" as one) as a whole word."""
    names = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("name")).unionByName(spark.createDataFrame([("of",), ("and",)], "name string"))
    said = sentence_spans(spark, sf_dir).select("conv_id", "sentence", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("name"))
    return said.join(names, "name").groupBy("conv_id", "sentence").agg(F.count("*").alias("names"), F.min("name").alias("first"))


def clip_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of five words or more as clips: words a minute against the conversation's median, numbers, how many words in, whether it leans back; a score from 0 to 1000, logistic."""
    rows = sentence_spans(spark, sf_dir).where("n_words >= 5").withColumn("wpm", F.floor(F.col("n_words") * 60_000 / (F.col("end_ms") - F.col("start_ms"))).cast("long"))
    rows = rows.join(middle(rows, ["conv_id"], "wpm", 50), "conv_id")
    x = 0.15 * F.greatest(F.lit(-2.0), F.least(F.lit(2.0), (F.col("wpm") - F.col("median")) / 30)) + 0.3 * F.when(F.col("n_words") >= 12, 1).when(F.col("n_words") >= 8, 0).otherwise(-1)
    x += 0.25 * F.least(F.lit(2), F.regexp_count("text", F.lit("[0-9]+"))) - F.when(F.col("text").rlike(T.ascii_edges(CONNECTIVE.replace("^(?i)", "(?i)^"))), 1.0).otherwise(0.0)
    return rows.select("conv_id", "sentence", "wpm", F.floor(1000 / (1 + F.exp(-x)) + 0.5).alias("score"))


def best_clips(spark: SparkSession, sf_dir: str, top: int = 3) -> DataFrame:
    rows = clip_scores(spark, sf_dir)
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("score"), "sentence"))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)


def style_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all cards by category: how many a minute of video, their share, the share on an even card, and the median hold of entrance O."""
    rows = cards(spark, sf_dir)
    minutes = rows.groupBy("video").agg(F.max("e").alias("s")).agg((F.sum("s") / 60).alias("minutes"), F.count("*").alias("videos"))
    whole = F.sum("n").over(W.partitionBy())
    found = rows.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("nr") % 2 == 0).alias("even"))
    hold = middle(rows.where("entrance = 'O'"), ["category"], "hold", 10, "hold")
    return found.withColumn("share", F.floor(F.col("n") * 100 / whole + 0.5)).crossJoin(F.broadcast(minutes)).join(hold, "category", "left").select("category", "n", "share", F.floor(F.col("even") * 100 / F.col("n") + 0.5).alias("even"), (F.col("n") / F.col("minutes")).alias("per_minute"), "hold")  # minutes: one row


def transition_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each creator's categories with at least 30 percent of its cards, the largest share first; a creator without cards has none."""
    own = cards(spark, sf_dir).join(videos(spark, sf_dir).select("creator", "video"), "video").groupBy("creator", "category").agg(F.count("*").alias("n"))
    own = own.withColumn("share", F.floor(F.col("n") * 100 / F.sum("n").over(W.partitionBy("creator")))).where("share >= 30")
    return own.groupBy("creator").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("s"), "category"))), lambda x: x["category"]), ",").alias("kinds"))


def recommended_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a conversation's pauses and fillers suggest, where there are enough of each: the pause to keep (1.5 times the median one, from 80 to 600 ms), and to keep fillers if two thirds are."""
    rows = words(spark, sf_dir)
    gap = F.lead("start_ms").over(W.partitionBy("conv_id").orderBy("idx")) - F.col("end_ms")
    rows = rows.withColumn("gap", F.when(gap > 0, gap)).withColumn("filler", F.col("norm").isin("the", "of", "to"))
    kept = F.col("idx") % 3 != 0
    found = rows.groupBy("conv_id").agg(F.count("gap").alias("pauses"), F.percentile("gap", F.lit(0.5)).alias("left"), F.count_if("filler").alias("fillers"), F.count_if(F.col("filler") & kept).alias("kept"))
    pause = F.when(F.col("pauses") >= 5, F.floor(F.least(F.lit(600.0), F.greatest(F.lit(80.0), F.col("left") * 1.5))).cast("long"))
    return found.select("conv_id", pause.alias("max_pause"), ((F.col("fillers") >= 3) & (F.col("kept") * 3 >= F.col("fillers") * 2)).alias("keep_fillers"))


def dealt_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards without a format (entrance O) take one from the mix, dealt in its shares; others keep their category."""
    rows = cards(spark, sf_dir).withColumn("free", (F.col("entrance") == "O").cast("int"))
    dealt = sequential.dealt(rows.where("free = 1"), ["video"], ["nr"], {"shot": 3, "sticker": 2}, "format").select("video", "nr", "format")
    return rows.select("video", "nr", "category").join(dealt, ["video", "nr"], "left").select("video", "nr", F.coalesce("format", "category").alias("format"))


def render_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos in pieces for containers: as many containers as 0.2 s a frame makes worth starting (25 s each), 40 at most, three pieces each of 30 frames or more."""
    rows = videos(spark, sf_dir).select("video", F.floor(F.col("views") / 50).alias("frames")).where("frames > 0")
    n = F.greatest(F.lit(1), F.least(F.lit(40), F.floor(F.col("frames") * 2 / 250)))
    k = F.greatest(F.lit(1), F.least(3 * n, F.floor(F.col("frames") / 30)))
    rows = rows.withColumn("n", n).withColumn("step", F.ceil(F.col("frames") / k))
    pieces = F.ceil(F.col("frames") / F.col("step"))
    return rows.select("video", F.least("n", pieces).alias("containers"), pieces.alias("pieces"), "step")


def growing_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of a caption that grows word by word (of each sentence, its first one, two, .. words, in turn): runs in which each is the start of the next, and the fullest of each."""
    rows = words(spark, sf_dir)
    first = (F.col("idx") == 1) | F.lag("ends_sentence").over(W.partitionBy("conv_id").orderBy("idx"))
    rows = islands(rows, ["conv_id"], ["idx"], first, "run")
    return rows.groupBy("conv_id", "run").agg(F.count("*").alias("samples"), F.min("idx").alias("first"), F.max("idx").alias("last")).where("samples >= 2").drop("run")


def job_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as pieces of an order rendered by suppliers: distinct containers, work, the longest piece, and by how much it straggles behind an even share."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_suppkey").alias("container"), F.col("l_quantity").cast("long").alias("s"))
    own = rows.groupBy("job", "container").agg(F.sum("s").alias("s"), F.count("*").alias("pieces"))
    return own.groupBy("job").agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("s").alias("work"), F.greatest(F.lit(1.0), F.max("s") * F.count("*") / F.sum("s")).alias("straggle"))


QUERIES = {q.__name__: q for q in (openings, card_openings, timed_lines, phrase_view, hesitant_likes, stressed_words, chapter_places, named_in_sentences, clip_scores, best_clips, style_summary, transition_lists, recommended_settings, dealt_formats, render_pieces, growing_captions, job_statistics)}

_S = f"s AS ({WORDS_ORACLE['sentence_spans']})"
_W = "(PARTITION BY conv_id ORDER BY idx)"


def _clips_sql() -> str:
    return f"""{_S}, w AS (SELECT *, CAST(floor(n_words * 60000 / (end_ms - start_ms)) AS BIGINT) AS wpm FROM s WHERE n_words >= 5), m AS (SELECT *, median(wpm) OVER (PARTITION BY conv_id) AS mid FROM w),
        x AS (SELECT conv_id, sentence, wpm, 0.15::DOUBLE * greatest(-2.0::DOUBLE, least(2.0::DOUBLE, (wpm - mid) / 30)) + 0.3::DOUBLE * CASE WHEN n_words >= 12 THEN 1 WHEN n_words >= 8 THEN 0 ELSE -1 END + 0.25::DOUBLE * least(2, len(regexp_extract_all(text, '[0-9]+'))) - CASE WHEN regexp_matches(text, '(?i)^(and|but|so|because|which|that)\\b') THEN 1 ELSE 0 END AS x FROM m),
        c AS (SELECT conv_id, sentence, wpm, CAST(floor(1000 / (1 + exp(-x)) + 0.5::DOUBLE) AS BIGINT) AS score FROM x)"""


ORACLE_SQL = {
    "openings": f"WITH {WORDS_SQL} SELECT conv_id, min(start_ms) AS first_ms, string_agg(word, ' ' ORDER BY idx) AS line, count(*) AS n FROM words WHERE start_ms < 3000 GROUP BY 1",
    "card_openings": f"""WITH {CARDS_SQL} SELECT video, count(*) FILTER (WHERE b < 20 AND category = 'A') * 100 / nullif(count(*) FILTER (WHERE b < 20), 0) AS face, min(b) AS graphic, arg_min(category, (b, nr)) AS kind, min(b) FILTER (WHERE category = 'R') AS caption,
        min(b) FILTER (WHERE entrance = 'O') AS line, count(*) FILTER (WHERE b < 20) AS n FROM cards GROUP BY 1""",
    "timed_lines": f"""WITH {WORDS_SQL}, f AS (SELECT *, CASE WHEN lag(ends_sentence) OVER {_W} OR start_ms - lag(end_ms) OVER {_W} > 600 OR idx = 1 THEN 1 ELSE 0 END AS c FROM words), r AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS line FROM f),
        g AS (SELECT conv_id, CAST(line AS BIGINT) AS line, min(start_ms) // 100 AS t, string_agg(word, ' ' ORDER BY idx) AS text FROM r GROUP BY 1, 2) SELECT conv_id, line, printf('[%d:%02d.%d] ', t // 600, t // 10 % 60, t % 10) || text AS text FROM g""",
    "phrase_view": f"""WITH p AS ({WORDS_ORACLE['phrase_islands']}), g AS (SELECT *, start_ms - lag(end_ms) OVER (PARTITION BY conv_id ORDER BY phrase) AS gap FROM p)
        SELECT conv_id, phrase, CASE WHEN gap >= 600 THEN printf('(+%d.%ds) ', gap // 1000, gap // 100 % 10) ELSE '' END || printf('[%d-%d] ', start_ms, end_ms) || text AS text FROM g""",
    "hesitant_likes": f"""WITH {WORDS_SQL}, g AS (SELECT *, lag(word) OVER {_W} AS prev, greatest(start_ms - lag(end_ms) OVER {_W}, lead(start_ms) OVER {_W} - end_ms) AS gap, lag(norm) OVER {_W} AS before FROM words)
        SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE prev IS NULL OR regexp_matches(prev, '[.?!,]$') OR ends_with(word, ',') OR coalesce(gap >= 300, false) OR before IN {BEFORE_LIKE}) AS loose FROM g WHERE norm = 'the' GROUP BY 1""",
    "stressed_words": f"""WITH {WORDS_SQL}, f AS (SELECT *, CASE WHEN idx = 1 OR start_ms - lag(end_ms) OVER {_W} > 200 THEN 1 ELSE 0 END AS c, coalesce(idx = 1 OR lag(ends_sentence) OVER {_W} OR start_ms - lag(end_ms) OVER {_W} > 500, false) AS starts FROM words),
        r AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS phrase FROM f) SELECT conv_id, idx, start_ms, end_ms - start_ms AS held, starts FROM r QUALIFY row_number() OVER (PARTITION BY conv_id, phrase ORDER BY end_ms - start_ms DESC, idx) = 1""",
    "chapter_places": f"""WITH {_S}, v AS ({WORDS_ORACLE['normalize_tokens']}), p AS (SELECT conv_id, idx, start_ms, norm, lead(norm) OVER {_W} AS nxt FROM v), o AS (SELECT s.conv_id, s.sentence, s.start_ms AS pos, p.norm, p.nxt FROM s JOIN p ON p.conv_id = s.conv_id AND p.start_ms = s.start_ms WHERE s.sentence % 5 = 1 AND s.n_words >= 2)
        SELECT o.conv_id, o.sentence, min(p.idx) FILTER (WHERE p.start_ms >= o.pos) AS idx, count(*) AS places FROM o JOIN p ON p.conv_id = o.conv_id AND p.norm = o.norm AND p.nxt = o.nxt GROUP BY 1, 2""",
    "named_in_sentences": f"""WITH {_S}, d AS (SELECT lower(n_name) AS name FROM nation UNION ALL SELECT 'of' UNION ALL SELECT 'and'), t AS (SELECT conv_id, sentence, unnest(list_distinct({_tokens_sql('text')})) AS name FROM s)
        SELECT conv_id, sentence, count(*) AS names, min(name) AS first FROM t JOIN d USING (name) GROUP BY 1, 2""",
    "clip_scores": f"WITH {_clips_sql()} SELECT * FROM c",
    "best_clips": f"WITH {_clips_sql()} SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, sentence) AS rank FROM c QUALIFY rank <= 3",
    "style_summary": f"""WITH {CARDS_SQL}, m AS (SELECT CAST(sum(s) AS BIGINT) / 60 AS minutes FROM (SELECT max(e) AS s FROM cards GROUP BY video)), g AS (SELECT category, count(*) AS n, count(*) FILTER (WHERE nr % 2 = 0) AS even, median(hold) FILTER (WHERE entrance = 'O') AS hold FROM cards GROUP BY 1)
        SELECT category, n, CAST(floor(n * 100 / sum(n) OVER () + 0.5::DOUBLE) AS BIGINT) AS share, CAST(floor(even * 100 / n + 0.5::DOUBLE) AS BIGINT) AS even, n / minutes AS per_minute, hold FROM g CROSS JOIN m""",
    "transition_lists": f"""WITH {CARDS_SQL}, {VIDEOS_SQL}, c AS (SELECT creator, category, count(*) AS n FROM cards JOIN videos USING (video) GROUP BY 1, 2), s AS (SELECT creator, category, floor(n * 100 / sum(n) OVER (PARTITION BY creator)) AS share FROM c)
        SELECT creator, string_agg(category, ',' ORDER BY share DESC, category) AS kinds FROM s WHERE share >= 30 GROUP BY 1""",
    "recommended_settings": f"""WITH {WORDS_SQL}, g AS (SELECT conv_id, idx, norm, CASE WHEN lead(start_ms) OVER {_W} > end_ms THEN lead(start_ms) OVER {_W} - end_ms END AS gap FROM words),
        a AS (SELECT conv_id, count(gap) AS pauses, median(gap) AS mid, count(*) FILTER (WHERE norm IN ('the', 'of', 'to')) AS f, count(*) FILTER (WHERE norm IN ('the', 'of', 'to') AND idx % 3 <> 0) AS k FROM g GROUP BY 1)
        SELECT conv_id, CASE WHEN pauses >= 5 THEN CAST(floor(least(600, greatest(80, mid * 1.5))) AS BIGINT) END AS max_pause, f >= 3 AND k * 3 >= f * 2 AS keep_fillers FROM a""",
    "dealt_formats": f"""WITH {CARDS_SQL}, f AS (SELECT video, nr, ['shot', 'sticker', 'shot', 'sticker', 'shot'][(row_number() OVER (PARTITION BY video ORDER BY nr) - 1) % 5 + 1] AS format FROM cards WHERE entrance = 'O') SELECT video, nr, coalesce(format, category) AS format FROM cards LEFT JOIN f USING (video, nr)""",
    "render_pieces": f"""WITH {VIDEOS_SQL}, f AS (SELECT video, views // 50 AS frames FROM videos WHERE views >= 50), n AS (SELECT *, greatest(1, least(40, frames * 2 // 250)) AS n FROM f), s AS (SELECT *, CAST(ceil(frames / greatest(1, least(3 * n, frames // 30))) AS BIGINT) AS step FROM n)
        SELECT video, least(n, CAST(ceil(frames / step) AS BIGINT)) AS containers, CAST(ceil(frames / step) AS BIGINT) AS pieces, step FROM s""",
    "growing_captions": f"""WITH {WORDS_SQL}, f AS (SELECT *, CASE WHEN idx = 1 OR lag(ends_sentence) OVER {_W} THEN 1 ELSE 0 END AS c FROM words), r AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM f)
        SELECT conv_id, count(*) AS samples, min(idx) AS first, max(idx) AS last FROM r GROUP BY conv_id, run HAVING count(*) >= 2""",
    "job_statistics": "WITH o AS (SELECT l_orderkey AS job, l_suppkey AS container, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s, count(*) AS pieces FROM lineitem GROUP BY 1, 2) SELECT job, count(*) AS containers, CAST(sum(pieces) AS BIGINT) AS pieces, CAST(sum(s) AS BIGINT) AS work, greatest(1.0::DOUBLE, max(s) * count(*) / CAST(sum(s) AS BIGINT)) AS straggle FROM o GROUP BY 1",
}
