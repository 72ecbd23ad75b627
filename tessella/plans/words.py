"""Words of a conversation as phrases, clauses, sentences and captions, and what they measure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators.islands import islands, previous
from tessella.sources.views import WORDS_SQL, table, words

BY, ORDER = ["conv_id"], ["idx"]
PHRASE_GAP_MS, LONG_GAP_MS = 500, 700
CAPTION_WORDS = 3


def _gap(rows: DataFrame) -> DataFrame:
    return rows.withColumn("gap", F.col("start_ms") - previous("end_ms", BY, ORDER)).withColumn("after_sentence", previous("ends_sentence", BY, ORDER)).withColumn("after_clause", previous("ends_clause", BY, ORDER))


_GAP_SQL = f"""{WORDS_SQL},
gaps AS (SELECT *, start_ms - lag(end_ms) OVER o AS gap, lag(ends_sentence) OVER o AS after_sentence, lag(ends_clause) OVER o AS after_clause
         FROM words WINDOW o AS (PARTITION BY conv_id ORDER BY idx))"""


def _islands_sql(name: str, breaks: str) -> str:
    return f"""{_GAP_SQL},
{name} AS (SELECT *, sum(CASE WHEN gap IS NULL OR {breaks} THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS island FROM gaps)"""


def _spans_of(rows: DataFrame, name: str) -> DataFrame:
    """One row per island: its bounds, size and text in order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]), " ")
    return rows.groupBy("conv_id", F.col("island").cast("long").alias(name)).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_words"), text.alias("text"))


_SPANS_SQL = "SELECT conv_id, CAST(island AS BIGINT) AS {0}, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_words, string_agg(word, ' ' ORDER BY idx) AS text FROM {1} GROUP BY conv_id, island"


def normalize_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("conv_id", "idx", "norm", "start_ms", "end_ms")


def phrase_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase ends at a pause of 0.5 s or a sentence's end."""
    rows = _gap(words(spark, sf_dir))
    return _spans_of(islands(rows, BY, ORDER, (F.col("gap") >= PHRASE_GAP_MS) | F.col("after_sentence")), "phrase")


def clause_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clause also ends after , ; : and after a token that is only a hesitation."""
    rows = _gap(words(spark, sf_dir)).withColumn("hesitated", F.coalesce(previous("norm", BY, ORDER).isin(*T.HARD_FILLERS), F.lit(False)))
    return _spans_of(islands(rows, BY, ORDER, (F.col("gap") >= PHRASE_GAP_MS) | F.col("after_clause") | F.col("hesitated")), "clause")


def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _gap(words(spark, sf_dir))
    return _spans_of(islands(rows, BY, ORDER, (F.col("gap") >= 1200) | F.col("after_sentence")), "sentence")


def finished_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences without those that trail off in an ellipsis."""
    return sentence_spans(spark, sf_dir).where(~F.col("text").rlike(r"\.\.\.$|…$"))


def caption_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions of at most CAPTION_WORDS words within a clause; a caption ends at most 1.1 s after its last word's start, and before the next."""
    rows = islands(_gap(words(spark, sf_dir)), BY, ORDER, (F.col("gap") >= PHRASE_GAP_MS) | F.col("after_clause"), "clause")
    nth = F.row_number().over(W.partitionBy("conv_id", "clause").orderBy("idx"))
    rows = rows.withColumn("part", F.floor((nth - 1) / CAPTION_WORDS).cast("long"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]), " ")
    chunks = rows.groupBy("conv_id", F.col("clause").cast("long").alias("clause"), "part").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("last_end"), F.max("start_ms").alias("last_start"), text.alias("text"))
    after = F.lead("start_ms").over(W.partitionBy("conv_id").orderBy("start_ms"))
    return chunks.select("conv_id", "clause", "part", "start_ms", F.least(F.col("last_end"), F.col("last_start") + 1100, F.coalesce(after, F.col("last_end"))).alias("end_ms"), "text")


def transcript_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation: words, length, words a minute, gaps, fillers and hype words per 100 words, pronouns."""
    rows = _gap(words(spark, sf_dir))
    gap = F.when(F.col("gap") > 0, F.col("gap"))
    single = [f for f in T.FILLERS if " " not in f]
    return rows.groupBy("conv_id").agg(
        F.count("*").alias("n_words"), F.max("end_ms").alias("length_ms"), (F.count("*") * 60000 / F.max("end_ms")).alias("wpm"),
        F.percentile(gap, F.lit(0.5)).alias("gap_median"), F.count_if(gap >= 300).alias("long_gaps"), F.max(gap).alias("gap_longest"),
        (F.count_if(F.col("norm").isin(*single)) * 100 / F.count("*")).alias("filler_rate"), F.count_if(F.col("norm").isin(*T.HYPE)).alias("hype"),
        F.count_if(F.col("norm").isin("you", "your", "yours")).alias("you"), F.count_if(F.col("norm").isin("i", "my", "me", "mine")).alias("me"),
    )


def wpm_thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words a minute in each third of a conversation; a word belongs where it starts."""
    rows = words(spark, sf_dir).withColumn("length_ms", F.max("end_ms").over(W.partitionBy("conv_id")))
    third = F.least(F.floor(F.col("start_ms") * 3 / F.col("length_ms")), F.lit(2)).cast("long")
    return rows.groupBy("conv_id", third.alias("third")).agg(F.count("*").alias("n_words"), (F.count("*") * 180000 / F.max("length_ms")).alias("wpm"))


def pause_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive pauses of each conversation: count, median, lower 90th percentile."""
    rows = _gap(words(spark, sf_dir)).where("gap > 0")
    ordered = F.array_sort(F.collect_list("gap"))
    p90 = F.element_at(ordered, (F.floor(F.lit(0.9) * (F.count("*") - 1)) + 1).cast("int"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.percentile("gap", F.lit(0.5)).alias("median"), p90.alias("p90"))


def sentence_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentence_spans(spark, sf_dir)
    return found.groupBy("conv_id").agg(F.count("*").alias("n"), F.percentile("n_words", F.lit(0.5)).alias("median"), F.min("n_words").alias("shortest"), F.max("n_words").alias("longest"))


def top_ngrams(spark: SparkSession, sf_dir: str, most: int = 12) -> DataFrame:
    """Each conversation's commonest runs of 3 to 5 words that occur twice or more; ties: the longer, then by text."""
    w = W.partitionBy("conv_id").orderBy("idx")
    rows = words(spark, sf_dir)
    for k in range(1, 5):
        rows = rows.withColumn(f"w{k}", F.lead("norm", k).over(w))
    grams = F.array(*[F.when(F.col(f"w{n - 1}").isNotNull(), F.concat_ws(" ", "norm", *[f"w{k}" for k in range(1, n)])) for n in (3, 4, 5)])
    counted = rows.select("conv_id", F.explode(grams).alias("gram")).where("gram is not null").groupBy("conv_id", "gram").agg(F.count("*").alias("n")).where("n >= 2")
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("n"), F.desc(F.length("gram")), "gram"))
    return counted.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)


def doubled_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words said twice in a row, hesitations ignored (every place; overlapping ones count)."""
    rows = words(spark, sf_dir).where(~F.col("norm").isin(*T.HARD_FILLERS))
    return rows.withColumn("next", F.lead("norm").over(W.partitionBy("conv_id").orderBy("idx"))).where("norm = next").select("conv_id", "idx", "norm", "start_ms")


def phrase_locate(spark: SparkSession, sf_dir: str, n: int = 3) -> DataFrame:
    """Where the first n words of conversations are said again: each opening once, with how many conversations begin so and the first of them, an equi-join on n-grams."""
    w = W.partitionBy("conv_id").orderBy("idx")
    rows = words(spark, sf_dir).select("conv_id", "idx", "start_ms", F.concat_ws(" ", "norm", *[F.lead("norm", k).over(w) for k in range(1, n)]).alias("phrase"), F.lead("norm", n - 1).over(w).alias("last")).where("last is not null")
    openings = rows.where("idx = 1").groupBy("phrase").agg(F.count("*").alias("openers"), F.min("conv_id").alias("opener"))
    return rows.join(openings, "phrase").where("openers > 1 or idx > 1").select("phrase", "openers", "opener", "conv_id", "idx", "start_ms")


def emphasis_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In each phrase of three words or more the longest one, if it takes over 1.4 x the upper median and has over 3 letters; ties: the first."""
    rows = islands(_gap(words(spark, sf_dir)), BY, ORDER, (F.col("gap") >= PHRASE_GAP_MS) | F.col("after_sentence"), "phrase")
    rows = rows.withColumn("ms", F.col("end_ms") - F.col("start_ms"))
    same = W.partitionBy("conv_id", "phrase")
    n = F.count("*").over(same)
    rows = rows.withColumn("n", n).withColumn("up", F.row_number().over(same.orderBy("ms", "idx"))).withColumn("down", F.row_number().over(same.orderBy(F.desc("ms"), "idx")))
    middle = F.max(F.when(F.col("up") == F.floor(F.col("n") / 2) + 1, F.col("ms"))).over(same)
    rows = rows.withColumn("middle", middle)
    return rows.where((F.col("n") >= 3) & (F.col("down") == 1) & (F.col("ms") * 10 > F.col("middle") * 14) & (F.length("norm") > 3)).select("conv_id", F.col("phrase").cast("long").alias("phrase"), "idx", "norm")


def keyterms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words with a digit or a capital inside a sentence, by conversation, with where each is first said."""
    rows = _gap(words(spark, sf_dir)).where(F.col("word").rlike("[0-9]") | (F.col("word").rlike("^[A-Z]") & (F.col("after_sentence") == F.lit(False))))
    return rows.groupBy("conv_id", "norm").agg(F.count("*").alias("n"), F.min("start_ms").alias("first_ms"))


def first_key_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a conversation first says one of the words of its first user turn that have over 6 letters."""
    titles = table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", F.explode(T.tokens(F.col("text"))).alias("term")).where(F.length("term") > 6).distinct()
    said = words(spark, sf_dir).join(titles.withColumnRenamed("term", "norm"), ["conv_id", "norm"])
    return said.groupBy("conv_id").agg(F.min(F.struct("start_ms", "norm")).alias("x")).select("conv_id", "x.start_ms", F.col("x.norm").alias("term"))


def filler_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filler words within two seconds of each other as one cluster of two or more."""
    single = [f for f in T.FILLERS if " " not in f]
    rows = words(spark, sf_dir).where(F.col("norm").isin(*single, "the", "to"))
    rows = rows.withColumn("gap", F.col("start_ms") - previous("end_ms", BY, ORDER))
    found = islands(rows, BY, ORDER, F.col("gap") > 2000, "cluster").groupBy("conv_id", F.col("cluster").cast("long").alias("cluster"))
    return found.agg(F.count("*").alias("n"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).where("n >= 2")


QUERIES = {
    q.__name__: q
    for q in (normalize_tokens, phrase_islands, clause_islands, sentence_spans, finished_sentences, caption_chunks, transcript_metrics, wpm_thirds, pause_stats, sentence_lengths, top_ngrams, doubled_words, phrase_locate, emphasis_words, keyterms, first_key_term, filler_clusters)
}


def _IN(xs: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in xs)


_SINGLE = [f for f in T.FILLERS if " " not in f]
_SENTENCES = _islands_sql("sents", "gap >= 1200 OR after_sentence")
_PHRASES = _islands_sql("phr", f"gap >= {PHRASE_GAP_MS} OR after_sentence")
_TOKENS = "list_filter(string_split_regex(trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(text), '%', ' percent '), '([0-9]),([0-9])', '\\1\\2', 'g'), '([0-9]),([0-9])', '\\1\\2', 'g'), '[^a-z0-9'' ]+', ' ', 'g')), ' +'), lambda x: x <> '')"

ORACLE_SQL = {
    "normalize_tokens": f"WITH {WORDS_SQL} SELECT conv_id, idx, norm, start_ms, end_ms FROM words",
    "phrase_islands": f"WITH {_PHRASES} " + _SPANS_SQL.format("phrase", "phr"),
    "clause_islands": f"WITH {_islands_sql('cl', f'gap >= {PHRASE_GAP_MS} OR after_clause OR coalesce(hesitated, false)').replace('lag(ends_clause) OVER o AS after_clause', f'lag(ends_clause) OVER o AS after_clause, lag(norm) OVER o IN ({_IN(T.HARD_FILLERS)}) AS hesitated')} " + _SPANS_SQL.format("clause", "cl"),
    "sentence_spans": f"WITH {_SENTENCES} " + _SPANS_SQL.format("sentence", "sents"),
    "finished_sentences": f"WITH {_SENTENCES}, s AS (" + _SPANS_SQL.format("sentence", "sents") + r") SELECT * FROM s WHERE NOT regexp_matches(text, '\.\.\.$|…$')",
    "caption_chunks": f"""WITH {_islands_sql('cl', f'gap >= {PHRASE_GAP_MS} OR after_clause')},
        parts AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, island ORDER BY idx) - 1) // {CAPTION_WORDS} AS part FROM cl),
        chunks AS (SELECT conv_id, CAST(island AS BIGINT) AS clause, CAST(part AS BIGINT) AS part, min(start_ms) AS start_ms, max(end_ms) AS last_end, max(start_ms) AS last_start, string_agg(word, ' ' ORDER BY idx) AS text FROM parts GROUP BY conv_id, island, part)
        SELECT conv_id, clause, part, start_ms, least(last_end, last_start + 1100, coalesce(lead(start_ms) OVER (PARTITION BY conv_id ORDER BY start_ms), last_end)) AS end_ms, text FROM chunks""",
    "transcript_metrics": f"""WITH {_GAP_SQL}
        SELECT conv_id, count(*) AS n_words, max(end_ms) AS length_ms, count(*) * 60000 / max(end_ms) AS wpm, median(gap) FILTER (WHERE gap > 0) AS gap_median,
               count(*) FILTER (WHERE gap >= 300) AS long_gaps, max(gap) FILTER (WHERE gap > 0) AS gap_longest,
               count(*) FILTER (WHERE norm IN ({_IN(_SINGLE)})) * 100 / count(*) AS filler_rate, count(*) FILTER (WHERE norm IN ({_IN(T.HYPE)})) AS hype,
               count(*) FILTER (WHERE norm IN ('you', 'your', 'yours')) AS you, count(*) FILTER (WHERE norm IN ('i', 'my', 'me', 'mine')) AS me
        FROM gaps GROUP BY conv_id""",
    "wpm_thirds": f"""WITH {WORDS_SQL}, l AS (SELECT *, max(end_ms) OVER (PARTITION BY conv_id) AS length_ms FROM words)
        SELECT conv_id, CAST(least(start_ms * 3 // length_ms, 2) AS BIGINT) AS third, count(*) AS n_words, count(*) * 180000 / max(length_ms) AS wpm FROM l GROUP BY 1, 2""",
    "pause_stats": f"""WITH {_GAP_SQL}
        SELECT conv_id, count(*) AS n, median(gap) AS median, list_sort(list(gap))[CAST(floor(0.9::DOUBLE * (count(*) - 1)) AS BIGINT) + 1] AS p90 FROM gaps WHERE gap > 0 GROUP BY conv_id""",
    "sentence_lengths": f"WITH {_SENTENCES}, s AS (" + _SPANS_SQL.format("sentence", "sents") + ") SELECT conv_id, count(*) AS n, median(n_words) AS median, min(n_words) AS shortest, max(n_words) AS longest FROM s GROUP BY conv_id",
    "top_ngrams": f"""WITH {WORDS_SQL}, l AS (SELECT conv_id, norm, lead(norm, 1) OVER o AS w1, lead(norm, 2) OVER o AS w2, lead(norm, 3) OVER o AS w3, lead(norm, 4) OVER o AS w4 FROM words WINDOW o AS (PARTITION BY conv_id ORDER BY idx)),
        g AS (SELECT conv_id, norm || ' ' || w1 || ' ' || w2 AS gram FROM l WHERE w2 IS NOT NULL UNION ALL SELECT conv_id, norm || ' ' || w1 || ' ' || w2 || ' ' || w3 FROM l WHERE w3 IS NOT NULL
              UNION ALL SELECT conv_id, norm || ' ' || w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM l WHERE w4 IS NOT NULL),
        c AS (SELECT conv_id, gram, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) >= 2)
        SELECT conv_id, gram, n, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, length(gram) DESC, gram) AS rank FROM c QUALIFY rank <= 12""",
    "doubled_words": f"""WITH {WORDS_SQL}, l AS (SELECT *, lead(norm) OVER (PARTITION BY conv_id ORDER BY idx) AS nxt FROM words WHERE norm NOT IN ({_IN(T.HARD_FILLERS)}))
        SELECT conv_id, idx, norm, start_ms FROM l WHERE norm = nxt""",
    "phrase_locate": f"""WITH {WORDS_SQL}, g AS (SELECT conv_id, idx, start_ms, norm || ' ' || lead(norm, 1) OVER o || ' ' || lead(norm, 2) OVER o AS phrase FROM words WINDOW o AS (PARTITION BY conv_id ORDER BY idx)),
        o AS (SELECT phrase, count(*) AS openers, min(conv_id) AS opener FROM g WHERE idx = 1 AND phrase IS NOT NULL GROUP BY 1) SELECT phrase, openers, opener, conv_id, idx, start_ms FROM g JOIN o USING (phrase) WHERE openers > 1 OR idx > 1""",
    "emphasis_words": f"""WITH {_PHRASES}, d AS (SELECT *, end_ms - start_ms AS ms, count(*) OVER (PARTITION BY conv_id, island) AS n,
            row_number() OVER (PARTITION BY conv_id, island ORDER BY end_ms - start_ms, idx) AS up, row_number() OVER (PARTITION BY conv_id, island ORDER BY end_ms - start_ms DESC, idx) AS down FROM phr),
        m AS (SELECT *, max(CASE WHEN up = n // 2 + 1 THEN ms END) OVER (PARTITION BY conv_id, island) AS middle FROM d)
        SELECT conv_id, CAST(island AS BIGINT) AS phrase, idx, norm FROM m WHERE n >= 3 AND down = 1 AND ms * 10 > middle * 14 AND length(norm) > 3""",
    "keyterms": f"""WITH {_GAP_SQL} SELECT conv_id, norm, count(*) AS n, min(start_ms) AS first_ms FROM gaps
        WHERE regexp_matches(word, '[0-9]') OR (regexp_matches(word, '^[A-Z]') AND after_sentence = false) GROUP BY 1, 2""",
    "first_key_term": f"""WITH {WORDS_SQL}, t AS (SELECT DISTINCT conv_id, unnest({_TOKENS}) AS norm FROM conversations WHERE turn = 0),
        r AS (SELECT conv_id, start_ms, norm AS term, row_number() OVER (PARTITION BY conv_id ORDER BY start_ms, norm) AS k FROM words JOIN t USING (conv_id, norm) WHERE length(norm) > 6)
        SELECT conv_id, start_ms, term FROM r WHERE k = 1""",
    "filler_clusters": f"""WITH {WORDS_SQL}, f AS (SELECT *, start_ms - lag(end_ms) OVER (PARTITION BY conv_id ORDER BY idx) AS gap FROM words WHERE norm IN ({_IN([*_SINGLE, 'the', 'to'])})),
        i AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS cluster FROM f)
        SELECT conv_id, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM i GROUP BY 1, 2 HAVING count(*) >= 2""",
}
