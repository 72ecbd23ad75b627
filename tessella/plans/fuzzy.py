"""Similar wording, and choices that depend on order."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import fuzzy, sequential
from tessella.operators.alignment import aligned
from tessella.operators.intervals import with_period
from tessella.operators.islands import islands
from tessella.plans.texts import grams, line_grams
from tessella.plans.words import PHRASE_GAP_MS, sentence_spans
from tessella.sources.views import SPANS_SQL, spans, table, words

#: A clause opens with so many words; one so long ago may be begun again.
OPENING, RESTART_MS = 6, 40_000


def clause_openings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Words with what is said (tokens without hesitations), and clauses with their first OPENING of these; here a clause also ends after a dash."""
    rows = words(spark, sf_dir).withColumn("tokens", T.tokens(F.col("word"))).withColumn("said", F.filter("tokens", lambda w: ~w.isin(*T.HARD_FILLERS)))
    ends = F.col("ends_clause") | F.col("word").rlike("-$") | ((F.size("tokens") > 0) & (F.size("said") == 0))
    w = W.partitionBy("conv_id").orderBy("idx")
    rows = rows.withColumn("ended", F.lag(ends).over(w)).withColumn("gap", F.col("start_ms") - F.lag("end_ms").over(w))
    rows = islands(rows, ["conv_id"], ["idx"], (F.col("gap") >= PHRASE_GAP_MS) | F.col("ended"), "clause").select("conv_id", "idx", "start_ms", "said", "clause")
    own = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("idx", "said"))), lambda x: x["said"]))
    return rows, rows.groupBy("conv_id", "clause").agg(F.min("idx").alias("idx"), F.min("start_ms").alias("start_ms"), F.slice(own, 1, OPENING).alias("opening"))


def _chosen(found: Iterator[Any]) -> Iterator[tuple]:
    """Clauses begun again, as they come, then the repeated words that these leave."""
    taken, spans, key = set(), [], None
    for row in found:
        key = row.conv_id
        if row.k:
            spans.append((row.n, row.k, row.before, row.again))
        else:
            taken.update(range(row.before, row.again))
            yield key, row.before, row.again, "clause"
    for before, again in fuzzy.first_free(spans, taken):
        yield key, before, again, "words"


def restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is begun again, from word `before` on at word `again`: clauses that open like an earlier one within 40 s (the nearest such one), and words said twice in a row."""
    rows, clauses = clause_openings(spark, sf_dir)
    nearest = fuzzy.nearest_alike(clauses.where(F.size("opening") >= 2), "conv_id", "start_ms", "idx", RESTART_MS)
    said = rows.select("conv_id", "idx", F.posexplode("said").alias("nth", "word"))
    order = W.partitionBy("conv_id").orderBy("idx", "nth")
    said = said.select("conv_id", F.row_number().over(order).cast("long").alias("place"), "word", F.collect_list("idx").over(order.rowsBetween(1 - fuzzy.LOOK_BACK, -1)).alias("at"), "idx")
    found = fuzzy.repeats(said, "conv_id").select("conv_id", "n", "k", F.element_at("at", (F.col("m") - F.col("n")).cast("int")).alias("before"), F.col("idx").alias("again"))
    none = F.lit(0).cast("long")
    found = nearest.select("conv_id", none.alias("n"), none.alias("k"), "before", "again").unionByName(found)
    kind = rows.schema["conv_id"].dataType.simpleString()
    return sequential.streamed(found, ["conv_id"], ["k", "n", "again"], _chosen, f"conv_id {kind}, before long, again long, kind string")


def script_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark lines and the documents that say most of their 5-word runs: the share said."""
    lines, docs = line_grams(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id", 5)
    lines = lines.drop("place").distinct()
    size = lines.groupBy("item_id").agg(F.count("*").alias("size"))
    hits = docs.drop("place").join(lines, "gram").distinct().groupBy("item_id", "doc_id").agg(F.count("*").alias("hits")).join(size, "item_id")
    return hits.where("hits * 2 >= size").select("item_id", "doc_id", "hits", (F.col("hits") / F.col("size")).alias("share"))


def fuzzy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names of a brand in groups around leaders that they are at least 0.6 like, by key."""
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name")
    found = fuzzy.leaders(rows, "p_brand", ["p_partkey"], 0.6, "p_name")
    return found.groupBy("p_brand", "leader").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


def similar_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of benchmark lines with two words in a row in common and a ratio of words of 0.1 or more."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.col("text")).alias("w"))
    own = grams(table(spark, sf_dir, "benchmark"), "item_id", 2).distinct()
    pairs = own.join(own.withColumnRenamed("item_id", "other"), "gram").where("item_id < other").select("item_id", "other").distinct()
    pairs = pairs.join(rows, "item_id").join(rows.select(F.col("item_id").alias("other"), F.col("w").alias("v")), "other")
    return pairs.select("item_id", "other", fuzzy.word_ratio(F.col("w"), F.col("v")).alias("ratio")).where("ratio >= 0.1")


def numbers_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number words of the conversations' turns as digits: how many words are left."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("w"))
    return rows.select("conv_id", "turn", F.size("w").cast("long").alias("n_words"), F.size(fuzzy.numbers_folded(F.col("w"))).cast("long").alias("n_folded"))


def names_said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with a capital inside a sentence that are never said in lower case, by conversation."""
    w = W.partitionBy("conv_id").orderBy("idx")
    rows = words(spark, sf_dir).withColumn("first", F.coalesce(F.lag("ends_sentence").over(w), F.lit(True)))
    named = rows.where(F.col("word").rlike("^[A-Z][a-z]") & ~F.col("first")).groupBy("conv_id", "norm").agg(F.count("*").alias("n"), F.min("start_ms").alias("first_ms"))
    lower = rows.where(F.col("word").rlike("^[a-z]")).select("conv_id", "norm").distinct()
    return named.join(lower, ["conv_id", "norm"], "left_anti")


def greedy_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks of a user at least two days apart, chosen from the first on."""
    rows = spans(spark, sf_dir).where("kind = 'click'").select("user_id", "id", "b")
    return sequential.spaced(rows, ["user_id"], "b", "id", 172_800_000_000).where("kept").select("user_id", "id", "b")


def interval_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a kind on as few lanes as they need.  All lanes are free where a busy period begins, so periods are dealt out by themselves."""
    rows = with_period(spans(spark, sf_dir).select("kind", "id", "b", "e"), ["kind"])
    return sequential.lanes(rows, ["kind", "period"], "id").select("kind", "id", "lane")


def clip_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's eight longest spans (on a tie the earliest) that don't overlap a longer one of the list."""
    rows = spans(spark, sf_dir).select("user_id", "id", "b", "e", (F.col("e") - F.col("b")).alias("score"))
    return sequential.shortlist(rows, ["user_id"], "score", ["b", "id"], 8).where("kept").select("user_id", "id", "b", "e")


def deal_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences dealt to three kinds by 55, 40 and 5 percent."""
    rows = sentence_spans(spark, sf_dir).select("conv_id", "sentence")
    return sequential.dealt(rows, ["conv_id"], ["sentence"], {"card": 55, "shot": 40, "chart": 5}).groupBy("conv_id", "dealt").agg(F.count("*").alias("n"))


def value_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's values cut where one departs by over 60 from the running median."""
    rows = table(spark, sf_dir, "events").where("value is not null").select("user_id", "event_id", "value")
    found = sequential.segments(rows, ["user_id"], ["event_id"], "value", 60.0)
    return found.groupBy("user_id").agg((F.max("segment") + 1).alias("segments"))


def _hearings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Canonical words (conv_id, idx, word, key, b, e), and those of a second hearing: every 11th heard otherwise (every 22nd cut short), every 17th missed, one more after every 23rd."""
    rows = words(spark, sf_dir).select("conv_id", "idx", F.col("norm").alias("key"), F.col("start_ms").alias("b"), F.col("end_ms").alias("e"))
    key = F.when((F.col("idx") % 22 == 0) & (F.length("key") > 1), F.expr("substring(key, 1, length(key) div 2)")).when(F.col("idx") % 11 == 0, F.concat("key", F.lit("x"))).otherwise(F.col("key"))
    other = rows.where("idx % 17 != 0").withColumn("key", key)
    more = rows.where("idx % 23 = 0").select("conv_id", "idx", F.lit("well").alias("key"), F.col("e").alias("b"), F.col("e").alias("e"))
    other = other.unionByName(more).withColumn("idx", F.row_number().over(W.partitionBy("conv_id").orderBy("b", "e", "idx")).cast("long"))
    return fuzzy.canonical_rows(rows, "conv_id"), fuzzy.canonical_rows(other, "conv_id")


def heard_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words against a second hearing of them, lined up by what they say (numbers as digits, contractions spoken out): (conv_id, what, left, right), the words' numbers."""
    rows, other = _hearings(spark, sf_dir)
    found = aligned(rows, other, "conv_id", keep=["word"])
    return found.select("conv_id", "what", F.col("left_word").alias("left"), F.col("right_word").alias("right"))


def verified_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of words in the second hearing, by the kind of difference, with how many and the first: a hesitation on either side, a fragment (one is the start of the other), spelling
    (at most a fifth of the letters edited), heard otherwise, missing, or more."""
    rows, other = _hearings(spark, sf_dir)
    found = aligned(rows, other, "conv_id", keep=["word", "key"]).where("what != 'same'")
    return found.withColumn("kind", difference(F.col("what"), F.col("left_key"), F.col("right_key"))).groupBy("conv_id", "kind").agg(F.count("*").alias("n"), F.min("left_word").alias("first"))


def difference(what: Column, was: Column, now: Column) -> Column:
    """The kind of a difference between a word and how it was heard again."""
    hesitation = F.coalesce(was.isin(*T.HARD_FILLERS), F.lit(False)) | F.coalesce(now.isin(*T.HARD_FILLERS), F.lit(False))
    differ = F.when(was.startswith(now) | now.startswith(was), F.when(F.abs(F.length(was) - F.length(now)) == 1, "spelling").otherwise("fragment"))
    differ = differ.when(F.levenshtein(was, now) * 5 <= F.greatest(F.length(was), F.length(now)), "spelling").otherwise("heard otherwise")
    return F.when(hesitation, "hesitation").when(what == "gone", "missing").when(what == "new", "more").otherwise(differ)


QUERIES = {q.__name__: q for q in (restarts, script_match, fuzzy_groups, similar_lines, numbers_folded, names_said, greedy_spacing, interval_lanes, clip_shortlist, deal_shares, value_segments, heard_again, verified_words)}

_GRAMS = "list_transform(range(1, greatest(length(w) - 3, 1)), lambda k: array_to_string(w[k:k + 4], ' '))"


def _oracle() -> dict[str, str]:
    from tessella.plans.texts import _tokens_sql
    from tessella.plans.words import _GAP_SQL, ORACLE_SQL as words_sql

    return {
        "script_match": f"""WITH b AS (SELECT item_id, {_tokens_sql('text')} AS w FROM benchmark), d AS (SELECT doc_id, {_tokens_sql('text')} AS w FROM documents),
            l AS (SELECT DISTINCT item_id, unnest({_GRAMS}) AS gram FROM b), s AS (SELECT item_id, count(*) AS size FROM l GROUP BY 1), g AS (SELECT DISTINCT doc_id, unnest({_GRAMS}) AS gram FROM d),
            h AS (SELECT item_id, doc_id, count(*) AS hits FROM g JOIN l USING (gram) GROUP BY 1, 2) SELECT item_id, doc_id, hits, hits / size AS share FROM h JOIN s USING (item_id) WHERE hits * 2 >= size""",
        "names_said": f"""WITH {_GAP_SQL}, n AS (SELECT conv_id, norm, count(*) AS n, min(start_ms) AS first_ms FROM gaps WHERE regexp_matches(word, '^[A-Z][a-z]') AND NOT coalesce(after_sentence, true) GROUP BY 1, 2)
            SELECT * FROM n ANTI JOIN (SELECT conv_id, norm FROM gaps WHERE regexp_matches(word, '^[a-z]')) USING (conv_id, norm)""",
        "clip_shortlist": f"""WITH RECURSIVE {SPANS_SQL}, n AS (SELECT user_id, id, b, e, row_number() OVER (PARTITION BY user_id ORDER BY e - b DESC, b, id) AS k FROM spans),
            r AS (SELECT user_id, 1 AS k, [{{'id': id, 'b': b, 'e': e}}] AS chosen FROM n WHERE k = 1
                  UNION ALL SELECT r.user_id, n.k, CASE WHEN len(chosen) < 8 AND len(list_filter(chosen, lambda x: x.b < n.e AND n.b < x.e)) = 0 THEN list_append(chosen, {{'id': n.id, 'b': n.b, 'e': n.e}}) ELSE chosen END
                  FROM r JOIN n ON n.user_id = r.user_id AND n.k = r.k + 1),
            f AS (SELECT user_id, unnest(chosen) AS c FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1) SELECT user_id, c.id AS id, c.b AS b, c.e AS e FROM f""",
        "deal_shares": f"""WITH RECURSIVE s AS ({words_sql['sentence_spans']}), p AS (SELECT 0 AS n, CAST(NULL AS VARCHAR) AS pick, 0 AS cards, 0 AS shots, 0 AS charts
                  UNION ALL SELECT n + 1, k, cards + CAST(k = 'card' AS INT), shots + CAST(k = 'shot' AS INT), charts + CAST(k = 'chart' AS INT)
                  FROM (SELECT *, CASE WHEN 55 * (n + 1) - 100 * cards >= greatest(40 * (n + 1) - 100 * shots, 5 * (n + 1) - 100 * charts) THEN 'card' WHEN 40 * (n + 1) - 100 * shots >= 5 * (n + 1) - 100 * charts THEN 'shot' ELSE 'chart' END AS k FROM p WHERE n < 100)),
            d AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY sentence) - 1) % 100 + 1 AS n FROM s)
            SELECT conv_id, pick AS dealt, count(*) AS n FROM d JOIN p USING (n) GROUP BY 1, 2""",
        "value_segments": """WITH RECURSIVE v AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE value IS NOT NULL),
            r AS (SELECT user_id, k, 0 AS nr, [value] AS recent FROM v WHERE k = 1
                  UNION ALL SELECT user_id, k, nr + CAST(jump AS INT), CASE WHEN jump THEN [value] ELSE list_append(recent, value)[-15:] END
                  FROM (SELECT v.user_id, v.k, r.nr, v.value, r.recent, abs(v.value - list_sort(r.recent)[len(r.recent) // 2 + 1]) > 60 AS jump FROM r JOIN v ON v.user_id = r.user_id AND v.k = r.k + 1))
            SELECT user_id, CAST(max(nr) + 1 AS BIGINT) AS segments FROM r GROUP BY user_id""",
        "interval_lanes": f"""WITH RECURSIVE {SPANS_SQL}, v AS (SELECT kind, id, b, e, row_number() OVER (PARTITION BY kind ORDER BY b, id) AS k FROM spans),
            r AS (SELECT kind, id, k, 1 AS spot, [e] AS ends FROM v WHERE k = 1
                  UNION ALL SELECT kind, id, k, CASE WHEN free > 0 THEN free ELSE len(ends) + 1 END,
                    CASE WHEN free > 0 THEN list_concat(list_append(ends[:free - 1], e), ends[free + 1:]) ELSE list_append(ends, e) END
                  FROM (SELECT v.*, r.ends, coalesce(list_position(list_transform(r.ends, lambda x: x <= v.b), true), 0) AS free FROM r JOIN v ON v.kind = r.kind AND v.k = r.k + 1))
            SELECT kind, id, CAST(spot - 1 AS BIGINT) AS lane FROM r""",
        "greedy_spacing": f"""WITH RECURSIVE {SPANS_SQL}, c AS (SELECT user_id, id, b FROM spans WHERE kind = 'click'),
            r AS (SELECT user_id, id, b FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY b, id) = 1
                  UNION ALL SELECT user_id, id, b FROM (SELECT c.user_id, c.id, c.b, row_number() OVER (PARTITION BY c.user_id ORDER BY c.b, c.id) AS k FROM r JOIN c ON c.user_id = r.user_id AND c.b - r.b >= 172800000000) WHERE k = 1)
            SELECT * FROM r""",
    }


ORACLE_SQL = _oracle()
