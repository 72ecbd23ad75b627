"""Documents in sections, numbers that are said, fixes that are remembered, and features filled in where they are missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators.fuzzy import TENS, UNITS
from tessella.operators.prefix import at_ranks
from tessella.plans.edits import video_features
from tessella.sources.views import table

#: A line of at most so many characters that doesn't end like a sentence is a heading.
HEADING = 60
#: As many words are fixed everywhere: the most frequent ones of the benchmark of so many letters or more.
FIXES, FIX_LETTERS = 20, 6


def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut at their headings: (doc_id, section from 0, heading (null before the first), lines, items (lines with a bullet or a number in front), words)."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    heading = (F.length("line") > 0) & (F.length("line") <= HEADING) & ~F.col("line").rlike(r"[.!?,;:]\s*$")
    rows = rows.withColumn("is_heading", heading)
    order = W.partitionBy("doc_id").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.sum(F.col("is_heading").cast("long")).over(order))
    body = ~F.col("is_heading") & (F.trim("line") != "")
    found = rows.groupBy("doc_id", "section").agg(
        F.max(F.when(F.col("is_heading"), F.col("line"))).alias("heading"), F.count_if(body).alias("lines"), F.count_if(body & F.col("line").rlike(r"^\s*([-*]|[0-9]+[.)])\s")).alias("items"),
        F.sum(F.when(body, F.size(T.tokens(F.col("line")))).otherwise(0)).alias("words"),
    )
    return found.where("heading is not null or lines > 0")


def numbers_in(words: Column) -> Column:
    """The numbers that an array of words says, in order: digits, number words, and tens with a unit after them as one."""
    value = lambda w: F.coalesce(F.when(w.rlike("^[0-9]{1,18}$"), w.cast("long")), *[F.when(w == name, F.lit(n).cast("long")) for name, n in (UNITS | TENS).items()])
    tens = list(TENS)
    small = [name for name, n in UNITS.items() if 0 < n < 10]

    def said(word: Column, k: Column) -> Column:
        after, before = F.get(words, k + 1), F.get(words, k - 1)
        joined = F.coalesce(word.isin(*tens) & after.isin(*small), F.lit(False))
        taken = F.coalesce(word.isin(*small) & before.isin(*tens) & (k > 0), F.lit(False))
        return F.when(taken, F.lit(None).cast("long")).when(joined, value(word) + value(after)).otherwise(value(word))

    return F.filter(F.transform(words, said), lambda n: n.isNotNull())


def said_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers that each document says: how many, how many different ones, the smallest and the largest; documents without any are left out."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", numbers_in(T.tokens(F.col("text"))).alias("n"))
    return rows.where(F.size("n") > 0).select("doc_id", F.size("n").cast("long").alias("numbers"), F.size(F.array_distinct("n")).cast("long").alias("different"), F.array_min("n").alias("least"), F.array_max("n").alias("most"))


def remembered_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary of FIXES corrections (the benchmark's most frequent long words, each with a mark) applied to the words of documents and conversations: (source, old, new, rows, n) that it changes."""
    said = table(spark, sf_dir, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("old")).where(F.length("old") >= FIX_LETTERS)
    fixes = said.groupBy("old").agg(F.count("*").alias("times")).orderBy(F.desc("times"), "old").limit(FIXES).select("old", F.concat(F.col("old"), F.lit("*")).alias("new"))
    sources = []
    for name, keys in (("documents", ["doc_id"]), ("conversations", ["conv_id", "turn"])):
        rows = table(spark, sf_dir, name).select(F.struct(*keys).alias("row"), F.explode(T.tokens(F.col("text"))).alias("old")).groupBy("row", "old").agg(F.count("*").alias("n"))
        rows = rows.join(F.broadcast(fixes), "old")  # FIXES rows
        sources.append(rows.groupBy(F.lit(name).alias("source"), "old", "new").agg(F.count("*").alias("rows"), F.sum("n").alias("n")))
    return sources[0].unionByName(sources[1])


def filled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos' features, filled in only where they are missing: the kind by the one that most of the creator's videos have (then by name), the length by their lower median; what was measured stays: (video, kind, length, filled)."""
    rows = video_features(spark, sf_dir)
    kinds = rows.where("kind is not null").groupBy("creator", "kind").agg(F.count("*").alias("n")).groupBy("creator").agg(F.min(F.struct((-F.col("n")).alias("n"), "kind"))["kind"].alias("usual_kind"))
    lengths = at_ranks(rows, ["creator"], "length", 100, {"usual_length": F.floor((F.col("n") - 1) / 2)})
    rows = rows.join(kinds, "creator", "left").join(lengths, "creator", "left")
    filled = (F.col("kind").isNull() & F.col("usual_kind").isNotNull()).cast("int") + (F.col("length").isNull() & F.col("usual_length").isNotNull()).cast("int")
    return rows.select("video", F.coalesce("kind", "usual_kind").alias("kind"), F.coalesce("length", "usual_length").alias("length"), filled.alias("filled"))


QUERIES = {q.__name__: q for q in (document_sections, said_numbers, remembered_fixes, filled_features)}


def _oracle() -> dict[str, str]:
    from tessella.plans.texts import _tokens_sql

    value = "CASE WHEN regexp_matches(w[k], '^[0-9]{1,18}$') THEN CAST(w[k] AS BIGINT) " + " ".join(f"WHEN w[k] = '{name}' THEN {n}" for name, n in (UNITS | TENS).items()) + " END"
    tens, small = (", ".join(f"'{x}'" for x in names) for names in (list(TENS), [name for name, n in UNITS.items() if 0 < n < 10]))
    said = f"CASE WHEN w[k] IN ({small}) AND k > 1 AND w[k - 1] IN ({tens}) THEN NULL WHEN w[k] IN ({tens}) AND k < len(w) AND w[k + 1] IN ({small}) THEN ({value}) + ({value.replace('w[k]', 'w[k + 1]')}) ELSE {value} END"
    return {
        "document_sections": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents WHERE text IS NOT NULL),
            h AS (SELECT *, length(line) > 0 AND length(line) <= {HEADING} AND NOT regexp_matches(line, '[.!?,;:]\\s*$') AS is_heading FROM l), s AS (SELECT *, CAST(sum(CAST(is_heading AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY place) AS BIGINT) AS section, NOT is_heading AND trim(line) <> '' AS body FROM h),
            g AS (SELECT doc_id, section, max(CASE WHEN is_heading THEN line END) AS heading, count(*) FILTER (WHERE body) AS lines, count(*) FILTER (WHERE body AND regexp_matches(line, '^\\s*([-*]|[0-9]+[.)])\\s')) AS items, CAST(sum(CASE WHEN body THEN len({_tokens_sql('line')}) ELSE 0 END) AS BIGINT) AS words FROM s GROUP BY 1, 2)
            SELECT * FROM g WHERE heading IS NOT NULL OR lines > 0""",
        "said_numbers": f"""WITH d AS (SELECT doc_id, {_tokens_sql('text')} AS w FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, list_filter(list_transform(range(1, len(w) + 1), lambda k: {said}), lambda x: x IS NOT NULL) AS n FROM d)
            SELECT doc_id, CAST(len(n) AS BIGINT) AS numbers, CAST(len(list_distinct(n)) AS BIGINT) AS different, list_min(n) AS least, list_max(n) AS most FROM n WHERE len(n) > 0""",
        "remembered_fixes": f"""WITH b AS (SELECT unnest({_tokens_sql('text')}) AS old FROM benchmark), f AS (SELECT old, old || '*' AS new FROM b WHERE length(old) >= {FIX_LETTERS} GROUP BY old ORDER BY count(*) DESC, old LIMIT {FIXES}),
            w AS (SELECT 'documents' AS source, doc_id AS a, 0 AS b, unnest({_tokens_sql('text')}) AS old FROM documents UNION ALL SELECT 'conversations', conv_id, turn, unnest({_tokens_sql('text')}) FROM conversations),
            g AS (SELECT source, a, b, old, count(*) AS n FROM w GROUP BY ALL) SELECT source, old, new, count(*) AS rows, CAST(sum(n) AS BIGINT) AS n FROM g JOIN f USING (old) GROUP BY 1, 2, 3""",
        "filled_features": """WITH c AS (SELECT l_orderkey AS video, CAST(sum(floor(l_quantity)) AS BIGINT) AS length FROM lineitem GROUP BY 1),
            v AS (SELECT o_custkey AS creator, o_orderkey AS video, nullif(o_orderstatus, 'P') AS kind, CASE WHEN o_orderkey % 9 <> 0 THEN length END AS length FROM orders LEFT JOIN c ON c.video = o_orderkey),
            k AS (SELECT creator, kind AS usual_kind FROM v WHERE kind IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY creator ORDER BY count(*) DESC, kind) = 1),
            m AS (SELECT creator, list_sort(list(length))[(count(*) - 1) // 2 + 1] AS usual_length FROM v WHERE length IS NOT NULL GROUP BY 1)
            SELECT video, coalesce(kind, usual_kind) AS kind, coalesce(length, usual_length) AS length, CAST(kind IS NULL AND usual_kind IS NOT NULL AS INT) + CAST(length IS NULL AND usual_length IS NOT NULL AS INT) AS filled FROM v LEFT JOIN k USING (creator) LEFT JOIN m USING (creator)""",
    }


ORACLE_SQL = _oracle()
