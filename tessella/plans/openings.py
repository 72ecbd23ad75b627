"""Alternate openings, the opening that stays, and everything of a recording that a cut may take, in one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import openings
from tessella.operators.asof import asof
from tessella.plans.fuzzy import RESTART_MS, clause_openings, restarts
from tessella.plans.words import BY, _gap
from tessella.sources.views import words

#: An alternate opening has at most so many words; a take that stays is compared over so many more.
LONGEST, MORE = 30, 10
#: Kinds of candidates, the weightiest first: what meets one of an earlier kind isn't one itself.
KINDS = ("opening", "restart", "double", "filler", "loose")
LOOSE = ("like", "so", "well", "right")
#: Fixed values, as these words join what comes next without meaning it: a loose word after one stands by itself.
JOINING = ("and", "so", "but", "or", "was", "were")
#: A word is set off by so long a pause, in ms.
PAUSE = 300


def alternate_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Takes of a conversation's opening at its end: (conv_id, idx, last), by words."""
    rows, clauses = clause_openings(spark, sf_dir)
    sizes = rows.groupBy("conv_id").agg(F.max("idx").alias("n"))
    return openings.alternates(openings.first_openings(clauses, "conv_id"), "conv_id", sizes, RESTART_MS, LONGEST)


def kept_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each alternate opening: the take of the opening that the cut keeps (the last within 40 s), and how far the two go alike, each to the end of its clause: (conv_id, idx, kept, kept_last, last)."""
    rows, clauses = clause_openings(spark, sf_dir)
    found = openings.first_openings(clauses, "conv_id")
    sizes = rows.groupBy("conv_id").agg(F.max("idx").alias("n"))
    kept = found.where(F.col("alike") & (F.col("start_ms") - F.col("at") <= RESTART_MS)).groupBy("conv_id").agg(F.max("idx").alias("kept"))
    takes = openings.alternates(found, "conv_id", sizes, RESTART_MS, LONGEST).join(kept, "conv_id")
    said = rows.select("conv_id", "idx", F.posexplode("said").alias("nth", "word"))
    own = takes.join(said.withColumnRenamed("idx", "w"), "conv_id")
    near = (F.col("w") >= F.col("kept")) & (F.col("w") < F.least(F.col("idx"), F.col("kept") + 2 * (LONGEST + MORE)))
    take = F.col("w").between(F.col("idx"), F.col("last"))
    own = own.where(near | take).groupBy("conv_id", "idx", "kept", "last").agg(
        F.slice(F.array_sort(F.collect_list(F.when(near, F.struct(F.col("w").alias("idx"), "nth", "word")))), 1, LONGEST + MORE).alias("x"),
        F.array_sort(F.collect_list(F.when(take & ~near, F.struct(F.col("w").alias("idx"), "nth", "word")))).alias("y"),
    )
    alike = openings.ends_alike(F.transform("x", lambda s: s["word"]), F.transform("y", lambda s: s["word"]))
    own = own.withColumn("ends", alike)
    last = lambda words_, n, otherwise: F.coalesce(F.get(words_, n - 1)["idx"], otherwise)
    own = own.withColumn("x_last", last(F.col("x"), F.col("ends")[0], F.col("kept"))).withColumn("y_last", last(F.col("y"), F.col("ends")[1], F.col("idx")))
    bounds = clauses.select("conv_id", F.col("idx").alias("begins"))
    order = W.partitionBy("conv_id").orderBy("begins")
    bounds = bounds.join(sizes, "conv_id").withColumn("ends_at", F.coalesce(F.lead("begins").over(order), F.col("n") + 1) - 1).select("conv_id", "begins", "ends_at")
    own = asof(own.select("conv_id", "idx", "kept", "last", "x_last", "y_last"), bounds, ["conv_id"], "x_last", "begins", "ends_at").withColumn("kept_last", F.col("found.ends_at")).drop("found")
    own = asof(own, bounds, ["conv_id"], "y_last", "begins", "ends_at")
    return own.select("conv_id", "idx", "kept", F.least("kept_last", F.col("idx") - 1).alias("kept_last"), F.least(F.col("found.ends_at"), "last").alias("last"))


def loose_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words like "like" where they stand by themselves: first in a clause, before a comma, after a joining word, or beside a pause."""
    order = W.partitionBy(*BY).orderBy("idx")
    rows = _gap(words(spark, sf_dir)).withColumn("before", F.lag("norm").over(order)).withColumn("next_gap", F.lead("gap").over(order))
    alone = F.col("before").isNull() | F.col("after_clause") | F.col("word").endswith(",") | (F.col("gap") >= PAUSE) | F.coalesce(F.col("next_gap") >= PAUSE, F.lit(False)) | F.col("before").isin(*JOINING, *T.HARD_FILLERS)
    return rows.where(F.col("norm").isin(*LOOSE) & alone).select("conv_id", "idx")


def cut_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a cut may take, by words: (conv_id, kind, first, last, check); check: somebody has to look.  What meets a weightier kind is part of that, and nothing is judged within alternate openings."""
    rows = words(spark, sf_dir)
    double = rows.withColumn("before", F.lag("norm").over(W.partitionBy(*BY).orderBy("idx"))).where("norm = before")
    found = {
        "opening": alternate_openings(spark, sf_dir).select("conv_id", F.col("idx").alias("first"), "last"),
        "restart": restarts(spark, sf_dir).groupBy("conv_id", F.col("before").alias("first")).agg((F.max("again") - 1).alias("last")),
        "double": double.select("conv_id", (F.col("idx") - 1).alias("first"), (F.col("idx") - 1).alias("last")),
        "filler": rows.where(F.col("norm").isin(*T.HARD_FILLERS)).select("conv_id", F.col("idx").alias("first"), F.col("idx").alias("last")),
        "loose": loose_words(spark, sf_dir).select("conv_id", F.col("idx").alias("first"), F.col("idx").alias("last")),
    }
    every = None
    for rank, kind in enumerate(KINDS):
        own = found[kind].select("conv_id", F.col("first").cast("long").alias("b"), (F.col("last") + 1).cast("long").alias("e"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"))
        every = own if every is None else every.unionByName(own)
    kept = openings.without_lesser(every, "conv_id", 50)
    return kept.select("conv_id", "kind", F.col("b").alias("first"), (F.col("e") - 1).alias("last"), F.col("kind").isin("restart", "double", "loose").alias("check"))


QUERIES = {q.__name__: q for q in (alternate_openings, kept_opening, loose_words, cut_candidates)}


def _oracle() -> dict[str, str]:
    from tessella.plans.words import _GAP_SQL

    joined = ", ".join(f"'{w}'" for w in (*JOINING, *T.HARD_FILLERS))
    return {
        "loose_words": f"""WITH {_GAP_SQL}, b AS (SELECT *, lag(norm) OVER o AS before, lead(gap) OVER o AS next_gap FROM gaps WINDOW o AS (PARTITION BY conv_id ORDER BY idx))
            SELECT conv_id, idx FROM b WHERE norm IN ({', '.join(f"'{w}'" for w in LOOSE)}) AND (before IS NULL OR after_clause OR word LIKE '%,' OR gap >= {PAUSE} OR coalesce(next_gap >= {PAUSE}, false) OR before IN ({joined}))""",
    }


ORACLE_SQL = _oracle()
