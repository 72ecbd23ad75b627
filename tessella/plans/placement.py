"""Placement under rules about neighbours: zooms, cues, cards and their entrances, each plan over a whole conversation or user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators import intervals, placement, sequential
from tessella.plans.words import sentence_spans
from tessella.sources.views import SPANS_SQL, spans, words

#: Zooms a minute, the least time between two (80% of the mean), the longest hold without one, and how far inside a hold a cut stays; in ms.
PER_MINUTE, GAP, HOLD, MARGIN = 5, 9_600, 13_000, 1_000
#: Sentences of so many words or more are zoomed on first.
LONG_SENTENCE = 8
MINUTE = 60_000_000
#: Cues by what happens, the loudest first; in minutes, how far apart two cues are, and for how long one is allowed.
CUES, CUE_GAP, CUE_EVERY = {"purchase": "hit", "click": "whoosh", "view": "zoom", "signup": "pop"}, 360, 2_160
#: The least time that a card is shown, in minutes.
SHOWN = 240
#: A card's entrance: it lasts from so long before its start, and so long after it; a move takes TRAVEL; a zoom shorter than BRIEF goes.
BEFORE, AFTER, TRAVEL, BRIEF = 15, 75, 16, 50


def place_zooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zoom changes: on long sentences at least GAP apart, then on sentence starts until there are PER_MINUTE a minute, then on the word nearest the middle of each hold over HOLD until none can be cut; in and out by turns."""
    sentences = sentence_spans(spark, sf_dir).select("conv_id", F.col("start_ms").alias("at"), "n_words", "end_ms")
    long = sentences.where(F.col("n_words") >= LONG_SENTENCE).select("conv_id", "at")
    base = sequential.spaced(long, ["conv_id"], "at", "at", GAP).where("kept").select("conv_id", "at")
    ends = sentences.groupBy("conv_id").agg(F.max("end_ms").alias("end"))
    wanted = ends.select("conv_id", F.expr(f"(2 * {PER_MINUTE} * end + 60000) div 120000").alias("n"))
    picks = placement.filled(base, sentences.select("conv_id", "at"), ["conv_id"], wanted, GAP)
    picks = placement.without_long_holds(picks, words(spark, sf_dir).select("conv_id", F.col("start_ms").alias("at")), ends, ["conv_id"], HOLD, MARGIN)
    order = W.partitionBy("conv_id").orderBy("at")
    picks = picks.join(ends, "conv_id").withColumn("nr", F.row_number().over(order).cast("long")).withColumn("until", F.coalesce(F.lead("at").over(order), "end"))
    return picks.select("conv_id", "nr", "at", "until", F.when(F.col("nr") % 2 == 1, "in").otherwise("out").alias("way"))


def sound_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's cues, the loudest kinds first and the earliest of a kind, CUE_GAP apart, one for each CUE_EVERY of the user's time; then none like the one before it."""
    rows = spans(spark, sf_dir).where(F.col("kind").isin(*CUES)).withColumn("at", F.expr(f"b div {MINUTE}"))
    rank = F.coalesce(*[F.when(F.col("kind") == kind, F.lit(k)) for k, kind in enumerate(CUES)])
    cue = F.coalesce(*[F.when(F.col("kind") == kind, F.lit(name)) for kind, name in CUES.items()])
    rows = rows.select("user_id", "id", "at", rank.alias("rank"), cue.alias("cue"))
    budget = rows.groupBy("user_id").agg(F.greatest(F.lit(1), F.expr(f"(max(at) - min(at)) div {CUE_EVERY}")).alias("budget"))
    chosen = placement.budgeted(rows.join(budget, "user_id"), ["user_id"], ["rank", "at", "id"], "at", "budget", CUE_GAP).where("kept")
    return placement.without_repeats(chosen, ["user_id"], ["at", "id"], "cue").select("user_id", "id", "at", "cue")


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as cards: user_id, id, b, e in minutes; a click's value is its time on screen."""
    rows = spans(spark, sf_dir).where("kind = 'click'")
    return rows.select("user_id", "id", F.expr(f"b div {MINUTE}").alias("b"), F.expr(f"b div {MINUTE} + (e - b) div 1000000").alias("e"))


def cards_long_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards shown for SHOWN minutes at least, by time from around them and from their neighbours; those without room go."""
    cards = _cards(spark, sf_dir)
    ends = cards.groupBy("user_id").agg((F.max("b") + 60).alias("end"))
    return placement.shown_long_enough(cards.join(ends, "user_id"), ["user_id"], "id", SHOWN, "end")


def _entrances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as cards with entrances: user_id, nr, b, e, to; every third is a full scene, under whose middle a change can hide."""
    rows = spans(spark, sf_dir).where("kind = 'purchase'").withColumn("start", F.expr(f"b div {MINUTE}"))
    scene = F.col("id") % 3 == 0
    begin = F.col("start") - BEFORE - TRAVEL
    return rows.select("user_id", F.col("id").alias("nr"), begin.alias("b"), (F.col("start") + AFTER).alias("e"), F.when(scene, F.col("start") + 100).otherwise(begin).alias("to"), scene.alias("scene"), (F.col("start") + 200).alias("ends"))


def clear_entrances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as zooms whose ends stay out of entrances: an end inside one moves to its begin, or to a scene's middle, and on from there;
    a zoom that is BRIEF then begins when the scene that it began under has left (else it goes), and zooms closer than TRAVEL are one."""
    rows = spans(spark, sf_dir).where("kind = 'view'")
    zooms = rows.select("user_id", "id", F.expr(f"b div {MINUTE}").alias("b"), F.expr(f"b div {MINUTE} + 20 + (e - b) div 1000000").alias("e"))
    cards = _entrances(spark, sf_dir)
    points = zooms.select("user_id", F.explode(F.array(F.struct((F.col("id") * 2).alias("point"), F.col("b").alias("at")), F.struct((F.col("id") * 2 + 1).alias("point"), F.col("e").alias("at")))).alias("x")).select("user_id", "x.point", "x.at")
    moved = placement.moved_out(points, cards, ["user_id"], "point")
    side: Column = F.col("point") % 2
    ends = moved.groupBy("user_id", F.expr("point div 2").alias("id")).agg(F.max(F.when(side == 0, F.col("to"))).alias("b"), F.max(F.when(side == 1, F.col("to"))).alias("e"), F.max(F.when(side == 0, F.col("at"))).alias("was"), (F.max("at") - F.min("at")).alias("long"))
    brief = ends.where(F.col("e") - F.col("b") < BRIEF).select("user_id", "id", F.col("was").alias("b"), (F.col("was") + 1).alias("e"), "long")
    scenes = cards.where("scene").select("user_id", F.col("nr").alias("scene"), (F.col("b") + 1).alias("b"), F.col("ends").alias("e"))
    under = intervals.overlap_join(brief, scenes, ["user_id"], 300).groupBy("user_id", "id").agg(F.min(F.struct("rb", "scene", (F.col("re") + AFTER).alias("b"), (F.col("re") + AFTER + F.col("long")).alias("e"))).alias("x"))
    kept = ends.where(F.col("e") - F.col("b") >= BRIEF).select("user_id", "b", "e").unionByName(under.select("user_id", "x.b", "x.e"))
    return intervals.union(kept, ["user_id"], TRAVEL - 1, 10_000).select("user_id", "b", "e", "n")


QUERIES = {q.__name__: q for q in (place_zooms, sound_cues, cards_long_enough, clear_entrances)}


def _oracle() -> dict[str, str]:
    from tessella.plans.words import ORACLE_SQL as words_sql
    from tessella.sources.views import WORDS_SQL

    kinds, ranks = (" ".join(f"WHEN '{kind}' THEN {value}" for kind, value in x) for x in ([(k, f"'{v}'") for k, v in CUES.items()], [(k, n) for n, k in enumerate(CUES)]))
    return {
        "place_zooms": f"""WITH RECURSIVE s AS ({words_sql['sentence_spans']}), {WORDS_SQL.strip()},
            d AS (SELECT conv_id, max(end_ms) AS ends FROM s GROUP BY 1), l AS (SELECT conv_id, start_ms AS t FROM s WHERE n_words >= {LONG_SENTENCE}),
            base AS (SELECT conv_id, t FROM l QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY t) = 1
                     UNION ALL SELECT conv_id, t FROM (SELECT l.conv_id, l.t, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.t) AS k FROM base JOIN l ON l.conv_id = base.conv_id AND l.t - base.t >= {GAP}) WHERE k = 1),
            have AS (SELECT conv_id, count(*) AS n FROM base GROUP BY 1), room AS (SELECT conv_id, (2 * {PER_MINUTE} * ends + 60000) // 120000 - coalesce(n, 0) AS room FROM d LEFT JOIN have USING (conv_id)),
            free AS (SELECT s.conv_id, s.start_ms AS t, room, row_number() OVER (PARTITION BY s.conv_id ORDER BY s.start_ms) AS k FROM s JOIN room ON room.conv_id = s.conv_id AND room > 0
                     WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.conv_id = s.conv_id AND abs(base.t - s.start_ms) < {GAP})),
            f AS (SELECT conv_id, k, t, room - 1 AS room, t AS last, true AS kept FROM free WHERE k = 1
                  UNION ALL SELECT n.conv_id, n.k, n.t, f.room - CAST(f.room > 0 AND n.t - f.last >= {GAP} AS BIGINT), CASE WHEN f.room > 0 AND n.t - f.last >= {GAP} THEN n.t ELSE f.last END, f.room > 0 AND n.t - f.last >= {GAP}
                  FROM f JOIN free n ON n.conv_id = f.conv_id AND n.k = f.k + 1),
            p AS (SELECT conv_id, t FROM base UNION ALL SELECT conv_id, t FROM f WHERE kept),
            h AS (SELECT conv_id, t AS b, coalesce(lead(t) OVER (PARTITION BY conv_id ORDER BY t), ends) AS e FROM p JOIN d USING (conv_id)
                  UNION ALL SELECT conv_id, unnest([b, m]) AS b, unnest([m, e]) AS e FROM (SELECT h.conv_id, h.b, h.e, w.start_ms AS m, row_number() OVER (PARTITION BY h.conv_id, h.b, h.e ORDER BY abs(2 * w.start_ms - h.b - h.e), w.start_ms) AS k
                    FROM h JOIN words w ON w.conv_id = h.conv_id AND w.start_ms > h.b + {MARGIN} AND w.start_ms < h.e - {MARGIN} WHERE h.e - h.b > {HOLD}) WHERE k = 1),
            a AS (SELECT DISTINCT conv_id, b FROM h), n AS (SELECT conv_id, b AS t, row_number() OVER o AS nr, lead(b) OVER o AS next FROM a WINDOW o AS (PARTITION BY conv_id ORDER BY b))
            SELECT conv_id, nr, t AS "at", coalesce(next, ends) AS until, CASE WHEN nr % 2 = 1 THEN 'in' ELSE 'out' END AS way FROM n JOIN d USING (conv_id)""",
        "sound_cues": f"""WITH RECURSIVE {SPANS_SQL}, c AS (SELECT user_id, id, b // {MINUTE} AS t, CASE kind {kinds} END AS cue, CASE kind {ranks} END AS rank FROM spans WHERE kind IN ({', '.join(f"'{k}'" for k in CUES)})),
            g AS (SELECT user_id, greatest(1, (max(t) - min(t)) // {CUE_EVERY}) AS budget FROM c GROUP BY 1),
            n AS (SELECT c.*, budget, row_number() OVER (PARTITION BY user_id ORDER BY rank, t, id) AS k FROM c JOIN g USING (user_id)),
            r AS (SELECT user_id, k, [{{'id': id, 't': t, 'cue': cue}}] AS chosen FROM n WHERE k = 1
                  UNION ALL SELECT n.user_id, n.k, CASE WHEN len(chosen) < budget AND len(list_filter(chosen, lambda x: abs(x.t - n.t) < {CUE_GAP})) = 0 THEN list_append(chosen, {{'id': n.id, 't': n.t, 'cue': n.cue}}) ELSE chosen END
                  FROM r JOIN n ON n.user_id = r.user_id AND n.k = r.k + 1),
            f AS (SELECT user_id, unnest(chosen) AS c FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1),
            w AS (SELECT user_id, c.id AS id, c.t AS t, c.cue AS cue, lag(c.cue) OVER (PARTITION BY user_id ORDER BY c.t, c.id) AS before FROM f) SELECT user_id, id, t AS "at", cue FROM w WHERE before IS DISTINCT FROM cue""",
        "cards_long_enough": f"""WITH RECURSIVE {SPANS_SQL}, c AS (SELECT user_id, id, b // {MINUTE} AS b, b // {MINUTE} + (e - b) // 1000000 AS e, row_number() OVER (PARTITION BY user_id ORDER BY b // {MINUTE}, id) AS k FROM spans WHERE kind = 'click'),
            d AS (SELECT user_id, max(b) + 60 AS ends FROM c GROUP BY 1),
            n AS (SELECT c.*, x.b AS nb, x.e AS ne, ends FROM c JOIN d USING (user_id) LEFT JOIN c x ON x.user_id = c.user_id AND x.k = c.k + 1),
            -- of card k: as it came (b may have been put off by the one before), the last one kept before it, and where those before that reach
            s AS (SELECT user_id, k, b, CAST(NULL AS BIGINT) AS pid, CAST(NULL AS BIGINT) AS pb, CAST(NULL AS BIGINT) AS pe, CAST(0 AS BIGINT) AS reached, CAST(NULL AS BIGINT) AS oid, CAST(NULL AS BIGINT) AS ob, CAST(NULL AS BIGINT) AS oe FROM n WHERE k = 1
                  UNION ALL
                  SELECT user_id, k + 1, CASE WHEN four > 0 THEN e3 + four ELSE nb END, CASE WHEN keep THEN id ELSE pid END, CASE WHEN keep THEN b4 ELSE pb END, CASE WHEN keep THEN e4 ELSE pe4 END,
                         CASE WHEN keep AND pid IS NOT NULL THEN greatest(reached, pe4) ELSE reached END, CASE WHEN keep THEN pid END, CASE WHEN keep THEN pb END, CASE WHEN keep THEN pe4 END
                  FROM (SELECT *, e3 + four AS e4, b3 AS b4, pe3 AS pe4, e3 + four - b3 >= {SHOWN} AS keep FROM (
                    SELECT *, CASE WHEN short AND lack3 > 0 AND nb <= e3 THEN least(lack3, greatest(0, ne - nb - {SHOWN})) ELSE 0 END AS four FROM (
                      SELECT *, b2 - three AS b3, pe - three AS pe3, e2 AS e3, {SHOWN} - (e2 - b2 + three) AS lack3 FROM (
                        SELECT *, CASE WHEN short AND {SHOWN} - (e2 - b2) > 0 AND pe = b2 THEN least({SHOWN} - (e2 - b2), greatest(0, pe - pb - {SHOWN})) ELSE 0 END AS three FROM (
                          SELECT *, CASE WHEN short THEN greatest(least(b, e2 - {SHOWN}), least(greatest(reached, coalesce(pe, 0)), b)) ELSE b END AS b2 FROM (
                            SELECT *, CASE WHEN short THEN least(greatest(e, b + {SHOWN}), greatest(free, b)) ELSE e END AS e2 FROM (
                              SELECT n.user_id, n.k, n.id, n.e, n.nb, n.ne, s.b, s.pid, s.pb, s.pe, s.reached, n.e - s.b < {SHOWN} AS short, CASE WHEN n.nb IS NULL THEN ends ELSE greatest(n.nb, s.b) END AS free
                              FROM s JOIN n ON n.user_id = s.user_id AND n.k = s.k))))))))
            SELECT user_id, oid AS id, ob AS b, oe AS e FROM s WHERE oid IS NOT NULL UNION ALL SELECT user_id, pid, pb, pe FROM s WHERE pid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""",
        "clear_entrances": f"""WITH RECURSIVE {SPANS_SQL}, z AS (SELECT user_id, id, b // {MINUTE} AS b, b // {MINUTE} + 20 + (e - b) // 1000000 AS e FROM spans WHERE kind = 'view'),
            c AS (SELECT user_id, b // {MINUTE} AS start, id % 3 = 0 AS scene, row_number() OVER (PARTITION BY user_id ORDER BY b // {MINUTE}, id) AS k FROM spans WHERE kind = 'purchase'),
            p AS (SELECT user_id, id, 0 AS side, b AS was, b AS t, 0 AS k FROM z UNION ALL SELECT user_id, id, 1, e, e, 0 FROM z),
            r AS (SELECT * FROM p UNION ALL SELECT r.user_id, r.id, r.side, r.was, CASE WHEN r.t > c.start - {BEFORE + TRAVEL} AND r.t < c.start + {AFTER} THEN c.start + CASE WHEN scene THEN 100 ELSE -{BEFORE + TRAVEL} END ELSE r.t END, c.k
                  FROM r JOIN c ON c.user_id = r.user_id AND c.k = r.k + 1),
            f AS (SELECT user_id, id, side, was, t FROM r QUALIFY row_number() OVER (PARTITION BY user_id, id, side ORDER BY k DESC) = 1),
            e AS (SELECT a.user_id, a.id, a.t AS b, b.t AS e, a.was, b.was - a.was AS long FROM f a JOIN f b ON b.user_id = a.user_id AND b.id = a.id AND b.side = 1 WHERE a.side = 0),
            u AS (SELECT e.user_id, c.start + 200 + {AFTER} AS b, c.start + 200 + {AFTER} + long AS e FROM e JOIN c ON c.user_id = e.user_id AND scene AND was > c.start - {BEFORE + TRAVEL} AND was < c.start + 200 WHERE e.e - e.b < {BRIEF}
                  QUALIFY row_number() OVER (PARTITION BY e.user_id, e.id ORDER BY c.k) = 1),
            q AS (SELECT user_id, b, e FROM e WHERE e - b >= {BRIEF} UNION ALL SELECT * FROM u),
            m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM q),
            g AS (SELECT *, sum(CASE WHEN before IS NULL OR b >= before + {TRAVEL} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS run FROM m)
            SELECT user_id, min(b) AS b, max(e) AS e, count(*) AS n FROM g GROUP BY user_id, run""",
    }


ORACLE_SQL = _oracle()
