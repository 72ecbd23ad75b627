"""Edits with a ledger, finds that become proposals, nested documents, totals shared by weight, and formats of videos."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators import edits, matching, sequential, trees
from tessella.sources.views import dealt_out, table

#: Places of a user's plan, and what each kind of event asks for.
PLACES = 40
ACTIONS = {"click": "cut", "error": "cut", "view": "trim", "signup": "restore", "purchase": "undo"}
#: Names whose contents no rule reads, and names that show something.
SKIPPED, PICTURES = ("id", "url"), ("src", "icon", "logo")
#: Milliseconds that an order's shots share for each of them, and the least of one: reading time by its quantity.
SHARE_MS, READ_MS, LEAST_MS = 3_000, 60, 1_600
#: How far apart two videos of one format are at most: times as long, times as many cards.
LENGTH_X, CARDS_X = 2, 3


def requested_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as edits of their user's plan: (plan, at, edit, action, first, last, n); what they point at follows from their number and value."""
    rows = table(spark, sf_dir, "events").where(F.col("value").isNotNull() & F.col("event_type").isin(*ACTIONS))
    action = F.coalesce(*[F.when(F.col("event_type") == kind, F.lit(name)) for kind, name in ACTIONS.items()])
    first = F.col("event_id") * 31 % PLACES + 1
    return rows.select(F.col("user_id").alias("plan"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("edit"), action.alias("action"),
                       first.alias("first"), (first + F.floor("value").cast("long") % 4).alias("last"), F.lit(PLACES).cast("long").alias("n"))


def edit_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each edit: applied, or why it was refused; how many places it changed, and how many are cut then."""
    return edits.ledger(requested_edits(spark, sf_dir))


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds of readers (events) on each plan's first cut, and their status: a bad kind, not in what is kept, spanning a cut, for a report only, a duplicate of a longer find of its sort, or proposed."""
    rows = requested_edits(spark, sf_dir).select("plan", F.col("edit").alias("id"), "action", "first", "last")
    kept = F.filter(F.sequence("first", "last"), lambda p: p % 7 != 3)  # every seventh place has gone before
    rows = rows.withColumn("kept", kept).withColumn("report", F.col("action") == "restore")
    status = F.when(F.col("action") == "undo", "bad kind").when((F.size("kept") == 0) | (F.col("last") > PLACES), "not in kept text")
    status = status.when(F.col("report"), "report").when(F.size("kept") < F.col("last") - F.col("first") + 1, "spans a cut").otherwise("proposed")
    rows = rows.withColumn("status", status).drop("kept")
    found = rows.where(~F.col("status").isin("bad kind", "not in kept text")).withColumn("b", F.col("first")).withColumn("e", F.col("last") + 1)
    found = matching.exclusive(found, ["plan", "report"], [F.col("first") - F.col("last"), "first", "id"])
    found = found.withColumn("status", F.when(F.col("kept"), F.col("status")).otherwise("dup"))
    rest = rows.where(F.col("status").isin("bad kind", "not in kept text"))
    return found.select("plan", "id", "first", "last", "status").unionByName(rest.select("plan", "id", "first", "last", "status"))


# ---- nested documents

def documents_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order, json): an order with its lines as cards, nested."""
    lines = table(spark, sf_dir, "lineitem")
    props = F.struct(F.col("l_linestatus").alias("label"), F.array(F.lit("line"), F.col("l_returnflag")).alias("tags"), F.when(F.col("l_linenumber") % 3 == 0, F.lit("a.png")).alias("src"))
    card = F.struct(F.col("l_linenumber").alias("nr"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("icon"), props.alias("props"))
    cards = lines.groupBy(F.col("l_orderkey").alias("order")).agg(F.array_sort(F.collect_list(card)).alias("cards"))
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "order").join(cards, "order")
    meta = F.struct(F.lit("http://a.example/x").alias("url"), F.array(F.struct(F.col("o_orderpriority").alias("note"))).alias("notes"))
    return rows.select("order", F.to_json(F.struct(F.col("o_orderstatus").alias("id"), "cards", meta.alias("meta"))).alias("json"))


def nested_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of each order's document with their path and nearest name, but for ids and URLs."""
    return trees.texts(documents_of_orders(spark, sf_dir), ["order"], "json", SKIPPED)


def nested_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Icons anywhere in an order's document, in lower case, and whether anything in it shows a picture."""
    found = trees.walk(documents_of_orders(spark, sf_dir).select("order", "json"), ["order"], "json")
    named = found.where((F.col("kind") == "STRING") & F.col("key").isin(*PICTURES) & F.col("path").endswith(F.concat(F.lit("."), F.col("key"))))
    named = named.select("order", "key", F.col("value").cast("string").alias("text")).where("text != ''")
    icons = F.array_join(F.array_sort(F.collect_set(F.when(F.col("key") == "icon", F.lower("text")))), ",")
    found = named.groupBy("order").agg(icons.alias("icons"), F.count("*").alias("pictures"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order")).join(found, "order", "left").select("order", F.coalesce("icons", F.lit("")).alias("icons"), F.coalesce("pictures", F.lit(0)).alias("pictures"), F.col("pictures").isNotNull().alias("has_picture"))


# ---- a total shared by weight

def shared_by_weight(rows: DataFrame, by: list[str], order: str, total: str, weight: str, least: str, fixed: str) -> DataFrame:
    """rows with given: what is left of a key's total after its fixed parts (column fixed, null: none), shared by weight, none less than its least; whole numbers that add up, the largest remainders rounded up.

    The water level: with the shares in order of least / weight from above, those whose least is above what the rest would get keep
    it.  If there isn't enough for all of them, each gets its least."""
    free = F.when(F.col(fixed).isNull(), F.col(weight))
    whole = W.partitionBy(*by)
    rows = rows.withColumn("__free", F.greatest(F.col(total) - F.coalesce(F.sum(fixed).over(whole), F.lit(0)), F.lit(0)))
    falling = whole.orderBy((F.col(least) / free).desc_nulls_last(), F.col(order))
    rows = rows.withColumn("__least", F.when(free.isNotNull(), F.col(least)))
    before = falling.rowsBetween(W.unboundedPreceding, -1)
    left = F.col("__free") - F.coalesce(F.sum("__least").over(before), F.lit(0))
    weight_left = F.sum(free).over(whole) - F.coalesce(F.sum(free).over(before), F.lit(0))
    rows = rows.withColumn("__left", left).withColumn("__weight", weight_left).withColumn("__w", free)
    rows = rows.withColumn("__kept", F.col("__least") * F.col("__weight") > F.col("__left") * F.col("__w"))
    # the first that isn't kept at its least has the level for all after it
    first = F.min(F.when(~F.col("__kept"), F.struct((-F.col("__least") / F.col("__w")).alias("rank"), F.col(order).alias("o"), F.col("__left").alias("l"), F.col("__weight").alias("w")))).over(whole)
    rows = rows.withColumn("__first", first)
    under = F.col("__w").isNotNull() & F.col("__first").isNotNull() & (F.struct((-F.col("__least") / F.col("__w")).alias("rank"), F.col(order).alias("o")) >= F.struct(F.col("__first.rank"), F.col("__first.o")))
    rows = rows.withColumn("__under", under)
    share = F.when(F.col("__under"), F.expr("__w * __first.l div __first.w"))
    rest = F.when(F.col("__under"), F.expr("__w * __first.l % __first.w"))
    rows = rows.withColumn("__share", share).withColumn("__rest", rest)
    over = F.col("__first.l") - F.sum("__share").over(whole)
    rank = F.row_number().over(whole.orderBy(F.col("__rest").desc_nulls_last(), F.col(order)))
    given = F.coalesce(F.col(fixed), F.when(F.col("__under"), F.col("__share") + (rank <= over).cast("long")), F.col("__least"))
    rows = rows.withColumn("given", given)
    return rows.drop(*[c for c in rows.columns if c.startswith("__")])


def shot_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as its shots: SHARE_MS for each of them shared by their part's size, none shorter than reading it takes; line 1 has a length of its own."""
    items = table(spark, sf_dir, "lineitem")
    lines = items.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("long").alias("weight")), "l_partkey")
    lines = dealt_out(lines.where("weight > 0"), items.count(), "l_orderkey")
    nr: Column = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("long")
    lines = lines.select(F.col("l_orderkey").alias("order"), nr.alias("nr"), "weight", F.greatest(F.lit(LEAST_MS), F.floor("l_quantity").cast("long") * READ_MS).cast("long").alias("least"))
    lines = lines.withColumn("total", F.count("*").over(W.partitionBy("order")) * SHARE_MS).withColumn("fixed", F.when(F.col("nr") == 1, F.lit(2_500).cast("long")))
    return shared_by_weight(lines, ["order"], "nr", "total", "weight", "least", "fixed").select("order", "nr", F.col("given").alias("ms"))


# ---- formats of a creator's videos

def video_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(creator, video, views, kind, length, cards): null where it wasn't measured, which is alike to anything."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("creator"), F.col("o_orderkey").alias("video"), F.floor("o_totalprice").cast("long").alias("views"), F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("kind"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("video")).agg(F.sum(F.floor("l_quantity").cast("long")).alias("length"), F.count("*").alias("cards"))
    return orders.join(lines, "video", "left").select("creator", "video", "views", "kind", F.when(F.col("video") % 9 != 0, F.col("length")).alias("length"), "cards")


def _alike(a: Any, b: Any) -> bool:
    def within(x: Any, y: Any, times: int) -> bool:
        return x is None or y is None or max(x, y) <= times * min(x, y)

    return (a.kind is None or b.kind is None or a.kind == b.kind) and within(a.length, b.length, LENGTH_X) and within(a.cards, b.cards, CARDS_X)


def format_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A creator's videos by format: from the most measured and most viewed on, each joins the first group whose seed it is like, or makes one.  The best group has most videos (then the highest
    median of views, then the earliest seed), and takes in every video that is like its seed.  One row a group that has videos left: seed, n, median of views, whether it is the best.

    The first pass is in order by nature and keeps seeds alone; the second is a join with one seed a creator."""
    rows = video_features(spark, sf_dir)
    measured = sum((F.col(c).isNotNull().cast("int") for c in ("kind", "length", "cards")), F.lit(0))
    rows = rows.withColumn("measured", measured)

    def rule(found: Iterator[Any]) -> Iterator[tuple]:
        seeds: list[Any] = []
        for row in found:
            row = row._replace(**{c: None if getattr(row, c) != getattr(row, c) else getattr(row, c) for c in ("length", "cards")})
            seed = next((s for s in seeds if _alike(s, row)), None)
            if seed is None:
                seeds.append(seed := row)
            yield row.creator, row.video, row.views, row.kind, row.length, row.cards, seed.video, seeds.index(seed)

    schema = "creator long, video long, views long, kind string, length long, cards long, seed long, nr long"
    rows = sequential.streamed(rows, ["creator"], [F.desc("measured"), F.desc("views"), "video"], rule, schema)
    sizes = rows.groupBy("creator", "nr").agg(F.count("*").alias("n"), F.median("views").alias("median"))
    best = sizes.groupBy("creator").agg(F.max(F.struct("n", "median", -F.col("nr")))["col3"].alias("best")).select("creator", (-F.col("best")).alias("best"))
    seeds = rows.where("video = seed").select("creator", F.col("nr").alias("best"), F.struct("kind", "length", "cards").alias("s"))
    rows = rows.join(best.join(seeds, ["creator", "best"]), "creator")

    def within(c: str, times: int) -> Column:
        a, b = F.col(c), F.col(f"s.{c}")
        return F.coalesce(F.greatest(a, b) <= times * F.least(a, b), F.lit(True)) | a.isNull() | b.isNull()

    like = F.coalesce(F.col("kind") == F.col("s.kind"), F.lit(True)) & within("length", LENGTH_X) & within("cards", CARDS_X)
    rows = rows.withColumn("nr", F.when(like, F.col("best")).otherwise(F.col("nr")))
    found = rows.groupBy("creator", "nr", "best").agg(F.count("*").alias("n"), F.median("views").alias("median"))
    return found.select("creator", "nr", "n", "median", (F.col("nr") == F.col("best")).alias("is_best"))


QUERIES = {q.__name__: q for q in (edit_ledger, proposals, nested_texts, nested_pictures, shot_lengths, format_groups)}

_CASE = " ".join(f"WHEN '{kind}' THEN '{name}'" for kind, name in ACTIONS.items())
_EDITS_SQL = f"""e AS (SELECT user_id AS plan, epoch_us(ts) AS t, event_id AS edit, CASE event_type {_CASE} END AS action, event_id * 31 % {PLACES} + 1 AS a, event_id * 31 % {PLACES} + 1 + CAST(floor(value) AS BIGINT) % 4 AS z
    FROM events WHERE value IS NOT NULL AND event_type IN ({', '.join(f"'{k}'" for k in ACTIONS)}))"""
_JSON_SQL = """docs AS (SELECT o_orderkey AS "order", to_json({id: o_orderstatus, cards: cards, meta: {url: 'http://a.example/x', notes: [{note: o_orderpriority}]}}) AS j FROM orders JOIN (
    SELECT l_orderkey, list({nr: l_linenumber, icon: CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END, props: {label: l_linestatus, tags: ['line', l_returnflag], src: CASE WHEN l_linenumber % 3 = 0 THEN 'a.png' END}}
      ORDER BY l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END, l_linestatus, l_returnflag) AS cards FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""
_LIKE = "(({0}.kind IS NULL OR {1}.kind IS NULL OR {0}.kind = {1}.kind) AND ({0}.length IS NULL OR {1}.length IS NULL OR greatest({0}.length, {1}.length) <= %d * least({0}.length, {1}.length)) AND ({0}.cards IS NULL OR {1}.cards IS NULL OR greatest({0}.cards, {1}.cards) <= %d * least({0}.cards, {1}.cards)))" % (LENGTH_X, CARDS_X)  # fmt: skip  # noqa: UP031

ORACLE_SQL = {
    "edit_ledger": f"""WITH RECURSIVE {_EDITS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY t, edit) AS k FROM e),
        s AS (SELECT plan, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS edit, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS VARCHAR) AS status, CAST(0 AS BIGINT) AS changed, CAST([] AS BIGINT[]) AS cut, CAST([] AS BIGINT[]) AS frozen, CAST([] AS STRUCT(added BIGINT[], given BIGINT[])[]) AS undo FROM n WHERE k = 1
          UNION ALL
          SELECT plan, k, edit, action, status, CASE WHEN status = 'applied' THEN len(added) + len(given) ELSE 0 END,
                 CASE WHEN status <> 'applied' THEN cut ELSE list_concat(list_filter(cut, lambda x: NOT list_contains(CASE WHEN action = 'undo' THEN added ELSE given END, x)), CASE WHEN action = 'undo' THEN given ELSE added END) END,
                 CASE WHEN status <> 'applied' THEN frozen WHEN action = 'undo' THEN list_filter(frozen, lambda x: NOT list_contains(given, x)) ELSE list_distinct(list_concat(frozen, given)) END,
                 CASE WHEN status <> 'applied' THEN undo WHEN action = 'undo' THEN undo[: len(undo) - 1] ELSE list_append(undo, {{'added': added, 'given': given}}) END
          FROM (SELECT *, CASE WHEN action = 'undo' THEN undo[len(undo)].added WHEN action = 'cut' THEN places ELSE CAST([] AS BIGINT[]) END AS added,
                       CASE WHEN action = 'undo' THEN undo[len(undo)].given WHEN action = 'restore' THEN range(lo, hi + 1) WHEN action = 'trim' THEN places ELSE CAST([] AS BIGINT[]) END AS given,
                       CASE WHEN action = 'undo' THEN CASE WHEN len(undo) = 0 THEN 'nothing to undo' ELSE 'applied' END WHEN a < 1 OR z > {PLACES} THEN 'out of range'
                            WHEN action = 'cut' THEN CASE WHEN list_has_any(frozen, places) THEN 'frozen' WHEN list_has_any(cut, places) THEN 'meets a cut' ELSE 'applied' END
                            WHEN NOT list_contains(cut, a) THEN 'not cut' WHEN action = 'restore' THEN 'applied' WHEN z > hi THEN 'not inside a cut' WHEN a <> lo AND z <> hi THEN 'mid-cut' ELSE 'applied' END AS status
                FROM (SELECT n.plan, n.k, n.edit, n.action, n.a, n.z, s.cut, s.frozen, s.undo, range(n.a, n.z + 1) AS places,
                             coalesce(list_max(list_filter(range(0, n.a), lambda y: NOT list_contains(s.cut, y))), -1) + 1 AS lo, coalesce(list_min(list_filter(range(n.a, {PLACES + 2}), lambda y: NOT list_contains(s.cut, y))), {PLACES + 1}) - 1 AS hi
                      FROM s JOIN n ON n.plan = s.plan AND n.k = s.k + 1)))
        SELECT plan, edit, action, status, changed, CAST(len(cut) AS BIGINT) AS total FROM s WHERE k > 0""",
    "proposals": f"""WITH RECURSIVE {_EDITS_SQL}, k AS (SELECT plan, edit AS id, action, a AS first, z AS last, action = 'restore' AS report, len(list_filter(range(a, z + 1), lambda p: p % 7 <> 3)) AS kept FROM e),
        s AS (SELECT *, CASE WHEN action = 'undo' THEN 'bad kind' WHEN kept = 0 OR last > {PLACES} THEN 'not in kept text' WHEN report THEN 'report' WHEN kept < last - first + 1 THEN 'spans a cut' ELSE 'proposed' END AS status FROM k),
        n AS (SELECT *, row_number() OVER (PARTITION BY plan, report ORDER BY first - last, first, id) AS nr FROM s WHERE status NOT IN ('bad kind', 'not in kept text')),
        g AS (SELECT plan, report, nr, [{{'nr': nr, 'b': first, 'e': last}}] AS taken FROM n WHERE nr = 1
              UNION ALL SELECT n.plan, n.report, n.nr, CASE WHEN len(list_filter(taken, lambda x: x.b <= n.last AND n.first <= x.e)) = 0 THEN list_append(taken, {{'nr': n.nr, 'b': n.first, 'e': n.last}}) ELSE taken END FROM g JOIN n ON n.plan = g.plan AND n.report = g.report AND n.nr = g.nr + 1),
        c AS (SELECT plan, report, unnest(list_transform(taken, lambda x: x.nr)) AS nr FROM g QUALIFY row_number() OVER (PARTITION BY plan, report ORDER BY nr DESC) = 1)
        SELECT n.plan, n.id, n.first, n.last, CASE WHEN c.nr IS NULL THEN 'dup' ELSE n.status END AS status FROM n LEFT JOIN c ON c.plan = n.plan AND c.report = n.report AND c.nr = n.nr
        UNION ALL SELECT plan, id, first, last, status FROM s WHERE status IN ('bad kind', 'not in kept text')""",
    "nested_texts": f"""WITH {_JSON_SQL}, t AS (SELECT "order", t.fullkey AS path, t.type AS type, t.atom ->> '$' AS text FROM docs, json_tree(docs.j) t)
        SELECT "order", path, regexp_extract(path, '\\.([A-Za-z_]+)(\\[[0-9]+\\])*$', 1) AS key, text FROM t WHERE type = 'VARCHAR' AND NOT regexp_matches(path, '\\.(id|url)(\\.|\\[|$)')""",
    "nested_pictures": f"""WITH {_JSON_SQL}, t AS (SELECT "order", regexp_extract(t.fullkey, '\\.([A-Za-z_]+)$', 1) AS key, t.type AS type, t.atom ->> '$' AS text FROM docs, json_tree(docs.j) t),
        p AS (SELECT "order", coalesce(array_to_string(list_sort(list(DISTINCT lower(text)) FILTER (WHERE key = 'icon')), ','), '') AS icons, count(*) AS pictures FROM t WHERE type = 'VARCHAR' AND key IN ('src', 'icon', 'logo') AND text <> '' GROUP BY 1)
        SELECT o_orderkey AS "order", coalesce(icons, '') AS icons, coalesce(pictures, 0) AS pictures, pictures IS NOT NULL AS has_picture FROM orders LEFT JOIN p ON p."order" = o_orderkey""",
    "shot_lengths": f"""WITH l AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nr, CAST(p_size AS BIGINT) AS w, greatest({LEAST_MS}, CAST(floor(l_quantity) AS BIGINT) * {READ_MS}) AS least_, count(*) OVER (PARTITION BY l_orderkey) * {SHARE_MS} AS total
          FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 0),
        f AS (SELECT *, greatest(total - 2500, 0) AS free FROM l), b AS (SELECT * FROM f WHERE nr > 1),
        q AS (SELECT *, free - coalesce(sum(least_) OVER (PARTITION BY o ORDER BY least_ / w DESC, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remain,
                     sum(w) OVER (PARTITION BY o) - coalesce(sum(w) OVER (PARTITION BY o ORDER BY least_ / w DESC, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight, row_number() OVER (PARTITION BY o ORDER BY least_ / w DESC, nr) AS k FROM b),
        x AS (SELECT o, min(k) AS k1 FROM q WHERE least_ * weight <= remain * w GROUP BY 1), y AS (SELECT q.o, q.remain AS lv, q.weight AS wt, k1 FROM q JOIN x ON x.o = q.o AND q.k = k1),
        z AS (SELECT q.o, q.nr, least_, CASE WHEN k >= k1 THEN CAST(w * lv AS BIGINT) // CAST(wt AS BIGINT) END AS share, CASE WHEN k >= k1 THEN CAST(w * lv AS BIGINT) % CAST(wt AS BIGINT) END AS rest, lv FROM q LEFT JOIN y USING (o)),
        r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY rest DESC NULLS LAST, nr) AS rk, lv - sum(share) OVER (PARTITION BY o) AS extra FROM z)
        SELECT o AS "order", nr, CAST(CASE WHEN share IS NULL THEN least_ ELSE share + CAST(rk <= extra AS BIGINT) END AS BIGINT) AS ms FROM r UNION ALL SELECT o, nr, 2500 FROM f WHERE nr = 1""",
    "format_groups": f"""WITH RECURSIVE c AS (SELECT l_orderkey AS video, CAST(sum(floor(l_quantity)) AS BIGINT) AS length, count(*) AS cards FROM lineitem GROUP BY 1),
        v AS (SELECT o_custkey AS creator, o_orderkey AS video, CAST(floor(o_totalprice) AS BIGINT) AS views, nullif(o_orderstatus, 'P') AS kind, CASE WHEN o_orderkey % 9 <> 0 THEN length END AS length, cards FROM orders LEFT JOIN c ON c.video = o_orderkey),
        n AS (SELECT *, row_number() OVER (PARTITION BY creator ORDER BY CAST(kind IS NOT NULL AS INT) + CAST(length IS NOT NULL AS INT) + CAST(cards IS NOT NULL AS INT) DESC, views DESC, video) AS k FROM v),
        s AS (SELECT creator, k, [{{'kind': kind, 'length': length, 'cards': cards}}] AS seeds, CAST(1 AS BIGINT) AS nr FROM n WHERE k = 1
              UNION ALL SELECT creator, k, CASE WHEN len(hits) = 0 THEN list_append(seeds, own) ELSE seeds END, CASE WHEN len(hits) = 0 THEN len(seeds) + 1 ELSE hits[1] END
              FROM (SELECT n.creator, n.k, s.seeds, {{'kind': n.kind, 'length': n.length, 'cards': n.cards}} AS own, list_filter(range(1, len(s.seeds) + 1), lambda i: {_LIKE.format('n', 's.seeds[i]')}) AS hits FROM s JOIN n ON n.creator = s.creator AND n.k = s.k + 1)),
        a AS (SELECT n.*, s.nr FROM n JOIN s USING (creator, k)), g AS (SELECT creator, nr, count(*) AS n, median(views) AS m FROM a GROUP BY 1, 2),
        b AS (SELECT creator, nr AS best FROM g QUALIFY row_number() OVER (PARTITION BY creator ORDER BY n DESC, m DESC, nr) = 1),
        d AS (SELECT b.creator, best, kind, length, cards FROM b JOIN a ON a.creator = b.creator AND a.nr = best QUALIFY row_number() OVER (PARTITION BY b.creator ORDER BY k) = 1),
        f AS (SELECT a.creator, CASE WHEN {_LIKE.format('a', 'd')} THEN best ELSE nr END AS nr, best, views FROM a JOIN d ON d.creator = a.creator)
        SELECT creator, CAST(nr - 1 AS BIGINT) AS nr, count(*) AS n, median(views) AS median, nr = best AS is_best FROM f GROUP BY creator, nr, best""",
}
