"""Rules over texts, pages and scripts: classifiers, findings, redaction, cues, colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import colour as C
from tessella.functions import text as T
from tessella.operators import membership
from tessella.plans.words import sentence_spans
from tessella.plans.words import ORACLE_SQL as WORDS_ORACLE
from tessella.sources.views import table

#: (kind, pattern of the path, score, most pages of the kind); the first that fits.
PAGE_KINDS = (("docs", "/(docs|en)/", 6, 3), ("blog", "/(blog|fr)/", 4, 2), ("pricing", "/(pricing|de)/", 8, 2), ("about", "/(about|es)/", 3, 1))
#: Phrases that give copy away, and how bad they are.
TELLS = (("shouting", "[A-Z]{4,}!!", "BAN"), ("filler marks", r"[#$%&*]{3,}", "WARN"), ("licence line", "(?i)licen[cs]e", "LOOK"))


def normalized_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark line's words: count, distinct, longest, and the line back together."""
    words = T.tokens(F.col("text"))
    rows = table(spark, sf_dir, "benchmark").withColumn("w", words)
    longest = F.aggregate("w", F.lit(0), lambda a, x: F.greatest(a, F.length(x))).cast("long")
    return rows.select("item_id", F.size("w").cast("long").alias("n"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), longest.alias("longest"), F.array_join("w", " ").alias("line"))


def motion_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn is doing, counted by role."""
    rows = table(spark, sf_dir, "conversations").select("role", T.motion_kind(F.col("text")).alias("kind"))
    return rows.groupBy("role", "kind").agg(F.count("*").alias("n"))


def url_parts(url: F.Column) -> tuple:
    host = F.lower(F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(host, r"^www\.", ""), path


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, path = url_parts(F.col("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", "url", host.alias("host"), path.alias("path"))
    kind, score, cap = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("int")
    for name, pattern, points, most in reversed(PAGE_KINDS):
        fits = F.concat("path", F.lit("/")).rlike(pattern)
        kind, score, cap = F.when(fits, name).otherwise(kind), F.when(fits, points).otherwise(score), F.when(fits, most).otherwise(cap)
    depth = F.size(F.filter(F.split("path", "/"), lambda x: x != ""))
    root = F.array_join(F.slice(F.split("host", r"\."), -2, 2), ".")
    return rows.select("page_id", "url", F.when(F.size(F.split("host", r"\.")) > 1, root).otherwise(F.col("host")).alias("site"), kind.alias("kind"), depth.cast("long").alias("depth"), score.cast("long").alias("points"), cap.cast("long").alias("most"))


def url_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", "site", "kind", "depth")


def page_rank_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each site's pages by score (points, less for depth), as many of a kind as it may have."""
    rows = _pages(spark, sf_dir).where("kind is not null")
    rows = rows.withColumn("score", F.col("points") * 10 - F.greatest(F.lit(0), F.col("depth") - 1) * F.when(F.col("kind") == "blog", 3).otherwise(12))
    rank = F.row_number().over(W.partitionBy("site", "kind").orderBy(F.desc("score"), "page_id"))
    return rows.withColumn("rank", rank.cast("long")).where("rank <= most").select("site", "kind", "page_id", "score", "rank")


def scrub_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many placeholders of each sort redaction puts into a document.  The generators keep the redaction from being repeated for each count."""
    kinds = {"mails": "<email>", "links": "<link>", "creators": "@creator", "paths": "<path>", "files": "<file>", "domains": "<domain>"}
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(T.scrub(F.col("text")))).alias("t"))
    counts = F.struct(*[F.regexp_count("t", F.lit(word)).cast("long").alias(name) for name, word in kinds.items()])
    rows = rows.select("doc_id", F.explode(F.array(counts)).alias("x")).select("doc_id", "x.*")
    return rows.where(" + ".join(kinds) + " > 0")


def copy_tells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding per document and tell: its level, and how often."""
    rows = table(spark, sf_dir, "documents")
    found = [F.struct(F.lit(name).alias("tell"), F.lit(level).alias("level"), F.regexp_count("text", F.lit(pattern)).cast("long").alias("n")) for name, pattern, level in TELLS]
    return rows.select("doc_id", F.explode(F.array(*found)).alias("x")).where("x.n > 0").select("doc_id", "x.*")


def chapter_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as chapters of its characters in tenths of a second: fewer than three, and those under 10 s."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("len"))
    start = F.coalesce(F.sum("len").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.select("conv_id", "turn", start.alias("start"), "len", F.count("*").over(W.partitionBy("conv_id")).alias("n"))
    few = rows.where("n < 3").groupBy("conv_id").agg(F.lit(-1).cast("long").alias("turn"), F.lit("fewer than 3 chapters").alias("what"))
    short = rows.where("len < 100").select("conv_id", "turn", F.lit("under 10 s").alias("what"))
    return few.unionByName(short)


def story_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose turns break the order: no user first, the same role twice in a row, no assistant last."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").where("role != 'system'").select("conv_id", "turn", "role", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"))
    first = rows.where("before is null and role != 'user'").select("conv_id", "turn", F.lit("no user first").alias("what"))
    twice = rows.where("before = role").select("conv_id", "turn", F.lit("twice in a row").alias("what"))
    last = rows.where("after is null and role != 'assistant'").select("conv_id", "turn", F.lit("no answer last").alias("what"))
    return first.unionByName(twice).unionByName(last)


def unsaid_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in a page's text (tags off) that its URL doesn't have."""
    text = F.regexp_replace("html", "<[^>]*>", " ")
    rows = table(spark, sf_dir, "pages")
    shown = rows.select("page_id", F.explode(F.regexp_extract_all(text, F.lit("[0-9]+"), 0)).alias("number")).distinct()
    said = rows.select("page_id", F.explode(F.regexp_extract_all("url", F.lit("[0-9]+"), 0)).alias("number"))
    return shown.join(said, ["page_id", "number"], "left_anti")


def grams(df: DataFrame, key: str, n: int) -> DataFrame:
    """Each n words in a row of the text column: (key, gram).  The words go through a generator so that they are cut once, not for each place."""
    rows = df.select(key, F.explode(F.array(T.tokens(F.col("text")))).alias("words"))
    return rows.select(key, F.explode(T.shingled(F.col("words"), n)).alias("gram"))


def hashed_grams(df: DataFrame, key: str, n: int, among: DataFrame | None = None) -> DataFrame:
    """(key, place from 0, gram): every n words in a row, as 128 bits of hash; among: only those whose first 64 bits (gram.h1) can be in it.

    Words are cut and hashed once (so they go through a generator), and an n-gram's hash is made of theirs; a filter comes before any exchange."""
    rows = df.select(F.col(key), F.explode(F.array(F.transform(T.tokens(F.col("text")), lambda w: F.xxhash64(w)))).alias("hashes")).where(F.size("hashes") >= n)
    rows = rows.select(key, "hashes", F.explode(F.sequence(F.lit(0), F.size("hashes") - n)).alias("place"))
    own = [F.get("hashes", F.col("place") + k) for k in range(n)]
    rows = rows.select(key, F.col("place").cast("long").alias("place"), F.xxhash64(*own).alias("h1"), F.xxhash64(*own[::-1], F.lit(n)).alias("h2"))
    rows = rows if among is None else membership.among(rows, "h1", among)
    return rows.select(key, "place", F.struct("h1", "h2").alias("gram"))


def line_grams(lines: DataFrame, docs: DataFrame, line: str, doc: str, n: int) -> tuple[DataFrame, DataFrame]:
    """hashed_grams of lines, and those of docs that can be among them."""
    own = hashed_grams(lines, line, n)
    return own, hashed_grams(docs, doc, n, own.select("gram.h1").distinct())


def site_phrase_semi(spark: SparkSession, sf_dir: str, n: int = 8) -> DataFrame:
    """Benchmark lines of which n words in a row stand in a document: an equi-join on hashed n-grams."""
    lines, docs = line_grams(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id", n)
    found = docs.join(lines.drop("place").distinct(), "gram").select("item_id", "doc_id").distinct()
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first"))


def missing_assets_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the labels table without a text of 200 characters or more."""
    present = table(spark, sf_dir, "documents").where(F.length("text") >= 200).select("doc_id")
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("quality")).join(present, "doc_id", "left_anti")


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that a document has more than once (white space collapsed, lower case)."""
    line = F.explode(F.split("text", "\n"))
    rows = table(spark, sf_dir, "documents").select("doc_id", line.alias("line")).select("doc_id", F.trim(F.regexp_replace(F.lower("line"), "[ \t\r\f]+", " ")).alias("line"))
    return rows.where(F.length("line") >= 20).groupBy("doc_id", "line").agg(F.count("*").alias("n")).where("n > 1").groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum("n").alias("copies"))


def srt_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences as numbered subtitle cues."""
    rows = sentence_spans(spark, sf_dir)
    cue = F.concat_ws("\n", F.col("sentence").cast("string"), F.concat(T.srt_time(F.col("start_ms")), F.lit(" --> "), T.srt_time(F.col("end_ms"))), "text")
    return rows.select("conv_id", "sentence", cue.alias("cue"))


def opens() -> Column:
    return F.col("n_words") >= 4


def closes() -> Column:
    return F.col("text").rlike("[.?!]$") & ~F.col("text").rlike(r"(\.\.\.|-)$") & (F.col("n_words") >= 3)


def clip_openers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that may open a clip (four words or more) and that may close one (a full end, three words or more)."""
    return sentence_spans(spark, sf_dir).groupBy("conv_id").agg(F.count_if(opens()).alias("openers"), F.count_if(closes()).alias("closers"))


def clip_windows(spark: SparkSession, sf_dir: str, low: int = 20_000, high: int = 40_000) -> DataFrame:
    """Runs of whole sentences that last from low to high ms: from each sentence on, how many, and the last sentence of the longest."""
    rows = sentence_spans(spark, sf_dir).select("conv_id", "sentence", "start_ms", "end_ms")
    bucket = F.floor(F.col("start_ms") / high)
    left = rows.select("conv_id", "sentence", "start_ms", F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    right = rows.select("conv_id", F.col("sentence").alias("last"), F.col("end_ms").alias("ends"), F.floor(F.col("end_ms") / high).alias("bucket"))
    found = left.join(right, ["conv_id", "bucket"]).where((F.col("last") >= F.col("sentence")) & (F.col("ends") - F.col("start_ms")).between(low, high))
    return found.groupBy("conv_id", "sentence").agg(F.count("*").alias("windows"), F.max("last").alias("longest"))


def slugs_and_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"), T.stamp(F.col("p_partkey") * 7).alias("stamp"), T.singular(F.concat(F.col("p_name"), F.lit("s"))).alias("one"), T.clock_seconds(T.stamp(F.col("p_partkey") * 7)).alias("seconds"))


def colour_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' keys as colours against white: channels, distance and whether the contrast is 4.5 or more."""
    colour = F.lpad(F.lower(F.hex(F.col("p_partkey") * 7919 % 16777216)), 6, "0")
    rows = table(spark, sf_dir, "part").select("p_partkey", colour.alias("colour"))
    return rows.select("p_partkey", "colour", *[C.channel(F.col("colour"), k).alias(n) for k, n in enumerate(("red", "green", "blue"))], C.distance(F.col("colour"), F.lit("#ffffff")).alias("distance"), (C.contrast(F.col("colour"), F.lit("ffffff")) >= 4.5).alias("readable"))


QUERIES = {
    q.__name__: q
    for q in (normalized_words, motion_kinds, url_classify, page_rank_capped, scrub_text, copy_tells, chapter_problems, story_order, unsaid_numbers, site_phrase_semi, missing_assets_anti, repeated_lines, srt_cues, clip_openers, clip_windows, slugs_and_stamps, colour_contrast)
}


def _tokens_sql(text: str) -> str:
    """norm() without lookaround: the capture form twice takes out neighbouring separators."""
    once = f"regexp_replace(replace(lower({text}), '%', ' percent '), '([0-9]),([0-9])', '\\1\\2', 'g')"
    return f"list_filter(string_split_regex(trim(regexp_replace(regexp_replace({once}, '([0-9]),([0-9])', '\\1\\2', 'g'), '[^a-z0-9'' ]+', ' ', 'g')), ' +'), lambda x: x <> '')"


def _count(text: str, pattern: str) -> str:
    return f"CAST(length(regexp_extract_all({text}, '{pattern}')) AS BIGINT)"


def _case(value: int, end: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(path || '/', '{k[1]}') THEN {repr(k[value])}" for k in PAGE_KINDS) + f" {end}"


_PAGES_SQL = f"""parts AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
kinds AS (SELECT page_id, CASE WHEN contains(host, '.') THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE host END AS site, {_case(0, 'END')} AS kind,
  CAST(length(list_filter(string_split(path, '/'), lambda x: x <> '')) AS BIGINT) AS depth, {_case(2, 'END')} AS points, {_case(3, 'END')} AS most FROM parts)"""
_SCRUB = "text"
for _pattern, _word in T.PRIVATE:
    _SCRUB = f"regexp_replace({_SCRUB}, '{_pattern}', '{_word}', 'g')"
_MOTION = " ".join(f"WHEN length(regexp_extract_all(text, '{pattern}')) >= {least} THEN '{kind}'" for kind, pattern, least in T.MOTIONS)
_LUM = " + ".join(f"{w}::DOUBLE * CASE WHEN {c} / 255.0::DOUBLE <= 0.03928 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END" for c, w in (("red", 0.2126), ("green", 0.7152), ("blue", 0.0722)))
_N8 = f"list_transform(range(1, greatest(length(w) - 6, 1)), lambda k: array_to_string(w[k:k + 7], ' '))"

ORACLE_SQL = {
    "normalized_words": f"WITH w AS (SELECT item_id, {_tokens_sql('text')} AS w FROM benchmark) SELECT item_id, CAST(length(w) AS BIGINT) AS n, CAST(length(list_distinct(w)) AS BIGINT) AS n_distinct, CAST(coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS longest, array_to_string(w, ' ') AS line FROM w",
    "motion_kinds": f"SELECT role, CASE {_MOTION} END AS kind, count(*) AS n FROM conversations GROUP BY 1, 2",
    "url_classify": f"WITH {_PAGES_SQL} SELECT page_id, site, kind, depth FROM kinds",
    "page_rank_capped": f"""WITH {_PAGES_SQL}, s AS (SELECT *, CAST(points * 10 - greatest(0, depth - 1) * CASE WHEN kind = 'blog' THEN 3 ELSE 12 END AS BIGINT) AS score FROM kinds WHERE kind IS NOT NULL)
        SELECT site, kind, page_id, score, row_number() OVER (PARTITION BY site, kind ORDER BY score DESC, page_id) AS rank FROM s QUALIFY rank <= most""",
    "scrub_text": f"""WITH s AS (SELECT doc_id, {_SCRUB} AS t FROM documents), c AS (SELECT doc_id, {_count('t', '<email>')} AS mails, {_count('t', '<link>')} AS links, {_count('t', '@creator')} AS creators,
        {_count('t', '<path>')} AS paths, {_count('t', '<file>')} AS files, {_count('t', '<domain>')} AS domains FROM s) SELECT * FROM c WHERE mails + links + creators + paths + files + domains > 0""",
    "copy_tells": "WITH x AS (" + " UNION ALL ".join(f"SELECT doc_id, '{name}' AS tell, '{level}' AS level, {_count('text', pattern)} AS n FROM documents" for name, pattern, level in TELLS) + ") SELECT * FROM x WHERE n > 0",
    "chapter_problems": """WITH c AS (SELECT conv_id, turn, length(text) AS len, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
        SELECT DISTINCT conv_id, CAST(-1 AS BIGINT) AS turn, 'fewer than 3 chapters' AS what FROM c WHERE n < 3 UNION ALL SELECT conv_id, turn, 'under 10 s' FROM c WHERE len < 100""",
    "story_order": """WITH r AS (SELECT conv_id, turn, role, lag(role) OVER o AS before, lead(role) OVER o AS after FROM conversations WHERE role <> 'system' WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
        SELECT conv_id, turn, 'no user first' AS what FROM r WHERE before IS NULL AND role <> 'user' UNION ALL SELECT conv_id, turn, 'twice in a row' FROM r WHERE before = role
        UNION ALL SELECT conv_id, turn, 'no answer last' FROM r WHERE after IS NULL AND role <> 'assistant'""",
    "unsaid_numbers": """WITH s AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[0-9]+')) AS number FROM pages), u AS (SELECT page_id, unnest(regexp_extract_all(url, '[0-9]+')) AS number FROM pages)
        SELECT * FROM s ANTI JOIN u USING (page_id, number)""",
    "site_phrase_semi": f"""WITH b AS (SELECT item_id, {_tokens_sql('text')} AS w FROM benchmark), d AS (SELECT doc_id, {_tokens_sql('text')} AS w FROM documents),
        l AS (SELECT DISTINCT item_id, unnest({_N8}) AS gram FROM b), g AS (SELECT doc_id, unnest({_N8}) AS gram FROM d), f AS (SELECT DISTINCT item_id, doc_id FROM g JOIN l USING (gram))
        SELECT item_id, count(*) AS documents, min(doc_id) AS first FROM f GROUP BY item_id""",
    "missing_assets_anti": "SELECT doc_id, CAST(quality AS BIGINT) AS quality FROM labels ANTI JOIN (SELECT doc_id FROM documents WHERE length(text) >= 200) USING (doc_id)",
    "repeated_lines": r"""WITH l AS (SELECT doc_id, trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '[ \t\r\f]+', ' ', 'g')) AS line FROM documents), c AS (SELECT doc_id, line, count(*) AS n FROM l WHERE length(line) >= 20 GROUP BY 1, 2 HAVING count(*) > 1)
        SELECT doc_id, count(*) AS lines, CAST(sum(n) AS BIGINT) AS copies FROM c GROUP BY doc_id""",
    "srt_cues": f"""WITH s AS ({WORDS_ORACLE['sentence_spans']}) SELECT conv_id, sentence, sentence || chr(10) || printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) || ' --> ' ||
        printf('%02d:%02d:%02d,%03d', end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60, end_ms % 1000) || chr(10) || text AS cue FROM s""",
    "clip_openers": f"WITH s AS ({WORDS_ORACLE['sentence_spans']}) SELECT conv_id, count(*) FILTER (WHERE n_words >= 4) AS openers, count(*) FILTER (WHERE regexp_matches(text, '[.?!]$') AND NOT regexp_matches(text, '(\\.\\.\\.|-)$') AND n_words >= 3) AS closers FROM s GROUP BY conv_id",
    "clip_windows": f"WITH s AS ({WORDS_ORACLE['sentence_spans']}) SELECT a.conv_id, a.sentence, count(*) AS windows, max(b.sentence) AS longest FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.sentence >= a.sentence AND b.end_ms - a.start_ms BETWEEN 20000 AND 40000 GROUP BY 1, 2",
    "slugs_and_stamps": r"""WITH p AS (SELECT p_partkey, p_name, p_partkey * 7 AS s, lower(p_name) || 's' AS w FROM part)
        SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, CASE WHEN s < 3600 THEN printf('%d:%02d', s // 60, s % 60) ELSE printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) END AS stamp,
               CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '(s|x|h)es$') THEN regexp_replace(w, 'es$', '') WHEN regexp_matches(w, '[^s]s$') THEN regexp_replace(w, 's$', '') ELSE w END AS one, s AS seconds FROM p""",
    "colour_contrast": f"""WITH h AS (SELECT p_partkey, p_partkey * 7919 % 16777216 AS v FROM part), c AS (SELECT p_partkey, lower(lpad(to_hex(v), 6, '0')) AS colour, v // 65536 AS red, v // 256 % 256 AS green, v % 256 AS blue FROM h)
        SELECT p_partkey, colour, red, green, blue, sqrt((red - 255) * (red - 255) + (green - 255) * (green - 255) + (blue - 255) * (blue - 255)) AS distance, 1.05 / ({_LUM} + 0.05) >= 4.5 AS readable FROM c""",
}
