"""Scalar rules over texts, colours, rates and times, each as one expression, and small text indexes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.plans.texts import _tokens_sql
from tessella.plans.words import ORACLE_SQL as WORDS_ORACLE
from tessella.plans.words import sentence_spans
from tessella.sources.views import VIDEOS_SQL, WORDS_SQL, dealt_out, table, videos, words

# Words that a title doesn't end on.
DANGLING = ("and", "or", "but", "the", "a", "an", "of", "to", "in", "with", "for", "so", "that")
#: As many presets are compared with each row.
MOST_PRESETS = 1_000
#: Parts of one name are paired in blocks of so many; so many pairs of parts are a task's share.
BLOCK, PART_PAIRS = 500, 4_000_000
#: Width of a stroke over its height, and the font weight drawn so; in between by proportion.
WEIGHTS = ((80, 300), (110, 400), (140, 500), (180, 700), (220, 900))


def content_words(text: Column) -> Column:
    """The distinct words that aren't stop words, apostrophes out."""
    return F.array_distinct(F.filter(F.transform(T.tokens(text), lambda w: F.replace(w, F.lit("'"), F.lit(""))), lambda w: ~w.isin(*T.STOP) & (w != "")))


def keyword_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's content words: how many distinct ones, how many over two letters, and their share of all words."""
    rows = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", T.tokens(F.col("text")).alias("w"), content_words(F.col("text")).alias("c"))
    said = F.size(F.filter("w", lambda w: ~w.isin(*T.STOP)))
    return rows.groupBy("conv_id", "turn").agg(F.sum(F.size("c")).alias("content"), F.sum(F.size(F.filter("c", lambda w: F.length(w) > 2))).alias("longer"), (F.sum(said) * 100 / F.nullif(F.sum(F.size("w")), F.lit(0))).alias("share"))


def clean_keyterms(spark: SparkSession, sf_dir: str, most: int = 100) -> DataFrame:
    """Names of parts as key terms: white space collapsed, at most 5 words and 30 characters, no brackets, distinct in lower case; the first hundred."""
    term = F.trim(F.regexp_replace("p_name", r"\s+", " "))
    rows = table(spark, sf_dir, "part").select("p_partkey", term.alias("term")).where(~F.col("term").rlike(r"[<>{}\[\]\\]") & (F.col("term") != "") & (F.length("term") <= 30) & (F.size(F.split("term", " ")) <= 5))
    rows = rows.groupBy(F.lower("term").alias("low")).agg(F.min_by("term", "p_partkey").alias("term"), F.min("p_partkey").alias("first"))
    return rows.select("term", "first").orderBy("first").limit(most)


def swapped_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole word replaced wherever it stands, in any case, by another; how often, and the text's length after."""
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    pattern = r"(?i)(^|[^\w'])the(?=$|[^\w'])"
    new = F.regexp_replace("text", pattern, "$1some")
    return rows.groupBy("conv_id").agg(F.sum(F.regexp_count("text", F.lit(pattern))).cast("long").alias("n"), F.sum(F.length(new)).alias("length"))


def cased_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words without signs (letters, digits, apostrophes and hyphens stay), in upper case at a sentence's end, else in lower case: the commonest."""
    rows = words(spark, sf_dir).withColumn("clean", F.regexp_replace("word", "[^A-Za-z0-9_'-]+", ""))
    rows = rows.withColumn("cased", F.when(F.col("ends_sentence"), F.upper("clean")).otherwise(F.lower("clean")))
    return rows.groupBy("cased").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"))


def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of a turn: split after a full stop, exclamation or question mark and white space."""
    rows = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", "role", F.posexplode(F.split(F.regexp_replace(F.trim("text"), r"([.!?])\s+", "$1\u0001"), "\u0001")).alias("nr", "sentence"))
    return rows.where("trim(sentence) != ''").groupBy("conv_id", "turn", "role").agg(F.count("*").alias("n"), F.max(F.length("sentence")).cast("long").alias("longest"))


def hue_saturation_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' keys as colours: hue in whole degrees, saturation and value in percent, and whether it is the commonplace violet."""
    v = F.col("p_partkey") * 7919 % 16777216
    rows = table(spark, sf_dir, "part").select("p_partkey", F.floor(v / 65536).alias("r"), (F.floor(v / 256) % 256).alias("g"), (v % 256).alias("b"))
    rows = rows.withColumn("high", F.greatest("r", "g", "b")).withColumn("low", F.least("r", "g", "b")).withColumn("span", F.col("high") - F.col("low"))
    turn = F.when(F.col("high") == F.col("r"), (F.col("g") - F.col("b")) / F.col("span")).when(F.col("high") == F.col("g"), 2 + (F.col("b") - F.col("r")) / F.col("span")).otherwise(4 + (F.col("r") - F.col("g")) / F.col("span"))
    hue = F.when(F.col("span") == 0, 0.0).otherwise(F.when(turn < 0, turn + 6).otherwise(turn) * 60)
    lightness, saturation = (F.col("high") + F.col("low")) / 510, F.when(F.col("high") == 0, 0.0).otherwise(F.col("span") / F.col("high"))
    violet = (F.col("span") > 0) & hue.between(225, 290) & (lightness > 0.5) & (lightness < 0.85) & (F.col("span") / (510 - F.col("high") - F.col("low")) > 0.45)
    return rows.select("p_partkey", F.floor(hue + 1e-9).cast("long").alias("hue"), F.floor(saturation * 100 + 1e-9).cast("long").alias("saturation"), F.floor(F.col("high") * 100 / 255).cast("long").alias("value"), F.coalesce(violet, F.lit(False)).alias("commonplace"))


def frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A video's views as frames at 29.97 or 30 a second: a rational time, and a timecode."""
    rows = videos(spark, sf_dir).select("video", F.col("views").alias("frames"), (F.col("video") % 2 == 0).alias("ntsc"))
    rational = F.when(F.col("frames") == 0, "0s").otherwise(F.concat((F.col("frames") * F.when(F.col("ntsc"), 1001).otherwise(1)).cast("string"), F.lit("/"), F.when(F.col("ntsc"), "30000").otherwise("30"), F.lit("s")))
    s = F.floor(F.col("frames") / 30)
    return rows.select("video", rational.alias("rational"), F.format_string("%02d:%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, F.col("frames") % 30).alias("timecode"))


def extracted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies (here the part's size and name as JSON in prose, for every third twice, for every fifth broken): the last object that has the key and parses."""
    size, name = F.col("p_size").cast("string"), F.regexp_replace("p_name", '["\\\\]', "")
    first = F.concat(F.lit('so {"size": '), size, F.lit(', "findings": "'), name, F.lit('"} and'))
    second = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(' {"size": '), (F.col("p_size") + 1).cast("string"), F.lit(', "findings": "again"}'))).otherwise("")
    third = F.when(F.col("p_partkey") % 5 == 0, F.lit(' {"size": , "findings": }')).otherwise("")
    found = F.transform(F.regexp_extract_all(F.concat(first, second, third), F.lit(r"(\{[^{}]*\})"), 1), lambda x: F.from_json(x, "size long, findings string"))
    last = F.element_at(F.filter(found, lambda x: x["findings"].isNotNull()), -1)
    return table(spark, sf_dir, "part").select("p_partkey", last["size"].alias("size"), last["findings"].alias("findings"))


def eased_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Easing curves by name at each part's size (1 to 50) of fifty; an entrance starts fast, an exit is the reverse: in millionths."""
    t = F.col("p_size") / 50
    out = 1 - F.pow(1 - t, F.lit(3.0))
    value = F.when(F.col("p_partkey") % 3 == 0, t).when(F.col("p_partkey") % 3 == 1, out).otherwise(1 - (1 - F.pow(t, F.lit(3.0))))
    name = F.when(F.col("p_partkey") % 3 == 0, "none").when(F.col("p_partkey") % 3 == 1, "cubic.out").otherwise("cubic.in")
    return table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("step"), name.alias("ease"), F.floor(value * 1_000_000 + 0.5).alias("value")).distinct()


def untracked_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs behind analytics redirects (here one prefix for every third page, two for every sixth): all prefixes off, however many."""
    tracked = F.concat(F.when(F.col("page_id") % 6 == 0, "https://hop.example/e/").otherwise(""), F.when(F.col("page_id") % 3 == 0, "https://count.example/go/").otherwise(""), F.col("url"))
    bare = F.regexp_replace(tracked, r"^(https?://(hop\.example/e|count\.example/go)/)+", "")
    return table(spark, sf_dir, "pages").where("url is not null").select("page_id", F.when(bare.rlike("^[a-z]+://"), bare).otherwise(F.concat(F.lit("https://"), bare)).alias("url"))


def rate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders against the rate that its segment asks for: the effective rate (null without a measure, 0 when off, else capped), whether the count is clearly off, the ratio's band, the longest gap, and likeness to the segment's size."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 5).alias("r"), F.length("c_mktsegment").alias("cap"))
    got = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("got"))
    rows = c.join(got, "c_custkey", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    rate = F.when(F.col("r") == 0, None).when(F.col("r") == 1, 0).otherwise(F.least(F.col("r") * 3, F.col("cap")))
    rows = rows.withColumn("rate", rate.cast("long"))
    off = (F.abs(F.col("got") - F.col("rate")) >= 1) & ~F.col("got").between(F.col("rate") / 2, F.col("rate") * 2 + 0.5)
    ratio = F.col("got") / F.nullif(F.col("rate"), F.lit(0))
    alike = (F.col("got") == 0) | (F.greatest("got", "cap") <= 2 * F.least("got", "cap"))
    return rows.select("c_custkey", "rate", "got", off.alias("off"), F.when(ratio < 0.6, "low").when(ratio > 1.6, "high").alias("band"), F.when(F.col("rate") > 0, F.floor(1200 / F.col("rate"))).alias("gap"), alike.alias("alike"))


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A content key: the first 20 hexadecimal digits of the SHA-1 of a JSON list of all that changes the result."""
    raw = F.concat(F.lit('["'), F.col("p_brand"), F.lit('", '), F.col("p_size").cast("string"), F.lit(', "'), F.regexp_replace("p_type", '"', ""), F.lit('"]'))
    return table(spark, sf_dir, "part").select("p_partkey", F.substring(F.sha1(raw.cast("binary")), 1, 20).alias("key"))


def clipped_texts(spark: SparkSession, sf_dir: str, n: int = 8) -> DataFrame:
    """Sentences of over twice n words as their first n and last half n words."""
    rows = sentence_spans(spark, sf_dir).select("conv_id", "sentence", "text", F.split("text", " ").alias("w"))
    cut = F.concat(F.array_join(F.slice("w", 1, n), " "), F.lit(" [...] "), F.array_join(F.slice("w", -(n // 2), n // 2), " "))
    return rows.select("conv_id", "sentence", F.when(F.size("w") <= 2 * n, F.col("text")).otherwise(cut).alias("text"))


def font_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight of a stroke ratio (the part's retail price modulo 260, in thousandths), between the measured ones by proportion, in hundreds."""
    ratio = F.floor("p_retailprice").cast("long") % 260
    weight = F.lit(900)
    for (r0, w0), (r1, w1) in reversed(list(zip(WEIGHTS, WEIGHTS[1:]))):
        weight = F.when(ratio <= r1, F.floor((w0 * (r1 - r0) + (w1 - w0) * F.greatest(F.lit(0), ratio - r0)) / (100 * (r1 - r0)) + 0.5) * 100).otherwise(weight)
    return table(spark, sf_dir, "part").groupBy(ratio.alias("ratio"), weight.cast("long").alias("weight")).agg(F.count("*").alias("n"))


def share_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand's sizes over 40 as text, the largest share first, or "none"; and its one container material, or "mixed"."""
    rows = table(spark, sf_dir, "part")
    shares = rows.where("p_size > 40").groupBy("p_brand", "p_size").agg(F.count("*").alias("n")).withColumn("share", F.floor(F.col("n") * 100 / F.sum("n").over(W.partitionBy("p_brand"))))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("s"), "p_size")))
    shares = shares.groupBy("p_brand").agg(F.array_join(F.transform(listed, lambda x: F.concat(x["p_size"].cast("string"), F.lit(" "), (-x["s"]).cast("string"), F.lit("%"))), ", ").alias("shares"))
    kinds = rows.groupBy("p_brand").agg(F.count_distinct(F.substring_index("p_type", " ", 1)).alias("kinds"), F.min(F.substring_index("p_type", " ", 1)).alias("kind"))
    return kinds.join(shares, "p_brand", "left").select("p_brand", F.coalesce("shares", F.lit("none")).alias("shares"), F.when(F.col("kinds") == 1, F.col("kind")).otherwise("mixed").alias("kind"))


def nearest_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation whose mean customer balance is nearest to each supplier's (ties: the lowest key)."""
    means = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.floor(F.avg("c_acctbal")).cast("long").alias("mean"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.floor("s_acctbal").cast("long").alias("own"))
    if means.count() > MOST_PRESETS:
        raise ValueError(f"more than {MOST_PRESETS} presets to compare with")
    pairs = suppliers.crossJoin(F.broadcast(means))
    return pairs.groupBy("s_suppkey").agg(F.min(F.struct(F.abs(F.col("own") - F.col("mean")).alias("apart"), "c_nationkey")).alias("x")).select("s_suppkey", F.col("x.c_nationkey").alias("nation"), F.col("x.apart").alias("apart"))


def letterbox_titles(spark: SparkSession, sf_dir: str, most: int = 6) -> DataFrame:
    """A conversation's title: its first words up to a stop or comma, six at most, no joining word last, lower case; a question keeps its mark."""
    rows = words(spark, sf_dir).where(F.col("idx") <= most)
    ends = F.min(F.when(F.col("word").rlike("[.?!,]$"), F.col("idx"))).over(W.partitionBy("conv_id"))
    rows = rows.withColumn("ends", ends).where(F.col("ends").isNull() | (F.col("idx") <= F.col("ends"))).withColumn("clean", F.lower(F.regexp_replace("word", "[^A-Za-z0-9_'-]+", "")))
    last = F.max(F.when(~F.col("clean").isin(*DANGLING), F.col("idx"))).over(W.partitionBy("conv_id"))
    rows = rows.withColumn("last", F.greatest(F.coalesce(last, F.lit(1)), F.lit(1))).where(F.col("idx") <= F.col("last"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "clean"))), lambda x: x["clean"]), " ")
    return rows.groupBy("conv_id").agg(text.alias("text"), F.max_by("word", "idx").alias("end")).select("conv_id", F.concat("text", F.when(F.col("end").endswith("?"), "?").otherwise("")).alias("title"))


def similar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a brand's part names that share half or more of the smaller one's content words, by an equi-join on brand, size and word.

    Parts of one name go in blocks, so what joins is blocks, each pair of them once, by the first word that they share; blocks' pairs are dealt out by their number before they become pairs of parts."""
    name = ["p_brand", "p_size", "p_name"]
    parts = table(spark, sf_dir, "part").where("p_partkey is not null")
    content = content_words(F.col("p_name"))
    each = parts.groupBy(*name).agg(F.count("*").alias("n")).select("p_brand", "p_size", "n", F.explode(content).alias("w")).groupBy("p_brand", "p_size", "w").agg(F.sum("n").cast("double").alias("n"))
    most = each.agg(F.sum(F.col("n") * F.col("n") / 2)).first()[0] or 0
    nr = F.row_number().over(W.partitionBy(*name).orderBy("p_partkey")) - 1
    rows = dealt_out(parts.select(*name, "p_partkey"), parts.count(), *name).withColumn("block", F.floor(nr / BLOCK))
    rows = rows.groupBy(*name, "block").agg(F.sort_array(F.collect_list("p_partkey")).alias("keys")).withColumn("words", F.array_sort(content))
    rows = rows.select("p_brand", "p_size", F.struct("p_name", "block").alias("id"), "keys", "words", F.explode("words").alias("w")).hint("merge")
    both = rows.join(rows.select("p_brand", "p_size", "w", F.col("id").alias("other_id"), F.col("keys").alias("others"), F.col("words").alias("other_words")), ["p_brand", "p_size", "w"]).where("id <= other_id")
    common, least = F.array_intersect("words", "other_words"), F.least(F.size("words"), F.size("other_words")).cast("long")
    both = both.where((F.get(common, 0) == F.col("w")) & (2 * F.size(common) >= least)).select("p_brand", "p_size", "id", "other_id", "keys", "others", F.size(common).cast("long").alias("shared"), least.alias("of"))
    both = both.repartition(max(1, math.ceil(most / PART_PAIRS)), "p_brand", "p_size", "id", "other_id").withColumn("same", F.col("id") == F.col("other_id"))
    pairs = both.select("same", "shared", "of", "others", F.explode("keys").alias("a")).select("same", "shared", "of", "a", F.explode("others").alias("b")).where("a < b or (a > b and not same)")
    return pairs.select(F.least("a", "b").alias("p_partkey"), F.greatest("a", "b").alias("other"), "shared", "of")


def reading_chunks(spark: SparkSession, sf_dir: str, size: int = 40_000, overlap: int = 10_000) -> DataFrame:
    """A conversation's sentences in parts of 40 s that overlap by 10 s; parts without a sentence are left out."""
    rows = sentence_spans(spark, sf_dir)
    step = size - overlap
    ends = F.max("end_ms").over(W.partitionBy("conv_id"))
    last = F.floor(F.col("start_ms") / step)
    rows = rows.withColumn("parts", F.greatest(F.lit(1), F.ceil((ends - overlap) / step)))
    rows = rows.select("conv_id", "sentence", "start_ms", "n_words", "parts", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), last - 1), last)).alias("part")).where((F.col("part") < F.col("parts")) & (F.col("start_ms") < F.col("part") * step + size))
    return rows.groupBy("conv_id", "part").agg(F.count("*").alias("sentences"), F.sum("n_words").alias("n_words"))


def highlights(spark: SparkSession, sf_dir: str, most: int = 3) -> DataFrame:
    """Of each conversation, the three sentences of over 15 characters that share most distinct words with its first; ties: the earlier."""
    rows = sentence_spans(spark, sf_dir).select("conv_id", "sentence", "text", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0)).alias("w"))
    first = rows.where("sentence = 1").select("conv_id", F.col("w").alias("said"))
    rows = rows.where("sentence > 1 and length(text) > 15").join(first, "conv_id").withColumn("shared", F.size(F.array_intersect("w", "said")).cast("long"))
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("shared"), "sentence"))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most).select("conv_id", "rank", "sentence", "shared")


def creator_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of one host and first path segment become one item when there are two or more, else stay an item each."""
    host, first = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.regexp_extract("url", "^[a-z]+://[^/?#]*/([^/?#]*)", 1)
    rows = table(spark, sf_dir, "pages").where("url is not null").select("page_id", host.alias("platform"), first.alias("handle"))
    groups = rows.groupBy("platform", "handle").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    return groups.select(F.when((F.col("n") >= 2) & (F.col("handle") != ""), "creator").otherwise("video").alias("kind"), "platform", "handle", "n", "first")


def preferred_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind's share of a brand's parts split evenly over its routes (by size class), summed by route, in thousandths."""
    rows = table(spark, sf_dir, "part").groupBy("p_brand", (F.col("p_size") % 4).alias("kind")).agg(F.count("*").alias("n"))
    rows = rows.withColumn("whole", F.sum("n").over(W.partitionBy("p_brand")))
    routes = F.when(F.col("kind") == 0, F.array(F.lit("capture"))).when(F.col("kind") == 1, F.array(F.lit("capture"), F.lit("draw"))).when(F.col("kind") == 2, F.array(F.lit("draw"), F.lit("logo"), F.lit("post"))).otherwise(F.array(F.lit("post")))
    rows = rows.select("p_brand", "n", "whole", F.size(routes).alias("ways"), F.explode(routes).alias("route"))
    return rows.groupBy("p_brand", "route").agg(F.sum(F.floor(F.col("n") * 6000 / F.col("ways"))).alias("part"), F.first("whole").alias("whole")).select("p_brand", "route", F.floor(F.col("part") / (6 * F.col("whole"))).alias("share"))


QUERIES = {q.__name__: q for q in (keyword_shares, clean_keyterms, swapped_words, cased_words, split_sentences, hue_saturation_value, frame_times, extracted_fields, eased_values, untracked_urls, rate_rules, cache_keys, clipped_texts, font_weights, share_texts, nearest_presets, letterbox_titles, similar_rules, reading_chunks, highlights, creator_groups, preferred_routes)}

_STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOP)
_CONTENT = "list_distinct(list_filter(list_transform(w, lambda x: replace(x, '''', '')), lambda x: x NOT IN (" + _STOP_SQL + ") AND x <> ''))"
_WEIGHT = " ".join(f"WHEN r <= {r1} THEN floor(({w0} * {r1 - r0} + {w1 - w0} * greatest(0, r - {r0})) / (100 * {r1 - r0}) + 0.5) * 100" for (r0, w0), (r1, w1) in zip(WEIGHTS, WEIGHTS[1:]))

ORACLE_SQL = {
    "keyword_shares": f"""WITH t AS (SELECT conv_id, turn, {_tokens_sql('text')} AS w FROM conversations WHERE text IS NOT NULL), c AS (SELECT conv_id, turn, w, {_CONTENT} AS c FROM t)
        SELECT conv_id, turn, CAST(sum(len(c)) AS BIGINT) AS content, CAST(sum(len(list_filter(c, lambda x: length(x) > 2))) AS BIGINT) AS longer, CAST(sum(len(list_filter(w, lambda x: x NOT IN ({_STOP_SQL})))) AS BIGINT) * 100 / nullif(CAST(sum(len(w)) AS BIGINT), 0) AS share FROM c GROUP BY 1, 2""",
    "clean_keyterms": r"""WITH t AS (SELECT p_partkey, trim(regexp_replace(p_name, '\s+', ' ', 'g')) AS term FROM part), o AS (SELECT * FROM t WHERE NOT regexp_matches(term, '[<>{}\[\]\\]') AND term <> '' AND length(term) <= 30 AND len(string_split(term, ' ')) <= 5)
        SELECT term, p_partkey AS first FROM o QUALIFY row_number() OVER (PARTITION BY lower(term) ORDER BY p_partkey) = 1 ORDER BY first LIMIT 100""",
    "swapped_words": r"""WITH s AS (SELECT conv_id, list_filter(string_split_regex(text, '[^\w'']+'), lambda x: lower(x) = 'the') AS hits, text FROM conversations WHERE text IS NOT NULL) SELECT conv_id, CAST(sum(len(hits)) AS BIGINT) AS n, CAST(sum(length(text) + len(hits)) AS BIGINT) AS length FROM s GROUP BY 1""",
    "cased_words": f"WITH {WORDS_SQL}, " + r"c AS (SELECT regexp_replace(word, '[^A-Za-z0-9_''-]+', '', 'g') AS clean, ends_sentence, conv_id FROM words) SELECT CASE WHEN ends_sentence THEN upper(clean) ELSE lower(clean) END AS cased, count(*) AS n, min(conv_id) AS first FROM c GROUP BY 1",
    "split_sentences": r"""WITH s AS (SELECT conv_id, turn, role, unnest(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS sentence FROM conversations WHERE text IS NOT NULL) SELECT conv_id, turn, role, count(*) AS n, CAST(max(length(sentence)) AS BIGINT) AS longest FROM s WHERE trim(sentence) <> '' GROUP BY 1, 2, 3""",
    "hue_saturation_value": """WITH h AS (SELECT p_partkey, p_partkey * 7919 % 16777216 AS v FROM part), c AS (SELECT p_partkey, v // 65536 AS r, v // 256 % 256 AS g, v % 256 AS b FROM h), m AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM c),
        t AS (SELECT *, hi - lo AS d, CASE WHEN hi = lo THEN 0 WHEN hi = r THEN (g - b) / (hi - lo) WHEN hi = g THEN 2 + (b - r) / (hi - lo) ELSE 4 + (r - g) / (hi - lo) END AS t FROM m), u AS (SELECT *, CASE WHEN t < 0 THEN t + 6 ELSE t END * 60 AS hue FROM t)
        SELECT p_partkey, CAST(floor(hue + 1e-9) AS BIGINT) AS hue, CAST(floor(CASE WHEN hi = 0 THEN 0 ELSE d / hi END * 100 + 1e-9) AS BIGINT) AS saturation, CAST(floor(hi * 100 / 255) AS BIGINT) AS value,
          coalesce(d > 0 AND hue BETWEEN 225 AND 290 AND (hi + lo) / 510 > 0.5 AND (hi + lo) / 510 < 0.85 AND d / nullif(510 - hi - lo, 0) > 0.45, false) AS commonplace FROM u""",
    "frame_times": f"""WITH {VIDEOS_SQL}, f AS (SELECT video, views AS n, views // 30 AS s FROM videos) SELECT video, CASE WHEN n = 0 THEN '0s' WHEN video % 2 = 0 THEN (n * 1001) || '/30000s' ELSE n || '/30s' END AS rational,
        printf('%02d:%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60, n % 30) AS timecode FROM f""",
    "extracted_fields": r"""SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS BIGINT) AS size, CASE WHEN p_partkey % 3 = 0 THEN 'again' ELSE regexp_replace(p_name, '["\\]', '', 'g') END AS findings FROM part""",
    "eased_values": "SELECT DISTINCT CAST(p_size AS BIGINT) AS step, CASE p_partkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'cubic.out' ELSE 'cubic.in' END AS ease, CAST(floor(CASE p_partkey % 3 WHEN 0 THEN p_size / 50 WHEN 1 THEN 1 - pow(1 - p_size / 50, 3.0::DOUBLE) ELSE 1 - (1 - pow(p_size / 50, 3.0::DOUBLE)) END * 1000000 + 0.5::DOUBLE) AS BIGINT) AS value FROM part",
    "untracked_urls": "SELECT page_id, CASE WHEN regexp_matches(url, '^[a-z]+://') THEN url ELSE 'https://' || url END AS url FROM pages WHERE url IS NOT NULL",
    "rate_rules": """WITH c AS (SELECT c_custkey, c_custkey % 5 AS r, length(c_mktsegment) AS cap FROM customer), g AS (SELECT o_custkey AS c_custkey, count(*) AS got FROM orders GROUP BY 1), j AS (SELECT c.*, coalesce(got, 0) AS got, CASE WHEN r = 1 THEN 0 WHEN r > 1 THEN least(r * 3, cap) END AS rate FROM c LEFT JOIN g USING (c_custkey))
        SELECT c_custkey, rate, got, abs(got - rate) >= 1 AND NOT (got BETWEEN rate / 2 AND rate * 2 + 0.5) AS off, CASE WHEN got / nullif(rate, 0) < 0.6 THEN 'low' WHEN got / nullif(rate, 0) > 1.6 THEN 'high' END AS band, CASE WHEN rate > 0 THEN 1200 // rate END AS gap,
          got = 0 OR greatest(got, cap) <= 2 * least(got, cap) AS alike FROM j""",
    "cache_keys": """SELECT p_partkey, substring(sha1('["' || p_brand || '", ' || p_size || ', "' || replace(p_type, '"', '') || '"]'), 1, 20) AS key FROM part""",
    "clipped_texts": f"WITH s AS ({WORDS_ORACLE['sentence_spans']}), w AS (SELECT conv_id, sentence, text, string_split(text, ' ') AS w FROM s) SELECT conv_id, sentence, CASE WHEN len(w) <= 16 THEN text ELSE array_to_string(w[:8], ' ') || ' [...] ' || array_to_string(w[-4:], ' ') END AS text FROM w",
    "font_weights": f"WITH r AS (SELECT CAST(floor(p_retailprice) AS BIGINT) % 260 AS r FROM part) SELECT r AS ratio, CAST(CASE {_WEIGHT} ELSE 900 END AS BIGINT) AS weight, count(*) AS n FROM r GROUP BY 1, 2",
    "share_texts": """WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part WHERE p_size > 40 GROUP BY 1, 2), s AS (SELECT p_brand, p_size, CAST(floor(n * 100 / sum(n) OVER (PARTITION BY p_brand)) AS BIGINT) AS share FROM c), t AS (SELECT p_brand, string_agg(p_size || ' ' || share || '%', ', ' ORDER BY share DESC, p_size) AS shares FROM s GROUP BY 1),
        k AS (SELECT p_brand, count(DISTINCT string_split(p_type, ' ')[1]) AS kinds, min(string_split(p_type, ' ')[1]) AS kind FROM part GROUP BY 1) SELECT p_brand, coalesce(shares, 'none') AS shares, CASE WHEN kinds = 1 THEN kind ELSE 'mixed' END AS kind FROM k LEFT JOIN t USING (p_brand)""",
    "nearest_presets": """WITH m AS (SELECT c_nationkey, CAST(floor(avg(c_acctbal)) AS BIGINT) AS mean FROM customer GROUP BY 1) SELECT s_suppkey, c_nationkey AS nation, abs(CAST(floor(s_acctbal) AS BIGINT) - mean) AS apart FROM supplier CROSS JOIN m QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY apart, c_nationkey) = 1""",
    "letterbox_titles": f"WITH {WORDS_SQL}, " + f"""f AS (SELECT *, lower(regexp_replace(word, '[^A-Za-z0-9_''-]+', '', 'g')) AS clean, min(CASE WHEN regexp_matches(word, '[.?!,]$') THEN idx END) OVER (PARTITION BY conv_id) AS ends FROM words WHERE idx <= 6),
        u AS (SELECT * FROM f WHERE ends IS NULL OR idx <= ends), l AS (SELECT *, coalesce(max(CASE WHEN clean NOT IN ({', '.join(f"'{w}'" for w in DANGLING)}) THEN idx END) OVER (PARTITION BY conv_id), 1) AS last FROM u)
        SELECT conv_id, string_agg(clean, ' ' ORDER BY idx) || CASE WHEN ends_with(arg_max(word, idx), '?') THEN '?' ELSE '' END AS title FROM l WHERE idx <= last GROUP BY 1""",
    "similar_rules": f"""WITH t AS (SELECT p_brand, p_size, p_partkey, {_tokens_sql('p_name')} AS w FROM part), c AS (SELECT p_brand, p_size, p_partkey, {_CONTENT} AS c FROM t) SELECT a.p_partkey, b.p_partkey AS other, CAST(len(list_intersect(a.c, b.c)) AS BIGINT) AS shared, CAST(least(len(a.c), len(b.c)) AS BIGINT) AS "of"
        FROM c a JOIN c b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE len(list_intersect(a.c, b.c)) > 0 AND 2 * len(list_intersect(a.c, b.c)) >= least(len(a.c), len(b.c))""",
    "reading_chunks": f"""WITH s AS ({WORDS_ORACLE['sentence_spans']}), e AS (SELECT conv_id, greatest(1, ceil((max(end_ms) - 10000) / 30000)) AS parts FROM s GROUP BY 1), p AS (SELECT conv_id, unnest(range(0, CAST(parts AS BIGINT))) AS part FROM e)
        SELECT p.conv_id, p.part, count(*) AS sentences, CAST(sum(n_words) AS BIGINT) AS n_words FROM p JOIN s ON s.conv_id = p.conv_id AND s.start_ms >= p.part * 30000 AND s.start_ms < p.part * 30000 + 40000 GROUP BY 1, 2""",
    "highlights": f"""WITH s AS ({WORDS_ORACLE['sentence_spans']}), w AS (SELECT conv_id, sentence, text, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM s), f AS (SELECT conv_id, w AS said FROM w WHERE sentence = 1)
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY len(list_intersect(w, said)) DESC, sentence) AS rank, sentence, CAST(len(list_intersect(w, said)) AS BIGINT) AS shared FROM w JOIN f USING (conv_id) WHERE sentence > 1 AND length(text) > 15 QUALIFY rank <= 3""",
    "creator_groups": """WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS platform, regexp_extract(url, '^[a-z]+://[^/?#]*/([^/?#]*)', 1) AS handle FROM pages WHERE url IS NOT NULL)
        SELECT CASE WHEN count(*) >= 2 AND handle <> '' THEN 'creator' ELSE 'video' END AS kind, platform, handle, count(*) AS n, min(page_id) AS first FROM p GROUP BY platform, handle""",
    "preferred_routes": """WITH c AS (SELECT p_brand, p_size % 4 AS kind, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY p_brand) AS BIGINT) AS whole FROM part GROUP BY 1, 2), r AS (SELECT *, CASE kind WHEN 0 THEN ['capture'] WHEN 1 THEN ['capture', 'draw'] WHEN 2 THEN ['draw', 'logo', 'post'] ELSE ['post'] END AS ways FROM c),
        u AS (SELECT p_brand, n * 6000 // len(ways) AS part, whole, unnest(ways) AS route FROM r) SELECT p_brand, route, CAST(floor(CAST(sum(part) AS BIGINT) / (6 * any_value(whole))) AS BIGINT) AS share FROM u GROUP BY 1, 2""",
}
