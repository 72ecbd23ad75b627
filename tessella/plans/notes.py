"""Findings of readers and what they refer to: checked rows, lost openings, transcripts laid on a cut, references, repeated notes, captions against speech, lint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import fuzzy, matching
from tessella.operators.alignment import aligned
from tessella.operators.asof import asof
from tessella.operators.islands import islands
from tessella.plans.rules import plan_cards
from tessella.plans.words import BY, ORDER, _gap, sentence_spans
from tessella.sources.views import spans, table, words

#: An opening is one of so many sentences, with so many words and content words; another says it again with 60% of these.
OPENINGS, OPENING_WORDS, OPENING_CONTENT = 5, 3, 2
#: A removed pause of so long shows in a transcript; a line of it has so many tokens.
CHIP_MS, LINE_TOKENS = 300, 24
#: A scene's card leads its word by so much, and has landed when half of its transition is over, in microseconds.
LEAD_US, LANDED_US, SLACK_US = 600_000, 310_000, 50_000
#: Two notes are the same from this ratio on.
SAME_NUM, SAME_DEN = 8, 10
KNOWN_TIMES = 3


def is_cut(idx: Column) -> Column:
    """Of every eleven words the cut leaves out three."""
    return idx % 11 < 3


# ---- checked rows

def checked_finds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a reader's finds: (id, check, severity, action, reason).  A find without what its action needs is dropped, for the first reason that holds; a blocker on something redundant becomes a spot check without an action."""
    rows = table(spark, sf_dir, "events")
    check = F.concat(F.when(F.col("user_id") % 2 == 0, "B").otherwise("W"), (F.col("event_id") % 7).cast("string"))
    action = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in (("click", "restore"), ("view", "trim"), ("purchase", "add"), ("signup", "none"))], F.lit("paint"))
    rows = rows.select(F.col("event_id").alias("id"), check.alias("check"), action.alias("action"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 40).alias("cut"), F.when(F.col("event_id") % 13 != 0, F.floor("value").cast("long")).alias("quote"), (F.col("event_id") % 3).alias("words"))
    reason = (
        F.when(F.col("check").isin("B0", "W6"), "unknown check").when(F.col("quote").isNull(), "no quote").when(F.col("action") == "paint", "unknown action")
        .when(F.col("action").isin("restore", "trim") & F.col("cut").isNull(), "needs a cut").when(F.col("cut") >= 30, "cut out of range").when((F.col("action") == "trim") & (F.col("words") == 0), "needs words to keep")
        .when((F.col("action") == "add") & (F.col("words") == 1), "needs evidence").when(F.col("quote") % 10 == 9, "not in the text")
    )
    redundant = (F.col("check") == "B3") & (F.coalesce(F.col("cut"), F.lit(1)) % 2 == 0)
    rows = rows.withColumn("reason", reason).withColumn("spot", redundant & F.col("reason").isNull())
    rows = rows.withColumn("action", F.when(F.col("spot") & (F.col("action") == "restore"), "none").otherwise(F.col("action"))).withColumn("check", F.when(F.col("spot"), "W5").otherwise(F.col("check")))
    return rows.select("id", "check", F.when(F.col("reason").isNotNull(), "dropped").when(F.col("check").startswith("B"), "blocker").otherwise("warn").alias("severity"), "action", "reason")


def content(text: Column) -> Column:
    return F.array_distinct(F.filter(T.tokens(text), lambda w: ~w.isin(*T.STOP)))


def lost_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose opening a cut takes half of or more: the first of OPENINGS sentences that says something and isn't said again later; (conv_id, sentence, n_words, n_cut)."""
    rows = islands(_gap(words(spark, sf_dir)), BY, ORDER, (F.col("gap") >= 1200) | F.col("after_sentence"), "sentence")
    cut = rows.groupBy("conv_id", F.col("sentence").cast("long").alias("sentence")).agg(F.count_if(is_cut(F.col("idx"))).alias("n_cut"))
    said = sentence_spans(spark, sf_dir).select("conv_id", F.col("sentence").cast("long").alias("sentence"), F.col("n_words"), content(F.col("text")).alias("c")).join(cut, ["conv_id", "sentence"])
    nth = F.row_number().over(W.partitionBy("conv_id").orderBy("sentence"))
    said = said.withColumn("nth", nth)
    first = said.where((F.col("nth") <= OPENINGS) & (F.col("n_words") >= OPENING_WORDS) & (F.size("c") >= OPENING_CONTENT))
    # said again: one row for each content word that both have
    own = first.select("conv_id", "sentence", F.size("c").alias("size"), F.explode("c").alias("word"))
    later = said.select("conv_id", F.col("sentence").alias("later"), F.explode("c").alias("word"))
    again = own.join(later, ["conv_id", "word"]).where("later > sentence").groupBy("conv_id", "sentence", "size", "later").agg(F.count("*").alias("both"))
    again = again.where("both * 10 >= size * 6").select("conv_id", "sentence").distinct()
    kept = first.join(again, ["conv_id", "sentence"], "left_anti").groupBy("conv_id").agg(F.min(F.struct("sentence", "n_words", "n_cut")).alias("x")).select("conv_id", "x.*")
    return kept.where("n_cut * 2 >= n_words")


def cut_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's words laid on the cut, in lines of at most LINE_TOKENS: (conv_id, line, at, words, cut, chips).

    A line ends with a sentence; a removed pause of CHIP_MS is a token of its own; at is where the line's first kept word plays: all kept words and the kept half of each pause before it."""
    rows = _gap(words(spark, sf_dir)).withColumn("is_cut", is_cut(F.col("idx"))).withColumn("pause", F.greatest(F.coalesce("gap", F.lit(0)), F.lit(0)))
    order = W.partitionBy("conv_id").orderBy("idx")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("removed", F.when(F.col("is_cut"), F.col("pause")).otherwise(F.expr("pause div 2"))).withColumn("plays", F.when(F.col("is_cut"), F.lit(0)).otherwise(F.col("end_ms") - F.col("start_ms")))
    rows = rows.withColumn("at", F.coalesce(F.sum(F.col("plays") + F.col("pause") - F.col("removed")).over(before), F.lit(0)) + F.col("pause") - F.col("removed")).withColumn("chip", (F.col("removed") >= CHIP_MS).cast("long"))
    rows = rows.withColumn("sentence", F.coalesce(F.sum(F.col("ends_sentence").cast("long")).over(before), F.lit(0)))
    inside = W.partitionBy("conv_id", "sentence").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("part", F.floor((F.sum(1 + F.col("chip")).over(inside) - 1) / LINE_TOKENS).cast("long"))
    lines = rows.groupBy("conv_id", "sentence", "part").agg(F.min("idx").alias("first"), F.min(F.when(~F.col("is_cut"), F.col("at"))).alias("at"), F.count("*").alias("words"), F.count_if("is_cut").alias("cut"), F.sum("chip").alias("chips"))
    line = F.row_number().over(W.partitionBy("conv_id").orderBy("first")).cast("long")
    return lines.select("conv_id", line.alias("line"), "at", "words", "cut", "chips")


# ---- references

def scene_landings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as scenes, and where they land against their word (the user's first view from a little before the scene on; else where the lead would put it): (user_id, id, word, landed); every fourth is a hard cut."""
    rows = spans(spark, sf_dir)
    scenes = rows.where("kind = 'purchase'").select("user_id", "id", "b", (F.col("b") - SLACK_US).alias("from"), (F.col("id") % 4 == 0).alias("hard"))
    said = rows.where("kind = 'view'").select("user_id", F.col("b").alias("at"), F.col("id").alias("view"))
    found = asof(scenes, said, ["user_id"], "from", "at", "view", "forward")
    lead = F.when(F.col("hard"), 0).otherwise(LEAD_US)
    return found.select("user_id", "id", F.coalesce(F.col("found.at"), F.col("b") + lead).alias("word"), (F.col("b") + F.when(F.col("hard"), 0).otherwise(LANDED_US)).alias("landed"))


def resolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to a plan's cards (one an order, made of its key: a card's number, a time, or a heading and which of them), and the card that each means: the one of that number; the one that is up then (the first), or begins or ends within 5 s (the nearest start, then the first); the nth with that heading.  Null where there is none."""
    cards = plan_cards(spark, sf_dir).select("video", "nr", "b", "e", "title")
    refs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video"))
    title = cards.groupBy("video").agg(F.max("title").alias("some"))
    refs = refs.join(title, "video", "left")
    key = F.col("video")
    ref = F.when(key % 4 == 0, F.concat(F.lit("card:"), (F.expr("video div 4") % 6).cast("string"))).when(key % 4 == 1, F.concat(F.lit("0:"), F.lpad((F.expr("video div 4") % 60).cast("string"), 2, "0"))).when(key % 4 == 2, F.concat((F.expr("video div 4") % 90).cast("string"), F.lit("s"))).otherwise(F.concat(F.coalesce("some", F.lit("none")), F.lit("@"), (F.expr("video div 4") % 2 + 1).cast("string")))
    refs = refs.select("video", ref.alias("ref"))
    number = F.regexp_extract("ref", "^card:?([0-9]+)$", 1)
    clock = F.regexp_extract("ref", "^(?:([0-9]+):)?([0-9]+)s?$", 2)
    minutes = F.regexp_extract("ref", "^(?:([0-9]+):)?([0-9]+)s?$", 1)
    refs = refs.withColumn("number", F.when(number != "", number.cast("long"))).withColumn("at", F.when(clock != "", F.coalesce(F.when(minutes != "", minutes.cast("long")), F.lit(0)) * 60 + clock.cast("long")))
    refs = refs.withColumn("word", F.when(F.col("number").isNull() & F.col("at").isNull(), F.regexp_extract("ref", "^([^@]*)", 1))).withColumn("nth", F.greatest(F.lit(1), F.coalesce(F.try_to_number(F.regexp_extract("ref", "@([0-9]+)$", 1), F.lit("999")).cast("long"), F.lit(1))))
    rows = refs.join(cards.withColumn("of_title", F.row_number().over(W.partitionBy("video", "title").orderBy("nr"))), "video", "left")
    up = (F.col("at") >= F.col("b")) & (F.col("at") < F.col("e"))
    near = F.least(F.abs(F.col("b") - F.col("at")), F.abs(F.col("e") - F.col("at"))) < 5
    rank = F.when(F.col("number") == F.col("nr"), F.lit(0)).when(up, F.lit(0)).when(near, 1 + F.abs(F.col("b") - F.col("at"))).when((F.lower("word") == F.lower("title")) & (F.col("nth") == F.col("of_title")), F.lit(0))
    rows = rows.withColumn("rank", rank)
    return rows.groupBy("video", "ref").agg(F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "nr")))["nr"].alias("card"))


def remapped_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats on every tenth word of an old cut, keyed by the word and which of its kind it is there, carried over to a new cut: on the same word if that is kept, else on the same word nearest in its sentence (ties: the earlier), else dropped: (conv_id, idx, word, nth, new_idx, new_nth, how)."""
    rows = islands(_gap(words(spark, sf_dir)), BY, ORDER, (F.col("gap") >= 1200) | F.col("after_sentence"), "sentence").select("conv_id", "idx", "norm", "sentence")
    old, new = rows.where(~is_cut(F.col("idx"))), rows.where("idx % 13 >= 4")
    of_kind = F.row_number().over(W.partitionBy("conv_id", "norm").orderBy("idx")).cast("long")
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("idx"))
    beats = old.withColumn("nth", of_kind).withColumn("place", place).where("place % 10 = 0").select("conv_id", "idx", "norm", "sentence", "nth")
    new = new.withColumn("new_nth", of_kind).select("conv_id", "norm", F.col("sentence").alias("new_sentence"), F.col("idx").alias("new_idx"), "new_nth")
    near = beats.join(new.withColumnRenamed("new_sentence", "sentence"), ["conv_id", "norm", "sentence"])  # within a sentence
    best = near.groupBy("conv_id", "idx").agg(F.min(F.struct(F.abs(F.col("new_idx") - F.col("idx")).alias("far"), "new_idx", "new_nth")).alias("x"))
    found = beats.join(best, ["conv_id", "idx"], "left")
    how = F.when(F.col("x").isNull(), "dropped").when(F.col("x.far") == 0, "kept").otherwise("sentence")
    return found.select("conv_id", "idx", F.col("norm").alias("word"), "nth", F.col("x.new_idx").alias("new_idx"), F.col("x.new_nth").alias("new_nth"), how.alias("how"))


def first_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that show an address (host and path, small, without a slash at the end) first; later ones drop out: (page_id, address, later)."""
    bare = F.regexp_replace(F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^?#]*)", 1)), "/+$", "")
    address = F.regexp_replace(bare, "^(www|m)\\.", "")
    return table(spark, sf_dir, "pages").groupBy(F.regexp_replace(address, "/[0-9]+$", "").alias("address")).agg(F.min("page_id").alias("page_id"), (F.count("*") - 1).alias("later"))


def clip_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site's pages as clips, by their name (small letters) and by when they were made (the number in the address; without one last, then by key)."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]*)", 1))
    name = F.lower(F.regexp_extract(F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "([^/]*)/*$", 1))
    made = F.regexp_extract("url", "page=([0-9]{1,9})", 1)
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(host, "([a-z]+)$", 1).alias("site"), name.alias("name"), F.when(made != "", made.cast("long")).alias("made"))
    by = W.partitionBy("site")
    return rows.select("page_id", "site", F.row_number().over(by.orderBy("name", "page_id")).cast("long").alias("by_name"), F.row_number().over(by.orderBy(F.col("made").asc_nulls_last(), "page_id")).cast("long").alias("by_time"))


def split_word_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences split into words that share their time by letters: (conv_id, sentence, nth, b, e)."""
    rows = sentence_spans(spark, sf_dir).select("conv_id", F.col("sentence").cast("long").alias("sentence"), "start_ms", "end_ms", F.posexplode(F.split("text", " ")).alias("nth", "word"))
    by = W.partitionBy("conv_id", "sentence")
    rows = rows.withColumn("upto", F.sum(F.length("word")).over(by.orderBy("nth").rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum(F.length("word")).over(by))
    place = lambda letters: f"start_ms + (end_ms - start_ms) * ({letters}) div `all`"
    return rows.select("conv_id", "sentence", F.col("nth").cast("long").alias("nth"), F.expr(place("upto - length(word)")).alias("b"), F.expr(place("upto")).alias("e"))


# ---- captions against speech

def _captions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What was heard, and captions of it: every 13th word spelled otherwise, every 29th left out."""
    heard = words(spark, sf_dir).select("conv_id", "idx", F.col("norm").alias("key"), F.col("start_ms").alias("b"), F.col("end_ms").alias("e"))
    shown = heard.where("idx % 29 != 0").withColumn("key", F.when(F.col("idx") % 13 == 0, F.concat(F.col("key"), F.lit("s"))).otherwise(F.col("key")))
    return heard, shown


def caption_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What captions show that wasn't heard so, but for words that the corpus knows (that come KNOWN_TIMES or more): (conv_id, heard, shown, was, now)."""
    heard, shown = _captions(spark, sf_dir)
    known = heard.groupBy(F.col("key").alias("now")).agg(F.count("*").alias("n")).where(F.col("n") >= KNOWN_TIMES).select("now")
    pairs = aligned(heard, shown, "conv_id").where(F.col("what").isin("differ", "new"))
    pairs = pairs.join(heard.select("conv_id", F.col("idx").alias("left"), F.col("key").alias("was")), ["conv_id", "left"], "left").join(shown.select("conv_id", F.col("idx").alias("right"), F.col("key").alias("now")), ["conv_id", "right"])
    return pairs.join(known, "now", "left_anti").select("conv_id", F.col("left").alias("heard"), F.col("right").alias("shown"), "was", "now")


def caption_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that were heard in the spelling that captions have: where the two differ at one time the captions' (the first heard word takes it, further ones go), but what was heard stays if both say the same number: (conv_id, idx, was, now)."""
    heard, shown = _captions(spark, sf_dir)
    pairs = aligned(heard, shown, "conv_id").where("what = 'differ'")
    first = pairs.groupBy("conv_id", "right").agg(F.min("left").alias("taker"))
    pairs = pairs.join(first, ["conv_id", "right"]).join(heard.select("conv_id", F.col("idx").alias("left"), F.col("key").alias("was")), ["conv_id", "left"]).join(shown.select("conv_id", F.col("idx").alias("right"), F.col("key").alias("now")), ["conv_id", "right"])
    same = F.array_join(fuzzy.numbers_folded(F.array("was")), " ") == F.array_join(fuzzy.numbers_folded(F.array("now")), " ")
    pairs = pairs.withColumn("now", F.when(same, F.col("was")).when(F.col("left") == F.col("taker"), F.col("now")))
    spelled = pairs.groupBy("conv_id", F.col("left").alias("idx")).agg(F.min("was").alias("was"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("right", "now"))), lambda x: x["now"]), " ").alias("now"))
    return spelled.where("was != now")


# ---- notes that say the same

def alike_texts(texts: DataFrame, by: str) -> DataFrame:
    """Of distinct texts (by, x), the pairs (by, x, y) that are SAME alike, each text with itself too.

    An equi-join on letters of which such texts must share one (`matching.letters_needed`), and a bound by length; a ratio is taken once for two texts."""
    own = texts.withColumn("letter", F.explode(matching.letters_needed(F.col("x"), SAME_NUM, SAME_DEN)))
    pairs = own.join(own.withColumnRenamed("x", "y"), [by, "letter"]).where("x < y").drop("letter")
    short, both = F.least(F.length("x"), F.length("y")), F.length("x") + F.length("y")
    pairs = pairs.where(2 * SAME_DEN * short >= SAME_NUM * both).distinct()
    alike = pairs.select("x", "y").distinct().where(fuzzy.ratio(F.col("x"), F.col("y")) >= SAME_NUM / SAME_DEN)
    pairs = pairs.join(alike, ["x", "y"]).select(by, "x", "y")
    return pairs.unionByName(pairs.select(by, F.col("y").alias("x"), F.col("x").alias("y"))).unionByName(texts.select(by, "x", F.col("x").alias("y")))


def note_repeats(notes: DataFrame) -> DataFrame:
    """notes (id, scope, video, text) with again: how many notes on other videos of the scope say the same.  Copies are counted, never paired."""
    rows = notes.withColumn("x", F.lower("text"))
    pairs = alike_texts(rows.select("scope", "x").distinct(), "scope")
    counts = rows.groupBy("scope", F.col("x").alias("y"), "video").agg(F.count("*").alias("n"))
    found = pairs.join(counts, ["scope", "y"]).groupBy("scope", "x", "video").agg(F.sum("n").alias("here"))
    totals = found.groupBy("scope", "x").agg(F.sum("here").alias("everywhere"))
    rows = rows.join(totals, ["scope", "x"]).join(found, ["scope", "x", "video"])
    return rows.select(*notes.columns, (F.col("everywhere") - F.col("here")).alias("again"))


def repeated_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as notes on videos of a brand (a size is a video, a type a scope): those that come back, SAME alike, on another video of the same scope, with how many such; and those marked for everyone (a key divisible by 50) that weren't suggested yet (by 100)."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("/", "p_brand", "p_type").alias("scope"), F.col("p_size").alias("video"), F.col("p_name").alias("text"))
    everyone = (F.col("id") % 50 == 0) & (F.col("id") % 100 != 0)
    return note_repeats(rows).where(everyone | (F.col("again") > 0)).select(F.col("id").alias("p_partkey"), "scope", "again", everyone.alias("for_everyone"))


# ---- lint

#: Rules of a document: (level, rule, condition in SQL over text, lines, and first, its first line).
DOCUMENT_RULES = (
    ("FAIL", "no text", "text = ''"), ("FAIL", "a heading that is too long", "length(first) > 300"), ("FAIL", "too many lines", "lines > 30"), ("FAIL", "placeholders left in", "MATCHES(text, '\\\\[[A-Za-z_ ]+\\\\]|TODO|FIXME')"),
    ("FAIL", "speaks as I or you", "MATCHES(lower(first), '^(i|me|my|we|us|our|you|your) ')"), ("WARN", "no end", "text <> '' AND NOT MATCHES(text, '[.!?]\\\\s*$')"), ("WARN", "a backslash", "contains(text, chr(92))"), ("WARN", "shouts", "text <> '' AND text = upper(text)"),
    ("WARN", "a line that is too long", "longest > 2000"), ("WARN", "empty lines in a row", "contains(text, concat(chr(10), chr(10), chr(10)))"),
)
#: Rules of a line of a page's source: (level, rule, regular expression).
LINE_RULES = (
    ("FAIL", "an inline script", r"<script>[^<]"), ("FAIL", "an unclosed bold", r"<b>[^<]*<(br|p)>"), ("WARN", "a style in the page", r"<style>"), ("WARN", "a comment", r"<!--"), ("WARN", "an ad", r"class=.ad."),
    ("WARN", "an entity twice", r"(&amp;|&copy;|&middot;)(&amp;|&copy;|&middot;)"), ("FAIL", "an address without a scheme", r"href=./[A-Za-z]+,"),
)


def _spark_sql(where: str) -> str:
    return where.replace("MATCHES(", "regexp_like(")


def document_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that a document breaks: (doc_id, level, rule)."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.split("text", "\n")
    rows = rows.withColumn("lines", F.size(lines)).withColumn("first", F.get(lines, 0)).withColumn("longest", F.array_max(F.transform(lines, F.length)))
    broken = "array_compact(array(" + ", ".join(f"CASE WHEN {_spark_sql(where)} THEN struct('{level}' AS level, '{rule}' AS rule) END" for level, rule, where in DOCUMENT_RULES) + "))"
    return rows.select("doc_id", F.explode(F.expr(broken)).alias("x")).select("doc_id", "x.level", "x.rule")


def page_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that a line of a page's source breaks (a line ends where a paragraph, a list or a part does), with the line's number: (page_id, line, level, rule)."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split(F.coalesce("html", F.lit("")), "(?<=</p>|</ul>|</div>|</head>)")).alias("line", "source"))
    broken = F.array_compact(F.array(*[F.when(F.col("source").rlike(pattern), F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"))) for level, rule, pattern in LINE_RULES]))
    return rows.select("page_id", (F.col("line") + 1).cast("long").alias("line"), F.explode(broken).alias("x")).select("page_id", "line", "x.level", "x.rule")


QUERIES = {q.__name__: q for q in (checked_finds, lost_openings, cut_transcripts, scene_landings, resolved_references, remapped_beats, first_uses, clip_order, split_word_times, caption_looks, caption_spellings, repeated_notes, document_lint, page_lint)}


def _oracle() -> dict[str, str]:
    from tessella.plans.rules import _CARD
    from tessella.plans.texts import _tokens_sql
    from tessella.plans.words import _GAP_SQL, _islands_sql
    from tessella.plans.words import ORACLE_SQL as words_sql
    from tessella.sources.views import SPANS_SQL

    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOP)
    cards = f"""picked AS (SELECT l_orderkey AS video, CAST(l_linenumber AS BIGINT) AS nr, * FROM lineitem JOIN part ON p_partkey = l_partkey
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_returnflag, l_linestatus, l_quantity, l_partkey, l_suppkey, l_discount, l_tax) = 1),
        cards AS (SELECT {', '.join(f'{sql} AS {name}' for name, sql in _CARD.items())} FROM picked)"""
    listed = "[" + ", ".join(f"CASE WHEN {where.replace('MATCHES(', 'regexp_matches(').replace(chr(92) * 2, chr(92))} THEN {{'level': '{level}', 'rule': '{rule}'}} END" for level, rule, where in DOCUMENT_RULES) + "]"
    lines = "[" + ", ".join(f"CASE WHEN regexp_matches(source, '{pattern}') THEN {{'level': '{level}', 'rule': '{rule}'}} END" for level, rule, pattern in LINE_RULES) + "]"
    return {
        "checked_finds": """WITH f AS (SELECT event_id AS id, CASE WHEN user_id % 2 = 0 THEN 'B' ELSE 'W' END || event_id % 7 AS check_, CASE event_type WHEN 'click' THEN 'restore' WHEN 'view' THEN 'trim' WHEN 'purchase' THEN 'add' WHEN 'signup' THEN 'none' ELSE 'paint' END AS action,
              CASE WHEN event_id % 5 <> 0 THEN event_id % 40 END AS cut, CASE WHEN event_id % 13 <> 0 THEN CAST(floor(value) AS BIGINT) END AS quote, event_id % 3 AS words FROM events),
            r AS (SELECT *, CASE WHEN check_ IN ('B0', 'W6') THEN 'unknown check' WHEN quote IS NULL THEN 'no quote' WHEN action = 'paint' THEN 'unknown action' WHEN action IN ('restore', 'trim') AND cut IS NULL THEN 'needs a cut' WHEN cut >= 30 THEN 'cut out of range'
              WHEN action = 'trim' AND words = 0 THEN 'needs words to keep' WHEN action = 'add' AND words = 1 THEN 'needs evidence' WHEN quote % 10 = 9 THEN 'not in the text' END AS reason FROM f),
            s AS (SELECT *, check_ = 'B3' AND coalesce(cut, 1) % 2 = 0 AND reason IS NULL AS spot FROM r), t AS (SELECT id, CASE WHEN spot THEN 'W5' ELSE check_ END AS check_, CASE WHEN spot AND action = 'restore' THEN 'none' ELSE action END AS action, reason FROM s)
            SELECT id, check_ AS "check", CASE WHEN reason IS NOT NULL THEN 'dropped' WHEN check_ LIKE 'B%' THEN 'blocker' ELSE 'warn' END AS severity, action, reason FROM t""",
        "lost_openings": f"""WITH {_islands_sql('i', 'gap >= 1200 OR after_sentence')}, s AS (SELECT conv_id, island AS sentence, count(*) AS n_words, count(*) FILTER (WHERE idx % 11 < 3) AS n_cut, string_agg(word, ' ' ORDER BY idx) AS text FROM i GROUP BY 1, 2),
            c AS (SELECT *, list_distinct(list_filter({_tokens_sql('text')}, lambda w: w NOT IN ({stop}))) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY sentence) AS nth FROM s),
            f AS (SELECT * FROM c WHERE nth <= {OPENINGS} AND n_words >= {OPENING_WORDS} AND len(c) >= {OPENING_CONTENT} AND NOT EXISTS (SELECT 1 FROM c l WHERE l.conv_id = c.conv_id AND l.sentence > c.sentence AND len(list_intersect(c.c, l.c)) * 10 >= len(c.c) * 6)),
            k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY sentence) = 1) SELECT conv_id, CAST(sentence AS BIGINT) AS sentence, n_words, n_cut FROM k WHERE n_cut * 2 >= n_words""",
        "cut_transcripts": f"""WITH {_GAP_SQL}, a AS (SELECT *, idx % 11 < 3 AS is_cut, greatest(coalesce(gap, 0), 0) AS pause FROM gaps), b AS (SELECT *, CASE WHEN is_cut THEN pause ELSE pause // 2 END AS removed, CASE WHEN is_cut THEN 0 ELSE end_ms - start_ms END AS plays FROM a),
            c AS (SELECT *, CAST(removed >= {CHIP_MS} AS BIGINT) AS chip, coalesce(sum(plays + pause - removed) OVER p, 0) + pause - removed AS plays_at, coalesce(sum(CAST(ends_sentence AS BIGINT)) OVER p, 0) AS sentence FROM b WINDOW p AS (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
            d AS (SELECT *, (CAST(sum(1 + chip) OVER (PARTITION BY conv_id, sentence ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1) // {LINE_TOKENS} AS part FROM c),
            l AS (SELECT conv_id, min(idx) AS first, CAST(min(CASE WHEN NOT is_cut THEN plays_at END) AS BIGINT) AS plays_at, count(*) AS words, count(*) FILTER (WHERE is_cut) AS cut, CAST(sum(chip) AS BIGINT) AS chips FROM d GROUP BY conv_id, sentence, part)
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY first) AS line, plays_at AS "at", words, cut, chips FROM l""",
        "scene_landings": f"""WITH {SPANS_SQL}, s AS (SELECT user_id, id, b, id % 4 = 0 AS hard FROM spans WHERE kind = 'purchase'), v AS (SELECT user_id, b FROM spans WHERE kind = 'view'),
            f AS (SELECT s.user_id, s.id, s.b, hard, min(v.b) AS word FROM s LEFT JOIN v ON v.user_id = s.user_id AND v.b >= s.b - {SLACK_US} GROUP BY ALL)
            SELECT user_id, id, coalesce(word, b + CASE WHEN hard THEN 0 ELSE {LEAD_US} END) AS word, b + CASE WHEN hard THEN 0 ELSE {LANDED_US} END AS landed FROM f""",
        "resolved_references": f"""WITH {cards}, t AS (SELECT video, max(title) AS last_title FROM cards GROUP BY 1),
            r AS (SELECT o_orderkey AS video, CASE o_orderkey % 4 WHEN 0 THEN 'card:' || o_orderkey // 4 % 6 WHEN 1 THEN '0:' || lpad(CAST(o_orderkey // 4 % 60 AS VARCHAR), 2, '0') WHEN 2 THEN (o_orderkey // 4 % 90) || 's' ELSE coalesce(last_title, 'none') || '@' || (o_orderkey // 4 % 2 + 1) END AS ref,
              CASE o_orderkey % 4 WHEN 0 THEN o_orderkey // 4 % 6 END AS number, CASE o_orderkey % 4 WHEN 1 THEN o_orderkey // 4 % 60 WHEN 2 THEN o_orderkey // 4 % 90 END AS t, CASE WHEN o_orderkey % 4 = 3 THEN coalesce(last_title, 'none') END AS word, o_orderkey // 4 % 2 + 1 AS nth FROM orders LEFT JOIN t ON video = o_orderkey),
            c AS (SELECT *, row_number() OVER (PARTITION BY video, title ORDER BY nr) AS of_title FROM cards),
            k AS (SELECT r.video, ref, nr, CASE WHEN number = nr THEN 0 WHEN t >= b AND t < e THEN 0 WHEN least(abs(b - t), abs(e - t)) < 5 THEN 1 + abs(b - t) WHEN lower(word) = lower(title) AND nth = of_title THEN 0 END AS rank FROM r LEFT JOIN c ON c.video = r.video)
            SELECT video, ref, CASE WHEN count(rank) > 0 THEN (list(nr ORDER BY rank, nr) FILTER (WHERE rank IS NOT NULL))[1] END AS card FROM k GROUP BY 1, 2""",
        "remapped_beats": f"""WITH {_islands_sql('i', 'gap >= 1200 OR after_sentence')}, o AS (SELECT conv_id, idx, norm, island, row_number() OVER (PARTITION BY conv_id, norm ORDER BY idx) AS nth, row_number() OVER (PARTITION BY conv_id ORDER BY idx) AS place FROM i WHERE idx % 11 >= 3),
            n AS (SELECT conv_id, idx, norm, island, row_number() OVER (PARTITION BY conv_id, norm ORDER BY idx) AS nth FROM i WHERE idx % 13 >= 4),
            b AS (SELECT o.conv_id, o.idx, o.norm, o.nth, n.idx AS new_idx, n.nth AS new_nth, abs(n.idx - o.idx) AS far FROM o LEFT JOIN n ON n.conv_id = o.conv_id AND n.norm = o.norm AND n.island = o.island WHERE o.place % 10 = 0
                  QUALIFY row_number() OVER (PARTITION BY o.conv_id, o.idx ORDER BY abs(n.idx - o.idx), n.idx) = 1)
            SELECT conv_id, idx, norm AS word, nth, new_idx, new_nth, CASE WHEN new_idx IS NULL THEN 'dropped' WHEN far = 0 THEN 'kept' ELSE 'sentence' END AS how FROM b""",
        "first_uses": r"""SELECT regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^?#]*)', 1)), '/+$', ''), '^(www|m)\.', ''), '/[0-9]+$', '') AS address, min(page_id) AS page_id, count(*) - 1 AS later FROM pages GROUP BY 1""",
        "clip_order": r"""WITH c AS (SELECT page_id, regexp_extract(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '([a-z]+)$', 1) AS site, lower(regexp_extract(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '([^/]*)/*$', 1)) AS name, TRY_CAST(nullif(regexp_extract(url, 'page=([0-9]{1,9})', 1), '') AS BIGINT) AS made FROM pages)
            SELECT page_id, site, row_number() OVER (PARTITION BY site ORDER BY name, page_id) AS by_name, row_number() OVER (PARTITION BY site ORDER BY made NULLS LAST, page_id) AS by_time FROM c""",
        "split_word_times": f"""WITH s AS ({words_sql['sentence_spans']}), w AS (SELECT conv_id, sentence, start_ms, end_ms, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS nth FROM s),
            u AS (SELECT *, CAST(sum(length(word)) OVER (PARTITION BY conv_id, sentence ORDER BY nth ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto, CAST(sum(length(word)) OVER (PARTITION BY conv_id, sentence) AS BIGINT) AS whole FROM w)
            SELECT conv_id, sentence, nth, start_ms + (end_ms - start_ms) * (upto - length(word)) // whole AS b, start_ms + (end_ms - start_ms) * upto // whole AS e FROM u""",
        "document_lint": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), l AS (SELECT doc_id, text, len(ls) AS lines, ls[1] AS first, list_max(list_transform(ls, lambda x: length(x))) AS longest FROM d)
            SELECT doc_id, x.level AS level, x.rule AS rule FROM (SELECT doc_id, unnest(list_filter({listed}, lambda x: x IS NOT NULL)) AS x FROM l)""",
        "page_lint": f"""WITH p AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(</p>|</ul>|</div>|</head>)', '\\1' || chr(1), 'g') AS h FROM pages),
            l AS (SELECT page_id, unnest(string_split(h, chr(1))) AS source, generate_subscripts(string_split(h, chr(1)), 1) AS line FROM p)
            SELECT page_id, line, x.level AS level, x.rule AS rule FROM (SELECT page_id, line, unnest(list_filter({lines}, lambda x: x IS NOT NULL)) AS x FROM l)""",
    }


ORACLE_SQL = _oracle()
