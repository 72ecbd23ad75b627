"""Where a text is said: windows like a phrase, words close in spelling and time, and takes of a script's lines.

Candidates come from equi-joins on what any match must share (a rare word, a letter, a run of words); ratios are
taken of candidates alone, and bounds before them never leave a match out."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessella.operators import fuzzy, sequential
from tessella.operators.lineage import cut

#: Rows that are broadcast at most: words or pairs in a filter, each some tens of bytes.
BROADCAST_ROWS = 200_000


def _small(df: DataFrame) -> DataFrame:
    """df, written down, and to be broadcast if it has few rows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


# ---- windows like a phrase

def anchors(phrases: DataFrame, counts: DataFrame, num: int, den: int) -> DataFrame:
    """(phrase, word, size, least): of each phrase (phrase, words) its rarest words, so many that a window with num / den of the phrase's words has `least` of them (two, or one if one is all it needs).

    counts: (word, n) of the texts; a word that they don't have can't be in a window and counts as the rarest."""
    rows = phrases.select("phrase", F.size("words").alias("size"), F.explode("words").alias("word")).join(counts, "word", "left")
    rank = F.row_number().over(W.partitionBy("phrase").orderBy(F.coalesce("n", F.lit(0)), "word"))
    need = F.ceil(F.col("size") * num / den)
    rows = rows.withColumn("rank", rank).withColumn("least", F.least(F.lit(2), need).cast("int"))
    return rows.where((F.col("rank") <= F.col("size") - need + F.col("least")) & F.col("n").isNotNull()).select("phrase", "word", "size", "least").distinct()


def common_in_order(words: Sequence[str], masks: dict[str, int], size: int) -> int:
    """The longest common subsequence of words and a text of `size` words, whose places are masks' bits: as many words as blocks can match at most."""
    free = whole = (1 << size) - 1
    for word in words:
        if mask := masks.get(word):
            met = free & mask
            free = (free + met | free - met) & whole
    return size - free.bit_count()


def _best_among(words: pd.Series, phrase: pd.Series, least: pd.Series) -> pd.Series:
    """Of each stretch of words: the windows in it that are as long as the phrase (all of it, if it is shorter), as [offset, score in thousandths], from the least score on.

    What a window has in common with the phrase is kept as it moves on by a word; blocks are matched where enough of it comes in the phrase's order alone."""
    out = []
    for own, said, low in zip(words, phrase, least, strict=True):
        own, said = list(own), list(said)
        n, wanted, found = len(said), Counter(said), []
        size, have, bag, masks = min(n, len(own)), Counter(), 0, {}
        for k, word in enumerate(said):
            masks[word] = masks.get(word, 0) | 1 << k
        for end, word in enumerate(own):
            if word in wanted:
                have[word] += 1
                bag += have[word] <= wanted[word]
            start = end - size + 1
            if start > 0 and own[start - 1] in wanted:
                bag -= have[own[start - 1]] <= wanted[own[start - 1]]
                have[own[start - 1]] -= 1
            if start >= 0 and 2 * bag * 1000 >= low * (n + size) and 2 * common_in_order(own[start : end + 1], masks, n) * 1000 >= low * (n + size):
                score = round(1000 * fuzzy.list_ratio(own[start : end + 1], said))
                if score >= low:
                    found.append((start, score))
        out.append(found)
    return pd.Series(out, dtype="object")


def phrase_windows(texts: DataFrame, phrases: DataFrame, num: int = 6, den: int = 10, top: int = 3, apart: int = 3_000) -> DataFrame:
    """Where texts (doc, words, starts: arrays) say phrases (phrase, words): (phrase, doc, place, start, score), of windows as long as the phrase (the whole text, if that is shorter) and at least num / den like it the `top` best whose starts are over `apart` apart; ties go to the earliest.

    Equi-join on a phrase's rarest words; only windows that hold two of them are looked at, each once, with the first two that it holds.  The texts are read several times, so they are written down as words once; a text meets all that is looked at in it in one row, so its words aren't copied for each."""
    texts = cut(texts)
    said = texts.select("doc", F.size("words").alias("n_words"), F.posexplode("words").alias("place", "word"))
    every = _small(phrases.select("phrase", F.size("words").alias("size"), F.explode(F.array_distinct("words")).alias("word")))
    counts = said.join(every.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    rare = anchors(phrases, counts, num, den)
    hits = said.join(_small(rare), "word").where("n_words >= size").select("doc", "phrase", "place", "n_words", "size", "least").repartition("doc")
    order = W.partitionBy("doc", "phrase").orderBy("place")
    end = F.when(F.col("least") == 1, F.col("place")).otherwise(F.lead("place").over(order))
    whole = hits.withColumn("end", end).withColumn("before", F.coalesce(F.lag("place").over(order), F.lit(-1))).where(F.col("end") - F.col("place") < F.col("size"))
    first, last = F.greatest(F.col("before") + 1, F.col("end") - F.col("size") + 1, F.lit(0)), F.least("place", F.col("n_words") - F.col("size"))
    whole = whole.select("doc", "phrase", first.alias("first"), last.alias("last")).where("first <= last")
    # a text shorter than the phrase is one window; as many of its words as are like it must be the phrase's
    longest = phrases.agg(F.max(F.size("words"))).first()[0] or 0
    short = said.where(F.col("n_words") < longest).join(every, "word").where("n_words < size").groupBy("doc", "phrase", "n_words", "size").agg(F.count("*").alias("shared"))
    short = short.where(2 * den * F.col("shared") >= num * (F.col("size") + F.col("n_words")))
    hits = whole.unionByName(short.select("doc", "phrase", F.lit(0).alias("first"), F.lit(0).alias("last")))
    hits = hits.join(_small(phrases.select("phrase", F.size("words").alias("size"))), "phrase")
    per = hits.groupBy("doc").agg(F.collect_list(F.struct("phrase", "first", "last", "size")).alias("all"))

    def places(column: str, first: Column, last: Column) -> Column:
        # by place: slice() makes objects of the whole array each time
        return F.transform(F.sequence(first, last), lambda k: F.get(column, k))

    def part(x: Column) -> Column:
        end = F.least(x["last"] + x["size"], F.size("words")) - 1
        return F.struct(x["phrase"].alias("phrase"), x["first"].alias("first"), places("words", x["first"], end).alias("stretch"), places("starts", x["first"], x["last"]).alias("starts"))

    rows = texts.hint("merge").join(per, "doc").select("doc", F.explode(F.transform("all", part)).alias("x")).select("doc", "x.*")
    rows = rows.join(_small(phrases.select("phrase", F.col("words").alias("said"))), "phrase")
    shared = F.size(F.filter("stretch", lambda w: F.array_contains("said", w)))
    rows = rows.where(2 * den * shared >= num * (F.size("said") + F.least(F.size("said"), F.size("stretch"))))
    among = pandas_udf(_best_among, "array<struct<place: int, score: int>>")("stretch", "said", F.lit(1000 * num // den))
    rows = rows.select("phrase", "doc", "first", "starts", F.explode(among).alias("x"))
    rows = rows.select("phrase", "doc", (F.col("first") + F.col("x.place")).cast("long").alias("place"), F.get("starts", F.col("x.place")).alias("start"), F.col("x.score").cast("long").alias("score"))
    spaced = rows.withColumn("b", F.col("start")).withColumn("e", F.col("start") + apart + 1)
    return sequential.shortlist(spaced, ["phrase", "doc"], "score", ["b", "place"], top).where("kept").select("phrase", "doc", "place", "start", "score")


# ---- words close in spelling and time

def letters_needed(word: Column, num: int, den: int) -> Column:
    """Letters of word (each with which of its kind it is), the rarest of English first, so many that a word at least num / den like it has one of them.

    Words of ratio r share r / 2 of both their letters, and the other's length is bound by r; so all but r / (2 - r) of the word's letters, and one."""
    letters = F.split(word, "")
    order = F.array(*[F.lit(c) for c in "zqxjkvbpygfwmucldrhsnioate"])  # by how often English has them
    kind = F.transform(F.array_distinct(letters), lambda c: F.struct(F.when(F.array_contains(order, c), F.array_position(order, c)).otherwise(F.lit(0).cast("long")).alias("rank"), c.alias("letter"), (F.length(word) - F.length(F.replace(word, c, F.lit("")))).alias("n")))
    each = F.flatten(F.transform(F.array_sort(kind), lambda k: F.transform(F.sequence(F.lit(1), k["n"]), lambda i: F.concat(k["letter"], i.cast("string")))))
    need = F.ceil(F.length(word) * F.lit(num) / F.lit(2 * den - num))
    return F.when(F.length(word) > 0, F.slice(each, 1, F.greatest(F.lit(1), (F.length(word) - need + 1).cast("int")))).otherwise(F.array().cast("array<string>"))


def close_in_time(tokens: DataFrame, words: DataFrame, on: Sequence[str], width: int, num: int, den: int) -> DataFrame:
    """tokens (on, token, b, e and others) with words (on, word, s) that start from b to e and are num / den alike: all pairs, with ratio.

    An equi-join on time bucket (of width, about as long as b to e) and letter; a word's ratio to a token is taken once, however often the two meet."""
    left = tokens.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("b") / width), F.floor(F.col("e") / width)))).withColumn("__letter", F.explode(letters_needed(F.col("token"), num, den)))
    right = words.select(*on, "word", "s", F.floor(F.col("s") / width).alias("__bucket"), F.explode(letters_needed(F.col("word"), num, den)).alias("__letter"))
    pairs = left.join(right, [*on, "__bucket", "__letter"]).where((F.col("s") >= F.col("b")) & (F.col("s") <= F.col("e")))
    shorter, both = F.least(F.length("token"), F.length("word")), F.length("token") + F.length("word")
    pairs = pairs.where(2 * den * shorter >= num * both).drop("__bucket", "__letter").distinct()
    ratios = pairs.select("token", "word").distinct().withColumn("ratio", fuzzy.ratio(F.col("token"), F.col("word"))).where(F.col("ratio") >= num / den)
    return pairs.join(ratios, ["token", "word"])


@lru_cache(maxsize=200_000)
def _ratio_of(token: str, word: str) -> float:
    return fuzzy.list_ratio(token, word)


def places_alike(tokens: Column, words: Column, num: int, den: int) -> Column:
    """For each of an array of tokens the places (from 0) in an array of words that are at least num / den like it.

    Two words have at most their letters in common, so a ratio is taken where those are enough alone."""

    def alike(token: str, word: str) -> bool:
        most = 2 * (fuzzy.letters(token) & fuzzy.letters(word)).bit_count()
        return most > 0 and den * most >= num * (len(token) + len(word)) and _ratio_of(token, word) >= num / den

    def run(own: pd.Series, said: pd.Series) -> pd.Series:
        return pd.Series([[[k for k, word in enumerate(y) if alike(token, word)] for token in x] for x, y in zip(own, map(list, said), strict=True)], dtype="object")

    return pandas_udf(run, "array<array<int>>")(tokens, words)


def first_later(found: DataFrame, by: Sequence[str], nth: str, begin: Column, back: int) -> DataFrame:
    """Of found (by, nth, s, begin's columns): each of a key's tokens in order takes the first s that isn't over `back` before what the one before took (the first: before begin): (by, hits), hits an array of struct(nth, s).

    A key is a caption; its tokens are folded in the row."""
    per = found.groupBy(*by, nth).agg(F.array_sort(F.collect_set("s")).alias("all"), F.min(begin).alias("__begin"))
    rows = per.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(nth, "all"))).alias("tokens"), F.min("__begin").alias("__begin"))
    none = F.array().cast(f"array<struct<{nth}: {found.schema[nth].dataType.simpleString()}, s: {found.schema['s'].dataType.simpleString()}>>")

    def take(state: Column, token: Column) -> Column:
        first = F.get(F.filter(token["all"], lambda s: s >= state["after"] - back), 0)
        return F.when(first.isNull(), state).otherwise(F.struct(first.alias("after"), F.concat(state["hits"], F.array(F.struct(token[nth].alias(nth), first.alias("s")))).alias("hits")))

    folded = F.aggregate("tokens", F.struct(F.col("__begin").alias("after"), none.alias("hits")), take)
    return rows.select(*by, folded["hits"].alias("hits"))


# ---- takes of a script's lines

def exclusive(df: DataFrame, by: Sequence[str], order: Sequence, name: str = "kept") -> DataFrame:
    """df with name: whether a row's interval [b, e) meets none of the rows kept before it in the given order.  State: the kept intervals, sorted; only neighbours are looked at."""

    def make() -> Any:
        def step(state: dict, row: Any) -> bool:
            begins, ends = state.setdefault("b", []), state.setdefault("e", [])
            place = bisect_left(begins, row.b)
            free = (not place or ends[place - 1] <= row.b) and (place == len(begins) or row.e <= begins[place])
            if free:
                begins.insert(place, row.b)
                ends.insert(place, row.e)
            return free

        return step

    return sequential.sequential(df, by, order, make, name, "boolean")


def runs_of(hits: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """Of hits (by, size, lpos, dpos: places of equal runs of n words in a line of `size` words and in a text): (by, size, first, last, got, upto), one row for each time the line is gone through.

    A new time begins where the line begins again, or more of the text lies between two hits than of the line, by more than a quarter of it (2 at least)."""
    order = W.partitionBy(*by).orderBy("dpos", "lpos")
    slack = F.greatest(F.lit(2), F.expr("size div 4"))
    rows = hits.withColumn("__l", F.lag("lpos").over(order)).withColumn("__d", F.lag("dpos").over(order))
    new = F.col("__l").isNull() | (F.col("lpos") <= F.col("__l")) | (F.col("dpos") - F.col("__d") > F.col("lpos") - F.col("__l") + slack)
    rows = rows.withColumn("__run", F.sum(new.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("__got", F.when(new, F.lit(n)).otherwise(F.least(F.lit(n), F.col("lpos") - F.col("__l"))))
    found = rows.groupBy(*by, "size", "__run").agg(F.min("dpos").alias("first"), (F.max("dpos") + n - 1).alias("last"), F.sum("__got").cast("long").alias("got"), (F.max("lpos") + n).alias("upto"))
    return found.drop("__run")
