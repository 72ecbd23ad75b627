"""Windows, close words and takes against brute force without indexes."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tessella.operators import matching, membership
from tessella.plans import matching as plans


def ratio(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_letters_that_a_like_word_must_share(spark):
    """No pair of words that are alike is left out by the letters that they are joined by."""
    rng = random.Random(1)
    words = list({"".join(rng.choice("abeetz'1é") for _ in range(rng.randrange(1, 8))) for _ in range(250)})
    for num, den in ((7, 10), (75, 100), (1, 2)):
        rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", matching.letters_needed(F.col("w"), num, den).alias("letters")).collect()
        needed = {r.w: set(r.letters) for r in rows}
        alike = [(a, b) for a in words for b in words if ratio(a, b) >= num / den]
        assert len(alike) > len(words) and all(needed[a] & needed[b] for a, b in alike)
    assert spark.range(1).select(matching.letters_needed(F.lit(""), 7, 10).alias("x")).first().x == []


def test_close_in_time(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abct") for _ in range(rng.randrange(1, 6)))
    tokens = [(rng.randrange(3), n, word(), t - 40, t + 25) for n, t in enumerate(rng.choices(range(600), k=80))]
    words = [(rng.randrange(3), word(), rng.randrange(600)) for _ in range(900)]
    found = matching.close_in_time(spark.createDataFrame(tokens, "k long, n long, token string, b long, e long"), spark.createDataFrame(words, "k long, word string, s long"), ["k"], 50, 7, 10)
    expected = {(k, n, w, s) for k, n, t, b, e in tokens for j, w, s in words if j == k and b <= s <= e and ratio(t, w) >= 0.7}
    assert {(r.k, r.n, r.word, r.s) for r in found.collect()} == expected and len(expected) > 50


def test_first_later(spark):
    rows = [(1, 1, 10, 0), (1, 1, 50, 0), (1, 2, 5, 0), (1, 2, 30, 0), (1, 3, 29, 0), (1, 4, 20, 0), (2, 1, 7, 9)]
    found = matching.first_later(spark.createDataFrame(rows, "k long, nth long, s long, t0 long"), ["k"], "nth", F.col("t0"), 2)
    assert {r.k: [tuple(h) for h in r.hits] for r in found.collect()} == {1: [(1, 10), (2, 30), (3, 29)], 2: [(1, 7)]}


def test_phrase_windows(spark):
    rng = random.Random(3)
    vocabulary = ["the", "of", "a", "red", "plan", "cost", "x", "y", "zeta"]
    texts = [(d, rng.choices(vocabulary, k=n)) for d, n in enumerate([0, 1, 2, 3, 3, 4, 5, 60, 200, 400])]
    phrases = [(p, rng.choices(vocabulary, k=rng.randrange(1, 8))) for p in range(12)] + [(99, ["never", "said", "here"]), (98, ["zeta", "never", "plan", "cost"])]
    rows = [(d, w, [k * 700 for k in range(len(w))]) for d, w in texts]
    found = matching.phrase_windows(spark.createDataFrame(rows, "doc long, words array<string>, starts array<long>"), spark.createDataFrame(phrases, "phrase long, words array<string>"))
    expected = set()
    for p, said in phrases:
        for d, own in texts:
            n, hits = len(said), []
            for start in range(len(own)):
                window = own[start : start + n]
                if (start + n <= len(own) or start == 0) and round(1000 * ratio(window, said)) >= 600:
                    hits.append((-round(1000 * ratio(window, said)), start))
            kept = []
            for score, start in sorted(hits):
                if len(kept) < 3 and all(abs(start - other) * 700 > 3_000 for _, other in kept):
                    kept.append((score, start))
            expected |= {(p, d, start, start * 700, -score) for score, start in kept}
    assert {tuple(r) for r in found.collect()} == expected and len(expected) > 60


def test_exclusive(spark):
    rng = random.Random(4)
    rows = [(k, n, b, b + rng.randrange(1, 20), rng.randrange(5)) for k in range(5) for n, b in enumerate(rng.choices(range(150), k=40))]
    found = matching.exclusive(spark.createDataFrame(rows, "k long, n long, b long, e long, rank long"), ["k"], ["rank", "n"])
    expected = set()
    for k in range(5):
        kept = []
        for _, n, b, e, _ in sorted((r for r in rows if r[0] == k), key=lambda r: (r[4], r[1])):
            if all(e <= x or y <= b for x, y in kept):
                kept.append((b, e))
                expected.add((k, n))
    assert {(r.k, r.n) for r in found.where("kept").collect()} == expected


def test_among_loses_nothing(spark, monkeypatch):
    values = spark.range(0, 5_000, 7).withColumnRenamed("id", "v")
    rows = spark.range(-10, 5_000).withColumnRenamed("id", "key")
    assert {r.key for r in membership.among(rows, "key", values).collect()} == set(range(0, 5_000, 7))
    monkeypatch.setattr(membership, "MOST_BITS", 1 << 15)
    many = spark.range(0, 400_000, 2).select((F.col("id") * 7_919).alias("v"))
    assert membership.among(many.withColumnRenamed("v", "key"), "key", many).count() == 200_000
    assert membership.among(rows, "key", values.limit(0)).count() == 0


def script_tables(spark, folder, lines, docs):
    spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(docs)], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")


A, B, C = "we open the box with great care", "then the small motor begins to turn", "nobody expected such a quiet sound"


def test_takes_and_the_one_that_stays(spark, tmp_path):
    docs = [
        f"{A}. {A}. {B}.",  # said again: the last whole take stays
        f"we open the box with. hm. {A}",  # a start that breaks off, then a whole one
        f"well well well well well {C} and so on and so on",  # words off the script around it
        None,
        "",
        f"{A} {B}",
    ]
    script_tables(spark, tmp_path, [f"{A}. {B}", C, "too short"], docs)
    found = {(r.doc_id, r.line, r["first"], r["last"], r.whole, r.stays) for r in plans.script_takes(spark, str(tmp_path)).collect()}
    assert {r for r in found if r[0] == 0} == {(0, 0, 0, 6, True, False), (0, 0, 7, 13, True, True), (0, 1, 14, 20, True, True)}
    assert {r for r in found if r[0] == 1} == {(1, 0, 0, 4, False, False), (1, 0, 6, 12, True, True)}
    assert {r for r in found if r[0] == 2} == {(2, 1000, 5, 10, True, True)}
    assert {r[0] for r in found} == {0, 1, 2, 5}
    off = {(r.doc_id, r.b, r.e) for r in plans.off_script(spark, str(tmp_path)).collect()}
    assert off == {(2, 0, 4), (2, 11, 16)}


def test_takes_of_a_line_that_the_script_says_twice(spark, tmp_path):
    """A, B, A, C: copies of A are told apart by their neighbours, then by order; one too many in the middle is nobody's."""
    docs = [f"{A} {B} {A} {C}", f"{B} {A} {C}", f"{A} {A}", f"{A} um {A} um {A}", f"{A}"]
    script_tables(spark, tmp_path, [A, B, A, C], docs)
    found = {}
    for r in plans.script_takes(spark, str(tmp_path)).collect():
        found.setdefault(r.doc_id, []).append((r["first"], r.line, r.stays))
    found = {k: sorted(v, key=str) for k, v in found.items()}
    assert found[0] == [(0, 0, True), (14, 2000, True), (21, 3000, True), (7, 1000, True)]
    assert found[1] == [(0, 1000, True), (14, 3000, True), (7, 2000, True)]
    assert found[2] == [(0, 0, True), (7, 2000, True)]
    assert found[3] == [(0, 0, True), (16, 2000, True), (8, None, False)]
    assert found[4] == [(0, 2000, True)]


def test_places_alike(spark):
    """Against ratios of all pairs."""
    rng = random.Random(21)
    rows = [tuple(["".join(rng.choice("abcde") for _ in range(rng.randrange(0, 7))) for _ in range(n)] for n in (6, 15)) for _ in range(60)]
    found = spark.createDataFrame(rows, "x array<string>, y array<string>").select("x", "y", matching.places_alike(F.col("x"), F.col("y"), 7, 10).alias("at")).collect()
    assert all(r.at == [[k for k, w in enumerate(r.y) if t and w and SequenceMatcher(None, t, w, autojunk=False).ratio() >= 0.7] for t in r.x] for r in found) and any(any(r.at) for r in found)
