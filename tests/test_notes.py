"""Notes that say the same, and captions against speech, against brute force and fixtures."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tessella.plans import notes


def same(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.8


def test_note_repeats(spark):
    rng = random.Random(1)
    texts = ["Keep the blue box", "keep the blue boxes", "Less zoom here", "less zooms here", "none", "", "a", "Keep the red box!"]
    rows = [(n, rng.choice("st"), rng.randrange(4), rng.choice(texts)) for n in range(120)]
    found = {r.id: r.again for r in notes.note_repeats(spark.createDataFrame(rows, "id long, scope string, video long, text string")).collect()}
    expected = {n: sum(t == s and w != v and (same(b.lower(), x.lower()) if b.lower() < x.lower() else same(x.lower(), b.lower())) for _, t, w, b in rows) for n, s, v, x in rows}
    assert found == expected and any(expected.values())


def test_alike_texts_leaves_no_pair_out(spark):
    rng = random.Random(2)
    texts = list({"".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 14))) for _ in range(150)})
    texts += [t + rng.choice("abc") for t in texts[:60]]
    texts = sorted(set(texts))
    found = notes.alike_texts(spark.createDataFrame([("s", t) for t in texts], "k string, x string"), "k")
    expected = {(a, b) for a in texts for b in texts if a == b or same(min(a, b), max(a, b))}
    assert {(r.x, r.y) for r in found.collect()} == expected and len(expected) > len(texts) + 40


def conversation(spark, tmp_path, text):
    spark.createDataFrame([(1, 0, text)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_captions(spark, tmp_path):
    """Word 13 is spelled otherwise and word 26 too, but that spelling is one that the corpus knows."""
    said = [f"w{k}x" for k in range(40)]
    said[25], said[30], said[31], said[32] = "plan", "plans", "plans", "plans"
    folder = conversation(spark, tmp_path, " ".join(said) + ".")
    looks = {(r.heard, r.was, r.now) for r in notes.caption_looks(spark, folder).collect()}
    assert looks == {(13, said[12], said[12] + "s"), (39, said[38], said[38] + "s")}
    spelled = {(r.idx, r.was, r.now) for r in notes.caption_spellings(spark, folder).collect()}
    assert {(13, said[12], said[12] + "s"), (26, "plan", "plans"), (39, said[38], said[38] + "s")} <= spelled


def test_lines_of_a_transcript(spark, tmp_path):
    """Twenty-four tokens make a line, and a sentence ends one."""
    folder = conversation(spark, tmp_path, " ".join(["word"] * 30) + ". " + " ".join(["next"] * 5) + ".")
    rows = notes.cut_transcripts(spark, folder).orderBy("line").collect()
    assert [r.words for r in rows] == [24, 6, 5] and sum(r.chips for r in rows) == sum(r.chips for r in rows if r.line == 3)
    assert all(a.at < b.at for a, b in zip(rows, rows[1:], strict=False)) and sum(r.cut for r in rows) == sum(i % 11 < 3 for i in range(1, 36))


def test_references(spark, tmp_path):
    found = notes.content(F.lit("the Plan, the plan and a Box"))
    assert spark.range(1).select(found.alias("c")).first().c == ["plan", "box"]
