"""Operators on small inputs against brute force."""

import random
from itertools import combinations
import statistics
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tessella.functions import colour, text
from tessella.operators import aggregates, alignment, fuzzy, intervals, prefix, sequential
from tessella.operators.asof import asof
from tessella.operators.islands import integer_runs
from tessella.plans import fuzzy as fuzzy_plans
from tessella.plans import streams
from tessella.plans.videos import compare
from tessella.sources import documents


@pytest.fixture(scope="module")
def spans():
    rng = random.Random(3)
    return [(k % 3, k, b := rng.randrange(0, 500), b + rng.randrange(0, 40)) for k in range(120)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, id long, b long, e long")


def test_union_and_complement(spark, spans):
    found = {tuple(r) for r in intervals.union(frame(spark, spans), ["k"]).select("k", "b", "e").collect()}
    expected = set()
    for k in range(3):
        merged = []
        for b, e in sorted((b, e) for g, _, b, e in spans if g == k):
            if merged and b <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([b, e])
        expected |= {(k, b, e) for b, e in merged}
    assert found == expected
    gaps = {tuple(r) for r in intervals.complement(frame(spark, spans), ["k"]).collect()}
    by_key = {k: sorted(x[1:] for x in expected if x[0] == k) for k in range(3)}
    assert gaps == {(k, a[1], b[0]) for k, v in by_key.items() for a, b in zip(v, v[1:])}


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_overlap_join_gives_each_pair_once(spark, spans, width):
    other = [(k, i + 1000, b + 5, e + 5) for k, i, b, e in spans]
    right = frame(spark, other).withColumnRenamed("id", "other")
    found = sorted((r.id, r.other) for r in intervals.overlap_join(frame(spark, spans), right, ["k"], width).collect())
    assert found == sorted((i, j) for k, i, b, e in spans for g, j, rb, re in other if k == g and b < re and rb < e)


def test_difference_covers_what_cuts_leave(spark, spans):
    cuts = [(k, i, b, b + (e - b) // 2) for k, i, b, e in spans if i % 4 == 0]
    found = intervals.difference(frame(spark, spans), frame(spark, cuts), ["k"], ["id"], 50).collect()
    left = {}
    for r in found:
        left.setdefault(r.id, set()).update(range(r.b, r.e))
    for k, i, b, e in spans:
        gone = {t for g, _, cb, ce in cuts if g == k for t in range(cb, ce)}
        assert left.get(i, set()) == set(range(b, e)) - gone


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_asof(spark, direction):
    rng = random.Random(5)
    left = [(k % 2, k, rng.randrange(50)) for k in range(40)]
    right = [(k % 2, 100 + k, rng.randrange(50)) for k in range(15)]
    found = asof(spark.createDataFrame(left, "k long, id long, t long"), spark.createDataFrame(right, "k long, rid long, rt long"), ["k"], "t", "rt", "rid", direction)
    for r in found.collect():
        own = [(rt, rid) for k, rid, rt in right if k == r.k]
        back, ahead = [x for x in own if x[0] <= r.t], [x for x in own if x[0] >= r.t]
        if direction == "backward":
            expected = max(back, default=None)
        elif direction == "forward":
            expected = min(ahead, default=None)
        else:
            expected = min((abs(rt - r.t), rt) for rt, _ in own)
        got = None if r.found is None else (r.found.rt, r.found.rid)
        assert (abs(got[0] - r.t), got[0]) == expected if direction == "nearest" else got == expected


def test_runs_and_mode(spark):
    runs = integer_runs(spark.createDataFrame([("a", x) for x in (1, 2, 3, 3, 7, 9, 10)], "k string, x long"), ["k"], "x")
    assert {(r.lo, r.hi, r.n) for r in runs.collect()} == {(1, 3, 3), (7, 7, 1), (9, 10, 2)}
    rows = spark.createDataFrame([("a", "y", 2), ("a", "x", 3), ("a", "x", 4), ("a", "y", 5), ("b", None, 1)], "k string, v string, at long")
    assert [(r.k, r["mode"], r.n) for r in aggregates.ordered_mode(rows, ["k"], "v", "at").collect()] == [("a", "y", 2)]


def test_compare_needs_two_a_side(spark):
    rows = [(1, "winner", "cards", 9.0), (1, "winner", "cards", 8.0), (1, "control", "cards", 2.0), (1, "control", "cards", 3.0), (2, "winner", "cards", 9.0), (2, "control", "cards", 2.0)]
    found = {r.creator: r.verdict for r in compare(spark.createDataFrame(rows, "creator long, role string, field string, value double"), "creator").collect()}
    assert found == {1: "differs, every winner", 2: "not enough"}


def test_lanes_and_spacing(spark, spans):
    rows = sequential.lanes(frame(spark, spans), ["k"], "id").collect()
    for k in range(3):
        own = [r for r in rows if r.k == k]
        for lane in {r.lane for r in own}:
            line = sorted((r.b, r.e) for r in own if r.lane == lane)
            assert all(b[0] >= a[1] for a, b in zip(line, line[1:]) if a[0] < a[1] and b[0] < b[1])
        deepest = max(sum(b <= t < e for _, b, e in ((r.id, r.b, max(r.e, r.b + 1)) for r in own)) for t in range(600))
        assert max(r.lane for r in own) < deepest
    kept = sorted(r.b for r in sequential.spaced(frame(spark, spans), ["k"], "b", "id", 30).where("kept and k = 1").collect())
    assert all(b - a >= 30 for a, b in zip(kept, kept[1:]))


def test_shortlist_is_greedy(spark, spans):
    rows = sequential.shortlist(frame(spark, spans).withColumn("score", (F.col("id") * 37) % 101), ["k"], "score", ["id"], 5).where("k = 0").collect()
    chosen = []
    for r in sorted(rows, key=lambda r: (-r.score, r.id)):
        keep = len(chosen) < 5 and all(r.e <= b or e <= r.b for b, e in chosen)
        assert r.kept == keep
        if keep:
            chosen.append((r.b, r.e))


def test_turns():
    """Every kind as often as its share, and never a whole pick ahead of it or behind."""
    shares = {"card": 55, "shot": 40, "chart": 5}
    picks = sequential.turns(shares)
    assert {k: picks.count(k) for k in shares} == shares and sequential.turns({}) == []
    for n in range(1, 101):
        assert all(abs(picks[:n].count(k) - n * s / 100) < 1 for k, s in shares.items())


@pytest.mark.parametrize("kind", ["max", "sum", "last"])
@pytest.mark.parametrize("itself", [False, True])
def test_running_values_over_buckets(spark, kind, itself):
    rng = random.Random(3)
    rows = [(rng.randrange(2), rng.randrange(200), k, rng.choice([None, rng.randrange(50)])) for k in range(300)]
    found = {r.id: r.x for r in prefix.running(spark.createDataFrame(rows, "k long, at long, id long, v long"), ["k"], "at", 30, F.col("v"), kind, "x", ["id"], itself).collect()}
    for key, at, id_, v in rows:
        before = [x for k, a, i, x in sorted(rows, key=lambda r: r[:3]) if k == key and x is not None and ((a, i) < (at, id_) or itself and i == id_)]
        expected = {"max": max, "sum": sum, "last": lambda x: x[-1]}[kind](before) if before else None
        assert found[id_] == expected, (key, at, id_)


def test_order_statistics(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(3), rng.choice([None, rng.randrange(-40, 40)])) for _ in range(200)] + [(7, None), (8, 5)]
    df = spark.createDataFrame(rows, "k long, v long")
    medians = {r.k: r.median for r in prefix.middle(df, ["k"], "v", 10).collect()}
    tops = {r.k: r.p90 for r in aggregates.lower_percentiles(df, ["k"], "v", {"p90": 0.9}, 7).collect()}
    for k in {k for k, _ in rows}:
        own = sorted(v for x, v in rows if x == k and v is not None)
        assert medians.get(k) == (statistics.median(own) if own else None) and tops.get(k) == (own[int(0.9 * (len(own) - 1))] if own else None)


@pytest.mark.parametrize("said, expected", [
    ("fifteen hundred", "1500"), ("eighty percent", "80 percent"), ("one of the best", "one of the best"), ("two thousand twenty four", "2024"), ("twenty one", "21"), ("three", "three"), ("thirteen", "13"), ("twenty", "20"),
    ("five five", "10"), ("hundred of them", "hundred of them"), ("three million two hundred thousand and six", "3200000 and six"), ("i gotta go", "i got to go"), ("one hundred five", "105"), ("", ""),
    (" ".join(["one"] * 14 + ["thousand"]), "14000"),
])
def test_numbers_folded(said, expected):
    assert " ".join(fuzzy.folded(said.split())) == expected


def test_canonical_words_know_their_places():
    assert fuzzy.canonical("we gonna sell twenty one cars".split()) == [("we", 0), ("going", 1), ("to", 1), ("sell", 2), ("21", 3), ("cars", 5)]


def test_line_up():
    """Equal words, words heard otherwise at the same time, words that only one side has, and a stretch that is far off in time."""
    heard = lambda text, at=0: [(w, at + 400 * k, at + 400 * k + 300) for k, w in enumerate(text.split())]
    assert alignment.line_up(heard("a b c"), heard("a b c")) == [("same", k, k) for k in range(3)]
    assert alignment.line_up(heard("a jev c"), heard("a jeff c")) == [("same", 0, 0), ("differ", 1, 1), ("same", 2, 2)]
    assert alignment.line_up(heard("a b c"), heard("a c")) == [("same", 0, 0), ("gone", 1, None), ("same", 2, 1)]
    assert alignment.line_up(heard("a c"), heard("a b c")) == [("same", 0, 0), ("new", None, 1), ("same", 1, 2)]
    assert alignment.line_up(heard("x y"), heard("v w", 90_000)) == [("gone", 0, None), ("gone", 1, None), ("new", None, 0), ("new", None, 1)]
    assert alignment.line_up([], heard("a")) == [("new", None, 0)] and alignment.line_up([], []) == []


def test_aligned_rows_cover_both_sides(spark):
    rng = random.Random(9)
    left = [(k % 3, k, rng.choice("abcd"), k * 300, k * 300 + 250) for k in range(150)]
    right = [(k, i, w if rng.random() < 0.8 else "z", b, e) for k, i, w, b, e in left if rng.random() < 0.9] + [(7, 1, "only", 0, 9)]
    schema = "k long, idx long, key string, b long, e long"
    found = alignment.aligned(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "k").collect()
    key = {(s, r[0], r[1]): r[2] for s, rows in (("l", left), ("r", right)) for r in rows}
    assert {(r.k, r.left) for r in found if r.left is not None} == {(r[0], r[1]) for r in left}
    assert {(r.k, r.right) for r in found if r.right is not None} == {(r[0], r[1]) for r in right}
    for r in found:
        assert (r.what == "same") == (r.left is not None and r.right is not None and key["l", r.k, r.left] == key["r", r.k, r.right])


def test_text_functions(spark):
    row = spark.createDataFrame([("1,500 Cats: 80%!", "mail me@x.org or https://a.b/c at @someone")], "a string, b string").select(
        text.norm(F.col("a")).alias("norm"), text.scrub(F.col("b")).alias("scrubbed"), text.stamp(F.lit(3725)).alias("stamp"), text.srt_time(F.lit(3725007)).alias("srt"),
        text.clock_seconds(F.lit("1:02:05")).alias("secs"), text.singular(F.lit("stories")).alias("one"), colour.contrast(F.lit("000000"), F.lit("#ffffff")).alias("contrast"), colour.channel(F.lit("nope"), 0).alias("bad"),
    ).first()
    assert row.norm.split() == ["1500", "cats", "80", "percent"]
    assert row.scrubbed == "mail <email> or <link> at @creator"
    assert (row.stamp, row.srt, row.secs, row.one, round(row.contrast, 3), row.bad) == ("1:02:05", "01:02:05,007", 3725, "story", 21.0, None)


@pytest.mark.parametrize("said, kind", [("My cat sleeps on the red sofa", None), ("Now it boots quicker, versus last week", "before_after"), ("take one step, then the next", "list"), ("salt, flour, and eggs", "list"), ("the queue sends a note", "flow"), ("click here", "ui_demo"), ("that is half of it", "counter"), ("", None)])
def test_motion_kind(spark, said, kind):
    assert spark.range(1).select(text.motion_kind(F.lit(said)).alias("k")).first().k == kind


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"words": [{"text": "Hi", "start": 0.0, "end": 0.4, "type": "word"}, {"text": " ", "start": 0.4, "end": 0.5, "type": "spacing"}]}')
    (tmp_path / "b.json").write_text('[{"text": "Yo", "start": 1.0, "end": 1.2, "type": "word"}]')
    assert {(r.text, r.pos) for r in documents.transcripts(spark, f"{tmp_path}/*.json").collect()} == {("Hi", 0), ("Yo", 0)}
    (tmp_path / "c.json3").write_text('{"events": [{"tStartMs": 1000, "segs": [{"utf8": "hello big"}, {"utf8": " world", "tOffsetMs": 500}]}, {"tStartMs": 9}]}')
    assert [(r.start_s, r.word) for r in documents.caption_tracks(spark, f"{tmp_path}/c.json3").collect()] == [(1.0, "hello"), (1.0, "big"), (1.5, "world")]
    (tmp_path / "log.jsonl").write_text('{"at": 1, "k": "x"}\nnoise\n{broken\n{"at": 2, "k": "y"}\n')
    log = documents.line_log(spark, f"{tmp_path}/log.jsonl", "at long, k string")
    assert sorted(r.k for r in log.collect()) == ["x", "y"]
    assert {(r.at, r.k) for r in documents.upserted(log, spark.createDataFrame([(5, "x")], "at long, k string"), "k").collect()} == {(2, "y"), (5, "x")}
    cues = spark.createDataFrame([("1\n00:00:01,000 --> 00:00:02,500\nhello there",)], "cue string")
    documents.write_subtitles(cues, f"{tmp_path}/srt")
    assert [tuple(r) for r in documents.read_subtitles(spark, f"{tmp_path}/srt").collect()] == [(1, 1000, 2500, "hello there")]
    (tmp_path / "s.md").write_text("# Title\n\nANNA: *Hello* you\n(laughs)\nplain line\n")
    assert [(r.speaker, r.line) for r in documents.script_lines(spark, f"{tmp_path}/s.md").collect()] == [("ANNA", "Hello you"), (None, "plain line")]
    (tmp_path / "feed.xml").write_text('<rss><channel><item><title>Old</title><pubDate>Mon, 1 Jan 2024 10:00:00 +0000</pubDate><enclosure url="u1"/></item><item><title>None</title></item><item><title>New</title><pubDate>Tue, 2 Jan 2024 10:00:00 +0000</pubDate><enclosure url="u2"/></item></channel></rss>')
    assert [r.title for r in documents.episodes(spark, f"{tmp_path}/feed.xml").collect()] == ["New", "Old"]


def test_page_lines():
    assert documents.lines_of("<body><nav>x</nav><h1>A &amp; b</h1><p>one <b>two</b></p><script>var</script></body>") == [("h1", "A & b"), ("p", "one two")]


def test_leaders_are_all_kept(spark):
    rng = random.Random(8)
    names = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(260)]
    names += [f"{x}x" for x in names[:20]] + [f"{rng.choice(names)[:-1]}" for _ in range(40)] + ["", ""]
    leaders, expected = [], []
    for name in names:
        match = next((x for x in leaders if SequenceMatcher(None, x, name, autojunk=False).ratio() >= 0.6), None)
        if match is None:
            leaders.append(match := name)
        expected.append(match)
    assert len(leaders) > 200
    found = fuzzy.leaders(spark.createDataFrame([("b", k, x) for k, x in enumerate(names)], "k string, id long, name string"), "k", ["id"], 0.6, "name")
    assert [r.leader for r in found.orderBy("id").collect()] == expected


def test_job_queue_takes_events_in_order(spark, tmp_path):
    rng = random.Random(9)
    rows = [(k % 10 // 9, k, rng.choice(["signup", "purchase", "click"]), 1_700_000_000 + rng.randrange(30_000)) for k in range(600)]
    spark.createDataFrame(rows, "user_id long, event_id long, event_type string, s long").select("user_id", "event_id", "event_type", F.timestamp_seconds("s").alias("ts")).repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    expected, queues = [], {0: [], 1: []}
    for user, _, kind, s in sorted(rows, key=lambda r: (r[3], r[1])):
        if kind == "signup":
            queues[user].append(s)
        elif kind == "purchase":
            queues[user] = [t for t in queues[user] if s - t <= 900]
            if queues[user]:
                expected.append((user, queues[user].pop(0) * 1_000_000, s * 1_000_000))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = [tuple(r) for r in streams.stream_job_queue(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(found) == sorted(expected) and len(expected) > 50


@pytest.mark.parametrize("before, after, alike", [
    ("kafka moves data quickly", "kafca moves data safely", True), ("from 3 to 9 miles", "3 to 9 miles", True), ("in the", "in the", False), ("it is so", "it is so", True),
    ("red", "red", False), ("red kites fly over town", "red herrings swim under ice", False), ("the plans we made", "the plan we made", True), ("", "", False),
])
def test_open_alike(before, after, alike):
    assert fuzzy.open_alike(before.split(), after.split()) == alike


def test_in_common():
    rng = random.Random(3)
    for _ in range(300):
        a, b = (rng.choices("abc", k=rng.randrange(8)) for _ in range(2))
        found = fuzzy.in_common(a, b)
        common = [c for n in range(len(a) + 1) for c in combinations(range(len(a)), n) if is_within([a[k] for k in c], b)]
        assert tuple(found) in common and len(found) == max(map(len, common))
    assert fuzzy.one_word("kafka", "kafca") and fuzzy.one_word("plans", "plan") and not fuzzy.one_word("a", "an") and not fuzzy.one_word("kites", "herrings")


def is_within(part, whole):
    rest = iter(whole)
    return all(x in rest for x in part)


def brute_repeats(said):
    """All repeats by the rule's text: of all triples (m, n, k) those that hold, then the nearest m of each n with its longest k."""

    def content(words):
        return not set(words) <= set(text.STOP)

    def is_list(between):
        ands = [k for k, w in enumerate(between) if w in {"and", "or"}]
        return ands != [] and content(between[: ands[-1]]) and not content(between[ands[-1] :])

    nearest = {}
    for m, n in combinations(range(len(said)), 2):
        if n - m < fuzzy.LOOK_BACK and said[m] == said[n]:
            longest = max(k for k in range(1, n - m + 1) if said[m : m + k] == said[n : n + k])
            enough = longest >= 3 or (longest == 2 and n - m <= fuzzy.NEAR)
            if enough and (longest >= 4 or content(said[n : n + longest])) and not is_list(said[m + longest : n]):
                nearest[n] = (m, n, longest)  # m rises, so the last one is the nearest
    return list(nearest.values())


def test_repeats_against_brute_force(spark):
    rng = random.Random(12)
    texts = {c: [rng.choice(["we", "the", "and", "or", "a", "plan", "cost", "of", "x", "y"]) for _ in range(rng.choice([0, 1, 40, 120]))] for c in range(40)}
    for c in range(40, 50):
        base = [f"w{k}" for k in range(rng.randrange(2, 29))]
        texts[c] = ["so", *base, *base, "and", *base[:2], "then"]
    rows = [(c, k, w) for c, own in texts.items() for k, w in enumerate(own)]
    found = sorted(map(tuple, fuzzy.repeats(spark.createDataFrame(rows, "c long, place long, word string"), "c").collect()))
    assert found == sorted((c, *x) for c, own in texts.items() for x in brute_repeats(own)) and len(found) > 200


def test_first_free_spans():
    assert fuzzy.first_free([(5, 2, 1, 3), (6, 2, 2, 4), (7, 3, 4, 9), (20, 2, 30, 29)], {8}) == [(1, 3)]
    assert fuzzy.first_free([(7, 3, 4, 9), (5, 2, 1, 3)], set()) == [(1, 3), (4, 9)]


def test_restarts(spark, tmp_path):
    rng = random.Random(10)
    said = [(1, 0, "kafka moves all data. kafca moves all data now."), (2, 0, "from 3 to 9 miles away, 3 to 9 miles away."), (3, 0, "the part about the part about rain is short."), (4, 0, "a cup of tea and a cup of coffee"), (5, 0, "the main idea- the main ideas are um the main idea again")]
    said += [(6, k, " ".join(rng.choice(["we", "the", "plan", "plans", "costs", "cost", "um", "moves"]) for _ in range(rng.randrange(2, 9))) + rng.choice(".,;")) for k in range(60)]
    spark.createDataFrame(said, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {tuple(r) for r in fuzzy_plans.restarts(spark, str(tmp_path)).collect()}
    assert {r for r in found if r[0] < 5} == {(1, 1, 5, "clause"), (2, 1, 7, "clause"), (3, 1, 4, "words")}
    assert {r for r in found if r[0] == 5} == {(5, 1, 4, "clause"), (5, 4, 9, "clause")}
    clauses = sorted((r.idx, r.start_ms, r.opening) for r in fuzzy_plans.clause_openings(spark, str(tmp_path))[1].where("conv_id = 6").collect())
    expected = set()
    for k, (b, at, own) in enumerate(clauses):
        for a, before, other in reversed(clauses[:k]):
            if at - before > 40_000:
                break
            if fuzzy.open_alike(other, own):
                expected.add((6, a, b, "clause"))
                break
    assert {r for r in found if r[0] == 6 and r[3] == "clause"} == expected and len(expected) > 10


def test_differences_of_hearings(spark):
    rows = [("differ", "plan", "plans", "spelling"), ("differ", "hello", "hel", "fragment"), ("differ", "colour", "colours", "spelling"), ("differ", "organise", "organize", "spelling"), ("differ", "cat", "dog", "heard otherwise"),
            ("gone", "cat", None, "missing"), ("new", None, "cat", "more"), ("new", None, "um", "hesitation"), ("gone", "uh", None, "hesitation"), ("differ", "a", "um", "hesitation")]
    found = spark.createDataFrame(rows, "what string, was string, now string, kind string").withColumn("found", fuzzy_plans.difference(F.col("what"), F.col("was"), F.col("now")))
    assert all(r.found == r.kind for r in found.collect())


def test_verified_words(spark, tmp_path):
    said = " ".join(f"{a}{b}{a}{b}" for a in "bcdfg" for b in "aeiou") + "."
    spark.createDataFrame([(1, 0, said)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.kind: (r.n, r["first"]) for r in fuzzy_plans.verified_words(spark, str(tmp_path)).collect()}
    assert found == {"spelling": (1, 11), "fragment": (1, 22), "missing": (1, 17), "more": (1, None)}


def test_canonical_rows(spark):
    said = "we wanna pay twenty five thousand dollars for two hundred cats now".split()
    rows = [(1, k + 1, w, 10 * k, 10 * k + 9) for k, w in enumerate(said)] + [(2, 4, "gonna", 0, 5)]
    found = {(r.c, r.idx): (r.word, r.key, r.b, r.e) for r in fuzzy.canonical_rows(spark.createDataFrame(rows, "c long, idx long, key string, b long, e long"), "c").collect()}
    assert found[2, 1] == (4, "going", 0, 5) and found[2, 2] == (4, "to", 0, 5)
    own = [found[1, k] for k in range(1, 11)]
    assert [k for _, k, _, _ in own] == ["we", "want", "to", "pay", "25000", "dollars", "for", "200", "cats", "now"]
    assert own[4] == (4, "25000", 30, 59) and own[7] == (9, "200", 80, 99) and len(found) == 12


def test_canonical_rows_take_no_array_along(spark):
    """A token's times come before tokens are rows: none of a long key's rows goes through its words again."""
    rows = spark.createDataFrame([(1, k, "wanna" if k % 3 else "twenty", 10 * k, 10 * k + 9) for k in range(1, 5001)], "c long, idx long, key string, b long, e long")
    found = fuzzy.canonical_rows(rows, "c")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_min" not in plan and not any("words" in line.split("Generate", 1)[1] for line in plan.splitlines() if "Generate" in line)
    own = [tuple(r) for r in found.orderBy("idx").collect()]
    assert own[:3] == [(1, 1, 1, "want", 10, 19), (1, 2, 1, "to", 10, 19), (1, 3, 2, "want", 20, 29)] and own[4] == (1, 5, 3, "20", 30, 39) and len(own) == 5000 + 3334


def test_matcher_as_difflib():
    """The same matches, and a word's places before a stretch aren't gone through again for it."""
    rng = random.Random(13)
    for n in (0, 1, 5, 60, 400):
        a, b = ([rng.choice("abcdefgh") for _ in range(n)] for _ in range(2))
        b = [*a[: n // 2], *b]
        assert alignment.Matcher(a, b).get_opcodes() == SequenceMatcher(None, a, b, autojunk=False).get_opcodes()

    class Places(list):
        seen = 0

        def __getitem__(self, k):
            found = super().__getitem__(k)
            Places.seen += len(found) if isinstance(k, slice) else 1
            return found

        def __iter__(self):
            Places.seen += len(self)
            return super().__iter__()

    a = ["x"] * 300 + [f"w{k}" for k in range(300)]
    matcher = alignment.Matcher(a, a)
    matcher.b2j = {w: Places(p) for w, p in matcher.b2j.items()}
    Places.seen = 0
    assert matcher.find_longest_match(300, 600, 300, 600) == (300, 300, 300) and matcher.find_longest_match(0, 10, 290, 300).size == 10
    assert Places.seen < 300 * 12 + 10 * 12 * 2
