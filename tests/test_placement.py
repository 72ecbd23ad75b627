"""Placement rules against plain rereadings of their text, on small random plans."""

import random

import pytest

from tessella.operators import placement, sequential


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


def test_streamed_rows_of_long_and_short_keys(spark):
    rows = [(k % 7, n) for n in range(3_000) for k in range(7) if k or n < 2]

    def rule(own):
        total = 0
        for row in own:
            total += row.v
            if row.v % 1_000 == 0:
                yield row.k, row.v, total

    found = sequential.streamed(frame(spark, rows, "k long, v long"), ["k"], ["v"], rule, "k long, v long, total long")
    expected = {(k, v, sum(range(v + 1))) for k in range(7) for v in ((0, 1_000, 2_000) if k else (0,))}
    assert {tuple(r) for r in found.collect()} == expected
    assert sequential.streamed(frame(spark, [], "k long, v long"), ["k"], ["v"], rule, "k long, v long, total long").count() == 0


def test_budgeted_and_without_repeats(spark):
    rng = random.Random(1)
    rows = [(k, n, rng.randrange(3), rng.randrange(60), rng.randrange(1, 6)) for k in range(12) for n in range(rng.randrange(25))]
    budget = {k: rng.randrange(1, 6) for k in range(12)}
    rows = [(k, n, rank, at, budget[k]) for k, n, rank, at, _ in rows]
    found = placement.budgeted(frame(spark, rows, "k long, n long, rank long, at long, budget long"), ["k"], ["rank", "at", "n"], "at", "budget", 7)
    kept = {(r.k, r.n) for r in found.where("kept").collect()}
    expected = set()
    for k in range(12):
        own = []
        for _, n, _, at, most in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[3], r[1])):
            if len(own) < most and min((abs(at - x) for x in own), default=99) >= 7:
                own.append(at)
                expected.add((k, n))
    assert kept == expected and len(expected) > 20
    cues = frame(spark, [(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "a"), (1, 5, "a"), (1, 6, "a"), (2, 1, "a")], "k long, at long, cue string")
    assert {(r.k, r.at) for r in placement.without_repeats(cues, ["k"], ["at"], "cue").collect()} == {(1, 1), (1, 3), (1, 4), (2, 1)}


def test_filled_up_to_a_number(spark):
    rng = random.Random(2)
    base, more, wanted = [], [], []
    for k in range(20):
        own = sorted(rng.sample(range(0, 400, 10), rng.randrange(4)))
        base += [(k, 15 * x) for x in own]
        more += [(k, x) for x in rng.sample(range(6_000), 60)]
        wanted.append((k, rng.randrange(12)))
    found = placement.filled(frame(spark, base, "k long, at long"), frame(spark, more, "k long, at long"), ["k"], frame(spark, wanted, "k long, n long"), 200)
    for k, n in wanted:
        own = [at for key, at in base if key == k]
        for at in sorted(at for key, at in more if key == k):
            if len(own) < n and all(abs(at - x) >= 200 for x in own):
                own.append(at)
        assert sorted(r.at for r in found.where(f"k = {k}").collect()) == sorted(own)


def test_halved():
    assert placement.halved(0, 100, [10, 49, 50, 51, 90], 45, 5) == [10, 50, 90]
    rng = random.Random(3)
    for _ in range(200):
        times = sorted(rng.sample(range(1, 300), 40))
        cuts = placement.halved(0, 300, times, 50, 4)
        edges = [0, *cuts, 300]
        assert set(cuts) <= set(times) and cuts == sorted(set(cuts))
        for a, b in zip(edges, edges[1:], strict=False):
            assert b - a <= 50 or not [t for t in times if a + 4 < t < b - 4]
    assert placement.halved(0, 100, [50, 50], 200, 1) == [] and placement.halved(0, 100, [], 10, 1) == []
    assert placement.halved(0, 100, [45, 55], 60, 1) == [45]  # equally near: the earlier


def test_long_holds(spark):
    picks, times = [(1, 0), (1, 100), (2, 5)], [(1, t) for t in range(0, 400, 10)] + [(3, 7)]
    ends = frame(spark, [(1, 400), (2, 300), (3, 900)], "k long, end long")
    found = placement.without_long_holds(frame(spark, picks, "k long, at long"), frame(spark, times, "k long, at long"), ends, ["k"], 120, 5)
    own = sorted(r.at for r in found.where("k = 1").collect())
    assert own == sorted([0, 100, *placement.halved(100, 400, [t for _, t in times[:40] if t > 100], 120, 5)]) and {r.at for r in found.where("k = 2").collect()} == {5}
    assert found.where("k = 3").count() == 0


@pytest.mark.parametrize("cards, expected", [
    ([(0, 10)], [(0, 30)]),  # free time after it
    ([(90, 95)], [(70, 100)]),  # and before it, up to the end
    ([(0, 50), (50, 60), (60, 100)], [(0, 30), (30, 60), (60, 100)]),  # from the one before
    ([(0, 30), (30, 40), (40, 100)], [(0, 30), (30, 60), (60, 100)]),  # from the one after
    ([(0, 30), (30, 40), (40, 70), (70, 100)], [(0, 30), (40, 70), (70, 100)]),  # none has any to spare
    ([(0, 35), (35, 45), (45, 75)], [(0, 30), (45, 75)]),  # what one has isn't enough; it has given it all the same
])
def test_shown_long_enough(spark, cards, expected):
    rows = [(1, n, b, e, 100) for n, (b, e) in enumerate(cards)]
    found = placement.shown_long_enough(frame(spark, rows, "k long, n long, b long, e long, end long"), ["k"], "n", 30, "end").collect()
    assert sorted((r.b, r.e) for r in found) == expected


def test_shown_long_enough_keeps_order_and_room(spark):
    rng = random.Random(5)
    rows = []
    for k in range(30):
        at = 0
        for n in range(rng.randrange(1, 12)):
            b = at + rng.choice([0, 0, 5, 40])
            at = b + rng.randrange(1, 60)
            rows.append((k, n, b, at, 600))
    found = placement.shown_long_enough(frame(spark, rows, "k long, n long, b long, e long, end long"), ["k"], "n", 30, "end").collect()
    for k in range(30):
        own = sorted((r.b, r.e, r.n) for r in found if r.k == k)
        assert all(e - b >= 30 for b, e, _ in own) and all(x[1] <= y[0] and x[2] < y[2] for x, y in zip(own, own[1:], strict=False))


def test_moved_out(spark):
    rng = random.Random(6)
    points, windows = [], []
    for k in range(25):
        points += [(k, n, rng.randrange(400)) for n in range(25)]
        begins = sorted(rng.sample(range(400), 6))
        windows += [(k, n, b, b + 30, b if rng.random() < 0.5 else b + rng.choice([5, 29, 45, 90])) for n, b in enumerate(begins)]
    found = placement.moved_out(frame(spark, points, "k long, p long, at long"), frame(spark, windows, "k long, nr long, b long, e long, to long"), ["k"], "p")
    expected = set()
    for k, p, at in points:
        now = at
        for _, _, b, e, to in sorted((w for w in windows if w[0] == k), key=lambda w: (w[2], w[1])):
            now = to if b < now < e else now
        expected.add((k, p, at, now))
    assert {tuple(r) for r in found.collect()} == expected and any(at != to for *_, at, to in expected)
