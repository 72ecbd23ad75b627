"""Openings said again, against plain loops."""

import random
from string import ascii_lowercase

from tessella.functions import text
from tessella.operators import fuzzy, openings
from tessella.plans import fuzzy as fuzzy_plans
from tessella.plans import openings as plans


def test_go_alike():
    x = "we build a small router out of spare parts".split()
    assert openings.go_alike(x, "we build a small router today out of spare".split()) == (8, 9)
    assert openings.go_alike(x, "we bought a house".split()) == (1, 1)  # one equal word after the start is no run
    assert openings.go_alike(x, "so we build".split()) == (2, 3)
    assert openings.go_alike(x, x) == (9, 9) and openings.go_alike(x, []) == (0, 0) and openings.go_alike([], []) == (0, 0)
    assert openings.go_alike(x, "nothing of the kind here at all".split()) == (0, 0)


def test_without_lesser(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(4), b := rng.randrange(200), b + rng.randrange(1, 30), rng.randrange(4), n) for n in range(150)]
    found = openings.without_lesser(spark.createDataFrame(rows, "k long, b long, e long, rank int, n long"), "k", 20)
    expected = {r[4] for r in rows if not any(o[0] == r[0] and o[3] < r[3] and o[1] < r[2] and r[1] < o[2] for o in rows)}
    assert {r.n for r in found.collect()} == expected and 10 < len(expected) < 150


def test_alternates(spark):
    """Takes at the end count, one in the middle (what follows is long) and one near the start don't."""
    rng = random.Random(2)
    said = ["my", "plan", "costs", "more"]
    other = ["nobody", "knows", "why", "birds"]
    clauses, sizes, expected = [], [], set()
    for k in range(40):
        idx = sorted(rng.sample(range(2, 300), 14))
        rows = [(k, 1, 0, said)] + [(k, i, i * 400, rng.choice([said, other, said[:2]])) for i in idx]
        n = idx[-1] + rng.randrange(1, 40)
        clauses += rows
        sizes.append((k, n))
        end = n
        for _, i, at, words in reversed(rows):
            if at > 40_000 and fuzzy.open_alike(said, words):
                if end - i + 1 > 30:
                    break
                expected.add((k, i, end))
                end = i - 1
    found = openings.first_openings(spark.createDataFrame(clauses, "k long, idx long, start_ms long, opening array<string>"), "k")
    found = openings.alternates(found, "k", spark.createDataFrame(sizes, "k long, n long"), 40_000, 30)
    assert {tuple(r) for r in found.collect()} == expected and len(expected) > 10


def test_a_recording(spark, tmp_path):
    """An opening begun twice, a long body, and the opening again at the end."""
    opening = "We build a small router from parts."
    body = " ".join(f"{a}{a}{b} {b}{a}{a} um {a}{b}{b}, like, {b}{b}{a}x." for a, b in zip(ascii_lowercase * 2, ascii_lowercase[7:] * 3, strict=False) if a != b)
    said = [(1, 0, f"{opening} {opening} {body}"), (1, 1, "We build a small router today from old parts."), (2, 0, "Just one line the the end.")]
    spark.createDataFrame(said, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    n = fuzzy_plans.clause_openings(spark, str(tmp_path))[0].where("conv_id = 1").count()
    takes = [tuple(r) for r in plans.alternate_openings(spark, str(tmp_path)).collect()]
    assert takes == [(1, n - 8, n)]
    assert [tuple(r) for r in plans.kept_opening(spark, str(tmp_path)).collect()] == [(1, n - 8, 8, 14, n)]
    found = {(r.conv_id, r.kind, r["first"], r["last"], r.check) for r in plans.cut_candidates(spark, str(tmp_path)).collect()}
    assert (1, "opening", n - 8, n, False) in found and (1, "restart", 1, 7, True) in found and (2, "double", 4, 4, True) in found
    assert sum(r[1] == "filler" for r in found) == sum(w.strip(",.") in text.HARD_FILLERS for w in body.split()) > 20 and sum(r[1] == "loose" for r in found) == body.count(" like, ")
    spans = sorted((c, a, b) for c, _, a, b, _ in found)
    assert all(x[0] != y[0] or x[2] < y[1] for x, y in zip(spans, spans[1:], strict=False))
