"""Edits, nested documents and shared totals against plain code, and the ledger of a stream with late and refused edits."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import edits, trees
from tessella.plans import edits as plans

EDIT = "plan long, at long, edit long, action string, first long, last long, n long"


def plain(rows):
    """The ledger by keeping the whole text and every state of it."""
    out, states = [], {}
    for plan, _, edit, action, first, last, n in sorted(rows, key=lambda r: (r[1], r[2])):
        history = states.setdefault(plan, [("." * n, frozenset())])
        text, frozen = history[-1]
        own = set(range(first - 1, last))
        status = "applied"
        if action == "undo":
            if len(history) == 1:
                status, after = "nothing to undo", None
            else:
                history.pop()
                after = history[-1]
        elif first < 1 or last > n or first > last:
            status, after = "out of range", None
        elif action == "cut":
            status = "frozen" if own & frozen else "meets a cut" if "x" in text[first - 1 : last] else "applied"
            after = ("".join("x" if k in own else c for k, c in enumerate(text)), frozen)
        else:
            run = {k for k in range(n) if "." not in text[min(k, first - 1) : max(k, first - 1) + 1]}
            if not run:
                status, after = "not cut", None
            else:
                given = run if action == "restore" else own
                if not given <= run:
                    status = "not inside a cut"
                elif min(given) != min(run) and max(given) != max(run):
                    status = "mid-cut"
                after = ("".join("." if k in given else c for k, c in enumerate(text)), frozen | given)
        changed = 0
        if status == "applied":
            changed = sum(a != b for a, b in zip(text, after[0], strict=True))
            if action != "undo":
                history.append(after)
        out.append((plan, edit, action, status, changed, history[-1][0].count("x")))
    return sorted(out)


def some_edits(rng, n, plans_=4):
    return [(rng.randrange(plans_), 1_700_000_000_000_000 + rng.randrange(5_000) * 1_000_000, k, rng.choice(["cut", "cut", "cut", "restore", "trim", "trim", "undo"]), a := rng.randrange(0, 16), a + rng.randrange(-1, 5), 15) for k in range(n)]


def test_ledger(spark):
    rows = some_edits(random.Random(1), 900)
    found = edits.ledger(spark.createDataFrame(rows, EDIT).repartition(5))
    assert sorted(tuple(r) for r in found.collect()) == plain(rows)
    assert {r.status for r in edits.summed(found).collect()} == {"applied", "nothing to undo", "out of range", "frozen", "meets a cut", "not cut", "not inside a cut", "mid-cut"}
    assert edits.ledger(spark.createDataFrame([], EDIT)).count() == 0
    assert edits.Plan().edit("shuffle", 1, 1, 5) == ("not cut", 0)


def test_ledger_of_a_stream(spark, tmp_path):
    """Edits out of order within the watermark are taken in order; one far too late isn't in the ledger; refused ones are, with why."""
    rows = some_edits(random.Random(2), 60, 2)
    end = 1_700_000_000_000_000 + 90_000 * 1_000_000
    late = (0, 1_699_000_000_000_000, 900, "cut", 1, 1, 15)
    batches = [rows[:30], rows[30:], [(7, end, 901, "undo", 0, 0, 15)], [late], [(7, end + 90_000 * 1_000_000, 902, "undo", 0, 0, 15)]]
    source, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    schema = spark.createDataFrame([], EDIT).withColumn("ts", F.current_timestamp()).schema
    for batch in batches:
        spark.createDataFrame(batch, EDIT).withColumn("ts", F.timestamp_micros("at")).coalesce(1).write.mode("append").parquet(source)
        stream = edits.stream_ledger(spark.readStream.schema(schema).parquet(source), "2 hours")
        stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    found = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert [r for r in found if r[0] < 7] == plain(rows)
    assert all(r[1] != 900 for r in found) and (7, 901, "undo", "nothing to undo", 0, 0) in found
    assert {"applied", "nothing to undo"} < {r[3] for r in found}


def leaves(node, skip, key=None, path="$"):
    """All values below node, by recursion."""
    inner = [(k, f"{path}.{k}", v) for k, v in node.items()] if isinstance(node, dict) else [(key, f"{path}[{i}]", v) for i, v in enumerate(node)] if isinstance(node, list) else []
    for name, at, value in inner:
        if name not in skip:
            yield at, name, value
            yield from leaves(value, skip, name, at)


def made_up(rng, depth):
    kind = rng.randrange(6) if depth else rng.randrange(3)
    if kind < 3:
        return [rng.choice(["", "text", "Ünï", "a.b"]), rng.randrange(99), rng.choice([None, True, 1.5])][kind]
    if kind < 5:
        return {name: made_up(rng, depth - 1) for name in rng.sample(["icon", "url", "label", "src", "deep"], rng.randrange(4))}
    return [made_up(rng, depth - 1) for _ in range(rng.randrange(4))]


def test_walk(spark):
    rng = random.Random(3)
    docs = [(k, json.dumps(made_up(rng, 6))) for k in range(90)] + [(k, json.dumps({"deep": [made_up(rng, 4) for _ in range(3)], "label": made_up(rng, 3)})) for k in range(200, 230)] + [(100, None), (101, "{broken"), (102, "3"), (103, "[]"), (104, '{"a": [[["deep"]]]}'), (104, '{"a": "again"}')]
    df = spark.createDataFrame(docs, "id long, doc string")
    for skip in ((), ("url", "deep")):
        expected = []
        for k, doc in docs:
            if doc and doc != "{broken":
                expected += [(k, path, name, value) for path, name, value in leaves(json.loads(doc), skip) if isinstance(value, str)]
        found = [tuple(r) for r in trees.texts(df, ["id"], "doc", skip).collect()]
        assert sorted(found, key=repr) == sorted(expected, key=repr) and len(found) > 20
        everything = [x for k, doc in docs if doc and doc != "{broken" for x in leaves(json.loads(doc), skip)]
        assert trees.walk(df, ["id"], "doc", skip).count() == len(everything)
    assert trees.texts(df.limit(0), ["id"], "doc").count() == 0


def test_a_walk_ends(spark, monkeypatch):
    monkeypatch.setattr(trees, "DEEPEST", 3)
    with pytest.raises(ValueError, match="deeper"):
        trees.walk(spark.createDataFrame([(1, "[[[[[1]]]]]")], "id long, doc string"), ["id"], "doc")


def water(total, parts):
    """given of parts (weight, least, fixed): those whose least is above their share keep it, until none is."""
    free = max(0, total - sum(f for _, _, f in parts if f is not None))
    open_ = {k: p for k, p in enumerate(parts) if p[2] is None}
    given = {k: p[2] for k, p in enumerate(parts) if p[2] is not None}
    while open_:
        weight = sum(p[0] for p in open_.values())
        short = {k for k, p in open_.items() if p[1] * weight > free * p[0]}
        if not short:
            shares = {k: divmod(free * p[0], weight) for k, p in open_.items()}
            rest = free - sum(s for s, _ in shares.values())
            for n, k in enumerate(sorted(shares, key=lambda k: (-shares[k][1], k))):
                given[k] = shares[k][0] + (n < rest)
            break
        k = max(short, key=lambda k: (open_[k][1] / open_[k][0], -k))
        given[k] = open_[k][1]
        free -= open_.pop(k)[1]
    return given


def test_shared_by_weight(spark):
    rng = random.Random(4)
    rows, expected = [], set()
    for key in range(120):
        parts = [(rng.randrange(1, 20), rng.choice([0, 5, 40, 200]), rng.choice([None, None, None, 30])) for _ in range(rng.randrange(1, 9))]
        total = rng.choice([0, 50, 300, 1_000])
        rows += [(key, k, total, *p) for k, p in enumerate(parts)]
        expected |= {(key, k, v) for k, v in water(total, parts).items()}
    found = plans.shared_by_weight(spark.createDataFrame(rows, "k long, nr long, total long, weight long, least long, fixed long"), ["k"], "nr", "total", "weight", "least", "fixed")
    assert {(r.k, r.nr, r.given) for r in found.collect()} == expected
