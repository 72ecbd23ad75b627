"""Edits on a plan's cut, one after the other, each checked before it is applied: a ledger with what was refused, and why.

A plan has places 1 to n.  `cut` takes out a stretch, `restore` gives back the whole run of cut places around one, `trim` gives
back a run's head or tail, `undo` takes back the last edit that still holds.  What was given back is frozen: no later cut may take it
again.  The same fold serves a table of edits, in order, and a stream of them."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.operators import sequential

LEDGER = "plan long, edit long, action string, status string, changed long, total long"
_STATE = "taken array<long>, frozen array<long>, undo array<struct<added: array<long>, given: array<long>>>, waiting array<struct<at: long, edit: long, action: string, first: long, last: long, n: long>>"


class Plan:
    """What is cut, what is frozen, and the edits that can be undone: (places cut, places given back)."""

    def __init__(self, cut: list[int] = (), frozen: list[int] = (), undo: list[tuple[list[int], list[int]]] = ()):  # type: ignore[assignment]
        self.cut, self.frozen, self.undo = set(cut), set(frozen), [tuple(map(list, x)) for x in undo]

    def run_around(self, place: int) -> tuple[int, int]:
        first = last = place
        while first - 1 in self.cut:
            first -= 1
        while last + 1 in self.cut:
            last += 1
        return first, last

    def _apply(self, added: list[int], given: list[int]) -> None:
        self.cut.update(added)
        self.cut.difference_update(given)
        self.frozen.update(given)
        self.undo.append((added, given))

    def edit(self, action: str, first: int, last: int, n: int) -> tuple[str, int]:
        """(status, places changed)."""
        if action == "undo":
            if not self.undo:
                return "nothing to undo", 0
            added, given = self.undo.pop()
            self.cut.difference_update(added)
            self.cut.update(given)
            self.frozen.difference_update(given)
            return "applied", len(added) + len(given)
        places = range(first, last + 1)
        if first < 1 or last > n or first > last:
            return "out of range", 0
        if action == "cut":
            if not self.frozen.isdisjoint(places):
                return "frozen", 0
            if not self.cut.isdisjoint(places):
                return "meets a cut", 0
            self._apply([*places], [])
            return "applied", len(places)
        if first not in self.cut:
            return "not cut", 0
        begin, end = self.run_around(first)
        if action == "restore":
            self._apply([], [*range(begin, end + 1)])
            return "applied", end - begin + 1
        if action == "trim":
            if last > end:
                return "not inside a cut", 0
            if first != begin and last != end:
                return "mid-cut", 0
            self._apply([], [*places])
            return "applied", len(places)
        return "unknown action", 0


def ledger(edits: DataFrame) -> DataFrame:
    """One row per row of edits (plan, at, edit, action, first, last, n), in order of at and edit: LEDGER."""

    def rule(rows: Iterator[Any]) -> Iterator[tuple]:
        plan = Plan()
        for row in rows:
            status, changed = plan.edit(row.action, row.first, row.last, row.n)
            yield row.plan, row.edit, row.action, status, changed, len(plan.cut)

    return sequential.streamed(edits, ["plan"], ["at", "edit"], rule, LEDGER)


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    taken, frozen, undo, waiting = (list(x) for x in state.get) if state.exists else ([], [], [], [])
    plan = Plan(taken, frozen, undo)
    waiting = [tuple(x) for x in waiting]
    for batch in batches:
        waiting += [(r.at, r.edit, r.action, r.first, r.last, r.n) for r in batch.itertuples(index=False)]
    waiting.sort(key=lambda r: r[:2])
    passed = state.getCurrentWatermarkMs()
    ready = bisect_left(waiting, passed * 1000, key=lambda r: r[0])
    out = []
    for _, edit, action, first, last, n in waiting[:ready]:
        status, changed = plan.edit(action, int(first), int(last), int(n))
        out.append((key[0], edit, action, status, changed, len(plan.cut)))
    waiting = waiting[ready:]
    if plan.cut or plan.frozen or plan.undo or waiting:
        state.update((sorted(plan.cut), sorted(plan.frozen), [tuple(x) for x in plan.undo], [(int(a), int(e), str(x), int(f), int(t), int(n)) for a, e, x, f, t, n in waiting]))
        if waiting:
            state.setTimeoutTimestamp(max(passed, waiting[0][0] // 1000) + 1)
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=[part.split()[0] for part in LEDGER.split(", ")])


def stream_ledger(edits: DataFrame, late: str = "1 hour") -> DataFrame:
    """The same of a stream of edits (with a timestamp ts beside at, its microseconds): an edit waits until the watermark has passed it; those that come later than that aren't in the ledger."""
    rows = edits.withWatermark("ts", late)
    return rows.groupBy("plan").applyInPandasWithState(_fold, LEDGER, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def summed(found: DataFrame) -> DataFrame:
    """How often each action came to each end, by plan."""
    return found.groupBy("plan", "action", "status").agg(F.count("*").alias("n"), F.sum("changed").alias("changed"))
