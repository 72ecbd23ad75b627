"""Placing things on a time line under rules about their neighbours: times in integers, one plan per key.

Rules that look at neighbours only stream through a key's rows in order and hold what is still open; a stretch
that nothing else touches is a group of its own."""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators import sequential

Step = Callable[[dict[str, Any], tuple], Any]


def budgeted(df: DataFrame, by: Sequence[str], order: Sequence, at: str, budget: str, spacing: int, name: str = "kept") -> DataFrame:
    """Greedy choice in the given order (best first) of at most budget (a column) rows a key, no two of them less than spacing apart.

    State: the chosen times, sorted; only the two neighbours of a time are looked at."""

    def make() -> Step:
        def step(state: dict, row: tuple) -> bool:
            chosen, time = state.setdefault("chosen", []), getattr(row, at)
            place = bisect_left(chosen, time)
            near = chosen[max(0, place - 1) : place + 1]
            keep = len(chosen) < getattr(row, budget) and all(abs(time - other) >= spacing for other in near)
            if keep:
                insort(chosen, time)
            return keep

        return step

    return sequential.sequential(df, by, order, make, name, "boolean")


def without_repeats(df: DataFrame, by: Sequence[str], order: Sequence, what: str) -> DataFrame:
    """df without rows whose `what` is that of the row before (which may itself go)."""
    before = F.lag(what).over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("__before", before).where(F.col("__before").isNull() | (F.col("__before") != F.col(what))).drop("__before")


def filled(base: DataFrame, more: DataFrame, by: Sequence[str], wanted: DataFrame, spacing: int) -> DataFrame:
    """base (by, at) and, in order of time, of more (by, at) those at least spacing from every one there is, until a key has as many as wanted (by, n) says.

    What lies next to a time in base comes by windows; the pass over the rest only remembers its own last choice."""
    own = base.groupBy(*by).agg(F.count("*").alias("__have"))
    rows = base.select(*by, "at", F.lit(True).alias("__base")).unionByName(more.select(*by, "at", F.lit(False).alias("__base")))
    placed = F.when(F.col("__base"), F.col("at"))
    order = W.partitionBy(*by).orderBy("at", F.desc("__base"))
    rows = rows.withColumn("__below", F.last(placed, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("__above", F.first(placed, ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing)))
    rows = rows.where(~F.col("__base") & (F.col("__below").isNull() | (F.col("at") - F.col("__below") >= spacing)) & (F.col("__above").isNull() | (F.col("__above") - F.col("at") >= spacing)))
    rows = rows.join(wanted, list(by)).join(own, list(by), "left").select(*by, "at", (F.col("n") - F.coalesce("__have", F.lit(0))).alias("room")).where("room > 0")

    def make() -> Step:
        def step(state: dict, row: tuple) -> bool:
            keep = state.get("n", 0) < row.room and ("last" not in state or row.at - state["last"] >= spacing)
            if keep:
                state.update(last=row.at, n=state.get("n", 0) + 1)
            return keep

        return step

    chosen = sequential.sequential(rows, by, ["at"], make, "kept", "boolean").where("kept")
    return base.select(*by, "at").unionByName(chosen.select(*by, "at"))


def halved(begin: int, end: int, times: list[int], longest: int, margin: int) -> list[int]:
    """Of sorted times, those that cut [begin, end) up until no part longer than `longest` can be cut: each part at the time nearest its middle (ties: the earlier), at least margin inside."""
    cuts, open_ = [], [(begin, end)]
    while open_:
        b, e = open_.pop()
        inside = times[bisect_left(times, b + margin + 1) : bisect_left(times, e - margin)]
        if e - b > longest and inside:
            cut = min(inside, key=lambda t: (abs(2 * t - b - e), t))  # noqa: B023
            cuts.append(cut)
            open_ += [(b, cut), (cut, e)]
    return sorted(cuts)


def without_long_holds(picks: DataFrame, times: DataFrame, ends: DataFrame, by: Sequence[str], longest: int, margin: int) -> DataFrame:
    """picks (by, at), and times (by, at) where what follows a pick lasts too long (until the next pick, or the key's end: ends (by, end)).

    Cuts of one hold never meet those of another, so each hold is a group; only the long ones and the times in them shuffle."""
    ends = ends.withColumnRenamed("end", "__end")
    rows = picks.select(*by, "at", F.lit(True).alias("__pick")).unionByName(times.select(*by, "at", F.lit(False).alias("__pick")))
    order = W.partitionBy(*by).orderBy("at", F.desc("__pick"))
    placed = F.when(F.col("__pick"), F.col("at"))
    rows = rows.withColumn("__b", F.last(placed, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("__e", F.first(placed, ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing)))
    rows = rows.join(ends, list(by)).withColumn("__e", F.coalesce("__e", "__end")).where(F.col("__b").isNotNull() & ~F.col("__pick") & (F.col("__e") - F.col("__b") > longest))
    schema = picks.select(*by, "at").schema

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[0]
        cuts = halved(int(first["__b"]), int(first["__e"]), sorted(set(frame["at"].tolist())), longest, margin)
        return pd.DataFrame({**{c: [first[c]] * len(cuts) for c in by}, "at": cuts})

    cuts = rows.select(*by, "at", "__b", "__e").groupBy(*by, "__b").applyInPandas(cut, schema)
    return picks.select(*by, "at").unionByName(cuts)


def shown_long_enough(df: DataFrame, by: Sequence[str], tie: str, least: int, end: str) -> DataFrame:
    """Intervals (b, e) on one line, each at least `least` long or gone: (by, tie, b, e).

    A shorter one takes what it lacks from the free time after it (up to column end), then from the free time before it, then
    from what the interval that touches it before, then the one after, has beyond `least`.  Where the next one begins it ends.
    State: the interval before, and the next one."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*by, tie, "b", "e").schema)

    def rule(rows: Iterator[Any]) -> Iterator[tuple]:
        before: list[int] | None = None  # b, e of the last one kept, and its row
        kept_row, reached = None, None
        row = next(rows, None)
        begin = row.b if row is not None else 0
        while row is not None:
            after = next(rows, None)
            b, e = begin, row.e
            then = [after.b, after.e] if after is not None else None
            if e - b < least:
                free = max(then[0], b) if then else getattr(row, end)
                e = min(max(e, b + least), max(free, b))
                floor = max([0 if reached is None else reached, *([before[1]] if before else [])])
                b = max(min(b, e - least), min(floor, b))
                lack = least - (e - b)
                if lack > 0 and before and before[1] == b:
                    given = min(lack, max(0, before[1] - before[0] - least))
                    before[1] -= given
                    b -= given
                    lack -= given
                if lack > 0 and then and then[0] <= e:
                    given = min(lack, max(0, then[1] - then[0] - least))
                    then[0] = e + given if given else then[0]
                    e += given
            if e - b >= least:
                if before:
                    yield (*(getattr(kept_row, c) for c in (*by, tie)), *before)
                    reached = before[1] if reached is None else max(reached, before[1])
                before, kept_row = [b, e], row
            row, begin = after, then[0] if then else 0
        if before:
            yield (*(getattr(kept_row, c) for c in (*by, tie)), *before)

    return sequential.streamed(df.select(*by, tie, "b", "e", end), by, ["b", tie], rule, schema)


def moved_out(points: DataFrame, windows: DataFrame, by: Sequence[str], tie: str) -> DataFrame:
    """points (by, tie, at) with to: where a point ends up that each window (by, nr, b, e, to), in order of b and nr, that holds it strictly inside moves to its `to`.

    A window that sends points ahead may send them into a later one; none sends points behind its own begin.  State: windows that are
    still open, and points that wait for the time they were sent to."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.select(*by, tie, "at").schema) + ", to long"
    rows = windows.select(*by, F.col("b").alias("at"), F.lit(None).cast(points.schema[tie].dataType).alias(tie), F.lit(0).alias("is_point"), "nr", "e", "to")
    rows = rows.unionByName(points.select(*by, "at", tie, F.lit(1).alias("is_point"), F.lit(0).cast("long").alias("nr"), F.lit(0).cast("long").alias("e"), F.lit(0).cast("long").alias("to")))

    def rule(found: Iterator[Any]) -> Iterator[tuple]:
        opened: deque[tuple[int, int, int, int]] = deque()  # number, b, e, to of windows that may still hold a point
        waiting: list[tuple[int, int, int, Any]] = []  # where, windows seen by then, number, row of points
        seen = arrived = 0

        def settle(now: int | None) -> Iterator[tuple]:
            while waiting and (now is None or waiting[0][0] <= now):
                where, after, _, row = heapq.heappop(waiting)
                for number, b, e, to in opened:
                    if number >= after and b < where < e:
                        where, ahead = to, to > where
                        if ahead and now is not None and where > now:  # not all windows around it have come yet
                            heapq.heappush(waiting, (where, number + 1, arrived, row))
                            break
                else:
                    yield (*(getattr(row, c) for c in by), getattr(row, tie), row.at, where)

        for row in found:
            yield from settle(int(row.at))
            while opened and opened[0][2] <= min([row.at, *(w[0] for w in waiting[:1])]):
                opened.popleft()
            if row.is_point:
                heapq.heappush(waiting, (int(row.at), 0, arrived, row))
            else:
                opened.append((seen, int(row.at), int(row.e), int(row.to)))
                seen += 1
            arrived += 1
        yield from settle(None)

    return sequential.streamed(rows, by, ["at", "is_point", "nr", tie], rule, schema)
