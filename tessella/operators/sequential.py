"""Order-dependent rules: rows of a key in order, one at a time, with a small state per key.

Spark brings a key's rows together and sorts them; a task then streams through its rows and never holds
a key's rows, only the state that the rule keeps."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import chain, groupby, islice
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Step = Callable[[dict[str, Any], tuple], Any]


def sequential(df: DataFrame, by: Sequence[str], order: Sequence, step: Callable[[], Step], name: str, kind: str) -> DataFrame:
    """df with column name: step() makes, per task, a function of (state, row) that may change the key's state (a dict, empty at first) and returns the row's value."""
    columns = df.columns
    keys = [columns.index(c) for c in by]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rule, key, state = step(), None, {}
        for batch in batches:
            values = []
            for row in batch.itertuples(index=False):
                own = tuple(row[k] for k in keys)
                if own != key:
                    key, state = own, {}
                values.append(rule(state, row))
            batch[name] = pd.Series(values, index=batch.index, dtype="object")
            yield batch

    ordered = df.repartition(*by).sortWithinPartitions(*by, *order)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"{name} {kind}"])
    return ordered.mapInPandas(run, schema)


def streamed(df: DataFrame, by: Sequence[str], order: Sequence, rule: Callable[[Iterator[Any]], Iterator[tuple]], schema: str) -> DataFrame:
    """What rule makes of each key's rows in order: it takes an iterator of them (named tuples) and yields rows of schema, any number at any time.

    A key's rows aren't held but by the rule, which looks ahead and back as far as it needs to."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = chain.from_iterable(batch.itertuples(index=False, name="Row") for batch in batches)
        made = chain.from_iterable(rule(own) for _, own in groupby(rows, key=lambda row: tuple(getattr(row, c) for c in by)))
        while part := list(islice(made, 10_000)):
            yield pd.DataFrame(part, columns=names, dtype="object")

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


def spaced(df: DataFrame, by: Sequence[str], at: str, tie: str, spacing: int, name: str = "kept") -> DataFrame:
    """Greedy choice with a minimum distance: a row is kept if it comes at least spacing after the last kept one."""

    def make() -> Step:
        def step(state: dict, row: tuple) -> bool:
            keep = "last" not in state or getattr(row, at) - state["last"] >= spacing
            if keep:
                state["last"] = getattr(row, at)
            return keep

        return step

    return sequential(df, by, [at, tie], make, name, "boolean")


def lanes(df: DataFrame, by: Sequence[str], tie: str, name: str = "lane") -> DataFrame:
    """Interval partitioning: each interval (b, e) goes to the lowest lane that is free at its start.  State: the lanes in use."""

    def make() -> Step:
        def step(state: dict, row: tuple) -> int:
            busy, free = state.setdefault("busy", []), state.setdefault("free", [])
            while busy and busy[0][0] <= row.b:
                heapq.heappush(free, heapq.heappop(busy)[1])
            lane = heapq.heappop(free) if free else len(busy)
            heapq.heappush(busy, (row.e, lane))
            return lane

        return step

    return sequential(df, by, ["b", tie], make, name, "long")


def shortlist(df: DataFrame, by: Sequence[str], score: str, ties: Sequence[str], top: int, name: str = "kept") -> DataFrame:
    """Greedy choice of at most top intervals (b, e) that don't overlap, by falling score.  State: the chosen ones."""

    def make() -> Step:
        def step(state: dict, row: tuple) -> bool:
            chosen = state.setdefault("chosen", [])
            keep = len(chosen) < top and all(row.e <= b or e <= row.b for b, e in chosen)
            if keep:
                chosen.append((row.b, row.e))
            return keep

        return step

    return sequential(df, by, [F.desc(score), *ties], make, name, "boolean")


def turns(shares: dict[str, int]) -> list[str]:
    """One period of picks that follow the shares: each goes to the kind that is furthest behind its share of the picks so far, on a tie to the one named first."""
    whole, had, out = sum(shares.values()), Counter(), []
    for n in range(1, whole + 1):
        out.append(max(shares, key=lambda kind: n * shares[kind] - whole * had[kind]))  # noqa: B023
        had[out[-1]] += 1
    return out


def dealt(df: DataFrame, by: Sequence[str], order: Sequence[str], shares: dict[str, int], name: str = "dealt") -> DataFrame:
    """Each key's rows, in order, get the picks of turns() over and over: a pick depends on the row's number alone."""
    period = turns(shares)
    number = F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumn(name, F.element_at(F.array(*map(F.lit, period)), (number % len(period) + 1).cast("int")) if period else F.lit(None).cast("string"))


def segments(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, jump: float, window: int = 15, name: str = "segment") -> DataFrame:
    """A new segment where a value departs by over jump from the running median of its segment's last window values."""

    def make() -> Step:
        def step(state: dict, row: tuple) -> int:
            x = getattr(row, value)
            recent = state.setdefault("recent", [])
            middle = sorted(recent)[len(recent) // 2] if recent else x
            if recent and abs(x - middle) > jump:
                state["nr"] = state.get("nr", 0) + 1
                recent.clear()
            recent.append(x)
            del recent[:-window]
            return state.get("nr", 0)

        return step

    return sequential(df, by, order, make, name, "long")
