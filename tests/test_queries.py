"""Every registered query outside the llm folder against its DuckDB SQL, as the driver compares them."""

import glob
import os

import duckdb
import pytest

from tessella.plans import aggregates, boxes, cuts, edits, findings, fuzzy, intervals, jobs, matching, notes, openings, pages, placement, reports, rules, sections, series, streams, strings, styles, texts, videos, words

SF = "/root/testdata/sf0.001"
PLANS = (videos, words, intervals, cuts, series, boxes, findings, jobs, strings, reports, pages, aggregates, texts, fuzzy, placement, matching, edits, rules, openings, styles, notes, sections, streams)
NAMES = [(plan, name) for plan in PLANS for name in plan.QUERIES]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


#: Queries that round: a few rows more often tell an order of additions than a hundred do.
MORE, ROUNDING = "/root/testdata/sf0.01", {"histogram_jumps", "ease_fits", "window_energy", "gain_needed", "shot_lengths", "blended_styles", "look_blocks", "split_word_times", "camera_path", "edit_ledger"}


def views(folder):
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.fixture(scope="module")
def duck():
    return views(SF)


@pytest.fixture(scope="module")
def more():
    return views(MORE)


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, (int, float)) or hasattr(x, "item"):
        return float(x)
    return str(x)


def same_rows(df, found):
    rows, columns = df.collect(), sorted(df.columns)
    assert columns == sorted(found.columns)
    order = [found.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr) == sorted((tuple(plain(r[k]) for k in order) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("plan, name", NAMES, ids=[name for _, name in NAMES])
def test_query(spark, duck, plan, name):
    df = plan.QUERIES[name](spark, SF)
    if name in plan.ORACLE_SQL:
        same_rows(df, duck.sql(plan.ORACLE_SQL[name]))
    else:
        df.collect()


@pytest.mark.parametrize("plan, name", [x for x in NAMES if x[1] in ROUNDING], ids=[name for _, name in NAMES if name in ROUNDING])
@pytest.mark.skipif(not os.path.isdir(MORE), reason="no test tables")
def test_rounding_on_more_rows(spark, more, plan, name):
    same_rows(plan.QUERIES[name](spark, MORE), more.sql(plan.ORACLE_SQL[name]))


def test_names_are_unique():
    names = [name for _, name in NAMES]
    assert len(names) == len(set(names))
