"""Queries on odd rows of small tables of their own, against their SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tessella.plans import cuts, fuzzy, matching, openings, series, texts
from tessella.sources import views
from tests.test_queries import SF, same_rows


def against_sql(spark, folder, plan, name, **tables):
    """The query on the given tables (columns by name) and its SQL on the same."""
    connection = duckdb.connect()
    for table, columns in tables.items():
        path = f"{folder}/{table}.parquet"
        pq.write_table(pa.table(columns), path)
        connection.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{path}'")
    same_rows(plan.QUERIES[name](spark, str(folder)), connection.sql(plan.ORACLE_SQL[name]))


def test_word_edges_are_ascii(spark, tmp_path):
    """Accented letters are no letters at a word's edge, and the long s and the Kelvin sign fold to s and k."""
    said = ["Ciónñqueue de", "la queueñ osar", "queue", "éhalf", "halfé", "half_", "two ſtepſ and steps, no", "he paſſeſ it", "clicKſ", "than lowerſer than", "a, b, c", None, "", "FROM é TO", "from xſ to", "x" * 9]
    against_sql(spark, tmp_path, texts, "motion_kinds", conversations={"conv_id": range(len(said)), "turn": [0] * len(said), "role": [f"r{k}" for k in range(len(said))], "text": said})
    said = ["éa.com b", "x é@creator y", "ñfile.mp4 z", "é.example.org"]
    against_sql(spark, tmp_path, texts, "scrub_text", documents={"doc_id": range(len(said)), "text": said})


def test_clip_windows_begin_and_end_anywhere(spark, tmp_path):
    """Short sentences and ones without a full end too."""
    said = [" ".join(["word"] * n) + end for n, end in ((3, "."), (20, "..."), (25, "-"), (2, "!"), (30, "."), (1, "?"), (40, "..."))] * 3
    against_sql(spark, tmp_path, texts, "clip_windows", conversations={"conv_id": [1] * len(said), "turn": range(len(said)), "role": ["user"] * len(said), "text": said})
    rows = {r.sentence for r in texts.clip_windows(spark, str(tmp_path)).collect()}
    assert {1, 4} <= rows


def test_words_are_dealt_out_once_and_never_broadcast(spark, monkeypatch):
    """A removal's place, and what the cuts cover, follow from windows where a conversation's words are."""
    monkeypatch.setattr(views, "PART_TURNS", 20)
    for name in ("resolved_spans", "covered_words", "paper_edit", "judged_changes"):
        plan = cuts.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "Join" not in plan and plan.count("Exchange hashpartitioning(conv_id") == plan.count("Exchange ") == 1, name


def test_onsets_sort_once(spark):
    """No sort by a comparison in Spark's own lambda, and none for each element of a window."""
    plan = series.onsets(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan and plan.count("sort_array") == 2


def test_restarts_stay_where_the_words_are(spark):
    """Openings and repeats are compared in windows: no join, so nothing is broadcast, and words shuffle once."""
    plan = fuzzy.restarts(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan
    assert plan.count("Exchange hashpartitioning(conv_id") - plan.count("ReusedExchange") <= 3


def test_candidates_are_not_broadcast(spark):
    """Candidates of one kind meet those of weightier kinds in a window; the joins that are left are by conversation and merge."""
    plan = openings.cut_candidates(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "__bucket" not in plan


def test_captions_meet_speech_where_the_words_are(spark, monkeypatch):
    """Words within reach of a caption are in its row: no join by letters, and words shuffle once."""
    monkeypatch.setattr(views, "PART_TURNS", 20)
    for name in ("captions_spoken", "caption_times"):
        plan = matching.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange hashpartitioning(conv_id") == plan.count("Exchange ") == 1, name
