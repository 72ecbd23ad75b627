"""Plans whose cost must not grow faster than their tables: what they read, copy and shuffle."""

import re

from tessella.operators import matching, membership
from tessella.plans import cuts, edits, findings, rules, strings, styles, texts
from tessella.plans import matching as takes
from tessella.sources import views

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df, column):
    return len(re.findall(rf"FileScan parquet \[[^\]]*{column}", plan_of(df)))


def test_phrase_windows_copies_no_text_for_each_stretch(spark, monkeypatch):
    """Texts are exploded with their stretches, not joined with each; a stretch at a text's end is as long as the phrase."""
    seen = []
    real = matching.sequential.shortlist
    monkeypatch.setattr(matching.sequential, "shortlist", lambda df, *rest: (seen.append(df), real(df, *rest))[1])
    texts = spark.createDataFrame([(1, ["x", "red", "plan", "red"], [0, 4_000, 8_000, 12_000])], "doc long, words array<string>, starts array<long>")
    phrases = spark.createDataFrame([(1, ["red", "plan", "cost"])], "phrase long, words array<string>")
    found = matching.phrase_windows(texts, phrases).collect()
    assert {tuple(r) for r in found} == {(1, 1, 1, 4_000, 667), (1, 1, 0, 0, 667)}
    plan = plan_of(seen[0])
    assert "collect_list(struct(phrase" in plan and "slice(words" not in plan


def test_common_in_order():
    masks = {"a": 0b101, "b": 0b010}
    assert [matching.common_in_order(words, masks, 3) for words in ([], ["a"], ["b", "a"], ["a", "b", "a"], ["b", "b", "c"])] == [0, 1, 2, 3, 1]


def test_plan_verdicts_read_cards_once(spark):
    found = rules.plan_verdicts(spark, SF)
    assert scans(found, "l_orderkey") == 1 and "Expand" not in plan_of(found)


def test_category_styles_read_cards_three_times(spark):
    assert scans(styles.category_styles(spark, SF), "l_orderkey") == 3


def test_plan_findings_read_cards_twice(spark):
    found = plan_of(findings.plan_findings(spark, SF))
    assert len(re.findall("FileScan parquet", found)) == 2 and "Expand" not in found


def test_shots_are_dealt_out_by_rows(spark, monkeypatch):
    """A task's share doesn't grow with the table, and nothing shuffles after they are dealt out."""
    monkeypatch.setattr(views, "PART_ROWS", 1_000)
    plan = plan_of(edits.shot_lengths(spark, SF))
    n = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 1_000)
    assert re.findall(r"hashpartitioning\(l_orderkey#\d+L?, (\d+)\)", plan) == [str(n)]


def test_similar_rules_pair_blocks_of_a_name(spark, monkeypatch, tmp_path):
    """Pairs of parts are neither shuffled nor counted, and are dealt out by their number; parts of several names, words in common twice, keys that come twice and nulls included."""
    monkeypatch.setattr(strings, "BLOCK", 3)
    monkeypatch.setattr(strings, "PART_PAIRS", 50)
    names = ["red bolt", "bolt red", "red red", "red gear", "big old rod gear", "the", "", None, "don't bolt"]
    parts = [(k, names[k * k % len(names)] if k % 5 else "red bolt", ("x", "y", None)[k % 7 % 3], k % 2) for k in range(120)] + [(3, "red bolt", "x", 1), (None, "red bolt", "x", 1)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = strings.similar_rules(spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == sorted(
        (a, b, len(x & y), min(len(x), len(y)))
        for a, n, brand, size in parts for b, m, other, large in parts
        if None not in (a, b, n, m, brand) and brand == other and size == large and a < b
        for x, y in [[{w.replace("'", "") for w in t.split()} - {"the"} for t in (n, m)]] if x & y and 2 * len(x & y) >= min(len(x), len(y))
    )
    assert found.rdd.getNumPartitions() > 20
    plan = plan_of(found)
    assert "Aggregate" not in plan[: plan.index("SortMergeJoin")] and "keys" in plan


def test_remapped_times_shuffle_words_once(spark, monkeypatch):
    """Words are read, dealt out and marked once, in as many parts as turns ask for; nothing made of them shuffles."""
    monkeypatch.setattr(views, "PART_TURNS", 10)
    found = plan_of(cuts.remapped_times(spark, SF))
    n = -(-spark.read.parquet(f"{SF}/conversations.parquet").count() // 10)
    assert re.findall(r"Exchange hashpartitioning\(conv_id#\d+L?, (\d+)\)", found) == [str(n)] and found.count("Exchange") == 1
    assert len(re.findall("FileScan parquet", found)) == 1 and "Union" not in found


def test_texts_are_cut_once_for_their_grams(spark):
    """The words of a text aren't cut once to be counted and once more to be hashed; its grams are looked up by place, without a text of the bitmap's bytes for each."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    few = texts.hashed_grams(docs.limit(3), "doc_id", 3).select("gram.h1").distinct()
    plan = plan_of(texts.hashed_grams(docs, "doc_id", 3))
    assert plan.count("split(") == 1
    found = plan_of(membership.among(texts.hashed_grams(docs, "doc_id", 3).select("gram.h1"), "h1", few))
    join = next(line for line in found.splitlines() if "BroadcastHashJoin" in line)
    assert "getbit" in join and "hex(" not in join and "substring(" not in join


def test_takes_are_found_once(spark):
    """What script_takes and off_script make of the takes doesn't go through all texts again; off_script counts their words besides."""
    scans_of = lambda df: len(re.findall(r"FileScan parquet \[doc_id[^\]]*text", plan_of(df)))
    assert scans_of(takes.script_takes(spark, SF)) == 0 and scans_of(takes.off_script(spark, SF)) == 1
