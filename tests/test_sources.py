"""Files that may be missing or broken."""

import json

from tessella.sources import documents


def test_optional_json(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    (folder / "good.json").write_text(json.dumps({"title": "a", "n": 3, "more": [1]}))
    (folder / "deep" / "lines.json").write_text('{\n  "title": "over\\nlines",\n  "n": 4\n}\n')
    (folder / "part.json").write_text('{"title": "only this"}')
    (folder / "broken.json").write_text('{"title": "cut o')
    (folder / "list.json").write_text("[1, 2]")
    (folder / "empty.json").write_text("")
    (folder / "wrong.json").write_text('{"title": "x", "n": "many"}')
    (folder / "other.txt").write_text("{}")
    names = spark.createDataFrame([(n,) for n in ("good", "lines", "part", "broken", "list", "empty", "wrong", "missing", "other")], "name string")
    found, rejects = documents.optional_json(spark, str(folder), names, "title string, n long")
    rows = {r.name: r.document for r in found.collect()}
    assert len(rows) == 9
    assert tuple(rows["good"]) == ("a", 3) and tuple(rows["lines"]) == ("over\nlines", 4) and tuple(rows["part"]) == ("only this", None)
    assert all(rows[n] is None for n in ("broken", "list", "empty", "wrong", "missing", "other"))
    assert {r.name: r.text for r in rejects.collect()} == {"broken": '{"title": "cut o', "list": "[1, 2]", "wrong": '{"title": "x", "n": "many"}'}


def test_optional_json_of_an_empty_folder(spark, tmp_path):
    names = spark.createDataFrame([("a",), ("a",)], "name string")
    found, rejects = documents.optional_json(spark, str(tmp_path), names, "title string")
    assert [r.document for r in found.collect()] == [None, None] and rejects.count() == 0
