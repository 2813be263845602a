"""Stored points read back as nodes, filters of points, and documents by id."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import index as IX
from quarry.sources import records as RE

CASES = {
    "whole": ({"_node_content": json.dumps({"id_": "n1", "text": " a\n", "metadata": {"x": "inner", "y": [1, 2]}}), "_node_type": "T", "x": "own", "text": "b"}, ("n1", "a", {"x": "own", "text": "b", "y": "[1,2]"})),
    "no id": ({"_node_content": json.dumps({"id_": "", "text": "a"})}, ("no id", "a", {})),
    "number": ({"_node_content": json.dumps({"text": 5}), "text": 7, "document": "d"}, ("number", "d", {"text": "7", "document": "d"})),
    "object, not JSON": ({"_node_content": {"text": "a"}, "content": "c"}, ("object, not JSON", "c", {"content": "c"})),
    "broken": ({"_node_content": "{", "text": " ", "content": "c"}, ("broken", "c", {"text": " ", "content": "c"})),
    "list": ({"_node_content": "[]", "document": "d", "content": "c"}, ("list", "d", {"document": "d", "content": "c"})),
    "metadata no object": ({"_node_content": json.dumps({"text": "a", "metadata": 3})}, ("metadata no object", "a", {})),
    "long": ({"text": "é " * 300_000 + "z"}, ("long", "é " * 300_000 + "z", {"text": "é " * 300_000 + "z"})),
    "blank": ({"text": " "}, None),
    "empty": ({}, None),
}


def test_decode(spark):
    points = spark.createDataFrame([(k, json.dumps(p), "kept") for k, (p, _) in CASES.items()] + [("null", None, "kept"), ("no JSON", "{", "kept"), ("no object", "3", "kept")], "id string, payload string, `odd.name` string")
    rows = RE.decode(points).collect()
    expected = [e for _, e in CASES.values() if e]
    assert sorted((r["node_id"], r["text"], sorted(r["metadata"].items())) for r in rows) == sorted((n, t, sorted(m.items())) for n, t, m in expected)
    assert {r["odd.name"] for r in rows} == {"kept"}
    assert RE.decode(points.limit(0)).columns == ["odd.name", "node_id", "text", "metadata"] and RE.decode(points.limit(0)).count() == 0


@pytest.fixture
def points(spark):
    rows = [("d1", "a.pdf", 0, "text", 2, "c0", None), ("d1", "a.pdf", 1, "table_parent", 2, "c1", "t1"), ("d2", "b.pdf", 0, "text", None, "c2", None), (None, "c.pdf", 0, "text", 2, "c3", "t1")]
    return spark.createDataFrame(rows, "source_doc_id string, filename string, chunk_index int, chunk_kind string, schema_version int, chunk_id string, table_id string")


def test_matching(points, tmp_path):
    found = lambda **wanted: sorted(r["chunk_id"] for r in IX.matching(points, wanted).collect())
    assert found() == ["c0", "c1", "c2", "c3"] and found(source_doc_id="d1") == ["c0", "c1"] and found(table_id="t1", filename="a.pdf", chunk_kind="table_parent") == ["c1"] and found(filename="no") == []
    with pytest.raises(ValueError, match="chunk_index"):
        IX.matching(points, {"chunk_index": 0})
    points.write.parquet(f"{tmp_path}/p")
    plan = IX.matching(points.sparkSession.read.parquet(f"{tmp_path}/p"), {"filename": "a.pdf"})._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(filename,a.pdf)" in plan


def test_get_documents(spark, points):
    wanted = spark.createDataFrame([("d1",), ("d1",), ("gone",), (None,)], "doc_id string")
    rows = {r["doc_id"]: (r["filename"], r["chunks"], r["chunk_kind_counts"], r["status"]) for r in IX.get_documents(points, wanted).collect()}
    assert rows == {"d1": ("a.pdf", 2, {"table_parent": 1, "text": 1}, "found"), "gone": (None, None, None, "not_found")}
    assert IX.get_documents(points, wanted.where(F.lit(False))).count() == 0


def test_picture_descriptions(spark):
    from quarry.operators.chunk import structure_map

    rows = [(1, 0, "PICTURE", "alt", "cap", 1, " meta ", ["note"]), (1, 1, "CHART", "alt", None, 1, " ", [None, " ", "note\n", "later"]), (1, 2, "PICTURE", " alt ", "", 2, None, []), (1, 3, "PICTURE", None, None, None, None, None), (1, 4, "PICTURE", " ", "cap", 3, "", [" "])]
    items = spark.createDataFrame(rows, "doc long, ordinal long, label string, text string, caption string, page int, description string, annotations array<string>")
    said = lambda df: [r["content"] for r in structure_map(df).orderBy("ordinal").collect()]
    assert said(items) == ["cap\n\nmeta", "note", "alt", "[picture on page ?]", "cap"]
    assert said(items.drop("description", "annotations")) == ["cap\n\nalt", "alt", "alt", "[picture on page ?]", "cap"]


def test_what_the_report_shows(spark):
    from quarry.operators import ingest as IN
    from quarry.operators.rank import latest

    results = spark.createDataFrame([(1, None, "text"), (2, "b", " \n"), (3, "c", None)], "doc long, filename string, ingested_markdown string")
    (row,) = IN.shown(results).collect()
    assert (row["doc"], row["filename"], row["markdown"], row["table_visual_failed_count"]) == (1, "unknown.pdf", "text", 0)
    assert {r["doc"]: r["ingested_markdown"] for r in IN.compacted(results).collect()} == {1: "<4 chars>", 2: "<2 chars>", 3: None}
    told = spark.createDataFrame([(1, "table_parent", True), (2, "table_parent", None), (3, "text", True), (4, None, False)], "id long, chunk_kind string, table_visual_selected boolean")
    seen = lambda *on: sorted(r["id"] for r in IN.visible(told, *on).collect())
    assert [seen(), seen(True), seen(False, True), seen(True, True)] == [[1, 2, 3, 4], [1, 2], [1, 3], [1]]
    assert sorted(r["id"] for r in latest(spark.range(1000), ["id"]).collect()) == list(range(488, 1000)) and latest(spark.range(3), ["id"]).count() == 3
