"""Forests, free JSON of any depth, and a document written in parts."""

import json
from functools import partial
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkseam.operators import governance as G
from sparkseam.operators import ranges, report
from sparkseam.operators.recursion import ROW_LIMIT, forest, json_values


def test_forest_of_chains_hub_and_cycle(spark):
    rows = [("r", None), ("a", "r"), ("b", "a"), ("x", "y"), ("y", "x"), ("below", "x"), ("lost", "gone"), (None, "r")]
    rows += [(f"h{i}", "hub") for i in range(2000)] + [("hub", None)]
    got = {(r[0], r[1], r[2]) for r in forest(spark.createDataFrame(rows, "k string, p string"), "k", "p").collect()}
    want = {("r", "r", 0), ("a", "r", 1), ("b", "r", 2), (None, "r", 1), ("hub", "hub", 0)} | {(f"h{i}", "hub", 1) for i in range(2000)}
    assert got == want


def test_forest_repeats_empty_and_too_deep(spark):
    kind = "k int, p int"
    assert forest(spark.createDataFrame([], kind), "k", "p").count() == 0
    assert forest(spark.createDataFrame([(1, None), (1, None), (2, 1)], kind), "k", "p").count() == 4
    chain = spark.range(12).select(F.col("id").alias("k"), F.when(F.col("id") > 0, F.col("id") - 1).alias("p"))
    assert forest(chain, "k", "p").agg(F.max("depth")).first()[0] == 11
    before = spark.conf.get(ROW_LIMIT)
    with pytest.raises(Exception, match="(?i)recursion"):
        forest(chain, "k", "p", 5)
    assert spark.conf.get(ROW_LIMIT) == before


def walk(v, at="$"):
    if isinstance(v, dict):
        return [x for k, y in v.items() for x in walk(y, f"{at}.{k}")]
    if isinstance(v, list):
        return [x for i, y in enumerate(v) for x in walk(y, f"{at}[{i}]")]
    return [(at, v)]


NESTED = {"a": [1, {"b": "x<b>", "c": None}], "d": {"e": {"f": ["../x", "ok", []]}, "g": {}}, "q\"uo:te\\": "back\\slash \"q\" \x01 é :", "t": True}
DEEP = "plain"
for _ in range(8):
    DEEP = {"n": [DEEP]}


def test_values_of_free_json_at_any_depth(spark):
    given = [(1, json.dumps(NESTED)), (2, json.dumps(DEEP)), (3, "not json"), (4, None), (5, '"alone"'), (6, "[]")]
    got = json_values(spark.createDataFrame(given, "id int, j string"), "id", "j").collect()
    assert {(r.id, r.at, r.value) for r in got if r.kind == "STRING"} == {(i, at, v) for i, j in ((1, NESTED), (2, DEEP), (5, "alone"))
        for at, v in walk(j) if isinstance(v, str)}
    assert len(got) == len(walk(NESTED)) + 2


def test_free_json_is_sanitised_and_keeps_its_shape(spark):
    given = [(1, json.dumps(NESTED)), (2, json.dumps(DEEP)), (3, "not json"), (4, None), (5, '"a\\u0001b"'), (6, json.dumps({"s": "\\\"\n" * 20000}))]
    rows = spark.createDataFrame(given, "id int, j string")
    got = dict(rows.select("id", G.sanitised_json(F.col("j"))).collect())
    clean = json.loads(json.dumps(NESTED).replace("\\u0001", ""))
    assert json.loads(got[1]) == clean and json.loads(got[2]) == DEEP and got[3] is got[4] is None and json.loads(got[5]) == "ab"
    assert json.loads(got[6]) == {"s": "\\\"\n" * 20000}
    bad = {(r.id, r.at, r.reason) for r in G.json_rejects(rows, "id", "j").collect()}
    assert bad == {(1, "$.a[1].b", "html"), (1, "$.d.e.f[0]", "path_traversal"), (6, "$.s", "length")}


def test_a_sarif_document_in_parts_is_valid_json(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(report, "row_numbers", partial(ranges.row_numbers, per_range=50))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    kind = "ord long, file_path string, rule_id string, issue string, line_number int, severity string, detector string"
    rows = [(i, f"a\\f{i % 3}", f"R{i % 7}", "said \"x\",\n]}", None if i % 2 else i, "HIGH", "d") for i in range(400)] + [(0, "a\\f0", "R0",
        "said \"x\",\n]}", 0, "HIGH", "d")]
    for given in (rows, rows[:1], []):
        path = tmp_path / str(len(given))
        report.write_sarif_parts(spark.createDataFrame(given, kind).repartition(5), "ord", str(path))
        parts = sorted(Path(path).glob("part-*"))
        document = json.loads("".join(p.read_text() for p in parts))
        run = document["runs"][0]
        assert document["version"] == "2.1.0" and len(run["results"]) == len(given)
        assert [r["id"] for r in run["tool"]["driver"]["rules"]] == sorted({r[2] for r in given})
        assert all(r["message"]["text"] == "said \"x\",\n]}" and "\\" not in r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"]
            for r in run["results"])
        assert len(given) < 2 or len(parts) > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
