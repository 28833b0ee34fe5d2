"""Layout of files, refs.bib with its lint, cite keys, tasks and escapes."""

import json

import pytest
from pyspark.sql import functions as F

from bibloom.operators import bib, export, reports, screening

SOURCE = """@string{x = "y"}

%%%%%%%%%%%%%%%%%%%%%%%%% one

% loose

% about zed
@misc{Zed, title = {Last}}

% about beta
@misc{beta, title = {B}}

%%%%%%%%%%%%%%%%%%%%%%%%% two

@misc{Alpha, title = {A}}
"""


def heads(spark, sort):
    nodes = bib.parse_files(spark.createDataFrame([("f", SOURCE)], "file string, source string"))
    return [r.line.split("\n")[0] for r in export.laid_out(nodes, sort).orderBy("place").collect()]


def test_sorts(spark):
    one, two = "%" * 25 + " one", "%" * 25 + " two"
    raw = '@string{x = "y"}'
    assert heads(spark, "sections") == [raw, one, "% about beta", "% about zed", two, "@misc{Alpha,"]
    assert heads(spark, "global") == [raw, one, two, "@misc{Alpha,", "% about beta", "% about zed"]
    assert heads(spark, "none") == [raw, one, "% loose", "% about zed", "% about beta", two, "@misc{Alpha,"]
    with pytest.raises(ValueError):
        heads(spark, "else")


def works(spark):
    text = ("venue", "volume", "pages", "oa_pdf_url", "doi", "arxiv_id", "abstract", "screen", "screen_reason", "validation")
    rows = [(1, "Grüne Wege", ["Ada Roe"], "2001"), (2, "Other ways", ["Bo Roe"], "2001"), (3, "", ["C Doe"], "2002"), (4, "No one", [], "2003"), (5, "Null", None, "2003")]
    w = spark.createDataFrame(rows, "position int, title string, authors array<string>, year string")
    return w.withColumn("work_id", F.col("position")).withColumns({c: F.lit("") for c in text}).withColumn("validation", F.lit("verified"))


def test_bibliography(spark):
    w = works(spark)
    keys = {r.work_id: r.cite_key for r in export.cite_keys(w).collect()}
    assert keys == {1: "Roe2001a", 2: "Roe2001b"}
    lines, found = export.bibliography(w)
    first = lines.orderBy("place").first().line
    assert first.startswith("@article{Roe2001a,") and first.isascii()
    assert {(r.key, r.level) for r in found.where("level = 'error'").collect()} == set()
    assert {r.key for r in found.collect()} == {"Roe2001a", "Roe2001b"}
    assert sorted(r.work_id for r in export.uncitable(w).collect()) == [3, 4, 5]


def test_tasks_carry_cite_keys(spark):
    w = works(spark)
    tasks = {r.work_id: json.loads(r.task) for r in screening.extraction_tasks(w, ["x"], export.cite_keys(w), "read it").collect()}
    assert tasks[1]["cite_key"] == "Roe2001a" and tasks[4]["cite_key"] == "work004"
    assert tasks[1]["instructions"] == "read it" and tasks[1]["has_open_access_pdf"] is False and tasks[1]["schema"] == ["x"]


def test_json_report_and_escapes(spark):
    entries = spark.createDataFrame([("f", "a", "b"), ("f", "c", "c"), ("g", "d", "d")], "file string, key string, new_key string")
    found = spark.createDataFrame([("f", "c", 2, "info", "i", "m"), ("f", "b", 1, "error", "e", "m")], "file string, key string, line int, level string, code string, message string")
    out = {r.file: json.loads(r.report) for r in reports.json_reports(found, entries).collect()}
    assert [x["code"] for x in out["f"]["findings"]] == ["e", "i"] and out["f"]["counts"] == {"error": 1, "warning": 0, "info": 1}
    assert out["f"]["rename_map"] == {"a": "b"} and out["f"]["exit_code"] == 2
    assert out["g"]["findings"] == [] and out["g"]["exit_code"] == 0 and out["g"]["entry_count"] == 1
    line = spark.createDataFrame([("né",), (None,)], "line string").select(reports.escaped("line").alias("x"))
    assert [r.x for r in line.collect()] == ["n\\xe9", None]
