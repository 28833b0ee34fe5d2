"""Measures, reading plan, checks that fail, corpus files, JSON reports and the SQL surface, by small examples."""

import json

import pytest
from pyspark.sql import functions as F

from bibloom.functions import sql
from bibloom.operators import bib, evidence, graph, metrics, reports, screening, verification
from bibloom.plans.queries import WORK_TYPES
from bibloom.sources import readers

KIND = dict(p.split(" ") for p in WORK_TYPES.split(", "))


def works(spark, *rows):
    blank = {c: [] if t.startswith("array") else {} if t.startswith("map") else 0 if t == "int" else False if t == "boolean" else "" for c, t in KIND.items()}
    return spark.createDataFrame([tuple((blank | {"position": k, "work_id": k} | r)[c] for c in KIND) for k, r in enumerate(rows)], WORK_TYPES)


def test_measures_come_from_one_pass_a_stage(spark):
    w = works(
        spark, {"title": "tides of the harbour", "abstract": "tide gauge", "screen": "include", "validation": "verified", "authors": ["Quill, Ada"], "year": "2001", "doi": "10.5555/a"},
        {"title": "tides of the harbour.", "abstract": "crane", "screen": "include", "validation": "quarantined", "doi": "10.5/b"}, {"title": "cats", "screen": "unsure", "validation": ""}, {"title": "on gauges", "screen": "exclude", "abstract": "gauge", "validation": "verified", "authors": ["Reed, Bo"]},
    )
    gold = spark.createDataFrame([("a", "doi:10.5555/A"), ("z", "10.5/z"), ("b", "10.5/b")], "key string, doi string")
    row = metrics.measured(w, gold, ["tides", "harbour"], ["gauge"], ["cats"])
    assert row == {
        "corpus_size": 4, "topical_kept": 2, "topical_dropped": 2, "triage_to_model": 2, "triage_by_rule": 2, "includes_lost_to_triage": 1, "gate_verified": 2, "gate_quarantined": 1, "screened_include": 2, "screened_unsure": 1,
        "dedup_merges": 0, "bib_entries": 1, "bib_errors": 0, "gold_total": 3, "gold_found": 2, "triage_saving_pct": 50.0, "triage_yield_pct": 50.0, "gold_recall_pct": 66.7,
    }
    assert metrics.regressions(row, row) == []
    assert metrics.regressions(row | {"triage_yield_pct": 48.0, "bib_errors": 1, "flag": False}, row | {"flag": True, "gone": [1]}) == ["bib_errors: 0 -> 1", "flag: True -> False", "gone: [1] -> None"]


def test_reading_plan_tells_how_many_more(spark):
    rows = [{"title": f"t|{k}", "role": "review" if k < 10 else "method" if k < 12 else "", "year": "2025" if k % 2 else "", "cited_by_count": k} for k in range(30)]
    w = graph.signals(works(spark, *rows).withColumn("in_corpus", F.when(F.col("position").isin(12, 13), 5).otherwise(0)), 2026)
    lines = [r.line for r in reports.reading_plan(graph.phases(w, 2026)).orderBy("place").collect()]
    assert lines[:3] == ["| Kind | Works |", "| --- | --- |", "| review | 10 |"] and "| unclassified | 18 |" in lines
    at = lines.index("## Phase 1 -- Foundation")
    assert lines[at + 2] == "Showing 8 of 12." and lines[at + 6] == "| (not in refs.bib) | 2025 | review | 4.5 | 0 | - | t/9 |"
    assert "4 further work(s) in this phase are in corpus.jsonl." in lines and sum(x.startswith("| (not") for x in lines) == 8 + 9 + 9
    empty = [r.line for r in reports.reading_plan(graph.phases(w.limit(0), 2026)).orderBy("place").collect()]
    assert empty.count("Nothing was placed in this phase.") == 3 and "| review | 0 |" in empty
    assert {r.phase: (r.n, r.shown) for r in reports.phase_counts(graph.phases(w, 2026)).collect()} == {"foundation": (12, 8), "core": (9, 9), "frontier": (9, 9)}


def test_a_batch_of_foreign_works_fails_when_it_is_read(spark):
    w = works(spark, {"title": "a"}, {"title": "b"}, {"title": "c"})
    assert screening.held_by(w.where("work_id < 2"), w).count() == 2 and screening.batches(w, corpus=w).count() == 3
    with pytest.raises(Exception, match="work 2 is not in the corpus"):
        screening.held_by(w, w.where("work_id < 2")).collect()
    with pytest.raises(Exception, match="not in the corpus"):
        screening.batches(w, corpus=w.where("work_id > 0")).collect()


def test_corpus_files_keep_their_order_and_merge_when_read(spark, tmp_path):
    w = works(spark, *[{"title": f"title number {chr(97 + k) * 5} {k * 7919}", "doi": f"10.5/{k}", "sources": ["a"], "cited_by_count": k} for k in range(40)])
    readers.write_works(w.repartition(5), str(tmp_path / "corpus"))
    lines = [x for part in sorted((tmp_path / "corpus").glob("part-*")) for x in part.read_text().split("\n") if x]
    assert [json.loads(x)["doi"] for x in lines] == [f"10.5/{k}" for k in range(40)]
    back = readers.read_corpus(spark, str(tmp_path / "corpus"))
    assert [(r.position, r.title, r.sources, r.cited_by_count) for r in back.orderBy("position").collect()] == [(r.position, r.title, r.sources, r.cited_by_count) for r in w.orderBy("position").collect()]
    (tmp_path / "twice.jsonl").write_text("\n".join([*lines, "", lines[3].replace('"cited_by_count":3', '"cited_by_count":900'), '{"title": ""}', '{"title": "only this", "unknown": 1}']) + "\n")
    again = {r.doi: r for r in readers.read_corpus(spark, str(tmp_path / "twice.jsonl")).collect()}
    assert len(again) == 41 and again["10.5/3"].cited_by_count == 900 and again[None].title == "only this"


def test_evidence_without_a_file_is_empty(spark, tmp_path):
    assert readers.read_evidence(spark, str(tmp_path / "none.jsonl"), ["speed"]).collect() == []


def test_conflicts_show_both_ends(spark):
    rows = spark.createDataFrame([("k1", 1, "2,5", "Cold", "q|1\nx", "high"), ("k2", 2, "25", "cold ", "q2", ""), ("k3", 3, "25", "COLD", "q3", None), ("k1", 4, "900", "warm", "", ""), ("k4", 5, "0", "cold", "", "")], "cite_key string, position long, speed string, where string, source_quote string, confidence string")
    found = evidence.conflicts(rows, ["speed"], ["where"])
    (line,) = [r.line for r in reports.conflict_rows(found, ["where"]).collect()]
    assert line.split("\n") == [
        "## speed -- where=cold", "", "3 row(s) from 3 paper(s) span 2.5 to 25 (10x).", "", "| | Cite key | Value | Read from | Quote |", "| --- | --- | --- | --- | --- |",
        "| low | k1 | 2,5 | high | q/1 x |", "| high | k3 | 25 | - | q3 |",
    ]


SOURCE = "@article{a, title = {On Birds}, author = {Doe, Jane}, year = 2020}\n@misc{b, title = {x}, year = {2001}}\n@misc{c, title = {Ümlaut}, author = {Poe, É.}}\n"


def test_json_reports_hold_key_problems_and_verifications(spark):
    entries = bib.keyed(bib.parse_files(spark.createDataFrame([("f", SOURCE)], "file string, source string")).where("kind = 'entry'"))
    records = spark.createDataFrame([("crossref", "10.5/a", "On Beasts", ["Doe, Jane"], "2020", "", "", "", "")], "source string, doi string, title string, authors array<string>, year string, journal string, volume string, pages string, url string")
    hits = records.select(F.lit("f").alias("file"), F.lit(0).alias("node_pos"), F.lit(0).alias("place"), "*").withColumn("title", F.lit("On Birds"))
    checked = verification.verified(entries, records, hits)
    (r,) = reports.json_reports(bib.findings(entries), entries, checked=checked).collect()
    got = json.loads(r.report)
    assert got["key_problems"] == [{"key": "b", "reason": "cannot determine a first-author surname from the author field"}, {"key": "c", "reason": "no 4-digit year found in the year field"}]
    assert got["rename_map"] == {"a": "Doe2020"} and got["entry_count"] == 3
    assert got["verifications"]["Doe2020"]["verdict"] == "verified" and got["verifications"]["Doe2020"]["source"] == "crossref" and got["verifications"]["b"] == {"verdict": "not_found", "source": "", "comparisons": [], "suggestions": {}}
    assert {c["field"]: c["status"] for c in got["verifications"]["Doe2020"]["comparisons"]} == {"title": "match", "author": "match", "year": "match", "doi": "missing-local"}
    lines = {x.line for x in reports.verification_rows(checked).collect()}
    assert "| `Doe2020` | verified | crossref | - |" in lines and "| `c` | not_found | - | - |" in lines


def test_letters_spelled_anew_are_told(spark):
    entries = bib.parse_files(spark.createDataFrame([("f", SOURCE)], "file string, source string")).where("kind = 'entry'")
    told = {(r.key, r.level, r.message) for r in bib.changes(entries, ascii_only=True).where("code = 'ascii'").collect()}
    assert told == {("c", "info", "title: rewrote non-ASCII characters as LaTeX escapes"), ("c", "info", "author: rewrote non-ASCII characters as LaTeX escapes")}
    assert bib.changes(entries).where("code = 'ascii'").count() == 0


def test_run_log_holds_the_whole_run(spark):
    gated = works(spark, {"title": "a", "validation": "verified", "doi": "10.5/a", "screen": "exclude"}, {"title": "b", "validation": "quarantined"})
    gold = screening.gold_recall(spark.createDataFrame([("x", "10.5/a"), ("y", "10.5/y")], "key string, doi string"), gated)
    known = screening.known_items(spark.createDataFrame([(2, "B"), (1, "zz")], "item_id long, title string"), gated)
    (r,) = reports.run_log(gated, {"question": F.lit("why?"), "queries": F.array(F.lit("q"))}, [{"round": 1, "new": 2, "new_fraction": 0.5}], known, gold).collect()
    assert json.loads(r.line) == {
        "question": "why?", "queries": ["q"], "corpus_size": 2, "verified": 1, "quarantined": 1, "saturation_curve": [{"round": 1, "new": 2, "new_fraction": 0.5}],
        "known_items": [{"wanted": "zz", "found": False, "best_match": "", "similarity": 0.0}, {"wanted": "B", "found": True, "best_match": "b", "similarity": 1.0}],
        "gold_set": {"total": 2, "found": 1, "recall_pct": 50.0, "missed": ["y"], "found_but_screened_out": ["x"]},
    }


def test_bibtex_and_functions_in_sql(spark):
    sql.register(spark)
    files = spark.createDataFrame([("f", SOURCE), ("g", "@misc{broken"), ("h", None)], "file string, source string")
    rows = spark.sql("SELECT file, b.* FROM {files}, LATERAL parse_bibtex(source) AS b", files=files).collect()
    assert [(r.file, r.key, r.fields["title"], r.line) for r in rows if r.kind == "entry"] == [("f", "a", "On Birds", 1), ("f", "b", "x", 2), ("f", "c", "Ümlaut", 3)]
    assert [(r.file, r.error) for r in rows if r.kind == "error"] == [("g", "unbalanced '{' on line 1")]
    one = spark.sql("SELECT title_key('{Ü}ber \"x\"'), first_surname('van der Berg, A. and Roe, B.'), size(split_authors('A and {B and C}')), title_ratio('abcd', 'abce'), fold_latex('{\\\\\\'e}'), latexify('é')").first()
    assert tuple(one) == ("uber x", "vanderBerg", 2, 0.75, "e", "{\\'e}")
