"""A file checked and a search run from end to end, on small recorded inputs."""

import json

import pytest

from bibloom.plans import check
from bibloom.plans.search import SearchSpec, run
from bibloom.sources import cache, retrieval
from bibloom.sources.retrieval import Request

BIB = """%%%%%%%%%%%%%%%%%%%%%%%%%
%% Harbours
%%%%%%%%%%%%%%%%%%%%%%%%%
@Article{z9, title = {Tides of {N}ight}, author = {Reed, Bo}, year = 2001, journal = {J. Sea}, volume = 3, pages = {1-9}, doi = {https://doi.org/10.1234/abc}}
% kept with its entry
@article{a1, title = {Cranés}, author = {Quill, Ada}, year = {1999}, journal = {J. Sea}, volume = {1}, pages = {2--3}, doi = {10.1234/def}}
@misc{who, title = {No one}, year = {2000}, url = {https://x.y}}
"""


def lines(path):
    return [x for part in sorted(path.glob("part-*")) for x in part.read_text(encoding="utf-8").split("\n")]


def test_a_file_is_checked(spark, tmp_path):
    (tmp_path / "refs.bib").write_text(BIB, encoding="utf-8")
    assert check.run(spark, str(tmp_path / "refs.bib"), str(tmp_path / "out"), ascii_only=True) == 2
    text = "\n".join(lines(tmp_path / "out" / "refs_checked.bib"))
    assert text.index("%% Harbours") < text.index("@article{Quill1999,") < text.index("@article{Reed2001,") and "% kept with its entry\n@article{Quill1999" in text
    assert "doi     = {10.1234/abc}" in text and "{1--9}" in text and "Cran{\\'e}s" in text and "@misc{who," in text
    report = json.loads("".join(lines(tmp_path / "out" / "refs_report.json")))
    assert report["rename_map"] == {"z9": "Reed2001", "a1": "Quill1999"} and report["entry_count"] == 3 and report["exit_code"] == 2
    assert [p["key"] for p in report["key_problems"]] == ["who"]
    codes = {(f["key"], f["code"]) for f in report["findings"]}
    assert {("who", "unkeyable"), ("who", "missing-field"), ("Reed2001", "doi-prefix"), ("Reed2001", "page-range"), ("Reed2001", "entry-type-case"), ("Quill1999", "ascii")} <= codes and (None, "non-ascii") in codes
    assert any(x.startswith("[1] A. Quill") or "Quill, Ada. Cranes." in x for x in lines(tmp_path / "out" / "refs_references.txt"))
    assert (tmp_path / "refs.bib").read_text(encoding="utf-8") == BIB


def test_a_file_is_verified_and_filled(spark, tmp_path):
    (tmp_path / "refs.bib").write_text("@article{b, title = {Tides of night and day}, author = {Reed, Bo}, year = {2001}, journal = {J. Sea}, pages = {1--9}}\n")
    record = ("crossref", "10.1234/abc", "Tides of night and day", ["Reed, Bo"], "2001", "J. Sea", "7", "1-9", "")
    records = spark.createDataFrame([record], "source string, doi string, title string, authors array<string>, year string, journal string, volume string, pages string, url string")
    assert check.run(spark, str(tmp_path / "refs.bib"), str(tmp_path), records=records, fix=True, strict=True) in (0, 2)
    text = "\n".join(lines(tmp_path / "refs_checked.bib"))
    assert "volume  = {7}" in text and "doi     = {10.1234/abc}" in text
    report = json.loads("".join(lines(tmp_path / "refs_report.json")))
    assert report["verifications"]["Reed2001"]["verdict"] == "verified" and "fixed-from-index" in {f["code"] for f in report["findings"]}


@pytest.fixture(scope="module")
def answered(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("search") / "answers")
    item = lambda k, title, year=2001, refs=(), cites=0: json.dumps({"id": f"https://openalex.org/W{k}", "doi": f"https://doi.org/10.1234/w{k}", "display_name": title, "publication_year": year, "cited_by_count": cites, "referenced_works": [f"https://openalex.org/W{r}" for r in refs], "authorships": [{"author": {"display_name": "Ada Quill"}}], "abstract_inverted_index": {"harbour": [0], "tides": [1], "gauge": [2]}})
    found = {
        Request("openalex", "search", "harbour tides", 50): [item(1, "harbour tides by night", refs=(2,), cites=40), item(3, "a dull note on harbour tides", cites=1)],
        Request("openalex", "cited_by", "W1", 50): [], Request("openalex", "work", "W2", 1): [item(2, "older harbour tides", 1990)], Request("openalex", "cited_by", "W3", 50): [], Request("openalex", "cited_by", "W2", 50): [],
    }
    rows = [(r.key(None, None), k, p) for r, items in found.items() for k, p in enumerate(items or [None])]
    retrieval.record(spark.createDataFrame(rows, "key string, place int, payload string"), root)
    return root


def test_a_search_runs_twice_and_ends_in_its_files(spark, tmp_path, answered):
    log = cache.ResponseLog(spark, str(tmp_path / "responses"))
    crossref = lambda k, title: (f"crossref:doi:10.1234/w{k}", json.dumps({"DOI": f"10.1234/w{k}", "title": [title], "author": [{"family": "Quill", "given": "Ada"}], "issued": {"date-parts": [[2001]]}, "volume": "3"}))
    log.append(spark.createDataFrame([crossref(1, "harbour tides by night"), crossref(2, "older harbour tides"), crossref(3, "another paper")], "key string, payload string"))
    gold = tmp_path / "gold.json"
    gold.write_text(json.dumps({"papers": [{"doi": "10.1234/W2", "key": "two"}, {"doi": "10.1234/none", "key": "none"}]}))
    spec = SearchSpec("what?", ("harbour tides",), sources=("openalex",), known_items=("Harbour tides by night", "not there at all"), gold_set=str(gold), required=("gauge",), fields=("speed", "place"), max_rounds=2, saturation=0.0)
    out = tmp_path / "out"
    assert run(spark, spec, str(out), log, answered) == 1
    log_row = json.loads(lines(out / "run.json")[0])
    assert (log_row["corpus_size"], log_row["verified"], log_row["quarantined"]) == (3, 2, 1) and log_row["gold_set"]["missed"] == ["none"] and [k["found"] for k in log_row["known_items"]] == [True, False]
    assert log_row["saturation_curve"][0]["new"] == 1
    batch = json.loads(lines(out / "screen" / "batches")[0])
    assert [w["t"] for w in batch["works"]] == ["harbour tides by night", "a dull note on harbour tides", "older harbour tides"]
    assert any("a dull note" in x for x in lines(out / "quarantine.md")) and "@article" not in "".join(lines(out / "refs.bib"))[:2]
    assert {json.loads(x)["cite_key"] for x in lines(out / "extract" / "tasks") if x} == {"Quill2001", "Quill1990"}

    first, note = batch["works"][0], batch["works"][1]
    (out / "screen" / "verdicts.jsonl").write_text("\n".join(json.dumps(v) for v in ({"index": first["i"], "t": first["c"], "verdict": "include", "reason": "on topic", "role": "primary"}, {"index": note["i"], "t": note["c"], "verdict": "exclude", "reason": "dull"})))
    (out / "extract" / "rows.jsonl").write_text("\n".join(json.dumps(r) for r in ({"cite_key": "Quill2001", "speed": "2", "place": "Pier", "source_quote": "2 m/s"}, {"cite_key": "Other1999", "speed": "9", "place": "pier", "source_quote": "9 m/s"}, {"cite_key": "x", "speed": "1"})))
    assert run(spark, spec, str(out), log, answered) == 1
    counts = json.loads(lines(out / "screen" / "counts")[0])
    assert (counts["include"], counts["exclude"], counts["unscreened"], counts["roled"]) == (1, 1, 1, 1)
    refs = "\n".join(lines(out / "refs.bib"))
    assert "@misc" in refs or "@article" in refs and "Quill2001" in refs and "Quill1990" not in refs
    plan = lines(out / "reading_plan.md")
    assert "| primary | 1 |" in plan and any(x.startswith("| Quill2001 | 2001 | primary |") for x in plan)
    assert any("4.5x" in x for x in lines(out / "conflicts.md"))
    assert len([x for x in lines(out / "evidence.csv") if "m/s" in x]) == 2
    works = [json.loads(x) for x in lines(out / "corpus.jsonl") if x]
    assert [w["title"] for w in works] == ["harbour tides by night", "a dull note on harbour tides", "older harbour tides"] and works[0]["screen"] == "include" and works[0]["volume"] == "3"
