from pyspark.sql import functions as F

from bibloom.operators import bib, reports, verification

SOURCE = """@article{a, title = {On {B}irds}, author = {Doe, Jane and Roe, R.}, year = 2020, journal = {J. X}, volume = {3}, pages = {1--9}, doi = {10.1/A}}
@article{b, title = {On fish and their ways}, author = {Doe, Jane and others}, year = 2021}
@misc{c, title = {On stones}, author = {Poe, E.}, year = 2019, eprint = {2004.14256}}
@software{d, title = {Tool}, author = {Lab}, year = 2018, doi = {10.5281/7}}
@article{e, title = {Nothing of the kind}, author = {Nix, N.}, year = 2000, doi = {10.1/none}}
"""
SCHEMA = "source string, doi string, title string, authors array<string>, year string, journal string, volume string, pages string, url string, published_doi string, published_journal string"
RECORDS = [
    ("crossref", "10.1/a", "On Beasts", ["Roe, R.", "Doe, Jane"], "2021", "J X", "4", "1-9", "", None, None),
    ("arxiv", None, "On stones", ["Poe, E."], "2020", "", "", "", "http://arxiv.org/abs/2004.14256v2", "10.1/s", "J. Y"),
    ("datacite", "10.5281/7", "lab/tool: v1", ["Someone"], "2018", "Zenodo", "", "", "", None, None),
]
HITS = [
    ("f", 1, 0, "openalex", "10.1/o", "On fish and their ways", ["Doe, Jane", "Roe, R."], "2021", "J Z", "7", "3", ""),
    ("f", 1, 1, "crossref", "10.1/f", "On fish and their way", ["Doe, Jane", "Roe, R."], "2021", "J Z", "7", "3-8", ""),
    ("f", 4, 0, "crossref", "10.1/x", "Nothing of the kind", ["Else, S."], "2000", "", "", "", ""),
]
HIT = "file string, node_pos int, place int, source string, doi string, title string, authors array<string>, year string, journal string, volume string, pages string, url string"


def checked(spark):
    entries = bib.parse_files(spark.createDataFrame([("f", SOURCE)], "file string, source string")).where("kind = 'entry'")
    return verification.verified(entries, spark.createDataFrame(RECORDS, SCHEMA), spark.createDataFrame(HITS, HIT))


def test_verification(spark):
    got = {r["key"]: r for r in checked(spark).collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {"a": "mismatched", "b": "verified", "c": "verified", "d": "verified", "e": "not_found"}
    assert {c["field"]: c["status"] for c in got["a"]["comparisons"]} == {"title": "mismatch", "author": "match", "year": "match", "journal": "match", "volume": "mismatch", "pages": "match", "doi": "match"}
    assert [(f["level"], f["message"]) for f in got["a"]["found"]] == [("error", "title: local 'On Birds' != crossref 'On Beasts'"), ("warning", "volume: local '3' != crossref '4'")]
    assert got["b"]["record"]["doi"] == "10.1/f"
    assert got["b"]["suggestions"] == {"journal": "J Z", "volume": "7", "pages": "3--8", "doi": "10.1/f", "author": "Doe, Jane and Roe, R."}
    assert [f["message"] for f in got["c"]["found"]] == ["arXiv:2004.14256 is now published as doi 10.1/s (J. Y); upgrade the entry"]
    assert [f["code"] for f in got["d"]["found"]] == ["repository-release"] and not got["d"]["comparisons"]
    assert [(f["level"], f["code"]) for f in got["e"]["found"]] == [("error", "doi-unresolved"), ("warning", "not-found")] and got["e"]["suggestions"] == {}


def test_applied(spark):
    b = verification.applied(checked(spark)).where("key = 'b'").first()
    assert {f["name"]: f["text"] for f in b["fields"]} == {"title": "On fish and their ways", "author": "Doe, Jane and Roe, R.", "year": "2021", "journal": "J Z", "volume": "7", "pages": "3--8", "doi": "10.1/f"}
    assert {f["code"] for f in b["found"]} == {"fixed-from-index"} and len(b["found"]) == 5


def test_findings_and_exit_code(spark, tmp_path):
    found = verification.verification_findings(checked(spark))
    files = spark.createDataFrame([("f",), ("g",)], "file string")
    assert {r["file"]: (r["errors"], r["exit_code"]) for r in reports.exit_codes(found, files).collect()} == {"f": (2, 2), "g": (0, 0)}
    reports.write_lines(reports.finding_rows(found), str(tmp_path / "r"), ["# Findings", "", *reports.head(reports.FINDING)])
    lines = [x for part in sorted((tmp_path / "r").glob("part-*")) for x in part.read_text().splitlines()]
    assert lines[2:4] == ["| level | key | code | message |", "| --- | --- | --- | --- |"]
    assert lines[4].startswith("| error | a | field-mismatch | title") and lines[-1].startswith("| info | d |")
    assert [r["line"] for r in reports.console_rows(found).orderBy("place").collect()][1] == "  [error  ] e: doi 10.1/none resolved in neither Crossref nor DataCite"


def test_plain_references(spark):
    entries = bib.parse_files(spark.createDataFrame([("f", SOURCE)], "file string, source string")).where("kind = 'entry'")
    lines = [r["line"] for r in reports.plain_references(entries).orderBy("number").collect()]
    assert lines[0] == "[1] Doe, Jane and Roe, R. On Birds. J. X 3, 1-9 (2020). https://doi.org/10.1/A"
    assert lines[1] == "[2] Doe, Jane et al. On fish and their ways. (2021)."
    assert lines[2] == "[3] Poe, E. On stones. (2019). arXiv:2004.14256"


def test_tables(spark):
    w = spark.createDataFrame([(1, "A|b", None, "", "2001", "", "", "no DOI", "quarantined"), (2, "", "10.1/x", "1", "", "unsure", "why", "", "verified")], "position int, title string, doi string, arxiv_id string, year string, screen string, screen_reason string, gate_reason string, validation string")
    assert [r["line"] for r in reports.quarantine_rows(w).collect()] == ["| A/b | - | - | no DOI |"]
    assert [r["line"] for r in reports.review_rows(w).orderBy("place").collect()] == ["| 2001 | A/b | unscreened |  |", "| - | (no title) | unsure | why |"]
    assert reports.run_log(w, {"question": F.lit("q")}).first()["line"] == '{"question":"q","corpus_size":2,"verified":1,"quarantined":1,"saturation_curve":[]}'


def test_general(spark):
    cells = [3.0, 12.5, 0.0, 1234567.0, 0.00012345678, 1e-7, 100000.0]
    got = spark.createDataFrame([(x,) for x in cells], "x double").select(reports.general(F.col("x")).alias("s")).collect()
    assert [r["s"] for r in got] == [f"{x:g}" for x in cells]
