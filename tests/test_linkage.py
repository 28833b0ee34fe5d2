import pytest
from pyspark.sql import functions as F

from bibloom.operators import corpus as corpora
from bibloom.operators import gate, graph, screening
from bibloom.sources.payloads import as_works, from_openalex
from bibloom.sources.schema import WORK

TITLE = "coherence of superconducting circuits in large cavities"


def corpus(spark, *rows):
    base = {"doi": None, "arxiv_id": None, "year": "", "authors": []}
    full = [(k, *(x[1] for x in sorted((base | r).items()))) for k, r in enumerate(rows)]
    names = sorted(base | rows[0])
    kinds = {"authors": "array<string>"}
    df = spark.createDataFrame(full, "position long, " + ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))
    work = as_works(df.withColumn("p", F.col("position")), **{n: F.col(n) for n in names})
    keyed = df.select("position", *[F.col(n) for n in names])
    defaults = {n.split(" ")[0]: c for n, c in ((part, None) for part in WORK.split(", "))}
    out = keyed.withColumn("work_id", F.col("position"))
    for name in defaults:
        if name not in out.columns:
            kind = dict(p.split(" ") for p in WORK.split(", "))[name]
            out = out.withColumn(name, {"string": F.lit(""), "int": F.lit(0), "boolean": F.lit(False)}.get(kind, F.array().cast(kind) if kind.startswith("array") else F.create_map().cast(kind)))
    assert work.count() == out.count()
    return out


CASES = [
    ([{"title": "a title", "doi": "10.1/x"}, {"title": "another one", "doi": "10.1/x"}], 1),
    ([{"title": "a title", "arxiv_id": "1712.30001"}, {"title": "other", "arxiv_id": "1712.30001"}], 1),
    ([{"title": TITLE}, {"title": TITLE + "."}], 1),
    ([{"title": TITLE, "doi": "10.1/a"}, {"title": "spectra of dense gas", "doi": "10.1/b"}], 2),
    ([{"title": TITLE + " tome one", "doi": "10.1/a"}, {"title": TITLE + " tome two", "doi": "10.1/b"}], 2),
    ([{"title": TITLE + " v1", "arxiv_id": "1712.30001"}, {"title": TITLE + " v2", "arxiv_id": "1712.30002"}], 2),
    ([{"title": TITLE, "doi": "10.1/a"}, {"title": TITLE}], 1),
    ([{"title": TITLE, "doi": "10.1/a"}, {"title": TITLE, "doi": "10.48550/arxiv.1712.30001", "arxiv_id": "1712.30001"}], 1),
    ([{"title": TITLE, "doi": "10.1/a", "year": "2020", "authors": ["Ada Quill"]}, {"title": TITLE, "doi": "10.1/b", "year": "2020", "authors": ["Quill, Ada"]}], 1),
    ([{"title": TITLE, "doi": "10.1/a", "year": "2020", "authors": ["Ada Quill"]}, {"title": TITLE, "doi": "10.1/b", "year": "2021", "authors": ["Quill, Ada"]}], 2),
    ([{"title": TITLE, "doi": "10.1/a", "year": "2020", "authors": ["Ada Quill"]}, {"title": TITLE, "doi": "10.1/b", "year": "2020", "authors": ["Doe, J"]}], 2),
]


@pytest.mark.parametrize(("rows", "n"), CASES)
def test_dedup_truth_table(spark, rows, n):
    assert corpora.deduplicated(corpus(spark, *rows)).count() == n


def test_merge_fills_blanks_and_keeps_the_publisher_doi(spark):
    rows = CASES[7][0]
    r = corpora.deduplicated(corpus(spark, *rows)).first()
    assert (r["doi"], r["arxiv_id"]) == ("10.1/a", "1712.30001")


def test_citations_ignore_self_and_repeats(spark):
    works = spark.createDataFrame([(1, 1, {"s": "A"}, ["A", "B", "B", "B"]), (2, 2, {"s": "B"}, [])], "work_id long, position long, source_ids map<string,string>, references array<string>")
    assert sorted(map(tuple, graph.in_corpus_citations(works).collect())) == [(1, 0), (2, 1)]


def test_rates(spark):
    works = spark.createDataFrame([("2010", 340), ("2025", 120), ("", 900)], "year string, cited_by_count int")
    assert [r["rate"] for r in graph.signals(works, 2026).collect()] == [20.0, 60.0, 0.0]


def verdicts(spark, *rows):
    return spark.createDataFrame(list(rows), "index long, t string, verdict string, reason string, role string")


def test_verdicts_move_to_the_work_they_name(spark):
    w = corpus(spark, {"title": "alpha beta gamma delta one"}, {"title": "second paper about noise"}, {"title": "third paper about loss"})
    out = screening.verdict_counts(screening.align(w, verdicts(spark, (0, "third paper about loss", "include", "r", "")))).first()
    assert (out["realigned"], out["misaligned"], out["include"]) == (1, 0, 1)
    out = screening.verdict_counts(screening.align(w, verdicts(spark, (0, "names no work here", "include", "r", "")))).first()
    assert (out["realigned"], out["misaligned"], out["include"]) == (0, 1, 0)
    out = screening.verdict_counts(screening.align(w, verdicts(spark, (0, "", "include", "r", "review")))).first()
    assert (out["unverified"], out["include"], out["roled"]) == (1, 1, 1)


def test_shared_checksum_is_refused(spark):
    w = corpus(spark, {"title": "x y z w"}, {"title": "same first four words a"}, {"title": "same first four words b"})
    out = screening.verdict_counts(screening.align(w, verdicts(spark, (0, "same first four words", "include", "r", "")))).first()
    assert (out["realigned"], out["misaligned"]) == (0, 1)


def test_gate(spark):
    w = corpus(spark, {"title": TITLE, "doi": "10.1/known"}, {"title": TITLE, "doi": "10.1/unknown", "arxiv_id": "1905.04321"}, {"title": "not the title at all", "doi": "10.1/known"}, {"title": TITLE, "doi": "10.5281/z"})
    records = spark.createDataFrame([("crossref", "10.1/known", TITLE, ["Doe, J"], "2020", "J", "1", "2", ""), ("datacite", "10.5281/z", "anything", [], "2019", "Zenodo", "", "", "")], "source string, doi string, title string, authors array<string>, year string, journal string, volume string, pages string, url string")
    out = {r["position"]: r for r in gate.enriched(gate.gate(w, records)).collect()}
    assert [out[k]["validation"] for k in range(4)] == ["verified", "quarantined", "quarantined", "verified"]
    assert (out[0]["year"], out[0]["authors"], out[1]["year"]) == ("2020", ["Doe, J"], "2019")


def test_openalex_payload(spark):
    payload = '{"id":"https://openalex.org/W1","doi":"https://doi.org/10.1/A","display_name":"T","publication_year":2020,"authorships":[{"author":{"display_name":"A B"}},{"author":{}}],"abstract_inverted_index":{"b":[1],"a":[0,2]},"referenced_works":["https://openalex.org/W2"],"biblio":{"first_page":"7","last_page":"7"}}'
    r = from_openalex(spark.createDataFrame([(payload,)], "payload string")).first()
    assert (r["doi"], r["abstract"], r["authors"], r["references"], r["pages"], r["source_ids"]) == ("10.1/a", "a b a", ["A B"], ["W2"], "7", {"openalex": "W1"})


def test_extraction_falls_back_only_while_nothing_is_screened(spark):
    from bibloom.operators import screening

    kind = "work_id long, screen string, screen_reason string, validation string, title string, doi string, arxiv_id string, year string, abstract string"
    row = lambda k, screen, reason, validation="verified": (k, screen, reason, validation, "t", "", "", "", "")
    tasks = lambda *rows: {r["work_id"] for r in screening.extraction_tasks(spark.createDataFrame(list(rows), kind), ["x"]).collect()}
    assert tasks(row(1, "exclude", "off topic")) == set()
    assert tasks(row(1, "", ""), row(2, "exclude", "rule: year"), row(3, "", "", "quarantined")) == {1, 2}
    assert tasks(row(1, "include", ""), row(2, "", "")) == {1} and tasks(row(1, "include", "", "quarantined"), row(2, "", "")) == set()


def test_gate_takes_the_nearest_title(spark):
    near, far = "a long title on harbours and their tides at nite", "a wholly other title"
    w = corpus(spark, {"title": "A long title on harbours and their tides at night"}, {"title": "Nothing like it"}, {"title": near})
    records = spark.createDataFrame([("openalex", "", t, [], y, "", "", "", "") for t, y in ((near, "2001"), (far, "2002"))], "source string, doi string, title string, authors array<string>, year string, journal string, volume string, pages string, url string")
    out = {r["position"]: (r["validation"], r["validation_source"]) for r in gate.gate(w, records).collect()}
    assert out == {0: ("verified", "openalex"), 1: ("quarantined", ""), 2: ("verified", "openalex")}
