"""Empty tables, repeated rows, missing ids and clashing columns, for every operator and the pipeline."""

import pytest

import corpus_pipeline
from bibloom.llm import cross_polytope, exact_dedup, html_extraction, language, line_dedup, near_dedup, packing, quality, sentencepiece_backend, spelling, substring_dedup, token_counts, whitening
from bibloom.llm.queries import vocabulary

TEXT = "the harbour crane lifts the heavy boxes while the tide goes out and the ferry waits for its last slow passengers"
DOCS = "doc_id long, text string, lang string, n_chars long, source string, id long, rep long, norm string, h long, component long"
BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"

OPERATORS = {
    "op1": lambda d: packing.pack(d, vocabulary(BYTES), end=0, length=64).where("start = 0"),
    "op2": lambda d: line_dedup.fuzzy_lines(d),
    "op3": lambda d: exact_dedup.dedup(d),
    "op4": lambda d: substring_dedup.dedup(d),
    "op5": lambda d: language.predict(d, language.fit(d)),
    "op7": lambda d: token_counts.counts(d, vocabulary(PIECES)),
    "op9": lambda d: sentencepiece_backend.round_trip(d, vocabulary(PIECES)),
    "op10": lambda d: near_dedup.near_duplicates(d, words=3, percent=85),
    "op13": lambda d: quality.assessed(d),
}
ONE_A_ROW = ("op3", "op5", "op7", "op9", "op13")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", len(t or ""), "s", 1, 2, "x", 3, 4) for i, t in rows], DOCS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty(spark, name):
    assert OPERATORS[name](docs(spark, [])).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_repeated_rows_and_missing_ids(spark, name):
    rows = [(1, TEXT), (1, TEXT), (2, TEXT + " now"), (None, TEXT), (None, None), (3, None), (3, ""), (4, "ab " * 4000), (4, "ab " * 4000)]
    found = OPERATORS[name](docs(spark, rows)).collect()
    assert {r["doc_id"] for r in found} <= {1, 2, 3, 4, None, -1}
    if name in ONE_A_ROW:
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found) == sorted((i is None, i or 0) for i, _ in rows)
    if name == "op10":
        kept = {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None}
        assert kept == {1: 1, 2: 1, 3: 3, 4: 4}
    if name == "op7":
        assert len({r["n_tokens"] for r in found if r["doc_id"] == 1}) == 1 and next(r["n_tokens"] for r in found if r["doc_id"] == 4) > 3000
    if name == "op9":
        assert all(r["parity"] for r in found) and {r["text"] for r in found if r["doc_id"] == 1} == {TEXT}


def test_spelling_of_repeated_rows(spark):
    got = {r["word"]: r["n"] for r in spelling.variants(docs(spark, [(1, "harbour"), (None, "harbour"), (2, None)] * 4)).collect()}
    assert got == {"harbour": 8}


def test_pages(spark):
    kind = "page_id long, url string, html string, text string, host string, body long, block long, chunk long"
    page = lambda i, u, h: (i, u, h, "t", "h", 1, 2, 3)
    assert html_extraction.extract(spark.createDataFrame([], kind)).collect() == []
    html = "<nav>Menu</nav><article><h1>Tides</h1><p>" + "word " * 30_000 + "</p></article>"
    rows = [page(1, "http://a.b/1", html), page(1, "http://a.b/1", html), page(None, None, html), page(None, "http://a.b/2", None), page(2, None, "")]
    got = sorted((r["page_id"] or 0, r["n_chars"]) for r in html_extraction.extract(spark.createDataFrame(rows, kind)).collect())
    n = len("Tides\n\n") + 5 * 30_000 - 1
    assert got == [(0, 0), (0, n), (1, n), (1, n), (2, 0)]


def test_vectors(spark):
    kind = "vec_id long, embedding array<float>, label string, rep long, d1 long, n long, k long, component int"
    row = lambda i, v, label="a": (i, v, label, 1, 2, 3, 4, 5)
    empty = spark.createDataFrame([], kind)
    assert cross_polytope.link(empty).collect() == [] and whitening.whitened(empty, whitening.fit(empty)).collect() == []
    rows = [row(1, [1.0, 0.0]), row(1, [1.0, 0.0]), row(2, [1.0, 0.001]), row(None, [1.0, 0.0]), row(None, [0.0, 1.0]), row(3, None), row(4, [0.0, 0.0]), row(5, [1.0, 0.0], None)]
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in cross_polytope.link(spark.createDataFrame(rows, kind)).collect())
    assert got == [(0, 0, 0, True), (0, 3, 1, False), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True)]


def test_tokenizer_versions_tell_libraries_apart(tmp_path, monkeypatch):
    (tmp_path / "a.json").write_text("{}")
    one = token_counts.tokenizer_version(str(tmp_path / "a.json"))
    monkeypatch.setattr(token_counts, "version", lambda name: "0.0.1")
    assert token_counts.tokenizer_version(str(tmp_path / "a.json")) != one


def test_pipeline_of_an_empty_table(spark, tmp_path):
    from bibloom.llm.common import written

    held = docs(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, held, str(tmp_path)), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == held.columns
        held = out
    assert held.count() == 0
