"""The index source over a recorded log, and a search from requests to a corpus against a plain loop."""

import json

import pytest
from pyspark.sql import functions as F

from bibloom.operators import expansion
from bibloom.sources import retrieval
from bibloom.sources.retrieval import Request

QUERY = "harbour tides"


def alex(k, title, year=2000, refs=(), cited=0, doi=None):
    return {"id": f"https://openalex.org/W{k}", "doi": doi, "display_name": title, "publication_year": year, "cited_by_count": cited, "referenced_works": [f"https://openalex.org/W{r}" for r in refs], "abstract_inverted_index": {"harbour": [0], "tides": [1]}}


def log(spark, root, answered):
    rows = [(key, place, json.dumps(item)) for key, found in answered.items() for place, item in enumerate(found)]
    rows += [(key, 0, None) for key, found in answered.items() if not found]
    retrieval.record(spark.createDataFrame(rows, "key string, place int, payload string").repartition(3), root)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("log") / "answers")
    works = {k: alex(k, f"tides of harbour number {w}", 1990 + k, refs, 100 - k) for k, w, refs in ((1, "alpha", (2, 3, 9)), (2, "omega", (4,)), (3, "of quite another sort", ()), (4, "zzz", ()))}
    off = alex(5, "cats") | {"abstract_inverted_index": {"cats": [0]}}
    log(spark, root, {
        Request("openalex", "search", QUERY, 50).key(None, None): [works[1], alex(7, "tides of harbour number alpha", 1991)],
        Request("openalex", "search", QUERY, 50).key(1990, 1999): [works[1]],
        Request("semanticscholar", "search", QUERY, 50).key(None, None): [],
        Request("openalex", "doi", "10.5/Seed", 1).key(None, None): [alex(8, "a seed on ferries", 1800, doi="https://doi.org/10.5/seed")],
        Request("openalex", "cited_by", "W1", 50).key(None, None): [works[4], off, works[1]],
        Request("openalex", "work", "W2", 1).key(None, None): [works[2]], Request("openalex", "work", "W3", 1).key(None, None): [works[3]],
        Request("openalex", "cited_by", "W2", 50).key(None, None): [], Request("openalex", "cited_by", "W4", 50).key(None, None): [],
    })
    return root


def test_a_failing_source_is_a_row(spark, root):
    requests = expansion.search_requests([QUERY], (*retrieval.SOURCES, "unknown"))
    found = retrieval.answers(spark, requests, root)
    assert found.rdd.getNumPartitions() == 3
    got = {r.source: tuple(r)[1:] for r in retrieval.report(found).collect()}
    assert got["openalex"] == (1, 2, 0, None, False) and got["semanticscholar"] == (0, 0, 0, None, True)
    assert got["inspire"][:3] == (1, 0, 1) and "no recorded answer" in got["inspire"][3] and got["inspire"][4]


def test_the_year_window_goes_into_the_request(spark, root):
    found = retrieval.answers(spark, [Request("openalex", "search", QUERY, 50)], root)
    assert found.where("publication_year >= 1990").count() == 2 and found.count() == 2
    inside = retrieval.answers(spark, [Request("openalex", "search", QUERY, 50)], root, 1990, 1999)
    assert [json.loads(r.payload)["id"] for r in inside.collect()] == ["https://openalex.org/W1"]  # recorded under the window
    assert retrieval.answers(spark, [Request("openalex", "search", QUERY, 50)], root, 1991).first().error.startswith("LookupError")


def test_requests_over_http():
    assert Request("openalex", "search", "a b", 500).address(1990, None) == ("https://api.openalex.org/works", {"search": "a b", "per-page": 200, "filter": "publication_year:1990-2100"})
    assert Request("semanticscholar", "search", "a", 5).address(None, 2001)[1] == {"query": "a", "limit": 5, "year": "-2001"}
    assert Request("inspire", "search", "a", 500).address(1990, 2001)[1] == {"q": "a and de 1990->2001", "size": 100, "sort": "mostcited"}
    assert Request("openalex", "cited_by", "W1", 7).address(None, None)[1] == {"filter": "cites:W1", "per-page": 7}
    answer = {"hits": {"hits": [{"metadata": {}}]}}
    assert retrieval.items(Request("inspire", "search", "a"), answer) == [{"metadata": {}}] and retrieval.items(Request("openalex", "search", "a"), {}) == []
    assert retrieval.items(Request("semanticscholar", "cited_by", "p"), {"data": [{"citingPaper": {"paperId": "x"}}, {}]}) == [{"paperId": "x"}]


def test_seeds_come_first_and_titles_merge(spark, root):
    corpus, report = expansion.retrieve(spark, expansion.search_requests([QUERY], seed_dois=("10.5/Seed", " ", "10.5/none")), root, None, None)
    rows = sorted(corpus.collect(), key=lambda r: r.position)
    assert [(r.title, r.is_seed, r.found_in_round) for r in rows] == [("a seed on ferries", True, 0), ("tides of harbour number alpha", False, 0)]
    assert rows[1].source_ids == {"openalex": "W7"} and report.where("failed > 0").count() == 2


def test_expansion_keeps_to_the_topic_and_ends(spark, root):
    corpus, _ = expansion.retrieve(spark, [Request("openalex", "search", QUERY, 50)], root)
    corpus = corpus.withColumn("source_ids", F.create_map(F.lit("openalex"), F.lit("W1")))
    grown, stats = expansion.expand(spark, corpus, [QUERY, "omega ferries"], root, rounds=3, n_seeds=1, refs_per_seed=2, saturation=0.0)
    assert stats[0] == {"round": 1, "seeds": 1, "found": 4, "new": 3, "corpus_size": 4, "off_topic_dropped": 1, "new_fraction": 0.75}
    assert len(stats) == 1 or stats[1]["new"] == 0
    assert sorted((r.title, r.found_in_round) for r in grown.collect()) == [("tides of harbour number alpha", 0), ("tides of harbour number of quite another sort", 1), ("tides of harbour number omega", 1), ("tides of harbour number zzz", 1)]
    assert grown.where("found_in_round = 0").first().references == ["W2", "W3", "W9"]  # the third reference was never asked for
