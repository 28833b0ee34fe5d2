"""A search from its requests to a corpus: retrieval, then rounds along the citation graph until nothing much is new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibloom.functions import text as T
from bibloom.operators import corpus as corpora
from bibloom.operators import graph, relevance
from bibloom.sources import retrieval
from bibloom.sources.retrieval import Request
from bibloom.sources.shared import written


def search_requests(queries: list[str], sources: tuple[str, ...] = retrieval.SOURCES, per_query: int = 50, seed_dois: tuple[str, ...] = ()) -> list[Request]:
    """Seeds by DOI first, then every query in every source; unknown sources are left out."""
    seeds = [Request("openalex", "doi", d.strip(), 1) for d in seed_dois if d and d.strip()]
    return seeds + [Request(s, "search", q, per_query) for q in queries for s in sources if s in retrieval.SOURCES]


def retrieve(spark: SparkSession, requests: list[Request], root: str = "", low: int | None = None, high: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(corpus, report) of a search: works merged in the order of requests and answers, round 0."""
    found = written(retrieval.answers(spark, requests, root, low, high), "answers")
    return written(corpora.deduplicated(retrieval.retrieved(found, low, high)), "corpus"), retrieval.report(found)


def expand(
    spark: SparkSession, corpus: DataFrame, queries: list[str], root: str = "", rounds: int = 2, n_seeds: int = 10, per_query: int = 50, refs_per_seed: int = 20,
    sources: tuple[str, ...] = retrieval.SOURCES, low: int | None = None, high: int | None = None, least_terms: int = 2, saturation: float = 0.05,
) -> tuple[DataFrame, list[dict]]:
    """(corpus, stats a round): each round expands the best unexpanded works and adds what is inside the window and on topic.

    Every work is expanded once. Ends without seeds, after `rounds`, or when a round brings less than `saturation` of the corpus.
    """
    terms = T.query_terms(queries)
    seen, stats = corpus.select("work_id").limit(0), []
    for k in range(1, rounds + 1):
        seeds = graph.seeds(corpus, seen, n_seeds).select("work_id", "source_ids", "references").collect()  # n_seeds rows
        if not seeds:
            break
        seen = written(seen.unionByName(spark.createDataFrame([(s["work_id"],) for s in seeds], seen.schema)), "seen")
        last = corpus.agg(F.max("position")).first()[0]
        requests = retrieval.harvest([s.asDict() for s in seeds], per_query, refs_per_seed, sources)
        found = retrieval.works_of(retrieval.answers(spark, requests, root), last + 1) if requests else retrieval.works_of(spark.createDataFrame([], retrieval.SCHEMA), last + 1)
        inside = written(found.where(relevance.in_years(F.col("year"), low, high)), "harvest")
        topical = relevance.on_topic(inside, terms, least_terms)
        n, kept = inside.count(), topical.count()
        corpus, new = corpora.add_all(corpus, topical.select(*corpus.columns), k)
        size, fresh = corpus.count(), new.count()
        share = fresh / size if size else 0.0
        stats.append({"round": k, "seeds": len(seeds), "found": kept, "new": fresh, "corpus_size": size, "off_topic_dropped": n - kept, "new_fraction": round(share, 4)})
        if share < saturation:
            break
    return corpus, stats
