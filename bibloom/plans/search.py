"""A whole search: retrieve, expand, gate, screen, extract, write. Every output is a folder of part files, in order.

What people or models answer (verdicts, evidence rows) is read from files that may not be there yet; the search is run again
when they are. Answers of indexes come from a recorded log or over HTTP, records for the gate from a response log or a table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibloom.operators import evidence, expansion, export, gate, graph, relevance, reports, screening
from bibloom.sources import cache, payloads, readers
from bibloom.sources.shared import written


@dataclass(frozen=True)
class SearchSpec:
    """What is asked, where, how far the graph is followed, and what screeners and extractors are told."""

    question: str
    queries: tuple[str, ...]
    seed_dois: tuple[str, ...] = ()
    year_from: int | None = None
    year_to: int | None = None
    sources: tuple[str, ...] = ("openalex", "inspire")
    per_query_limit: int = 50
    max_rounds: int = 2
    seeds_per_round: int = 10
    refs_per_seed: int = 8
    least_terms: int = 2
    saturation: float = 0.05
    known_items: tuple[str, ...] = ()
    gold_set: str = ""
    required: tuple[str, ...] = ()
    forbidden: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    instructions: str = ""


def _or_none(read, *args):
    """What a reader gives, or None where its file is not there yet."""
    try:
        return read(*args)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def records_of(log: cache.ResponseLog, works: DataFrame) -> DataFrame:
    """The records that a response log holds for works: Crossref and DataCite by DOI, arXiv by id."""
    parts = []
    for kind, column, read in (("crossref:doi", "doi", payloads.record_from_crossref), ("datacite:doi", "doi", payloads.record_from_datacite), ("arxiv", "arxiv_id", payloads.record_from_arxiv)):
        keys = works.where(F.coalesce(column, F.lit("")) != "").select(cache.key_of(kind, F.col(column)).alias("key")).distinct()
        parts.append(read(log.lookup(keys).where("payload is not null")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def screened(works: DataFrame, spec: SearchSpec, verdicts: DataFrame | None) -> DataFrame:
    """works with rules' and readers' verdicts in screen, screen_reason and role, and triage_verdict."""
    judged = relevance.stamped(relevance.triage(works, list(spec.required), list(spec.forbidden)))
    if verdicts is None:
        return judged
    a = screening.align(judged, verdicts)
    return a.withColumns({"screen": F.col("new_screen"), "screen_reason": F.col("new_reason"), "role": F.col("new_role")}).select(*judged.columns, "outcome", "refused", "new_screen", "new_role")


def run(spark: SparkSession, spec: SearchSpec, out: str, records: DataFrame | cache.ResponseLog, answers: str = "", now_year: int = 2026) -> int:
    """Writes the outputs of a search under `out`; 1 if a known item was not found, else 0.

    records: index records, or the log of responses that holds them. answers: folder of recorded answers, else HTTP.
    """
    low, high = spec.year_from, spec.year_to
    requests = expansion.search_requests(list(spec.queries), spec.sources, spec.per_query_limit, spec.seed_dois)
    corpus, hits = expansion.retrieve(spark, requests, answers, low, high)
    corpus, rounds = expansion.expand(spark, corpus, list(spec.queries), answers, spec.max_rounds, spec.seeds_per_round, spec.per_query_limit, spec.refs_per_seed, spec.sources, low, high, spec.least_terms, spec.saturation)

    held = records_of(records, corpus) if isinstance(records, cache.ResponseLog) else records
    gated = written(gate.enriched(gate.gate(corpus, held)), "gated")
    verdicts = _or_none(readers.read_verdicts, spark, f"{out}/screen/verdicts.jsonl")
    works = written(screened(gated, spec, verdicts), "screened")
    passed = works.where("validation = 'verified'")

    known = None
    if spec.known_items:
        items = spark.createDataFrame(list(enumerate(spec.known_items)), "item_id long, title string")
        known = written(screening.known_items(items, works), "known")
    gold = screening.gold_recall(readers.read_gold(spark, spec.gold_set), works) if spec.gold_set else None

    to_model = works.where("triage_verdict = 'needs_ai'")
    screening.batch_files(screening.batches(to_model, corpus=works)).select("payload").write.mode("overwrite").text(f"{out}/screen/batches")
    if verdicts is not None:
        screening.verdict_counts(works).write.mode("overwrite").json(f"{out}/screen/counts")
    reports.write_lines(reports.review_rows(works), f"{out}/needs_review.md", [*reports.head(reports.REVIEW)])

    included = works.where("validation = 'verified' and screen = 'include'")
    cited = passed if included.isEmpty() else included
    keys = written(export.cite_keys(cited), "keys")
    screening.extraction_tasks(works, list(spec.fields), keys, spec.instructions).select(F.col("task").alias("value")).write.mode("overwrite").text(f"{out}/extract/tasks")
    rows = readers.read_evidence(spark, f"{out}/extract/rows.jsonl", list(spec.fields))
    accepted = written(evidence.checked(rows, list(spec.fields)).where("accepted"), "rows")

    readers.write_works(works, f"{out}/corpus.jsonl")
    ranked = graph.signals(cited.join(graph.in_corpus_citations(cited), "work_id"), now_year)
    best = graph.signals(passed.join(graph.in_corpus_citations(passed), "work_id"), now_year)
    reports.write_lines(reports.shortlist_rows(best), f"{out}/shortlist.md", reports.head(reports.SHORTLIST))
    reports.write_lines(reports.quarantine_rows(works), f"{out}/quarantine.md", reports.head(reports.QUARANTINE))
    reports.write_lines(reports.reading_plan(graph.phases(ranked, now_year), keys), f"{out}/reading_plan.md", ["# Reading plan", "", f"> {spec.question}", ""])
    kinds = {r["field"]: r["quantity"] for r in evidence.column_kinds(accepted, list(spec.fields)).collect()} if spec.fields else {}
    quantities = [f for f in spec.fields if kinds.get(f)]
    conditions = [f for f in spec.fields if f not in quantities]
    if quantities:
        reports.write_lines(reports.conflict_rows(evidence.conflicts(accepted, quantities, conditions), conditions), f"{out}/conflicts.md", ["# Candidate contradictions", ""])
    readers.write_csv(evidence.evidence_csv(accepted, list(spec.fields)), f"{out}/evidence.csv")
    lines, findings = export.bibliography(cited)
    reports.write_lines(lines.withColumn("line", export.blank_line_after(F.col("line"))), f"{out}/refs.bib", ascii_only=True)
    reports.write_lines(reports.finding_rows(findings), f"{out}/refs_findings.md", reports.head(reports.FINDING))
    search = {"question": F.lit(spec.question), "queries": F.array(*map(F.lit, spec.queries)), "sources": F.array(*map(F.lit, spec.sources)), "year_from": F.lit(low).cast("int"), "year_to": F.lit(high).cast("int")}
    reports.run_log(works, search, rounds, known, gold).select(F.col("line").alias("value")).coalesce(1).write.mode("overwrite").text(f"{out}/run.json")
    hits.write.mode("overwrite").json(f"{out}/sources")
    return 0 if known is None or known.where(~F.col("found")).isEmpty() else 1
