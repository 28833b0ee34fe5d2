"""Measures of a search, gathered while its stages are written: no scan for a measure, and no stage run twice for one.

Each stage is observed on its way to the shared folder; when it is written its counts are known. The measures are one row:
what dedup would still merge, what the topical guard keeps, what triage saves and what it costs, the gate, the screen, the
bibliography and the gold set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from bibloom.operators import bib, corpus, relevance, screening
from bibloom.sources.shared import written

# How far a measure may drift before it counts.
TOLERANCE = {"triage_yield_pct": 2.0, "triage_saving_pct": 2.0}


class Measures:
    """Counts of stages by name, known once the stages are written."""

    def __init__(self):
        self.seen: list[Observation] = []

    def stage(self, df: DataFrame, name: str, **counts: Column) -> DataFrame:
        """df written to the shared folder, with counts taken on the way."""
        seen = Observation(name)
        self.seen.append(seen)
        return written(df.observe(seen, *[c.alias(n) for n, c in counts.items()]), name)

    def row(self) -> dict[str, int]:
        return {n: int(v or 0) for o in self.seen for n, v in o.get.items()}


def percent(part: int, whole: int) -> float:
    """Of at least one, with one digit."""
    return round(100 * part / max(whole, 1), 1)


def measured(works: DataFrame, gold: DataFrame, terms: list[str], required: list[str], forbidden: list[str], least_terms: int = 2, least: float = corpus.RATIO) -> dict:
    """The measures of a corpus with its verdicts (screen) and its gate (validation). includes_lost counts titles that rules discard though a screener included them."""
    m = Measures()
    yes = lambda c: F.coalesce(c, F.lit(False))
    included = works.where("screen = 'include'").select("title", F.lit(True).alias("_in")).distinct()
    judged = relevance.triage(works, required, forbidden).withColumn("_topical", relevance.term_hits(relevance.haystack(), terms) >= least_terms).join(included, "title", "left")
    rule, verdict, gate = F.col("triage_verdict") == "exclude_rule", F.coalesce("screen", F.lit("")), F.coalesce("validation", F.lit(""))
    m.stage(
        judged.select("work_id", "_topical", "triage_verdict", "_in", "screen", "validation"), "triage", corpus_size=F.count(F.lit(1)), topical_kept=F.count_if(yes(F.col("_topical"))), topical_dropped=F.count_if(~yes(F.col("_topical"))),
        triage_to_model=F.count_if(~rule), triage_by_rule=F.count_if(rule), includes_lost_to_triage=F.count_if(rule & yes(F.col("_in"))), yielded=F.count_if(~rule & yes(F.col("_in"))),
        gate_verified=F.count_if(gate == "verified"), gate_quarantined=F.count_if((gate != "") & (gate != "verified")), screened_include=F.count_if(verdict == "include"), screened_unsure=F.count_if(verdict == "unsure"),
    )
    m.stage(corpus.clusters(works, least), "again", dedup_merges=F.count_if(F.col("position") != F.col("cluster")))
    citable = bib.citable(works.where("screen = 'include' and validation = 'verified'"))
    entries = m.stage(bib.normalized(bib.from_works(citable)), "entries", bib_entries=F.count(F.lit(1)))
    m.stage(bib.findings(entries), "findings", bib_errors=F.count_if(F.col("level") == "error"))
    m.stage(screening.gold_recall(gold, works), "gold", gold_total=F.count(F.lit(1)), gold_found=F.count_if("found"))
    row = m.row()
    row |= {"triage_saving_pct": percent(row["triage_by_rule"], row["corpus_size"]), "triage_yield_pct": percent(row.pop("yielded"), row["triage_to_model"])}
    row["gold_recall_pct"] = percent(row["gold_found"], row["gold_total"]) if row["gold_total"] else 0.0
    return row


def regressions(current: dict, baseline: dict) -> list[str]:
    """Measures that differ from the baseline by more than they may."""
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    out = []
    for name, was in baseline.items():
        now = current.get(name)
        if number(was) and number(now):
            if abs(now - was) > TOLERANCE.get(name, 0):
                out.append(f"{name}: {was} -> {now}")
        elif now != was:
            out.append(f"{name}: {was!r} -> {now!r}")
    return out
