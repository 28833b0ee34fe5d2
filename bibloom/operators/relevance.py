"""Filters that a rule can decide: year window, topical guard, triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def haystack() -> Column:
    return F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit("")))


def year_of(c: Column) -> Column:
    return F.trim(F.substring(c, 1, 4)).try_cast("int")


def in_years(year: Column, low: int | None, high: int | None) -> Column:
    """Whether the year lies in the window; a year that cannot be read passes."""
    y = year_of(year)
    inside = F.lit(True)
    if low is not None:
        inside = inside & (y >= low)
    if high is not None:
        inside = inside & (y <= high)
    return F.coalesce(inside, F.lit(True))


def term_hits(text: Column, terms: list[str]) -> Column:
    """Distinct terms among the text's words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))
    return F.size(F.array_intersect(words, F.array(*map(F.lit, terms)))) if terms else F.lit(0)


def on_topic(works: DataFrame, terms: list[str], least: int = 2) -> DataFrame:
    """Works that show `least` terms; 0 admits all, and no terms admit none unless it is 0."""
    return works.where(term_hits(haystack(), terms) >= least) if least > 0 else works


def triage(works: DataFrame, required: list[str], forbidden: list[str]) -> DataFrame:
    """works with triage_verdict and triage_reason: the first forbidden phrase in list order, else the lack of any required."""
    text = F.lower(haystack())
    holds = lambda p: F.contains(text, F.lit(p.lower()))
    reason = F
    for p in forbidden:
        reason = reason.when(holds(p), F.lit(f"rule: mentions '{p}'"))
    if required:
        lacks = F.lit(True)
        for p in required:
            lacks = lacks & ~holds(p)
        reason = reason.when(lacks, F.lit("rule: none of the required subject terms present"))
    reason = F.lit("") if reason is F else reason.otherwise("")
    out = works.withColumn("triage_reason", reason)
    return out.withColumn("triage_verdict", F.when(F.col("triage_reason") == "", "needs_ai").otherwise("exclude_rule"))


def stamped(triaged: DataFrame) -> DataFrame:
    """Rule verdicts written into screen and screen_reason."""
    rule = F.col("triage_verdict") == "exclude_rule"
    return triaged.withColumn("screen", F.when(rule, "exclude").otherwise(F.col("screen"))).withColumn("screen_reason", F.when(rule, F.col("triage_reason")).otherwise(F.col("screen_reason")))
