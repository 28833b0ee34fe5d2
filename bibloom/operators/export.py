"""The bibliography as files: sort modes of a parsed file, refs.bib of a corpus with its own lint, cite keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibloom.operators import bib

SORTS = ("sections", "global", "none")


def laid_out(nodes: DataFrame, sort: str = "sections") -> DataFrame:
    """(file, place, line): the chunks of files of nodes (as from `bib.parse_files`), in the order of place.

    Raw nodes come first. `sections` sorts entries by key under their section's banner, `global` puts all banners before
    all entries by key, and both leave out loose comments; `none` keeps nodes as they came. Blank chunks are left out.
    The place is built from each node alone, so nothing is shuffled here: `reports.write_lines` range-partitions by it.
    """
    if sort not in SORTS:
        raise ValueError(f"sort is one of {', '.join(SORTS)}, not {sort!r}")
    key = F.coalesce("new_key", "key") if "new_key" in nodes.columns else F.col("key")
    entry, banner = F.col("kind") == "entry", (F.col("kind") == "comment") & F.coalesce("is_banner", F.lit(False))
    part = F.when(F.col("kind") == "raw", 0).when((F.lit(sort == "global")) & entry, 2).otherwise(1)
    by_key = entry & F.lit(sort != "none")
    section = F.when(F.lit(sort == "sections") & (entry | banner), F.col("section_id")).otherwise(0)
    place = F.struct(
        part.alias("part"), section.alias("section"), by_key.cast("int").alias("entries"),
        F.when(by_key, F.lower(key)).otherwise("").alias("lower"), F.when(by_key, key).otherwise("").alias("key"), F.col("node_pos").alias("node_pos"),
    )
    shown = nodes if sort == "none" else nodes.where(entry | banner | (F.col("kind") == "raw"))
    fields = F.coalesce("fields", F.array().cast("array<struct<name:string,text:string,delim:string>>"))
    body = bib.rendered(shown.where("kind <> 'error'").withColumn("fields", fields))
    lead = F.when(F.col("lead_comment").isNotNull(), F.concat("lead_comment", F.lit("\n"))).otherwise("")
    line = F.btrim(F.when(entry, F.concat(lead, F.col("bibtex"))).otherwise(F.col("text")), F.lit("\n"))
    return body.select("file", place.alias("place"), line.alias("line")).where(F.trim(F.regexp_replace("line", r"\s+", " ")) != "")


def entries_of(works: DataFrame, ascii_only: bool = True) -> DataFrame:
    """Citable works as normalised entries with new_key and bibtex."""
    return bib.rendered(bib.keyed(bib.normalized(bib.from_works(bib.citable(works)), ascii_only)))


def cite_keys(works: DataFrame, ascii_only: bool = True) -> DataFrame:
    """(work_id, cite_key) of each citable work, as refs.bib has it."""
    return entries_of(works, ascii_only).select("work_id", F.col("new_key").alias("cite_key"))


def uncitable(works: DataFrame) -> DataFrame:
    """Works without an author or a title, which refs.bib leaves out; nulls count as absent."""
    return works.where(~F.coalesce((F.size("authors") > 0) & (F.coalesce("title", F.lit("")) != ""), F.lit(False)))


def bibliography(works: DataFrame, ascii_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """((place, line) of refs.bib by key, findings): each entry is parsed again from its text and linted."""
    entries = entries_of(works, ascii_only)
    lines = entries.select(F.struct(F.lower("new_key").alias("lower"), F.col("new_key").alias("key")).alias("place"), F.col("bibtex").alias("line"))
    back = bib.parse_files(entries.select(F.col("new_key").alias("file"), F.col("bibtex").alias("source"))).where("kind = 'entry'")
    return lines, bib.findings(back.withColumn("file", F.lit("refs.bib")))


def blank_line_after(line: Column) -> Column:
    """Chunks are parted by an empty line where they are written as text lines."""
    return F.concat(line, F.lit("\n"))
