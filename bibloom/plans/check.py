"""A BibTeX file checked from the command line: keys, layout, findings, verification, reports, exit code.

    python -m bibloom.plans.check refs.bib --out-dir out --sort sections --ascii

Outputs are folders of part files in order beside each other: `<stem>_checked.bib`, `<stem>_report.md`, `<stem>_report.json`,
`<stem>_references.txt`. The input is never changed.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibloom.operators import bib, bib_chunks, export, reports, verification
from bibloom.operators import search as title_search
from bibloom.sources.shared import written


def checked(spark: SparkSession, path: str, ascii_only: bool = False, records: DataFrame | None = None, fix: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(nodes as they are to be written, findings, verified entries): keys first, so that findings go by the new ones.

    records: index records to verify with; fix fills in what they know.
    """
    nodes = written(bib_chunks.read_large(spark, path), "nodes")
    keyed = written(bib.keyed(nodes.where("kind = 'entry'")), "keyed")
    entries = written(bib.normalized(keyed, ascii_only), "entries")
    problem = reports.key_problem()
    unkeyable = keyed.where("unkeyable").select("file", "key", "line", F.lit("error").alias("level"), F.lit("unkeyable").alias("code"), F.concat(F.lit("kept original key: "), problem).alias("message"))
    source = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("source"))
    odd = bib.non_ascii_findings(source, ascii_only)
    odd = odd.select("file", F.lit(None).cast("string").alias("key"), "line", "level", "code", F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), F.array_join("found", " ")).alias("message"))
    found = bib.changes(keyed, ascii_only).unionByName(bib.findings(entries.drop("unkeyable"))).unionByName(unkeyable).unionByName(odd.select("file", "key", "line", "level", "code", "message"))
    found = found.unionByName(bib.duplicate_findings(entries).select("file", "key", "line", "level", "code", "message"))
    told = None
    if records is not None:
        told = written(verification.verified(entries, records, title_search.hits(entries, records)), "verified")
        told = written(verification.applied(told), "applied") if fix else told
        found = found.unionByName(verification.verification_findings(told))
        entries = told if fix else entries
    rest = nodes.where("kind <> 'entry'").withColumn("new_key", F.lit(None).cast("string"))
    shown = entries.select(*rest.columns).unionByName(rest)
    return shown, written(found, "findings"), told


def run(spark: SparkSession, path: str, out_dir: str, sort: str = "sections", ascii_only: bool = False, strict: bool = False, write: bool = True, records: DataFrame | None = None, fix: bool = False) -> int:
    """Writes the outputs and gives the exit code: 2 with errors (or warnings, if strict), 1 with warnings, else 0."""
    shown, found, told = checked(spark, path, ascii_only, records, fix)
    entries = shown.where("kind = 'entry'")
    if write:
        stem = f"{out_dir}/{os.path.basename(path.rstrip('/')).removesuffix('.bib')}"
        laid = export.laid_out(shown, sort)
        reports.write_lines(laid.select(F.struct("file", "place").alias("place"), export.blank_line_after(F.col("line")).alias("line")), f"{stem}_checked.bib")
        reports.write_lines(reports.finding_rows(found), f"{stem}_report.md", reports.head(reports.FINDING), ascii_only=True)
        reports.json_reports(found, entries, strict, told).select(F.col("report").alias("value")).write.mode("overwrite").text(f"{stem}_report.json")
        plain = reports.plain_references(entries)
        reports.write_lines(plain.select(F.struct("file", "number").alias("place"), "line"), f"{stem}_references.txt", ascii_only=True)
    return reports.exit_codes(found, shown.select("file"), strict).agg(F.coalesce(F.max("exit_code"), F.lit(0))).first()[0]


def main(argv: Sequence[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="bibloom.plans.check", description="Checks a BibTeX file: keys, order, completeness, identifiers.")
    ap.add_argument("input", help="the file, or a folder of files; never changed")
    ap.add_argument("--out-dir", default=None, help="folder of the outputs (default: beside the input)")
    ap.add_argument("--sort", default="sections", choices=export.SORTS)
    ap.add_argument("--ascii", action="store_true", help="rewrite letters beyond ASCII as LaTeX")
    ap.add_argument("--strict", action="store_true", help="warnings count as errors")
    ap.add_argument("--no-write", action="store_true", help="only the exit code and the findings on the console")
    ap.add_argument("--show-info", action="store_true", help="tell automatic changes too")
    ap.add_argument("--records", default=None, help="Parquet of index records to verify with")
    ap.add_argument("--fix-from-index", action="store_true", help="with --records: fill blanks from the records")
    args = ap.parse_args(argv)
    if args.fix_from_index and not args.records:
        print("note: --fix-from-index does nothing without --records")
    spark = SparkSession.builder.appName("bibloom-check").getOrCreate()
    records = spark.read.parquet(args.records) if args.records else None
    out_dir = args.out_dir or os.path.dirname(args.input.rstrip("/")) or "."
    code = run(spark, args.input, out_dir, args.sort, args.ascii, args.strict, not args.no_write, records, args.fix_from_index)
    if args.no_write:
        _, found, _ = checked(spark, args.input, args.ascii, records, args.fix_from_index)
        for r in reports.console_rows(found, args.show_info).orderBy("place").toLocalIterator():
            print(r["line"])
    return code


if __name__ == "__main__":
    sys.exit(main())
