"""Rows of the written reports: Markdown tables, plain references, the order of findings, exit code and run log.

Each renderer maps rows to (place, line); `write_lines` range-partitions by place, so long reports are never sorted in
one task and the part files follow each other in order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from bibloom.functions import text as T
from bibloom.functions.numeric import one_digit
from bibloom.operators import bib, graph

# Heads of the tables.
QUARANTINE = ("Title", "DOI", "arXiv", "Reason")
SHORTLIST = ("Cites/yr", "Cites", "Cited here", "Year", "Role", "Title", "Venue", "Validated by", "OA PDF")
REVIEW = ("Year", "Title", "Verdict", "Reason")
CONFLICT = ("", "Cite key", "Value", "Read from", "Quote")
FINDING = ("level", "key", "code", "message")
LEVELS = ("error", "warning", "info")


def head(names: tuple[str, ...]) -> list[str]:
    return ["| " + " | ".join(names).strip() + " |", "| " + " | ".join("---" for _ in names) + " |"]


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells]), F.lit(" |"))


def _or(c: str | Column, other: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(other))


def _cell(c: Column, width: int) -> Column:
    return F.replace(F.substring(c, 1, width), F.lit("|"), F.lit("/"))


def quarantine_rows(gated: DataFrame) -> DataFrame:
    """Works that the gate held back, in corpus order."""
    return gated.where("validation <> 'verified'").select(F.col("position").alias("place"), _row(_cell(_or("title", "(no title)"), 70), _or("doi", "-"), _or("arxiv_id", "-"), F.col("gate_reason")).alias("line"))


def review_rows(works: DataFrame) -> DataFrame:
    """Works nobody decided, in corpus order."""
    open_ = works.where(F.coalesce("screen", F.lit("")).isin("", "unsure"))
    return open_.select(F.col("position").alias("place"), _row(_or("year", "-"), _cell(_or("title", "(no title)"), 70), _or("screen", "unscreened"), F.col("screen_reason")).alias("line"))


def shortlist_rows(ranked: DataFrame, limit: int = 50) -> DataFrame:
    """The best works; place is a work's rank, numbered over `limit` rows only."""
    best = graph.top(ranked, limit).withColumn("place", F.row_number().over(Window.orderBy(*graph.rank_order())))
    pdf = F.when(_or("oa_pdf_url", "") != "", "yes").otherwise("-")
    return best.select("place", _row(F.col("rate"), F.col("cited_by_count"), F.col("in_corpus"), _or("year", "-"), _or("role", "-"), _cell(_or("title", ""), 70), _cell(_or("venue", ""), 30), _or("validation_source", ""), pdf).alias("line"))


def general(c: Column) -> Column:
    """A number with six significant digits, without closing zeros."""
    digits = F.regexp_replace(F.format_string("%g", c.cast("double")), r"(\.\d*?)0+(e|$)", "$1$2")
    return F.regexp_replace(digits, r"\.(e|$)", "$1")


def conflict_rows(conflicts: DataFrame, conditions: list[str]) -> DataFrame:
    """The part of each conflict, the largest ratio first (one digit): heading, sentence and the table of its two ends."""
    c = conflicts.withColumn("_r", one_digit("ratio"))
    stated = F.concat_ws(", ", *[F.concat(F.lit(f"{n}="), F.col(n)) for n in conditions])
    said = F.concat(F.col("rows").cast("string"), F.lit(" row(s) from "), F.col("papers").cast("string"), F.lit(" paper(s) span "), general(F.col("low")), F.lit(" to "), general(F.col("high")), F.lit(" ("), general(F.col("_r")), F.lit("x)."))
    end = lambda side: _row(F.lit(side), F.col(f"{side}_row.cite_key"), F.col(f"{side}_row.as_written"), _or(f"{side}_row.confidence", "-"), F.substring(F.replace(F.replace(f"{side}_row.source_quote", F.lit("|"), F.lit("/")), F.lit("\n"), F.lit(" ")), 1, 200))
    lines = F.concat_ws("\n", F.concat(F.lit("## "), F.col("field"), F.lit(" -- "), _or(stated, "no stated conditions")), F.lit(""), said, F.lit(""), *map(F.lit, head(CONFLICT)), end("low"), end("high"))
    return c.select(F.struct((-F.col("_r")).alias("r"), "field", *conditions).alias("place"), lines.alias("line"))


# Phases of the reading plan, how many works each shows, heads of its tables.
PHASES = (("foundation", "Phase 1 -- Foundation", 8), ("core", "Phase 2 -- Core evidence", 15), ("frontier", "Phase 3 -- Frontier", 12))
PLAN, KINDS = ("Cite key", "Year", "Role", "Cites/yr", "Cited here", "PDF", "Title"), ("Kind", "Works")


def phase_counts(phased: DataFrame) -> DataFrame:
    """(phase, n, shown) of graph.phases' works, empty phases included: how many works each holds and shows."""
    every = phased.sparkSession.createDataFrame([(p, k) for p, _, k in PHASES], "phase string, most int")
    n = phased.groupBy("phase").agg(F.count("*").alias("n"))
    return every.join(n, "phase", "left").select("phase", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.least(F.coalesce("n", F.lit(0)), F.col("most")).cast("int").alias("shown"))


def reading_plan(phased: DataFrame, cite_keys: DataFrame | None = None) -> DataFrame:
    """(place, line): what to read in which order: works by kind, then the best works of each phase and how many more there are.

    phased: graph.phases' works. The best of a phase are ranked per task before any row is shuffled; in the first phase
    reviews go before landmarks. cite_keys: (work_id, cite_key) of refs.bib.
    """
    spark = phased.sparkSession
    order = Window.partitionBy("phase").orderBy((F.col("part") != "reviews").cast("int"), *graph.rank_order())
    most = F.coalesce(*[F.when(F.col("phase") == p, k) for p, _, k in PHASES])
    best = phased.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= max(k for *_, k in PHASES)).where(F.col("_at") <= most)
    best = best.withColumn("cite_key", F.lit(None).cast("string")) if cite_keys is None else best.join(cite_keys, "work_id", "left")
    section = F.coalesce(*[F.when(F.col("phase") == p, i + 1) for i, (p, *_) in enumerate(PHASES)])
    place = lambda s, at: F.struct(s.alias("section"), at.cast("int").alias("at"))
    some = lambda c: _or(c, "") if c in phased.columns else F.lit("")
    pdf = F.when((some("oa_pdf_url") != "") | (some("arxiv_id") != ""), "yes").otherwise("-")
    rows = best.select(place(section, F.col("_at") + 10).alias("place"), _row(_or("cite_key", "(not in refs.bib)"), _or("year", "-"), _or("role", "unclassified"), F.col("rate"), F.col("in_corpus"), pdf, _cell(_or("title", "(no title)"), 70)).alias("line"))
    counts = phase_counts(phased)
    title = F.coalesce(*[F.when(F.col("phase") == p, t) for p, t, _ in PHASES])
    opening = F.when(F.col("n") == 0, F.array(F.lit(""), F.concat(F.lit("## "), title), F.lit(""), F.lit("Nothing was placed in this phase."))).otherwise(
        F.array(F.lit(""), F.concat(F.lit("## "), title), F.lit(""), F.concat(F.lit("Showing "), F.col("shown"), F.lit(" of "), F.col("n"), F.lit(".")), F.lit(""), *map(F.lit, head(PLAN)))
    )
    heads = counts.select(section.alias("s"), F.posexplode(opening).alias("at", "line")).select(place(F.col("s"), F.col("at")).alias("place"), "line")
    more = counts.where("n > shown").select(section.alias("s"), F.posexplode(F.array(F.lit(""), F.concat((F.col("n") - F.col("shown")).cast("string"), F.lit(" further work(s) in this phase are in corpus.jsonl.")))).alias("at", "line")).select(place(F.col("s"), F.col("at") + 1000).alias("place"), "line")
    roles = graph.role_counts(phased)
    kind = F.coalesce(*[F.when(F.col("role") == r, i) for i, r in enumerate(graph.ROLES)], F.lit(len(graph.ROLES)))
    kinds = roles.select(place(F.lit(0), kind + 2).alias("place"), _row(F.col("role"), F.col("n")).alias("line"))
    top = spark.createDataFrame([(i, line) for i, line in enumerate(head(KINDS))], "at int, line string").select(place(F.lit(0), F.col("at")).alias("place"), "line")
    return top.unionByName(kinds).unionByName(heads).unionByName(rows).unionByName(more)


def finding_place() -> Column:
    """Errors, warnings, the rest; then by key and code."""
    level = F.coalesce(*[F.when(F.col("level") == v, i) for i, v in enumerate(LEVELS)], F.lit(9))
    return F.struct(level.alias("level"), F.coalesce("key", F.lit("")).alias("key"), F.col("code").alias("code"))


def finding_rows(findings: DataFrame) -> DataFrame:
    """The Markdown table of findings."""
    return findings.select(finding_place().alias("place"), _row(F.col("level"), _or("key", "-"), F.col("code"), F.replace("message", F.lit("|"), F.lit("\\|"))).alias("line"))


def console_rows(findings: DataFrame, infos: bool = False) -> DataFrame:
    """The findings as the console shows them."""
    shown = findings if infos else findings.where("level <> 'info'")
    return shown.select(finding_place().alias("place"), F.concat(F.lit("  ["), F.rpad("level", 7, " "), F.lit("] "), _or("key", "<file>"), F.lit(": "), F.col("message")).alias("line"))


def exit_codes(findings: DataFrame, files: DataFrame, strict: bool = False) -> DataFrame:
    """(file, errors, warnings, exit_code): 2 with errors, 1 with warnings (2 if strict), else 0; files without findings too."""
    n = findings.groupBy("file").agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    all_ = files.select("file").distinct().join(n, "file", "left").fillna(0, ["errors", "warnings"])
    return all_.withColumn("exit_code", F.when(F.col("errors") > 0, 2).when(F.col("warnings") > 0, 2 if strict else 1).otherwise(0))


def key_problem() -> Column:
    """Why an entry gets no key: null where it does."""
    surname = T.surname_udf(F.coalesce(bib.field("author"), F.lit("")))
    year = T.entry_year(bib.field("year"), bib.field("date"))
    return F.when(surname == "", "cannot determine a first-author surname from the author field").when(year == "", "no 4-digit year found in the year field")


_COMPARISON = "array<struct<field:string,local:string,remote:string,status:string>>"


def json_reports(findings: DataFrame, entries: DataFrame, strict: bool = False, checked: DataFrame | None = None) -> DataFrame:
    """(file, report): one JSON object a file of entries: counts, exit code, renamed keys, key problems, findings in order, verifications.

    checked: verified entries, whose verdicts, records, comparisons and suggestions are told by key. A file's findings are
    gathered, as the object is one value: it is as large as the file that they are about.
    """
    one = F.struct(finding_place().alias("place"), "level", "code", "key", "line", "message")
    found = findings.groupBy("file").agg(F.count_if(F.col("level") == "info").alias("info"), F.transform(F.sort_array(F.collect_list(one)), lambda x: x.dropFields("place")).alias("findings"))
    new = F.col("new_key") if "new_key" in entries.columns else F.lit(None).cast("string")
    place = F.col("node_pos") if "node_pos" in entries.columns else F.lit(0)
    problem = key_problem() if "fields" in entries.columns else F.lit(None).cast("string")
    e = entries.withColumn("_problem", problem).withColumn("_renamed", F.when(new != F.col("key"), F.struct(F.col("key").alias("k"), new.alias("v"))))
    problems = F.sort_array(F.collect_list(F.when(F.col("_problem").isNotNull(), F.struct(place.alias("place"), "key", F.col("_problem").alias("reason")))))
    own = e.groupBy("file").agg(F.count("*").alias("entry_count"), F.sort_array(F.collect_list(F.struct(place.alias("place"), F.col("_renamed").alias("r")))).alias("renamed"), F.transform(problems, lambda x: x.dropFields("place")).alias("key_problems"))
    # of two entries with one key the later one's new key counts
    renamed = F.aggregate(F.filter(F.transform("renamed", lambda x: x["r"]), lambda r: r.isNotNull()), F.create_map().cast("map<string,string>"), lambda m, r: F.map_concat(F.map_filter(m, lambda k, v: k != r["k"]), F.create_map(r["k"], r["v"])))
    whole = exit_codes(findings, own, strict).join(own, "file").join(found, "file", "left")
    none = F.array().cast("array<struct<level:string,code:string,key:string,line:int,message:string>>")
    counts = F.struct(F.col("errors").alias("error"), F.col("warnings").alias("warning"), F.coalesce("info", F.lit(0)).alias("info"))
    told = F.create_map().cast(f"map<string,struct<verdict:string,source:string,comparisons:{_COMPARISON},suggestions:map<string,string>>>")
    if checked is not None:
        key = F.coalesce("new_key", "key") if "new_key" in checked.columns else F.col("key")
        value = F.struct("verdict", F.coalesce("record.source", F.lit("")).alias("source"), F.col("comparisons").cast(_COMPARISON).alias("comparisons"), "suggestions")
        by_key = checked.groupBy("file", key.alias("k")).agg(F.max_by(value, place if "node_pos" in checked.columns else F.lit(0)).alias("v"))
        whole = whole.join(by_key.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_told")), "file", "left")
        told = F.coalesce("_told", told)
    parts = F.struct(F.col("file").alias("input"), "entry_count", counts.alias("counts"), "exit_code", renamed.alias("rename_map"), "key_problems", F.coalesce("findings", none).alias("findings"), told.alias("verifications"))
    return whole.select("file", F.to_json(parts, {"ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"}).alias("report"))


def verification_rows(checked: DataFrame) -> DataFrame:
    """The Markdown table of verdicts, by key."""
    key = F.coalesce("new_key", "key") if "new_key" in checked.columns else F.col("key")
    wrong = F.array_join(F.transform(F.filter("comparisons", lambda c: c["status"] == "mismatch"), lambda c: c["field"]), ", ")
    return checked.select(F.struct("file", key.alias("key")).alias("place"), _row(F.concat(F.lit("`"), key, F.lit("`")), F.col("verdict"), _or("record.source", "-"), _or(wrong, "-")).alias("line"))


@F.pandas_udf(StringType())
def escaped(s: pd.Series) -> pd.Series:
    """Text in ASCII, other characters as backslash escapes; null stays."""
    return s.map(lambda x: None if x is None else x.encode("ascii", "backslashreplace").decode("ascii"))


def plain_references(entries: DataFrame) -> DataFrame:
    """(file, number, line): each file's entries by key as a numbered plain bibliography."""
    text = lambda n: F.trim(F.coalesce(bib.field(n), F.lit("")))
    bare = F.transform(F.col("_names"), lambda a: F.btrim(a, F.lit("{} ")))
    e = entries.withColumn("_key", F.coalesce("new_key", "key") if "new_key" in entries.columns else F.col("key"))
    e = e.withColumn("_names", T.authors_udf(bib.field("author"))).withColumn("_all", F.size("_names")).withColumn("_names", T.folds_udf("_names"))
    e = e.withColumn("_names", F.filter(bare, lambda a: (a != "") & (F.lower(a) != "others"))).withColumn("_n", F.size("_names"))
    names = (
        F.when(F.col("_n") < 1, F.when(F.col("_all") > 0, " et al."))
        .when((F.col("_n") > 6) | (F.col("_n") < F.col("_all")), F.concat(F.try_element_at("_names", F.lit(1)), F.lit(" et al.")))
        .when(F.col("_n") == 1, F.try_element_at("_names", F.lit(1)))
        .otherwise(F.concat(F.array_join(F.slice("_names", F.lit(1), F.greatest(F.col("_n") - 1, F.lit(0))), ", "), F.lit(" and "), F.try_element_at("_names", F.lit(-1))))
    )
    title = F.btrim(T.fold_udf(text("title")), F.lit(". "))
    where = T.fold_udf(F.coalesce(*[F.nullif(text(n), F.lit("")) for n in ("journal", "booktitle", "school")], F.lit("")))
    pages, year = F.replace(text("pages"), F.lit("--"), F.lit("-")), T.entry_year(bib.field("year"), bib.field("date"))
    place = F.concat_ws(" ", F.nullif(where, F.lit("")), F.nullif(text("volume"), F.lit("")))
    e = e.withColumn("_place", place).withColumn("_pages", pages).withColumn("_year", year)
    locator = F.when((F.col("_place") != "") & (F.col("_pages") != ""), F.concat("_place", F.lit(", "), "_pages")).when(F.col("_pages") != "", F.concat(F.lit("pp. "), "_pages")).otherwise(F.col("_place"))
    locator = F.when(F.col("_year") != "", F.trim(F.concat(locator, F.lit(" ("), "_year", F.lit(")")))).otherwise(locator)
    link = F.when(bib.has("doi"), F.concat(F.lit("https://doi.org/"), text("doi"))).when(bib.has("eprint"), F.concat(F.lit("arXiv:"), text("eprint"))).when(bib.has("url"), text("url"))
    closed = lambda c: F.when(c != "", F.concat(c, F.lit(".")))
    number = F.row_number().over(Window.partitionBy("file").orderBy(F.lower("_key"), "node_pos"))
    e = e.withColumn("number", number)
    line = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), F.concat_ws(" ", closed(names), closed(title), closed(locator), link))
    return e.select("file", "number", F.regexp_replace(line, r"\.\.+", ".").alias("line"))


def run_log(gated: DataFrame, search: dict[str, Column], rounds: list[dict] = (), known: DataFrame | None = None, gold: DataFrame | None = None) -> DataFrame:
    """One JSON row: the search, the size of the corpus, what passed the gate, the rounds, the known items and the gold set.

    rounds: what the expansion reports. known: known_items' rows. gold: gold_recall's rows; both are lists that people write.
    """
    from bibloom.operators import screening

    ok = F.count_if(F.col("validation") == "verified")
    row = gated.agg(F.count("*").alias("corpus_size"), ok.alias("verified"), (F.count("*") - ok).alias("quarantined"))
    curve = [F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in r.items()])) for r in rounds]
    told = [c.alias(n) for n, c in search.items()] + ["corpus_size", "verified", "quarantined", F.parse_json(F.concat(F.lit("["), F.concat_ws(",", *curve), F.lit("]"))).alias("saturation_curve")]
    if known is not None:
        one = F.struct(F.col("title").alias("wanted"), "found", "best_match", F.round("ratio", 3).alias("similarity"))
        row = row.crossJoin(F.broadcast(known.agg(F.transform(F.sort_array(F.collect_list(F.struct("item_id", one.alias("x")))), lambda r: r["x"]).alias("known_items"))))  # one row each
        told.append("known_items")
    if gold is not None:
        key = F.coalesce("key", T.clean_doi(F.col("doi")))
        row = row.crossJoin(F.broadcast(screening.gold_summary(gold).select("total", "found", "recall_pct")))
        lists = [F.sort_array(F.collect_list(F.when(w, key))).alias(n) for n, w in (("missed", ~F.col("found")), ("found_but_screened_out", F.col("found") & F.col("screen").isin(*screening.SCREENED_OUT)))]
        row = row.crossJoin(F.broadcast(gold.agg(*lists)))
        told.append(F.struct("total", "found", "recall_pct", "missed", "found_but_screened_out").alias("gold_set"))
    return row.select(F.to_json(F.struct(*told), {"ignoreNullFields": "false"}).alias("line"))


def write_lines(rows: DataFrame, path: str, opening: list[str] = (), ascii_only: bool = False) -> None:
    """Report lines as text: the opening (title, table head) in the first part file, rows by place after it."""
    line = escaped("line").alias("line") if ascii_only else F.col("line")
    rows = rows.repartitionByRange(F.col("place")).sortWithinPartitions("place").select(line)
    if opening:
        rows = rows.sparkSession.createDataFrame([("\n".join(opening),)], "line string").coalesce(1).union(rows)
    rows.write.mode("overwrite").text(path)
