"""BibTeX: parsing (a Python UDTF-like map over files), rendering, normalising, linting and keys."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from bibloom.functions import text as T
from bibloom.sources.schema import NODE

# Entry types kept verbatim, order of fields, characters without width.
VERBATIM = ("comment", "preamble", "string", "control")
FIELD_ORDER = "author title journal booktitle school institution publisher series edition volume number pages month year eprint archivePrefix primaryClass doi url issn isbn note".split()
ZERO_WIDTH = "﻿​‌‍⁠"
# Fields of each entry type.
REQUIRED = {
    "article": "author title year", "book": "author title publisher year", "inbook": "author title publisher year", "incollection": "author title booktitle year",
    "inproceedings": "author title booktitle year", "conference": "author title booktitle year", "mastersthesis": "author title school year", "phdthesis": "author title school year",
    "techreport": "author title institution year", "misc": "author title year", "software": "author title year", "dataset": "author title year", "unpublished": "author title note",
}
RECOMMENDED = {"article": "journal volume pages doi", "book": "doi", "incollection": "pages doi", "inproceedings": "pages doi", "conference": "pages doi"}
ONE_OF = {"software": "url doi eprint", "dataset": "url doi"}
ONE_OF_ADVISED = {"misc": "url doi eprint note howpublished", "phdthesis": "doi url", "mastersthesis": "doi url", "techreport": "doi url"}
ORGANISATIONS = "software inc ltd llc gmbh corp corporation company technologies technology systems solutions university institute laboratory laboratories collaboration consortium foundation team".split()

_STRUCTURE = re.compile(r'\\.|[{}()"]', re.S)


class BibError(ValueError):
    """Broken BibTeX, with the line it was found on."""


def _closed(source: str, at: int) -> int:
    """Place after the delimiter that closes the one at `at`."""
    opener = source[at]
    closer, depth = {"{": "}", "(": ")"}[opener], 0
    for m in _STRUCTURE.finditer(source, at):
        depth += (m[0] == opener) - (m[0] == closer)
        if depth == 0:
            return m.end()
    raise BibError(f"unbalanced {opener!r} on line {source.count(chr(10), 0, at) + 1}")


def _value(body: str, at: int, name: str, line: int) -> tuple[str, str, int]:
    """(text, delimiter, place after it) of the value at `at`."""
    begin = at
    if body[at : at + 1] == "{":
        at = _closed(body, at)
        found = (body[begin + 1 : at - 1], "brace")
    elif body[at : at + 1] == '"':
        depth = 0
        for m in _STRUCTURE.finditer(body, at + 1):
            depth += (m[0] == "{") - (m[0] == "}")
            if m[0] == '"' and depth == 0:
                at = m.end()
                break
        else:
            raise BibError(f"unterminated quoted value for {name!r} on line {line}")
        found = (body[begin + 1 : at - 1], "quote")
    else:
        at = re.compile(r"[^,}\n]*").match(body, at).end()
        found = (body[begin:at].strip(), "bare")
    joined = re.compile(r"\s*#").match(body, at)
    if not joined:
        return *found, at
    at = joined.end()
    while at < len(body) and body[at] != ",":
        at = _closed(body, at) if body[at] == "{" else (re.compile(r'"(?:\\.|[^"\\])*"?', re.S).match(body, at).end() if body[at] == '"' else at + (2 if body[at] == "\\" else 1))
    return body[begin:at].strip(), "raw", at


def _entry(body: str, line: int) -> tuple[str, list[tuple[str, str, str]]]:
    """Key and fields of the inside of an entry."""
    key, _, rest = body.partition(",")
    fields, at, seen = [], 0, set()
    name_at = re.compile(r"[A-Za-z][A-Za-z0-9_:.+-]*")
    while at < len(rest):
        m = name_at.match(rest, at)
        if not m:
            at += 1
            continue
        equals = re.compile(r"\s*=\s*").match(rest, m.end())
        if not equals:
            raise BibError(f"expected = after field {m[0]!r} in the entry on line {line}")
        value, delim, at = _value(rest, equals.end(), m[0], line)
        if m[0] in seen:
            raise BibError(f"duplicate field {m[0]!r} in entry {key.strip()!r} on line {line}")
        seen.add(m[0])
        fields.append((m[0], value, delim))
    return key.strip(), fields


def parse(source: str) -> list[dict]:
    """The nodes of a file in order: comment, raw and entry; a note right before an entry is its lead comment."""
    source = source.replace("\r\n", "\n").replace("\r", "\n").translate(dict.fromkeys(map(ord, ZERO_WIDTH)))
    nodes: list[dict] = []
    section, at = 0, 0

    def line_of(place: int) -> int:
        return source.count("\n", 0, place) + 1

    def comments(upto: int) -> None:
        nonlocal section
        place = at
        for piece in re.split(r"(\n[ \t]*\n)", source[at:upto]):
            if piece.strip():
                banner = re.search("%{20,}", piece) is not None
                section += banner
                nodes.append({"kind": "comment", "text": piece.strip("\n"), "line": line_of(place), "is_banner": banner, "section_id": section})
            place += len(piece)

    while (start := source.find("@", at)) >= 0:
        comments(start)
        line = line_of(start)
        head = re.compile(r"@([A-Za-z]+)\s*").match(source, start)
        if not head:
            raise BibError(f"expected an entry type after @ on line {line}")
        if source[head.end() : head.end() + 1] not in ("{", "("):
            raise BibError(f"expected {{ or ( after @{head[1]} on line {line}")
        at = _closed(source, head.end())
        kind = head[1].lower()
        if kind in VERBATIM:
            nodes.append({"kind": "raw", "text": source[start:at], "line": line, "section_id": section})
            continue
        key, fields = _entry(source[head.end() + 1 : at - 1], line)
        node = {"kind": "entry", "type": kind, "type_raw": head[1], "key": key, "line": line, "fields": fields, "section_id": section}
        if nodes and nodes[-1]["kind"] == "comment" and not nodes[-1]["is_banner"]:
            node["lead_comment"] = nodes.pop()["text"]
        nodes.append(node)
    comments(len(source))
    return nodes


def parse_files(files: DataFrame, strict: bool = True) -> DataFrame:
    """Nodes of BibTeX files (file, source); broken files raise, or give one error row where not strict."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in re.sub(r"<.*>", "", NODE).split(", ")]
        for pdf in frames:
            rows = []
            for file, source in zip(pdf["file"], pdf["source"]):
                try:
                    found = parse(source or "")
                except BibError as e:
                    if strict:
                        raise
                    found = [{"kind": "error", "error": str(e)}]
                for k, node in enumerate(found):
                    row = dict.fromkeys(names) | node | {"file": file, "node_pos": k}
                    row["fields"] = [dict(zip(("name", "text", "delim"), f)) for f in node.get("fields", ())]
                    rows.append(row)
            out = pd.DataFrame(rows, columns=names)
            for c in ("node_pos", "line", "section_id"):
                out[c] = out[c].astype("Int32")
            yield out

    return files.select("file", "source").mapInPandas(run, NODE)


def field(name: str, fields: str | Column = "fields") -> Column:
    """A field's text, case-insensitively, or null."""
    hit = F.filter(fields, lambda f: F.lower(f["name"]) == name.lower())
    return F.try_element_at(hit, F.lit(1))["text"]


def has(name: str) -> Column:
    return F.coalesce(F.trim(field(name)) != "", F.lit(False))


def with_field(fields: Column, name: str, value: Column, put: Column) -> Column:
    """fields with name = {value} where `put` holds: replaced in place, or appended."""
    same = lambda f: F.lower(f["name"]) == name.lower()
    new = F.struct(F.lit(name).alias("name"), value.alias("text"), F.lit("brace").alias("delim"))
    replaced = F.transform(fields, lambda f: F.when(same(f), F.struct(f["name"].alias("name"), value.alias("text"), F.lit("brace").alias("delim"))).otherwise(f))
    return F.when(F.coalesce(put, F.lit(False)), F.when(F.exists(fields, same), replaced).otherwise(F.concat(fields, F.array(new)))).otherwise(fields)


def without_field(fields: Column, name: str, drop: Column) -> Column:
    return F.when(F.coalesce(drop, F.lit(False)), F.filter(fields, lambda f: F.lower(f["name"]) != name.lower())).otherwise(fields)


def rendered(entries: DataFrame) -> DataFrame:
    """entries with bibtex: canonical field order, aligned names, no comma after the last field."""
    order = F.create_map(*[x for i, n in enumerate(FIELD_ORDER) for x in (F.lit(n.lower()), F.struct(F.lit(i).alias("i"), F.lit(n).alias("n")))])
    placed = F.transform("fields", lambda f, i: F.struct(F.coalesce(order[F.lower(f["name"])]["i"], F.lit(len(FIELD_ORDER)) + i).alias("place"), F.coalesce(order[F.lower(f["name"])]["n"], f["name"]).alias("name"), f["text"].alias("text"), f["delim"].alias("delim")))
    value = lambda f: F.when(f["delim"] == "brace", F.concat(F.lit("{"), f["text"], F.lit("}"))).when(f["delim"] == "quote", F.concat(F.lit('"'), f["text"], F.lit('"'))).otherwise(f["text"])
    out = entries.withColumn("_f", F.array_sort(placed)).withColumn("_w", F.coalesce(F.array_max(F.transform("_f", lambda f: F.length(f["name"]))), F.lit(0)))
    lines = F.transform("_f", lambda f: F.concat(F.lit("    "), F.rpad(f["name"], F.col("_w"), F.lit(" ")), F.lit(" = "), value(f)))
    key = F.coalesce("new_key", "key") if "new_key" in entries.columns else F.col("key")
    body = F.concat(F.lit("@"), "type", F.lit("{"), key, F.lit(",\n"), F.array_join(lines, ",\n"), F.when(F.size("_f") > 0, "\n").otherwise(""), F.lit("}"))
    return out.withColumn("bibtex", body).drop("_f", "_w")


def letters(i: Column) -> Column:
    """a to z, then aa to zz, then aaa and so on: a text of its own for each number from 0 on."""
    out, first = F, 0
    for n in range(1, 8):  # row numbers are ints, seven letters hold them; a length begins where the shorter ones end
        digits = [F.char((F.floor((i - first) / 26**d) % 26).cast("int") + 97) for d in reversed(range(n))]
        out = out.when(i < first + 26**n, F.concat(*digits))
        first += 26**n
    return out


def keyed(entries: DataFrame) -> DataFrame:
    """entries with new_key: SurnameYEAR, suffixed in groups; entries without surname or year keep their key."""
    year = T.entry_year(field("year"), field("date"))
    surname = T.surname_udf(F.coalesce(field("author"), F.lit("")))
    e = entries.withColumn("_s", surname).withColumn("_y", year).withColumn("_t", T.normalize_title(F.coalesce(field("title"), F.lit("")))).withColumn("_d", F.lower(F.coalesce(field("doi"), F.lit(""))))
    ok = (F.col("_s") != "") & (F.col("_y") != "")
    e = e.withColumn("_b", F.when(ok, F.concat(F.upper(F.substring("_s", 1, 1)), F.expr("substring(_s, 2)"), "_y")).otherwise(F.concat(F.lit("\0"), F.col("file"), F.lit("\0"), F.col("node_pos").cast("string"))))
    w = Window.partitionBy("file", "_b")
    n, k = F.count("*").over(w), F.row_number().over(w.orderBy("_t", "_d", "key", "node_pos")) - 1
    suffix = F.when(n == 1, "").otherwise(letters(k))
    return e.withColumn("unkeyable", ~ok).withColumn("new_key", F.when(ok, F.concat("_b", suffix)).otherwise(F.col("key"))).drop("_s", "_y", "_t", "_d", "_b")


def normalized(entries: DataFrame, ascii_only: bool = False) -> DataFrame:
    """entries with unambiguous fixes: arXiv ids to eprint, bare DOIs, double-hyphen page ranges, unwrapped values."""
    e = entries
    set_ = lambda name, value, put: e.withColumn("fields", with_field(F.col("fields"), name, value, put))
    e = e.withColumn("_e", F.trim(field("eprint"))).withColumn("_id", T.find_arxiv_id(F.col("_e")))
    bad = (F.coalesce("_e", F.lit("")) != "") & F.col("_id").isNull() & F.lower("_e").rlike(r"^(https?://|www\.)")
    e = e.withColumn("_bad", F.coalesce(bad, F.lit(False))).withColumn("_url", has("url") | has("doi"))
    e = e.withColumn("fields", without_field(without_field(without_field(F.col("fields"), "eprint", F.col("_bad")), "archivePrefix", F.col("_bad")), "primaryClass", F.col("_bad")))
    e = e.withColumn("fields", with_field(F.col("fields"), "url", F.col("_e"), F.col("_bad") & ~F.col("_url")))
    e = e.withColumn("fields", with_field(F.col("fields"), "eprint", F.col("_id"), F.col("_id").isNotNull() & (F.col("_id") != F.col("_e"))))
    none = F.coalesce(F.col("_e"), F.lit("")) == ""
    source = F
    for name in ("journal", "note", "url", "howpublished"):
        source = source.when(none & F.lower(field(name)).contains("arxiv") & T.find_arxiv_id(field(name)).isNotNull(), F.struct(F.lit(name).alias("name"), field(name).alias("text"), T.find_arxiv_id(field(name)).alias("id")))
    e = e.withColumn("_m", source)
    category = F.regexp_extract("_m.text", r"\[([a-z-]+(?:\.[A-Za-z]{2})?)\]", 1)
    residue = F.regexp_replace(F.regexp_replace(F.regexp_replace("_m.text", r"\[[a-z-]+(?:\.[A-Za-z]{2})?\]", ""), r"(?i)arxiv[:\s]*", ""), r"(\d{4}\.\d{4,5}|[a-z-]+(\.[A-Z]{2})?/\d{7})(v\d+)?", "")
    e = e.withColumn("_c", category).withColumn("_r", F.regexp_replace(residue, r"^[ .,:;\[\]]+|[ .,:;\[\]]+$", ""))
    moved = F.col("_m").isNotNull()
    e = e.withColumn("fields", with_field(F.col("fields"), "eprint", F.col("_m.id"), moved))
    e = e.withColumn("_p", (moved | F.col("_id").isNotNull()) & ~has("archivePrefix"))
    e = e.withColumn("fields", with_field(F.col("fields"), "archivePrefix", F.lit("arXiv"), F.col("_p")))
    e = e.withColumn("_q", moved & (F.col("_c") != "") & ~has("primaryClass"))
    e = e.withColumn("fields", with_field(F.col("fields"), "primaryClass", F.col("_c"), F.col("_q")))
    e = e.withColumn("fields", F.when(moved & (F.col("_r") == ""), F.filter("fields", lambda f: F.lower(f["name"]) != F.col("_m.name"))).otherwise(F.col("fields")))
    e = e.withColumn("_d", field("doi"))
    bare = F.regexp_replace(F.trim(F.regexp_replace("_d", r"(?i)^\s*(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")), r"\.+$", "")
    e = e.withColumn("fields", with_field(F.col("fields"), "doi", bare, (F.coalesce("_d", F.lit("")) != "") & (bare != F.col("_d"))))
    hidden = F.regexp_extract(field("url"), r"(10\.\d{4,9}/\S+)", 1)
    e = e.withColumn("_h", F.when((F.coalesce("_d", F.lit("")) == "") & F.lower(field("url")).contains("doi.org/"), F.nullif(hidden, F.lit(""))))
    e = e.withColumn("fields", with_field(F.col("fields"), "doi", F.col("_h"), F.col("_h").isNotNull()))
    e = e.withColumn("_g", F.regexp_replace(F.trim(field("pages")), r"^(\w+)\s*[-–—]\s*(\w+)$", "$1--$2"))
    e = e.withColumn("fields", with_field(F.col("fields"), "pages", F.col("_g"), F.col("_g") != F.trim(field("pages"))))
    unwrap = lambda f: F.when(f["delim"].isin("brace", "quote") & f["text"].contains("\n"), F.trim(F.regexp_replace(f["text"], r"\s*\n\s*", " "))).otherwise(f["text"])
    e = e.withColumn("fields", F.transform("fields", lambda f: F.struct(f["name"].alias("name"), unwrap(f).alias("text"), f["delim"].alias("delim"))))
    if ascii_only:
        e = e.withColumn("fields", _latexified(F.col("fields")))
    return e.drop("_e", "_id", "_bad", "_url", "_m", "_c", "_r", "_p", "_q", "_d", "_h", "_g")


def changes(entries: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(file, key, line, level, code, message): what `normalized` changes of each entry, told from its fields before and after.

    One map over entries, nothing is shuffled. An eprint that is no identifier and no link is a warning. With ascii_only
    every field that gets LaTeX spellings is told.
    """
    e = normalized(entries.withColumn("_was", F.col("fields")))
    blank = lambda c: F.coalesce(c, F.lit(""))
    was, now = (lambda n: blank(field(n, "_was"))), (lambda n: blank(field(n)))
    held = lambda n: F.trim(was(n)) != ""
    eprint, found = F.trim(was("eprint")), T.find_arxiv_id(was("eprint"))
    link = F.lower(eprint).rlike(r"^(https?://|www\.)")
    notes: list[Column] = []

    def note(when: Column, code: str, *message: str | Column, level: str = "info") -> None:
        text = F.concat(*[F.lit(m) if isinstance(m, str) else m for m in message])
        notes.append(F.when(when, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), text.alias("message"))))

    known = (eprint != "") & found.isNotNull()
    note(known & (found != eprint), "arxiv-eprint", "eprint normalised to bare arXiv id ", blank(found))
    note(known & ~held("archivePrefix"), "arxiv-eprint", "added archivePrefix = {arXiv}")
    unknown = (eprint != "") & found.isNull()
    note(unknown & ~link, "bad-eprint", "eprint '", eprint, "' is not an arXiv identifier", level="warning")
    note(unknown & link & (held("url") | held("doi")), "bad-eprint", "dropped a publisher PDF link from eprint; the entry already has a url/doi")
    note(unknown & link & ~held("url") & ~held("doi"), "bad-eprint", "moved a publisher PDF link from eprint into url")
    taken = F.lit(False)
    for n in ("journal", "note", "url", "howpublished"):
        here = (eprint == "") & F.lower(was(n)).contains("arxiv") & T.find_arxiv_id(was(n)).isNotNull()
        verb = F.when(field(n).isNotNull(), "copied").otherwise("moved")
        note(here & ~taken, "arxiv-relocated", verb, " arXiv id ", blank(T.find_arxiv_id(was(n))), f" from {n} into eprint/archivePrefix")
        taken = taken | here
    note((was("doi") != "") & (now("doi") != was("doi")), "doi-prefix", "stripped resolver prefix from doi -> ", now("doi"))
    note((was("doi") == "") & (now("doi") != ""), "doi-from-url", "recovered doi ", now("doi"), " from the url field")
    pages = F.trim(was("pages"))
    fixed = F.regexp_replace(pages, r"^(\w+)\s*[-–—]\s*(\w+)$", "$1--$2")
    note(fixed != pages, "page-range", "page range ", pages, " normalised to ", fixed)
    told = F.array_compact(F.array(*notes))
    if ascii_only:
        e = e.withColumn("_latex", _latexified(F.col("fields")))
        spelled = F.filter(F.zip_with("fields", "_latex", lambda a, b: F.when(a["text"] != b["text"], a["name"])), lambda n: n.isNotNull())
        told = F.concat(told, F.transform(spelled, lambda n: F.struct(F.lit("info").alias("level"), F.lit("ascii").alias("code"), F.concat(n, F.lit(": rewrote non-ASCII characters as LaTeX escapes")).alias("message"))))
    key = F.coalesce("new_key", "key") if "new_key" in entries.columns else F.col("key")
    return e.select("file", key.alias("key"), "line", F.explode(told).alias("f")).select("file", "key", "line", "f.*")


_FIELD = StructType().add("name", StringType()).add("text", StringType()).add("delim", StringType())


@F.pandas_udf(ArrayType(_FIELD))
def _latexified(s: pd.Series) -> pd.Series:
    return s.map(lambda fields: [{"name": f["name"], "text": T.latex(f["text"]), "delim": f["delim"]} for f in fields])


def findings(entries: DataFrame) -> DataFrame:
    """(file, key, line, level, code, message) of every entry rule, in one pass: each rule adds to an array, exploded once."""
    e = entries.withColumn("_k", F.coalesce("new_key", "key") if "new_key" in entries.columns else F.col("key"))
    text = lambda n: F.coalesce(field(n), F.lit(""))
    author = text("author")
    e = e.withColumn("_names", T.authors_udf(author)).withColumn("_surname", T.surname_udf(author)).withColumn("_title", T.normalize_title(text("title"))).withColumn("_year", T.entry_year(field("year"), field("date")))
    preprint = has("eprint") & ~has("journal")
    known = F.col("type").isin(*REQUIRED)
    rules: list[Column] = []

    def rule(when: Column, level: str | Column, code: str, message: Column | str) -> None:
        one = F.struct((F.lit(level) if isinstance(level, str) else level).alias("level"), F.lit(code).alias("code"), (F.lit(message) if isinstance(message, str) else message).alias("message"))
        rules.append(F.when(when, one))

    at = F.concat(F.lit("@"), F.col("type"))
    rule(F.col("type") != F.col("type_raw"), "info", "entry-type-case", F.concat(F.lit("entry type @"), "type_raw", F.lit(" normalised to "), at))
    rule(~known, "warning", "unknown-type", F.concat(F.lit("unrecognised entry type "), at, F.lit("; completeness not checked")))
    for table, level, code in ((REQUIRED, "error", "missing-field"), (RECOMMENDED, "warning", "missing-recommended")):
        for name in sorted({n for v in table.values() for n in v.split()}):
            kinds = [k for k, v in table.items() if name in v.split()]
            when = F.col("type").isin(*kinds) & ~has(name)
            if table is RECOMMENDED and name in ("journal", "volume", "pages"):
                when = when & ~preprint
            rule(when, level, code, F.concat(at, F.lit(f" is missing required field {name}" if table is REQUIRED else f" has no {name}")))
    for table, level, code, said in ((ONE_OF, "error", "missing-field", " needs at least one of: "), (ONE_OF_ADVISED, "warning", "missing-recommended", " has none of: ")):
        for kind, names in table.items():
            none = F.lit(True)
            for n in names.split():
                none = none & ~has(n)
            rule((F.col("type") == kind) & none, level, code, F.concat(at, F.lit(said + ", ".join(names.split()))))
    rule(known & preprint, "warning", "preprint", F.concat(F.lit("preprint arXiv:"), text("eprint"), F.lit(" with no journal; run with --verify to check for a published version")))
    rule(known & F.exists("_names", lambda n: F.lower(F.trim(n)).isin("others", "{others}")), "warning", "truncated-authors", 'author list is truncated with "and others"; --fix-from-index can expand it')
    rule(known & (author != "") & (F.col("_surname") == "") & ~T.has_placeholder(author), "error", "bad-author", "cannot parse a first-author surname from the author field")
    single = F.when(F.size("_names") == 1, F.trim(F.try_element_at("_names", F.lit(1)))).otherwise("")
    words = F.split(single, r"\s+")
    organisation = (single != "") & ~F.contains(single, F.lit(",")) & ~F.startswith(single, F.lit("{")) & (F.size(words) > 1) & F.regexp_replace(F.lower(F.element_at(words, -1)), r"^\.+|\.+$", "").isin(*ORGANISATIONS)
    rule(known & organisation, "warning", "unbraced-organisation", F.concat(F.lit("author '"), single, F.lit("' looks like an organisation; brace it")))
    year = F.trim(field("year"))
    rule(known & year.isNotNull() & ~year.rlike(r"^\d{4}$"), F.when(F.col("_year") != "", "warning").otherwise("error"), "bad-year", F.concat(F.lit("year field '"), year, F.when(F.col("_year") != "", "' is not a bare 4-digit year").otherwise("' contains no 4-digit year")))
    rule(known & (text("doi") != "") & ~F.trim(text("doi")).rlike(r"^10\.\d{4,9}/\S+$"), "error", "bad-doi", F.concat(F.lit("doi '"), F.trim(text("doi")), F.lit("' does not look like a DOI (expected 10.NNNN/suffix)")))
    rule(known & (F.trim(text("doi")) != "") & F.contains(text("url"), F.trim(text("doi"))), "info", "redundant-url", "url only restates the doi; consider dropping it")
    rule(known & (text("title") != "") & (F.col("_title") == ""), "error", "bad-title", "title contains no readable text after LaTeX stripping")
    if "unkeyable" in entries.columns:
        rule(F.col("unkeyable"), "error", "unkeyable", "no key can be built")
    kind = "array<struct<level:string,code:string,message:string>>"
    marked = F.transform(F.filter("fields", lambda f: (F.lower(f["name"]) != "url") & f["text"].rlike(T.PLACEHOLDER_REGEX)), lambda f: F.struct(F.lit("error").alias("level"), F.lit("placeholder").alias("code"), F.concat(f["name"], F.lit(" contains an editing placeholder: '"), F.trim(f["text"]), F.lit("'")).alias("message")))
    every = F.concat(F.array_compact(F.array(*rules)).cast(kind), F.when(known, marked.cast(kind)).otherwise(F.array().cast(kind)))
    return e.select("file", F.col("_k").alias("key"), "line", F.explode(every).alias("f")).select("file", "key", "line", "f.*")


def duplicate_findings(entries: DataFrame) -> DataFrame:
    """Repeated keys, and entries that repeat a DOI or else (surname, year, title); the only rules that shuffle."""
    e = entries.select("file", "node_pos", "key", "line", F.lower(F.trim(field("doi"))).alias("doi"), T.surname_udf(F.coalesce(field("author"), F.lit(""))).alias("s"), T.entry_year(field("year"), field("date")).alias("y"), T.normalize_title(F.coalesce(field("title"), F.lit(""))).alias("t"))

    def later(on: Column) -> Column:
        # entries without the value are dealt by their place, or all of them would be one group
        apart = F.when(on.isNull(), F.col("node_pos"))
        return F.when(on.isNotNull(), F.row_number().over(Window.partitionBy("file", on, apart).orderBy("node_pos"))) > 1

    signature = F.when((F.col("s") != "") & (F.col("y") != "") & (F.col("t") != ""), F.concat_ws("\0", "s", "y", "t"))
    e = e.withColumn("by_key", later(F.nullif(F.col("key"), F.lit("")))).withColumn("by_doi", later(F.nullif(F.col("doi"), F.lit("")))).withColumn("by_signature", later(signature))
    keys = e.where("by_key").select("file", "key", "line", F.lit("error").alias("level"), F.lit("duplicate-key").alias("code"), F.concat(F.lit("key "), "key", F.lit(" is already used")).alias("message"))
    twins = e.where("coalesce(by_doi, false) or coalesce(by_signature, false)").select("file", "key", "line", F.lit("warning").alias("level"), F.lit("duplicate-entry").alias("code"), F.when(F.col("by_doi"), "same doi as an earlier entry").otherwise("same author, year and title as an earlier entry").alias("message"))
    return keys.unionByName(twins)


def non_ascii_findings(files: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(file, line, level, code, found): visible non-ASCII and zero-width characters of each source line."""
    lines = files.select("file", F.posexplode(F.split(F.regexp_replace("source", r"\r\n?", "\n"), "\n")).alias("k", "value")).where(F.col("value").rlike(r"[^\x00-\x7F]"))
    odd = F.array_sort(F.array_distinct(F.regexp_extract_all("value", F.lit(r"([^\x00-\x7F])"), F.lit(1))))
    invisible = lambda x: x.isin(*ZERO_WIDTH)
    parts = F.array(F.struct(F.lit("info").alias("level"), F.lit("zero-width").alias("code"), F.filter(odd, invisible).alias("found")), F.struct(F.lit("info" if ascii_only else "warning").alias("level"), F.lit("non-ascii").alias("code"), F.filter(odd, lambda x: ~invisible(x)).alias("found")))
    return lines.select("file", (F.col("k") + 1).alias("line"), F.explode(parts).alias("f")).select("file", "line", "f.*").where(F.size("found") > 0)


def from_works(works: DataFrame) -> DataFrame:
    """Entries of works: @misc for preprints without a venue, else @article; url only without a DOI."""
    t = lambda c: F.coalesce(F.col(c), F.lit(""))
    preprint = (t("arxiv_id") != "") & (t("venue") == "")
    clean = T.ascii_punctuation
    people = F.array_join(F.transform(F.filter("authors", lambda a: a != ""), clean), " and ")
    parts = [("author", people, F.size("authors") > 0), ("title", clean(t("title")), t("title") != ""), ("journal", clean(t("venue")), (t("venue") != "") & ~preprint), ("volume", clean(t("volume")), (t("volume") != "") & ~preprint), ("pages", clean(t("pages")), (t("pages") != "") & ~preprint), ("year", clean(t("year")), t("year") != ""), ("doi", clean(t("doi")), t("doi") != ""), ("eprint", clean(t("arxiv_id")), t("arxiv_id") != ""), ("archivePrefix", F.lit("arXiv"), t("arxiv_id") != ""), ("url", F.trim(t("oa_pdf_url")), (t("oa_pdf_url") != "") & (t("doi") == ""))]
    fields = F.array_compact(F.array(*[F.when(put, F.struct(F.lit(n).alias("name"), v.alias("text"), F.lit("brace").alias("delim"))) for n, v, put in parts]))
    latin = F.transform("authors", lambda a: F.regexp_replace(F.element_at(F.split(F.concat(F.lit(" "), clean(a)), " "), -1), "[^A-Za-z]", ""))
    key = F.concat(F.coalesce(F.try_element_at(F.filter(latin, lambda s: s != ""), F.lit(1)), F.lit("Anon")), F.coalesce(F.nullif(t("year"), F.lit("")), F.lit("0000")), F.lit("x"), F.col("position").cast("string"))
    kind = F.when(preprint, "misc").otherwise("article")
    return works.select("work_id", F.lit("works").alias("file"), F.col("position").cast("int").alias("node_pos"), F.lit("entry").alias("kind"), kind.alias("type"), kind.alias("type_raw"), key.alias("key"), F.lit(0).alias("line"), fields.alias("fields"))


def citable(works: DataFrame) -> DataFrame:
    return works.where((F.size("authors") > 0) & (F.coalesce("title", F.lit("")) != ""))
