"""Works and index records from the JSON payloads of scholarly indexes, projected with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibloom.functions import text
from bibloom.sources.schema import WORK

OPENALEX = "id string, doi string, display_name string, title string, publication_year int, authorships array<struct<author:struct<display_name:string>>>, primary_location struct<source:struct<display_name:string>,landing_page_url:string>, abstract_inverted_index map<string,array<int>>, cited_by_count int, best_oa_location struct<pdf_url:string>, referenced_works array<string>, biblio struct<volume:string,first_page:string,last_page:string>"
SEMANTIC_SCHOLAR = "paperId string, title string, year int, abstract string, authors array<struct<name:string>>, externalIds struct<DOI:string,ArXiv:string>, venue string, citationCount int, openAccessPdf struct<url:string>, references array<struct<paperId:string>>"
INSPIRE = "metadata struct<control_number:string,titles:array<struct<title:string>>,authors:array<struct<full_name:string>>,dois:array<struct<value:string>>,arxiv_eprints:array<struct<value:string>>,publication_info:array<struct<year:int,journal_title:string>>,earliest_date:string,citation_count:int,abstracts:array<struct<value:string>>>"
CROSSREF = "DOI string, title array<string>, author array<struct<family:string,given:string,name:string>>, `container-title` array<string>, volume string, page string, issued struct<`date-parts`:array<array<int>>>, URL string"
DATACITE = "doi string, titles array<struct<title:string>>, creators array<struct<name:string,familyName:string,givenName:string>>, publicationYear string, publisher string, container struct<title:string>, volume string, firstPage string, url string"


def _text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def _named(c: Column) -> Column:
    return F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")


def words_in_order(inverted: Column) -> Column:
    """Text from an inverted index word -> positions."""
    spots = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(spots), lambda x: x["w"]), " "), F.lit(""))


def short_id(c: Column) -> Column:
    return F.coalesce(F.substring_index(c, "/", -1), F.lit(""))


def as_works(df: DataFrame, keep: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    """df projected to the work type and the columns of `keep`, absent columns at their defaults."""
    out = [F.col(f"_keep.{c}").alias(c) for c in keep]
    for part in WORK.split(", "):
        name, kind = part.split(" ")
        value = columns.get(name)
        if value is None:
            value = {"string": F.lit(None if name in ("doi", "arxiv_id") else ""), "int": F.lit(0), "boolean": F.lit(False)}.get(kind)
            value = F.create_map() if kind.startswith("map") else F.array() if value is None else value
        out.append(value.cast(kind).alias(name))
    return df.select(*out)


def _parsed(payloads: DataFrame, schema: str, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    held = [F.struct(*keep).alias("_keep")] if keep else []
    return payloads.select(F.from_json(column, schema).alias("p"), *held).select("p.*", *(["_keep"] if keep else []))


def from_openalex(payloads: DataFrame, column: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    p = _parsed(payloads, OPENALEX, column, keep)
    doi, page = text.clean_doi(F.col("doi")), "primary_location.landing_page_url"
    first, last = _text("biblio.first_page"), _text("biblio.last_page")
    pages = F.when((first != "") & (last != "") & (first != last), F.concat(first, F.lit("--"), last)).when(first != "", first).otherwise(last)
    arxiv = text.clean_arxiv_id(F.when(F.contains(doi, F.lit("arxiv")), doi).otherwise(F.col(page)))
    return as_works(
        p, keep, title=_text("display_name"), doi=doi, arxiv_id=arxiv, year=_text("publication_year"), authors=_named(F.transform("authorships", lambda a: a["author"]["display_name"])),
        venue=_text("primary_location.source.display_name"), volume=_text("biblio.volume"), pages=pages, abstract=words_in_order(F.col("abstract_inverted_index")), cited_by_count=F.coalesce("cited_by_count", F.lit(0)),
        oa_pdf_url=_text("best_oa_location.pdf_url"), landing_url=_text(page), sources=F.array(F.lit("openalex")), source_ids=F.create_map(F.lit("openalex"), short_id(F.col("id"))),
        references=F.transform(F.coalesce("referenced_works", F.array().cast("array<string>")), short_id),
    )


def from_semantic_scholar(payloads: DataFrame, column: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    p = _parsed(payloads, SEMANTIC_SCHOLAR, column, keep)
    return as_works(
        p, keep, title=_text("title"), doi=text.clean_doi(F.col("externalIds.DOI")), arxiv_id=text.clean_arxiv_id(F.col("externalIds.ArXiv")), year=_text("year"), authors=_named(F.transform("authors", lambda a: a["name"])), venue=_text("venue"),
        abstract=_text("abstract"), cited_by_count=F.coalesce("citationCount", F.lit(0)), oa_pdf_url=_text("openAccessPdf.url"), sources=F.array(F.lit("semanticscholar")), source_ids=F.create_map(F.lit("semanticscholar"), _text("paperId")),
        references=_named(F.transform("references", lambda r: r["paperId"])),
    )


def from_inspire(payloads: DataFrame, column: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    p = _parsed(payloads, INSPIRE, column, keep).select("metadata.*", *(["_keep"] if keep else []))
    first = lambda c, f: F.try_element_at(c, F.lit(1))[f]
    year = _text(first("publication_info", "year"))
    return as_works(
        p, keep, title=_text(first("titles", "title")), doi=text.clean_doi(first("dois", "value")), arxiv_id=text.clean_arxiv_id(first("arxiv_eprints", "value")), year=F.when(year != "", year).otherwise(F.substring(_text("earliest_date"), 1, 4)),
        authors=_named(F.transform(F.slice("authors", 1, 50), lambda a: a["full_name"])), venue=_text(first("publication_info", "journal_title")), abstract=_text(first("abstracts", "value")), cited_by_count=F.coalesce("citation_count", F.lit(0)),
        sources=F.array(F.lit("inspire")), source_ids=F.create_map(F.lit("inspire"), _text("control_number")),
    )


def _person(family: Column, given: Column) -> Column:
    return F.regexp_replace(F.trim(F.concat(family, F.lit(", "), given)), r"^,+|,+$", "")


def record_from_crossref(payloads: DataFrame, column: str = "payload") -> DataFrame:
    p = _parsed(payloads, CROSSREF, column)
    people = F.transform(F.coalesce("author", F.array().cast("array<struct<family:string,given:string,name:string>>")), lambda a: _person(F.coalesce(F.nullif(a["family"], F.lit("")), a["name"], F.lit("")), F.coalesce(a["given"], F.lit(""))))
    one = lambda c: _text(F.try_element_at(c, F.lit(1)))
    year = F.try_element_at(F.try_element_at(F.col("issued.date-parts"), F.lit(1)), F.lit(1))
    return p.select(F.lit("crossref").alias("source"), F.col("DOI").alias("doi"), text.strip_markup(one("title")).alias("title"), people.alias("authors"), _text(year).alias("year"), one("container-title").alias("journal"), _text("volume").alias("volume"), _text("page").alias("pages"), _text("URL").alias("url"))


def record_from_datacite(payloads: DataFrame, column: str = "payload") -> DataFrame:
    p = _parsed(payloads, DATACITE, column)
    people = F.transform(F.coalesce("creators", F.array().cast("array<struct<name:string,familyName:string,givenName:string>>")), lambda a: _person(F.coalesce(F.nullif(a["familyName"], F.lit("")), a["name"], F.lit("")), F.coalesce(a["givenName"], F.lit(""))))
    journal = F.coalesce(F.nullif(F.col("container.title"), F.lit("")), "publisher", F.lit(""))
    return p.select(F.lit("datacite").alias("source"), "doi", text.strip_markup(_text(F.try_element_at("titles", F.lit(1))["title"])).alias("title"), people.alias("authors"), _text("publicationYear").alias("year"), journal.alias("journal"), _text("volume").alias("volume"), _text("firstPage").alias("pages"), _text("url").alias("url"))


def record_from_arxiv(entries: DataFrame, column: str = "payload") -> DataFrame:
    """Records from Atom <entry> elements; local names, so namespaces do not matter."""
    at = lambda name: F.trim(F.coalesce(F.xpath_string(column, F.lit(f"/*[local-name()='entry']/*[local-name()='{name}']")), F.lit("")))
    names = F.filter(F.xpath(column, F.lit("/*[local-name()='entry']/*[local-name()='author']/*[local-name()='name']/text()")), lambda x: F.trim(x) != "")
    people = F.transform(names, lambda n: _person(F.substring_index(F.trim(n), " ", -1), F.trim(F.regexp_replace(F.trim(n), r"\s*\S+$", ""))))
    return entries.select(F.lit("arxiv").alias("source"), F.regexp_replace(at("title"), r"\s+", " ").alias("title"), people.alias("authors"), F.substring(at("published"), 1, 4).alias("year"), at("id").alias("url"), F.nullif(at("doi"), F.lit("")).alias("published_doi"), at("journal_ref").alias("published_journal"))


def fan_out(sources: list[tuple[int, int, DataFrame]], low: int | None = None, high: int | None = None) -> DataFrame:
    """The ordered union of (query number, source number, works), filtered by year; order columns for dedup."""
    from bibloom.operators.relevance import in_years

    parts = [df.withColumn("query_no", F.lit(q)).withColumn("source_no", F.lit(s)) for q, s, df in sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(in_years(F.col("year"), low, high))


def hits_by_source(works: DataFrame, names: list[str]) -> DataFrame:
    """(source, n) with zeros for sources that found nothing."""
    every = works.sparkSession.createDataFrame([(n,) for n in names], "source string")
    return every.join(works.select(F.explode("sources").alias("source")).groupBy("source").agg(F.count("*").alias("n")), "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"))
