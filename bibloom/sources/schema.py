"""Row types. Absent text is an empty string on ingest, absent identifiers are null."""

from __future__ import annotations

WORK = (
    "title string, year string, venue string, volume string, pages string, abstract string, oa_pdf_url string, landing_url string, screen string, screen_reason string, role string, "
    "validation string, validation_source string, doi string, arxiv_id string, authors array<string>, sources array<string>, references array<string>, source_ids map<string,string>, "
    "cited_by_count int, found_in_round int, is_seed boolean"
)
RECORD = "source string, doi string, title string, authors array<string>, first_surname string, year string, journal string, volume string, pages string, url string, published_doi string, published_journal string"
FIELD = "struct<name:string,text:string,delim:string>"
NODE = f"file string, node_pos int, kind string, type string, type_raw string, key string, line int, text string, fields array<{FIELD}>, lead_comment string, is_banner boolean, section_id int, error string"
VERDICT = "index string, t string, verdict string, reason string, role string"
TEXT_FIELDS = ("title", "year", "venue", "volume", "pages", "abstract", "oa_pdf_url", "landing_url", "screen", "screen_reason", "role", "validation", "validation_source")
