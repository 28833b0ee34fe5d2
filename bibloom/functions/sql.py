"""The library's functions in SQL: names to call in any query of a session, and BibTeX as a table function for LATERAL joins."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from bibloom.functions import text as T
from bibloom.operators.bib import BibError, parse

NODE = "node_pos int, kind string, type string, `key` string, line int, text string, fields map<string,string>, lead_comment string, section_id int, error string"
SCALARS = {
    "fold_latex": T.fold_udf, "latexify": T.latex_udf, "split_authors": T.authors_udf, "first_surname": T.surname_udf, "surnames": T.surnames_udf,
    "title_ratio": T.ratio_udf, "title_key": T.title_udf,
}


@udtf(returnType=NODE)
class ParseBibtex:
    """parse_bibtex(source): one row a node of a BibTeX text, fields by lower-case name; one row with the error for a broken text."""

    def eval(self, source: str) -> Iterator[tuple]:
        try:
            found = parse(source or "")
        except BibError as e:
            yield None, "error", None, None, None, None, None, None, None, str(e)
            return
        for k, node in enumerate(found):
            fields = {n.lower(): v for n, v, _ in node.get("fields") or ()}
            yield k, node["kind"], node.get("type"), node.get("key"), node["line"], node.get("text"), fields, node.get("lead_comment"), node["section_id"], None


def register(spark: SparkSession) -> None:
    """Makes SCALARS and parse_bibtex known to a session."""
    for name, f in SCALARS.items():
        spark.udf.register(name, f)
    spark.udtf.register("parse_bibtex", ParseBibtex)
