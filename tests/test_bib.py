import pytest
from pyspark.sql import functions as F

from bibloom.operators import bib

SOURCE = """%%%%%%%%%%%%%%%%%%%%%%%%%
% one
%%%%%%%%%%%%%%%%%%%%%%%%%

note on the next
@Article{b, title = {A {B} c}, author = {Doe, J.
   and Roe, R.}, year = 2020, journal = {arXiv:2004.14256},}
@misc{a, title = "quoted {"} text", note = {Submitted; arXiv:2509.03375}, month = jan # "~1", author={Doe, Jane}, year={2020}}
@string{x = {y}}
"""


def entries(spark, source=SOURCE):
    return bib.parse_files(spark.createDataFrame([("f", source)], "file string, source string")).where("kind = 'entry'")


def test_parse():
    nodes = bib.parse(SOURCE)
    assert [n["kind"] for n in nodes] == ["comment", "entry", "entry", "raw"]
    assert nodes[0]["is_banner"] and nodes[1]["lead_comment"].strip() == "note on the next"
    assert dict((f[0], f[1:]) for f in nodes[2]["fields"])["month"] == ('jan # "~1"', "bare")
    assert bib.parse('@misc{a, month = "1~" # jan}')[0]["fields"] == [("month", '"1~" # jan', "raw")]


@pytest.mark.parametrize("source", ["@article{a, title = {x", "@{a}", "@article a", "@article{a, title {x}}", '@misc{a, title = "x}', "@misc{a, t = {x}, t = {y}}"])
def test_errors(source):
    with pytest.raises(bib.BibError):
        bib.parse(source)


def test_permissive_mode_keeps_the_error(spark):
    out = bib.parse_files(spark.createDataFrame([("f", "@article{a")], "file string, source string"), strict=False).first()
    assert out["kind"] == "error" and "line 1" in out["error"]


def test_round_trip(spark):
    once = bib.rendered(entries(spark)).orderBy("node_pos").collect()
    again = bib.rendered(entries(spark, "\n\n".join(r["bibtex"] for r in once))).orderBy("node_pos").collect()
    assert [r["bibtex"] for r in once] == [r["bibtex"] for r in again]
    assert "    author  = {" in once[0]["bibtex"] and not once[0]["bibtex"].rstrip("}\n").endswith(",")


def test_arxiv_relocation(spark):
    out = {r["key"]: r for r in bib.normalized(entries(spark)).select("key", bib.field("eprint").alias("eprint"), bib.field("journal").alias("journal"), bib.field("note").alias("note"), bib.field("author").alias("author")).collect()}
    assert (out["b"]["eprint"], out["b"]["journal"], out["b"]["author"]) == ("2004.14256", None, "Doe, J. and Roe, R.")
    assert (out["a"]["eprint"], out["a"]["note"]) == ("2509.03375", "Submitted; arXiv:2509.03375")


def test_keys_take_suffixes_by_title(spark):
    keys = {r["key"]: r["new_key"] for r in bib.keyed(entries(spark)).collect()}
    assert keys == {"b": "Doe2020a", "a": "Doe2020b"}


def test_findings(spark):
    found = bib.findings(entries(spark, "@article{k, title = {todo}, author = {Sonnet Software}, year = {in 2020}, doi = {bad}}\n@weird{w, title={x}}"))
    codes = {(r["key"], r["code"]) for r in found.collect()}
    assert {("k", "placeholder"), ("k", "bad-doi"), ("k", "bad-year"), ("k", "unbraced-organisation"), ("k", "missing-recommended"), ("w", "unknown-type")} <= codes
    assert ("k", "missing-field") not in codes and ("w", "missing-field") not in codes


def test_duplicates(spark):
    rows = bib.duplicate_findings(entries(spark, "@misc{a, doi={10.1/X}}\n@misc{a, doi={10.1/x}}\n@misc{c, doi={10.1/y}}")).collect()
    assert sorted((r["key"], r["code"]) for r in rows) == [("a", "duplicate-entry"), ("a", "duplicate-key")]


def test_non_ascii(spark):
    files = spark.createDataFrame([("f", "ok\né​é")], "file string, source string")
    assert sorted((r["line"], r["code"]) for r in bib.non_ascii_findings(files).collect()) == [(2, "non-ascii"), (2, "zero-width")]



def test_changes_are_told(spark):
    def entry(key, *fields):
        return ("f", 0, key, 1, [(n, v, "brace") for n, v in fields])

    rows = [entry("a", ("eprint", "arXiv:2001.00001v2")), entry("b", ("eprint", "https://x.org/a.pdf"), ("doi", "10.1/b")), entry("c", ("eprint", "https://x.org/a.pdf")), entry("d", ("eprint", "none")), entry("e", ("note", "see arXiv:2001.00002 there")), entry("g", ("pages", "1--2"), ("doi", "10.1234/x"))]
    e = spark.createDataFrame(rows, "file string, node_pos int, key string, line int, fields array<struct<name:string,text:string,delim:string>>")
    got = {(r.key, r.code, r.level, r.message.split(" ")[0]) for r in bib.changes(e).collect()}
    assert {("b", "bad-eprint", "info", "dropped"), ("c", "bad-eprint", "info", "moved"), ("d", "bad-eprint", "warning", "eprint"), ("e", "arxiv-relocated", "info", "copied"), ("a", "arxiv-eprint", "info", "added"), ("a", "arxiv-eprint", "info", "eprint")} == got


def test_every_member_of_a_large_group_has_a_key_of_its_own(spark):
    def spelled(i):
        out, i = "", i + 1
        while i:
            i, d = divmod(i - 1, 26)
            out = chr(97 + d) + out
        return out

    places = [*range(0, 60), *range(675, 730), 4_813, 18_277, 18_278, 475_253, 475_254, 2**31 - 1]
    got = spark.createDataFrame([(i,) for i in places], "i int").select("i", bib.letters(F.col("i"))).collect()
    assert [r[1] for r in got] == [spelled(r[0]) for r in got]
    field = lambda n, v: {"name": n, "text": v, "delim": "brace"}
    fields = [field("author", "Doe, J."), field("title", "Tides"), field("year", "2001")]
    many = spark.createDataFrame([("f", k, f"k{k}", fields) for k in range(6_000)], "file string, node_pos int, key string, fields array<struct<name:string,text:string,delim:string>>")
    assert bib.keyed(many).select("new_key").distinct().count() == 6_000
