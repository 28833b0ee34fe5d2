"""A file cut into many chunks gives the nodes of the whole parse."""

import random

import pytest

from bibloom.operators import bib, bib_chunks
from bibloom.operators.bib_chunks import BRACE, BROKEN, HEAD, OUT, PAREN
from bibloom.plans import queries

PIECES = [
    "@article{key%d,\n  author = {Quill, {\\'A}da and {The Ferry\n  Group}},\n  title = \"Tides {@} of \\\"night\\\" (part\",\n  year = 1999\n}\n",
    "@Book(round%d,\n title = {Par(en)s \\} and \\{ more},\n note = {J} # { x } # \"y,z\"\n)\n",
    "% a note on what follows, with an @\n",
    "%%%%%%%%%%%%%%%%%%%%%%%%%\n%% Section %d\n%%%%%%%%%%%%%%%%%%%%%%%%%\n",
    "@comment{ anything { nested } @article{no, } }\n",
    "@string\n\n {jan = \"January\"}\n",
    "@misc\n{split%d,\n title = {a\n\n\nb}, deep = {{{{\n}}}}\n}",
    "free text without a mark\n\nsecond block\n\n",
    "@software{bare%d, url = {https://x/y_z}, year = 2020,}\n\n",
    "\n",
    "Üñï ﻿zero​width\r\nlines\rhere\n",
]


def source(seed, n):
    rng = random.Random(seed)
    out = ""
    for k in range(n):
        piece = rng.choice(PIECES)
        out += piece % k if "%d" in piece and "%%" not in piece else piece.replace("%d", str(k))
    return out.replace("with an @\n", "without a mark\n")


@pytest.mark.parametrize("seed", range(40))
def test_folded_summaries_find_the_units_of_the_whole(seed):
    text = source(seed, 30).replace("\r\n", "\n").replace("\r", "\n")
    rng = random.Random(seed)
    lines = text.splitlines(keepends=True)
    cuts = sorted(rng.sample(range(1, len(lines)), min(len(lines) - 1, rng.choice([1, 5, 40]))))
    parts = ["".join(lines[a:b]) for a, b in zip([0, *cuts], [*cuts, len(lines)])]
    whole = bib_chunks.ends(text, OUT, 0)[0]
    mode, depth, base, found = OUT, 0, 0, []
    for part in parts:
        here, after, deep = bib_chunks.ends(part, mode, depth)
        found += [base + at for at in here]
        told = bib_chunks.step(bib_chunks.summary(part), mode, depth)
        assert told == [after, deep if after in (BRACE, PAREN) else told[1], here[-1] if here else -1]
        mode, depth, base = told[0], told[1], base + len(part)
    assert found == whole


def test_states_at_the_edges():
    assert bib_chunks.ends("@article\n", OUT, 0)[1] == HEAD
    assert bib_chunks.ends("\n \n", HEAD, 0)[1] == HEAD
    assert bib_chunks.ends("@ x\n", OUT, 0)[1] == BROKEN and bib_chunks.ends("x\n", HEAD, 0)[1] == BROKEN
    told = bib_chunks.summary("}} @a{b, (\n")
    assert bib_chunks.step(told, BRACE, 2) == [BRACE, 1, 2] and bib_chunks.step(told, BRACE, 3) == [BRACE, 2, -1] and bib_chunks.step(told, PAREN, 1) == [PAREN, 2, -1]


def nodes(df):
    return sorted((r.file.rsplit("/", 1)[-1], r.node_pos, r.kind, r.type, r.type_raw, r.key, r.line, r.text, [tuple(f) for f in r.fields or []], r.lead_comment, bool(r.is_banner), r.section_id) for r in df.collect())


@pytest.mark.parametrize(("rows", "block"), [(3, "200"), (20_000, "64k"), (1, "1m")])
def test_chunks_equal_whole_files(spark, tmp_path, rows, block):
    texts = {f"f{k}.bib": source(k + 100, 60) for k in range(3)} | {"empty.bib": "", "notes.bib": "only notes\n\n% two\n", "one.bib": "@misc{x, title = {y}}"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8", newline="")
    (tmp_path / "old.bib").write_bytes("@misc{m, title = {Fähre}}\n% naïve\n".encode("cp1252"))
    (tmp_path / "odd.bib").write_bytes(b"@misc{m, title = {F\xe4hre \x81}}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        got = nodes(bib_chunks.parse_chunks(bib_chunks.chunks(spark, str(tmp_path), rows)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    all_texts = texts | {"old.bib": "@misc{m, title = {Fähre}}\n% naïve\n", "odd.bib": "@misc{m, title = {F�hre �}}\n"}
    want = nodes(bib.parse_files(spark.createDataFrame(list(all_texts.items()), "file string, source string")))
    assert got == want


def test_faults_name_their_line(spark, tmp_path):
    (tmp_path / "f.bib").write_text("@misc{a, title = {b}}\n\n@misc{c,\n title {d}}\n")
    with pytest.raises(Exception, match="expected = after field 'title' in the entry on line 3"):
        bib_chunks.parse_chunks(bib_chunks.chunks(spark, str(tmp_path), 1)).collect()


def test_query_cuts_its_files(spark):
    found = queries.QUERIES["bib_chunks_parsed"](spark, "/root/testdata/sf0.001")
    assert found.count() == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
