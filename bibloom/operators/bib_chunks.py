"""One large BibTeX file parsed in parallel: where entries begin is told by a scan over small summaries of its chunks.

A file is a row of units, each an entry with the free text before it; the end of an entry ends the unit. Whether a closing
brace at some place ends an entry depends on all that comes before it, but only through a little state: outside an entry,
between its type and its opener, or inside at some depth. Every chunk is summed up apart as a map from the state it is
entered in to the state it is left in: one answer for each state outside, and for the states inside the net depth and one
answer for each level that the chunk closes. Folding these summaries in order, a few bytes a chunk, gives every
chunk its state, and with it the units that end in it. Units inside a chunk are parsed where they lie, those that cross
chunks are put together first. Places and section numbers are counted per chunk and added up over chunks.

Chunks are cut after line feeds, so neither an escape nor a letter is ever cut. A file is UTF-8, else cp1252, else UTF-8 with
replacements. Broken files raise with the line of the fault. The largest unit has to fit in a task.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bibloom.operators.bib import ZERO_WIDTH, BibError, parse
from bibloom.sources.schema import NODE
from bibloom.sources.shared import written

#: States at the edge of a chunk: mode and depth. In OUT a new entry is looked for, in HEAD its opener.
OUT, HEAD, BRACE, PAREN, BROKEN = "out", "head", "brace", "paren", "broken"
_MODE = {"{": BRACE, "(": PAREN}
_STEPS = {BRACE: (re.compile(r"\\.|[{}]", re.S), "{", "}"), PAREN: (re.compile(r"\\.|[()]", re.S), "(", ")")}
_TYPE = re.compile(r"@[A-Za-z]+")
_SPACE = re.compile(r"[ \t\r\n]*")
_DROP = dict.fromkeys(map(ord, ZERO_WIDTH))


def _opened(text: str, at: int) -> tuple[str, int]:
    """(mode, place) from a place where an opener is looked for."""
    at = _SPACE.match(text, at).end()
    if at == len(text):
        return HEAD, at
    return _MODE.get(text[at], BROKEN), at


def ends(text: str, mode: str, depth: int, at: int = 0) -> tuple[list[int], str, int]:
    """(places where units end, mode and depth at the end) of a chunk entered in a state at a place."""
    found: list[int] = []
    while at < len(text):
        if mode == BROKEN:
            break
        if mode == OUT:
            at = text.find("@", at)
            if at < 0:
                break
            kind = _TYPE.match(text, at)
            mode, at = _opened(text, kind.end()) if kind else (BROKEN, at)
            depth = 0
        elif mode == HEAD:
            mode, at = _opened(text, at)
            depth = 0
        else:
            steps, more, less = _STEPS[mode]
            for m in steps.finditer(text, at):
                depth += (m[0] == more) - (m[0] == less)
                if depth == 0:
                    at, mode = m.end(), OUT
                    found.append(at)
                    break
            else:
                return found, mode, depth
    return found, mode, depth


def summary(text: str) -> dict:
    """What a chunk does to each state: for states inside, the net depth and the outcomes of closing 1, 2, ... levels.

    An outcome is [mode, depth, where the last unit ended or -1].
    """

    def outcome(mode: str, depth: int, at: int = 0, closed: bool = False) -> list:
        found, mode, depth = ends(text, mode, depth, at)
        return [mode, depth, found[-1] if found else at if closed else -1]

    out: dict = {OUT: outcome(OUT, 0), HEAD: outcome(HEAD, 0)}
    seen: dict[int, list] = {}
    for mode, (steps, more, less) in _STEPS.items():
        depth, low, closing = 0, 0, []
        for m in steps.finditer(text):
            depth += (m[0] == more) - (m[0] == less)
            if depth < low:
                low = depth
                nearest = text.find("@", m.end())
                # from here the chunk is read as from its next entry on
                if nearest not in seen:
                    seen[nearest] = outcome(OUT, 0, nearest) if nearest >= 0 else [OUT, 0, -1]
                mode_after, depth_after, last = seen[nearest]
                closing.append([mode_after, depth_after, last if last >= 0 else m.end()])
        out[mode] = [depth, closing]
    return out


def step(told: dict, mode: str, depth: int) -> list:
    """The outcome [mode, depth, last unit end or -1] of a chunk summed up as `told`, entered in a state."""
    if mode == BROKEN:
        return [BROKEN, 0, -1]
    if mode in (OUT, HEAD):
        return told[mode]
    net, closing = told[mode]
    return closing[depth - 1] if depth <= len(closing) else [mode, depth + net, -1]


def chunks(spark: SparkSession, path: str, rows: int = 20_000) -> DataFrame:
    """(file, block, part, raw, other) of BibTeX files: runs of at most `rows` lines of each block that Spark reads.

    other: the file is not UTF-8 throughout.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("raw"), F.is_valid_utf8("value").alias("valid"))
    broken = lines.where("not valid").select("file").distinct().withColumn("other", F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        for (file, block), held in itertools.groupby(stream, key=lambda r: r[:2]):
            for part in itertools.count():
                raw = [r[2] for r in itertools.islice(held, rows)]
                if not raw:
                    break
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([b"\n".join(raw) + b"\n"], pa.binary())], names=["file", "block", "part", "raw"])

    cut = lines.select("file", "block", "raw").mapInArrow(run, "file string, block long, part int, raw binary")
    return cut.join(broken, "file", "left").select("file", "block", "part", "raw", F.coalesce("other", F.lit(False)).alias("other"))


def _text(raw: bytes, encoding: str) -> str:
    return raw.decode(encoding, "replace").replace("\r\n", "\n").replace("\r", "\n").translate(_DROP)


def _decoded(found: DataFrame) -> DataFrame:
    """(file, block, part, text): files that are not UTF-8 throughout are cp1252 if that is defined for all their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, part, raw, encoding in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([_text(raw, encoding)])], names=["file", "block", "part", "text"])

    # bytes that cp1252 leaves undefined (fixed values)
    odd = found.where("other").select("file", F.hex("raw").rlike("^(?:..)*(?:81|8D|8F|90|9D)").alias("odd")).groupBy("file").agg(F.bool_or("odd").alias("odd"))
    named = found.join(odd, "file", "left").withColumn("encoding", F.when(~F.col("other") | F.coalesce("odd", F.lit(False)), "utf-8").otherwise("cp1252"))
    return named.select("file", "block", "part", "raw", "encoding").mapInArrow(run, "file string, block long, part int, text string")


def _folded(told: DataFrame) -> DataFrame:
    """(file, block, part, chunk, mode, depth, unit_chunk, unit_at, first_line) of every chunk, from the summaries in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        for file, held in itertools.groupby(rows, key=lambda r: r[0]):
            mode, depth, unit, line = OUT, 0, (0, 0), 1
            for chunk, (_, block, part, breaks, spelled) in enumerate(held):
                yield pa.RecordBatch.from_pylist([dict(zip(_EDGE_NAMES, (file, block, part, chunk, mode, depth, *unit, line)))], schema=_EDGE_ARROW)
                mode, depth, last = step(json.loads(spelled), mode, depth)
                if last >= 0:
                    unit = (chunk, last)
                line += breaks

    return told.repartition("file").sortWithinPartitions("file", "block", "part").mapInArrow(run, _EDGE)


_EDGE = "file string, block long, part int, chunk int, mode string, depth int, unit_chunk int, unit_at int, first_line long"
_EDGE_NAMES = [c.split(" ")[0] for c in _EDGE.split(", ")]
_EDGE_ARROW = pa.schema([(c.split(" ")[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[c.split(" ")[1]]) for c in _EDGE.split(", ")])


def _summed(text: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            columns = [batch.column(c) for c in ("file", "block", "part")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([t.count("\n") for t in texts], pa.int64()), pa.array([json.dumps(summary(t)) for t in texts])], names=["file", "block", "part", "breaks", "told"])

    return text.mapInArrow(run, "file string, block long, part int, breaks long, told string")


_PIECE = "file string, unit_chunk int, unit_at int, piece int, line long, whole boolean, text string"
_PIECE_ARROW = pa.schema([("file", pa.string()), ("unit_chunk", pa.int32()), ("unit_at", pa.int32()), ("piece", pa.int32()), ("line", pa.int64()), ("whole", pa.bool_()), ("text", pa.string())])


def _pieces(entered: DataFrame) -> DataFrame:
    """Units, whole or as the pieces that their chunks hold; line is that of the unit's first character, where it is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                text, unit, at, line, inside, out = r["text"], (r["unit_chunk"], r["unit_at"]), 0, r["first_line"], r["chunk"] > 0, []
                for end in [*ends(text, r["mode"], r["depth"])[0], len(text)]:
                    last = end == len(text)
                    if at < end or not last:
                        # the unit that a chunk was entered in begins in an earlier one, unless it is the first
                        out.append((r["file"], *unit, r["chunk"], None if inside else line, not inside and not last, text[at:end]))
                    line += text.count("\n", at, end)
                    at, unit, inside = end, (r["chunk"], end), False
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _PIECE_ARROW)] if out else [pa.array([], t.type) for t in _PIECE_ARROW], schema=_PIECE_ARROW)

    return entered.mapInArrow(run, _PIECE)


def _nodes(units: DataFrame) -> DataFrame:
    """NODE rows with unit_chunk and unit_at; node_pos and section_id count inside the unit still."""
    names = [c.split(" ")[0] for c in re.sub(r"<.*>", "", NODE).split(", ")]
    kinds = {"node_pos": pa.int32(), "line": pa.int32(), "section_id": pa.int32(), "is_banner": pa.bool_(), "fields": pa.list_(pa.struct([(n, pa.string()) for n in ("name", "text", "delim")]))}
    schema = pa.schema([("unit_chunk", pa.int32()), ("unit_at", pa.int32()), *((n, kinds.get(n, pa.string())) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    found = parse(r["text"])
                except BibError as e:
                    shifted = re.sub(r"on line (\d+)$", lambda m, first=r["line"]: f"on line {first + int(m[1]) - 1}", str(e))
                    raise BibError(f"{r['file']}: {shifted}") from None
                for k, node in enumerate(found):
                    node = dict.fromkeys(names) | node | {"file": r["file"], "node_pos": k, "line": r["line"] + node["line"] - 1}
                    node["fields"] = [dict(zip(("name", "text", "delim"), f)) for f in node["fields"] or ()]
                    rows.append(node | {"unit_chunk": r["unit_chunk"], "unit_at": r["unit_at"]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return units.select("file", "unit_chunk", "unit_at", "line", "text").mapInArrow(run, f"unit_chunk int, unit_at int, {NODE}")


def parse_chunks(found: DataFrame) -> DataFrame:
    """NODE rows of the files that `chunks` cut up: what `bib.parse_files` gives for each whole file."""
    text = written(_decoded(found), "chunks")
    edges = written(_folded(_summed(text)), "edges")
    pieces = written(_pieces(text.join(edges, ["file", "block", "part"])), "pieces")
    put = pieces.where("not whole").groupBy("file", "unit_chunk", "unit_at").agg(F.max("line").alias("line"), F.sort_array(F.collect_list(F.struct("piece", "text"))).alias("p"))
    crossing = put.select("file", "unit_chunk", "unit_at", "line", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    units = pieces.where("whole").select("file", "unit_chunk", "unit_at", "line", "text").unionByName(crossing)
    nodes = written(_nodes(units), "nodes")
    # places and sections: counted in a chunk, then added up over the chunks before it
    per = nodes.groupBy("file", "unit_chunk").agg(F.count("*").alias("n"), F.count_if("is_banner").alias("b"))
    before = Window.partitionBy("file").orderBy("unit_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("file", "unit_chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"))
    inside = Window.partitionBy("file", "unit_chunk").orderBy("unit_at", "node_pos")
    own = nodes.withColumn("_k", F.row_number().over(inside) - 1).withColumn("_b", F.count_if("is_banner").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    out = own.join(base, ["file", "unit_chunk"]).withColumn("node_pos", (F.col("n0") + F.col("_k")).cast("int")).withColumn("section_id", (F.col("b0") + F.col("_b")).cast("int"))
    return out.select(*[c.split(" ")[0] for c in re.sub(r"<.*>", "", NODE).split(", ")])


def read_large(spark: SparkSession, path: str) -> DataFrame:
    """NODE rows of BibTeX files of any size."""
    return parse_chunks(chunks(spark, path))
