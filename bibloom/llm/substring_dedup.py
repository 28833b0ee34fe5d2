"""Substring dedup by hashing lines and their sentences.

A text's units are its lines, cut further at sentence ends of any script so that a passage set into a longer line is
seen too. A unit is normalised (lower case, one space between words) and hashed; short units inside a line are not
looked up. A whole line is looked up from LINE_CHARS characters on, as one unit or, where it has short units, besides
them. Words are counted so that scripts without spaces and long tokens have their share. Digests are grouped over the
whole table, the earliest ranked occurrence (least doc_id, then place) stays. A run of neighbouring units that all have
an earlier occurrence goes if it has RUN_WORDS words, or fills whole lines; units too short to be looked up go with a
run they stand inside. Removed spans keep their character offsets in the original text.

Null text stays null and has no unit, and so do empty texts; an empty table gives no rows. Ties: rows of equal doc_id
count as one document, so that a repeated row keeps what its first one keeps; rows without doc_id lose only repeats
within their own text. Very long texts are read whole, one at a time. Other columns, whatever their names, are carried
along as they are where a whole table is asked for.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibloom.llm.common import bounded_batches, release, sliced, texts_of, written

#: Words of a unit that is looked up; words of a removed run that does not fill its lines.
UNIT_WORDS, RUN_WORDS = 4, 20
#: Characters of a shorter line that is looked up all the same; characters that count as a word at least.
LINE_CHARS, WORD_CHARS = 5, 16
#: Sentence ends: before white space, and those of scripts that write none after them.
_SPACED, _BARE = ".!?؟۔।॥።", "。！？｡．"
_UNIT = re.compile(rf"[^\n{_SPACED}{_BARE}]*(?:[{_SPACED}](?![\s{_SPACED}{_BARE}]|\Z)[^\n{_SPACED}{_BARE}]*)*(?:[{_SPACED}{_BARE}]+[\"'”’»)\]」』）】]*|(?=\n)|\Z)[^\S\n]*")
#: Scripts without spaces; every character counts as a word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def _words(tokens: list[str]) -> int:
    joined = "".join(tokens)
    unspaced = 0 if joined.isascii() else len(_UNSPACED.findall(joined))
    return max(len(tokens), unspaced, len(joined) // WORD_CHARS)


def _digest(tokens: list[str], kind: bytes = b"") -> bytes:
    return hashlib.blake2b(" ".join(tokens).encode("utf-8", "surrogatepass"), digest_size=16, person=kind).digest()


class Rule(NamedTuple):
    """What is looked up and what goes. Rule(1, 1, 1) looks up every unit and removes every repeat."""

    unit_words: int = UNIT_WORDS
    run_words: int = RUN_WORDS
    line_chars: int = LINE_CHARS


def units(text: str, rule: Rule = Rule()) -> list[tuple[int, int, int, int, bytes, bytes]]:
    """(start, end, line, words, digest, whole) of each unit.

    digest empty: too short to be looked up. whole: the digest of its line where the line has several units and one of
    them is too short, else empty.
    """
    out, base = [], 0
    for line, body in enumerate(text.split("\n")):
        at, own, tokens = 0, [], []
        while at < len(body):
            end = _UNIT.match(body, at).end()
            if end == at:
                end = at + 1
            words = body[at:end].lower().split()
            if words:
                own.append((base + at, base + end, _words(words), words))
                tokens += words
            at = end
        looked_up = len(" ".join(tokens)) >= rule.line_chars
        digests = [_digest(words) if n >= rule.unit_words or len(own) == 1 and looked_up else b"" for _, _, n, words in own]
        whole = _digest(tokens, b"line") if len(own) > 1 and looked_up and not all(digests) else b""
        out += [(a, b, line, n, d, whole) for (a, b, n, _), d in zip(own, digests)]
        base += len(body) + 1
    return out


def removed(text: str, later: set[bytes], rule: Rule = Rule()) -> list[tuple[int, int]]:
    """Spans of text to remove. later: digests whose earliest occurrence is in an earlier document."""
    own, seen = units(text, rule), set()
    again, line = [], -1
    for *_, at, _, digest, whole in own:
        if at != line:  # the line as a whole
            line, copied = at, bool(whole) and (whole in later or whole in seen)
            seen.add(whole)
        again.append(copied or bool(digest) and (digest in later or digest in seen))
        seen.add(digest)
    spans, k = [], 0
    while k < len(own):
        if not again[k]:
            k += 1
            continue
        last, j = k, k + 1
        while j < len(own) and (again[j] or not own[j][4]):
            last, j = (j if again[j] else last), j + 1
        words = sum(u[3] for u in own[k : last + 1])
        if words >= rule.run_words:
            spans.append((own[k][0], own[last][1]))
        else:  # whole lines inside the run
            for line in range(own[k][2], own[last][2] + 1):
                inside = [i for i in range(k, last + 1) if own[i][2] == line]
                if inside and (inside[0] == 0 or own[inside[0] - 1][2] != line) and (inside[-1] + 1 == len(own) or own[inside[-1] + 1][2] != line):
                    spans.append((own[inside[0]][0], own[inside[-1]][1]))
        k = last + 1
    return spans


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """What stays; lines that a removal has emptied go with it."""
    if not spans:
        return text
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at:a])
        at = b
        if at < len(text) and text[at] == "\n" and (not a or text[a - 1] == "\n"):
            at += 1
    parts.append(text[at:])
    return "".join(parts)


def _occurrences(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            ids, found = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))):
                own = {d for u in units(text, rule) for d in u[4:]} - {b""}
                ids += [doc] * len(own)
                found += own
            high, low = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(high), pa.array(low)], names=["doc_id", "high", "low"])

    return run


def _sets(later: pa.ListArray) -> Iterator[set[bytes]]:
    """The digests of each row of a list of (high, low)."""
    pairs = later.flatten()
    raw = np.stack([pairs.field(k).to_numpy().astype("<i8") for k in (0, 1)], 1).tobytes()
    at = 0
    for n in pc.fill_null(pc.list_value_length(later), 0).to_pylist():
        yield {raw[k : k + 16] for k in range(at, at + 16 * n, 16)}
        at += 16 * n


def _rewrite(keep: list[str], later: str, rule: Rule, with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            old = batch.column("text").to_pylist()
            spans = [removed(t or "", x, rule) for t, x in zip(old, _sets(batch.column(later)))]
            new = pa.array([None if t is None else without(t, s) for t, s in zip(old, spans)], pa.string())
            arrays = [new if c == "text" else batch.column(c) for c in keep]
            if with_spans:
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                arrays += [pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], kind), pa.array([len(s) for s in spans], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=keep + (["removed", "n_removed"] if with_spans else []))
        release()

    return run


def _with_later(docs: DataFrame, rule: Rule) -> tuple[DataFrame, str]:
    """docs and the digests of each document that an earlier one holds, in a column of the name returned.

    Copies of a unit are reduced to their least doc_id on the map side; what is later is found by a sort-merge join that
    Spark splits where a digest is common.
    """
    bounded_batches(docs.sparkSession)
    name, id_ = f"later_{uuid.uuid4().hex}", f"id_{uuid.uuid4().hex}"
    seen = written(docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(_occurrences(rule), "doc_id long, high long, low long"), "units")
    first = seen.groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("high", "low", "first")
    later = seen.join(first, ["high", "low"]).where("doc_id > first").groupBy("doc_id").agg(F.collect_set(F.struct("high", "low")).alias(name))
    later = written(later, "later").withColumnRenamed("doc_id", id_)
    return docs.join(later, docs["doc_id"] == later[id_], "left").drop(id_), name


def dedup(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, text, removed, n_removed) for each row of docs: text without its repeats, removed as spans [start, end) of the original."""
    found, later = _with_later(docs.select("doc_id", "text"), rule)
    return found.mapInArrow(_rewrite(["doc_id", "text"], later, rule, True), "doc_id long, text string, removed array<struct<start:long,end:long>>, n_removed long")


def cleaned(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """All rows and columns of docs, text without its repeats."""
    found, later = _with_later(docs, rule)
    return found.mapInArrow(_rewrite(docs.columns, later, rule, False), docs.schema)
