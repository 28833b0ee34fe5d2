"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is read here field by field; from it the normaliser, the space marker, the vocabulary with its scores
(unigram) or the merges that the scores imply (BPE) and the byte fallback are rebuilt as a tokenizers pipeline. Batches
are encoded and decoded by the library's threads. Words (each with the gap before it) are remembered where no piece
crosses from a word into the next gap, and so is what the rebuilt decoder gives for each piece. The ids are always those of the rebuilt pipeline; each word is compared with the sentencepiece library when first met, so parity is
checked for every text, and a text with a word on which the two differ is marked by parity false.

Null text counts as empty and has no ids. Texts of any length are encoded whole. Repeated rows get equal results, and
so do ties; null ids stay null. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import os
import struct
from array import array
from collections.abc import Iterator
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bibloom.llm.common import Memory, bounded_batches, sliced, texts_of

MARK = "▁"
#: Threads of the library in one worker process; unset, it would take every core in each of them.
THREADS = 2
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value, shift, at = value | (b & 127) << shift, shift + 7, at + 1
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = {5: 4, 1: 8}[kind]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def parse_model(data: bytes) -> dict:
    """Pieces (text, score, type), model type and normaliser settings of a model file."""
    pieces, trainer, normalizer = [], {}, {}
    for number, value in fields(data):
        if number == 1:
            own = dict(fields(value))
            pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
        elif number == 3:
            normalizer = dict(fields(value))
    return {
        "pieces": pieces,
        "type": trainer.get(3, UNIGRAM),
        "byte_fallback": bool(trainer.get(35, 0)),
        "normalizer": normalizer.get(1, b"").decode(),
        "charsmap": normalizer.get(2, b""),
        "add_dummy_prefix": bool(normalizer.get(3, 1)),
        "remove_extra_whitespaces": bool(normalizer.get(4, 1)),
        "escape_whitespaces": bool(normalizer.get(5, 1)),
    }


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """The merges that a BPE model's scores imply: each piece from two pieces, best score first."""
    place = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
    found = []
    for p, i in place.items():
        for k in range(1, len(p)):
            if p[:k] in place and p[k:] in place:
                found.append((-pieces[i][1], i, place[p[:k]], place[p[k:]]))
    return [(pieces[a][0], pieces[b][0]) for _, _, a, b in sorted(found)]


def build(spec: dict):
    """The tokenizers pipeline of a parsed model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    pieces = spec["pieces"]
    unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), None)
    if spec["type"] == UNIGRAM:
        own = Tokenizer(models.Unigram([(p, s) for p, s, _ in pieces], unk_id=unknown, byte_fallback=spec["byte_fallback"]))
    elif spec["type"] == BPE:
        own = Tokenizer(models.BPE({p: i for i, (p, _, _) in enumerate(pieces)}, merges(pieces), unk_token=pieces[unknown][0] if unknown is not None else None, fuse_unk=True, byte_fallback=spec["byte_fallback"]))
    else:
        raise ValueError("only unigram and BPE models are known")
    steps = [normalizers.Precompiled(spec["charsmap"])] if spec["charsmap"] else []
    if spec["remove_extra_whitespaces"]:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec["add_dummy_prefix"]:
        steps.append(normalizers.Prepend(MARK if spec["escape_whitespaces"] else " "))
    if spec["escape_whitespaces"]:
        steps.append(normalizers.Replace(" ", MARK))
    own.normalizer = normalizers.Sequence(steps)
    own.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()] + ([decoders.Strip(" ", 1, 0)] if spec["add_dummy_prefix"] else []))
    return own


class Backend:
    """Encoder and decoder of one model, with a bounded memory of words."""

    MOST = 400_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        self.path, self.spec = path, parse_model(Path(path).read_bytes())
        spec = self.spec
        inner = any(MARK in p.lstrip(MARK) for p, _, _ in spec["pieces"])
        self.by_word = spec["normalizer"] == "identity" and spec["add_dummy_prefix"] and spec["escape_whitespaces"] and not spec["remove_extra_whitespaces"] and not inner and not any(k == USER for *_, k in spec["pieces"])
        self.words = Memory(self._fresh, self.MOST)
        self.differ: set[str] = set()  # words on which the two libraries differ

    @cached_property
    def own(self):
        return build(self.spec)

    @cached_property
    def other(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=self.path)

    def _fresh(self, texts: list[str]) -> list[bytes]:
        """The ids of the rebuilt pipeline; texts on which sentencepiece gives others are noted."""
        mine = [e.ids for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]
        self.differ.update(t for t, a, b in zip(texts, mine, self.other.encode(texts, num_threads=THREADS)) if a != b)
        return [array("I", a).tobytes() for a in mine]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """(ids, whether sentencepiece gives the same) of each text."""
        if len(self.differ) > self.MOST:  # what is noted must be met again with its words
            self.differ, self.words = set(), Memory(self._fresh, self.MOST)
        split = [t.split(" ") if self.by_word and t and t[0] != " " and t[-1] != " " and "  " not in t and MARK not in t and "\0" not in t else None for t in texts]
        found = iter(self.words.of([w for w in split if w is not None]))
        rest = [t for t, w in zip(texts, split) if w is None and t]
        whole = dict(zip(rest, self._fresh(rest))) if rest else {}
        ids = [(whole[t] if t else b"") if w is None else b"".join(next(found)) for t, w in zip(texts, split)]
        same = [not self.differ or (t not in self.differ if w is None else self.differ.isdisjoint(w)) for t, w in zip(texts, split)]
        return list(zip(ids, same))

    @cached_property
    def spelled(self) -> list[str | None]:
        """What the rebuilt decoder gives for each piece after another one; null for pieces that take part in a character."""
        pieces = self.spec["pieces"]
        anchor = next(i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL and len(p) == 1 and p != MARK)
        texts = self.own.decode_batch([[anchor, i] for i in range(len(pieces))], skip_special_tokens=False)
        return [None if kind == BYTE and int(p[3:5], 16) > 127 else t[1:] for t, (p, _, kind) in zip(texts, pieces)]

    @cached_property
    def partial(self) -> np.ndarray:
        return np.array([t is None for t in self.spelled])

    def decode(self, ids: list[bytes]) -> list[str]:
        """The texts of ids, joined from the decoder's texts of pieces; ids with parts of characters go to it whole."""
        if not self.spec["add_dummy_prefix"]:
            return self.own.decode_batch([np.frombuffer(i, "<u4").tolist() for i in ids], skip_special_tokens=False)
        out, late = [], []
        for k, raw in enumerate(ids):
            numbers = np.frombuffer(raw, "<u4")
            if self.partial[numbers].any():
                late.append((k, numbers.tolist()))
                out.append("")
            else:
                out.append("".join(map(self.spelled.__getitem__, numbers.tolist())).removeprefix(" "))
        for (k, _), text in zip(late, self.own.decode_batch([n for _, n in late], skip_special_tokens=False) if late else []):
            out[k] = text
        return out


_backends: dict[str, Backend] = {}


def backend(path: str) -> Backend:
    """One backend a worker process."""
    if path not in _backends:
        _backends[path] = Backend(path)
    return _backends[path]


_ENCODED = "doc_id long, ids binary, parity boolean"


def _encoded(own: Backend, batch: pa.RecordBatch) -> list[pa.Array]:
    found = own.encode(texts_of(batch.column("text")))
    return [batch.column("doc_id"), pa.array([i for i, _ in found], pa.binary()), pa.array([p for _, p in found], pa.bool_())]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, parity): ids as little-endian unsigned 32-bit; parity: the sentencepiece library gave the same."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = backend(model)
        for batch in sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays(_encoded(own, batch), names=["doc_id", "ids", "parity"])

    return docs.select("doc_id", "text").mapInArrow(run, _ENCODED)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded (doc_id, ids, parity) with the column text, decoded from ids."""
    bounded_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = backend(model)
        for batch in sliced(batches, "ids"):
            texts = own.decode(batch.column("ids").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return encoded.select("doc_id", "ids", "parity").mapInArrow(run, f"{_ENCODED}, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, parity, text) as decode(encode(docs)) gives them, by one worker process a task."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = backend(model)
        for batch in sliced(batches, "text"):
            columns = _encoded(own, batch)
            texts = own.decode(columns[1].to_pylist())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "parity", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"{_ENCODED}, text string")
