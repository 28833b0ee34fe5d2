"""Packing along a space-filling curve.

Every document gets a hashed vector (signed counts of its byte trigrams, projected to three dimensions and scaled by
its length), the place of that vector on a Hilbert curve, and its token ids. Documents are dealt into ranges of
(curve place, doc_id), sorted, and laid end to end into sequences of a fixed number of tokens, so neighbours on the
curve share sequences. What a range leaves over becomes sequences whose lengths are powers of two, which need no padding.

Null and empty texts have their end marker as only token. Ties on the curve (copies) are dealt by a hash of doc_id.
Texts of any length are cut wherever a sequence ends. A null doc_id counts, and is returned, as
-1; rows of one doc_id are packed each on its own. An empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibloom.llm.common import U64, Memory, bounded_batches, ids_of, mix, partitions, release, sliced, texts_of, written

#: Bits of each of the three curve coordinates; the key has three times as many, and 33 bits more from doc_id.
BITS = 10
FEATURES = 1 << 12
#: End of the letters that every version of Unicode knows as such.
LATIN_END = "\u0250"
_PROJECTION = (mix(np.arange(1, FEATURES + 1, dtype=np.uint64)[None, :] * (U64(2) * np.arange(1, 4, dtype=np.uint64)[:, None] + U64(1)) * U64(0x9E3779B97F4A7C15)) >> U64(40)).astype(np.float64) / (1 << 23) - 1


def vectors(texts: list[str]) -> np.ndarray:
    """(n, 3) projections of the hashed trigram counts, divided by the root of their number."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw).lower() + b"\0\0", dtype=np.uint8).astype(np.uint16)
    slot = (data[:-2] * np.uint16(0x9E35) ^ data[1:-1] * np.uint16(0x58D1) ^ data[2:] * np.uint16(0x2C1B)) >> np.uint16(4)
    out, at = np.zeros((len(raw), 3)), 0
    for i, n in enumerate(size.tolist()):  # a text's counts, then one product
        if n:
            out[i] = _PROJECTION @ np.bincount(slot[at : at + n], minlength=FEATURES) / np.sqrt(n)
        at += n
    return out


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of integer cells (n, d) on a d-dimensional Hilbert curve of 2**bits cells a side (Skilling 2004)."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(d):
            inside = (x[i] & q) != 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(inside, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(texts: list[str], doc_ids: np.ndarray) -> np.ndarray:
    """63-bit sort keys: the curve place, then bits of a hash of doc_id that spread ties."""
    v = np.tanh(vectors(texts) / 2)
    cells = np.clip(((v + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return (hilbert(cells) << 33) | (mix(doc_ids.astype(np.int64).view(np.uint64)) >> U64(31)).astype(np.int64)


class Words:
    """Token ids of texts as the tokenizers library gives them, through a bounded memory of encoded words.

    A byte-level pre-tokenizer never joins what a single space or line feed parts, so a text of single gaps is encoded
    word by word, each with the gap before it; a slice's new words go to the library in one batch. Texts with other gaps
    or special strings go to the library whole, and so does every text if the tokenizer file has another normaliser or
    pre-tokenizer.
    """

    #: Words of a generation of the memory; two workers an executor hold theirs beside the heap.
    MOST = 150_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        own = self.tokenizer = Tokenizer.from_file(path)
        special = "|".join(re.escape(t.content) for t in own.get_added_tokens_decoder().values())
        self.special = re.compile(special).search if special else lambda _: None
        known = json.loads(own.to_str())
        self.by_word = known["normalizer"] is None and known["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if own.get_vocab_size() > 1 << 16:
            raise ValueError("ids are held in 16 bits")
        if self.by_word:
            spell = lambda t: own.pre_tokenizer.pre_tokenize_str(t)[0][0]
            self.space = spell(" a")[:-1]
            self.spelling = {c: spell(chr(c)) for c in range(0x80, ord(LATIN_END)) if chr(c).isalpha()}
            self.model = Tokenizer(own.model)  # the same model, without normaliser and pre-tokenizer
        self.memory = Memory(self._fill, self.MOST)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("H", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fill(self, keys: list[str]) -> list[bytes]:
        """Keys: a text's first word after a carriage return, a line's first word after its line feed, others bare.

        The pre-tokenizer leaves a space and letters together, so such words go to the model as it would spell them.
        """
        plain = [k.isalpha() and (k.isascii() or max(k) < LATIN_END) for k in keys]
        letters = iter(self.model.encode_batch_fast([self.space + k.translate(self.spelling) for k, p in zip(keys, plain) if p], add_special_tokens=False))
        others = iter(self._library([k[1:] if k[0] == "\r" else k if k[0] == "\n" else " " + k for k, p in zip(keys, plain) if not p]))
        return [array("H", next(letters).ids).tobytes() if p else next(others) for p in plain]

    def _split(self, text: str) -> list[str] | None:
        """The keys of a text; None where it has to go to the library whole."""
        keys, before = [], "\r"
        for line in text.split("\n"):
            words = line.split()
            if not words or " ".join(words) != line:
                return None
            words[0] = before + words[0]
            keys += words
            before = "\n"
        return None if self.special(text) else keys

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 16-bit ids of each text."""
        keys = [self._split(t) if self.by_word else None for t in texts]
        known = iter(self.memory.of([k for k in keys if k is not None]))
        whole = iter(self._library([t for t, k in zip(texts, keys) if k is None]))
        return [next(whole) if k is None else b"".join(next(known)) for k in keys]


_words: dict[str, Words] = {}


def words_of(path: str, memory: int = Words.MOST) -> Words:
    """One encoder a worker process."""
    if path not in _words:
        _words[path] = Words(path)
    _words[path].memory.most = memory
    return _words[path]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text", 1 << 20):
        ids = batch.column("doc_id")
        yield pa.RecordBatch.from_arrays([pa.array(curve_keys(texts_of(batch.column("text")), ids_of(ids)))], names=["key"])


def _encoded(path: str, bounds: np.ndarray, end: int, memory: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, stop = words_of(path, memory).encode, np.array([end], "<u2").tobytes()
        for batch in sliced(batches, "text", 1 << 20):
            texts, ids = texts_of(batch.column("text")), batch.column("doc_id")
            key = curve_keys(texts, ids_of(ids))
            part = np.searchsorted(bounds, key, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids, pa.array(part), pa.array(key), pa.array([e + stop for e in encode(texts)], pa.binary())], names=["doc_id", "part", "key", "ids"])
        release()

    return run


_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _pack(length: int):
    """Lays the documents of each part end to end; each part's rest becomes sequences of powers of two."""

    def rows(part: int, docs: list[tuple[int, np.ndarray, int, int]], total: int, first: int, tail: bool):
        """Cuts the laid tokens [0, total) at sequence ends. docs: (doc_id, ids, begin here, tokens before it)."""
        sizes = [length] * (total // length)
        if tail:
            rest = total % length
            sizes += [1 << b for b in range(length.bit_length(), -1, -1) if rest >> b & 1]
        ends = np.cumsum(sizes)
        out: tuple[list, ...] = ([], [], [], [], [], [], [])
        at, k = 0, 0
        for doc, ids, done, whole in docs:
            here = 0
            while here < len(ids) and k < len(ends):
                begin = int(ends[k - 1]) if k else 0
                take = min(len(ids) - here, int(ends[k]) - at)
                for column, v in zip(out, (doc, done + here, take, ids[here : here + take].astype("<u4").tobytes(), whole, (part << 40) + first + k, at - begin)):
                    column.append(v)
                here, at = here + take, at + take
                if at == ends[k]:
                    k += 1
        arrays = [pa.array(c, pa.binary() if i == 3 else pa.int64()) for i, c in enumerate(out)]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]), len(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, total, first = None, [], 0, 0
        for batch in batches:
            for doc, p, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "ids"))):
                if part is not None and p != part:
                    yield rows(part, held, total, first, True)[0]
                    held, total, first = [], 0, 0
                part, ids = p, np.frombuffer(raw, "<u2")
                held.append((doc, ids, 0, len(ids)))
                total += len(ids)
                if total >= length << 9:
                    made, n = rows(part, held, total, first, False)
                    yield made
                    keep, back, rest = total % length, [], total % length
                    while rest > 0:
                        doc_, ids_, done_, whole_ = held.pop()
                        take = min(rest, len(ids_))
                        back.append((doc_, ids_[len(ids_) - take :], done_ + len(ids_) - take, whole_))
                        rest -= take
                    held, total, first = back[::-1], keep, first + n
        if held:
            yield rows(part, held, total, first, True)[0]
        held = []
        release()

    return run


def pack(docs: DataFrame, tokenizer: str, end: int = 0, length: int = 1024, memory: int = Words.MOST) -> DataFrame:
    """Pieces of all documents in sequences of at most `length` (a power of two) tokens, neighbours on the curve together.

    Columns: doc_id, start (the document's ids before the piece), length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset (in the sequence). The ranges of the curve come from approximate quantiles of all
    keys; they only deal the work, every document is packed. memory: words that a worker remembers of a generation.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select("doc_id", "text")
    n = partitions(spark)
    keys = written(source.mapInArrow(_keys, "key long"), "keys")
    bounds = keys.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 20 * n).alias("b")).first()["b"] if n > 1 else []
    bounds = np.unique(np.array(bounds or [], np.int64))
    ids = source.mapInArrow(_encoded(tokenizer, bounds, end, memory), "doc_id long, part int, key long, ids binary")
    return ids.repartition(n, "part").sortWithinPartitions("part", "key", "doc_id").drop("key").mapInArrow(_pack(length), _SCHEMA)
