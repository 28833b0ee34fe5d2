"""Shared pieces of the training-data operators: tables in the shared folder, connected components,
vectorised word hashing and group-wise reading of sorted partitions."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Odd multipliers of the word and shingle hashes (fixed values).
MULTIPLIER = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Bytes hashed at once; bounds the memory of a worker whatever a text's length is.
BLOCK_BYTES = 1 << 20
#: Bytes of an Arrow batch that goes to a Python worker, about.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = tempfile.mkdtemp(prefix="bibloom-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return base


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession) -> None:
    """From now on Arrow batches to Python hold about BATCH_BYTES (one row at least), so that workers' memory is bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star steps (distributed union-find).

    Returns (id, component): one row for each id that has a link, component being the smallest id reachable. Every
    step aggregates map-side before it shuffles; each round is written to the shared folder. Ends when a round
    leaves the edges as they were; the rounds grow with the logarithm of the longest chain.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e, before = written(e, "edges"), None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or now[0] == 0:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")


def release() -> None:
    """Gives what a worker process has freed back to the system, at the end of a task: idle workers stay beside the heap."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(MIX_1)
    x = x ^ (x >> U64(27))
    x = x * U64(MIX_2)
    return x ^ (x >> U64(31))


_BYTE_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * U64(MULTIPLIER))
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        p = np.full(max(n, BLOCK_BYTES + 1), base, dtype=np.uint64)
        p[0] = 1
        _powers[key] = np.multiply.accumulate(p)
    return _powers[key][:n]


_INVERSE = pow(MULTIPLIER, -1, 1 << 64)


def _block_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of one block that begins and ends at word ends."""
    gap = _SEPARATOR[data]
    edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE_TABLE[data] * _power(MULTIPLIER, len(data)), dtype=np.uint64)))
    value = (total[end] - total[start]) * _power(_INVERSE, len(data) + 1)[start]
    return mix(value + (end - start).astype(np.uint64) * U64(MIX_1)), start


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of the texts, A-Z lower-cased, and each text's offset in them.

    A word's hash is a polynomial in its bytes modulo 2**64, taken from prefix sums, so that no Python loop runs over
    words. The texts are hashed in blocks cut between words.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    begins = np.cumsum([0] + [len(r) + 1 for r in raw])
    data = np.frombuffer(b"\n".join(raw).lower() + b"\n", dtype=np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(data):
        to = min(at + BLOCK_BYTES, len(data))
        if to < len(data):
            gaps = np.flatnonzero(_SEPARATOR[data[at:to]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            else:
                while to < len(data) and not _SEPARATOR[data[to]]:
                    to += 1
        h, s = _block_words(data[at:to])
        hashes.append(h)
        starts.append(s + at)
        at = to
    h, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, starts))
    return h.astype(np.uint64), np.searchsorted(s, begins)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings, null as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def ids_of(column: pa.Array) -> np.ndarray:
    """64-bit ids, null as -1."""
    return column.fill_null(-1).to_numpy().astype(np.int64)


def sliced(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that a slice holds about `most` bytes of text (one row at least)."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal key, one after another, from a partition that is sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and held[-1].column(key)[held[-1].num_rows - 1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        at = 0
        for c in cuts:
            held.append(batch.slice(at, c - at))
            yield pa.Table.from_batches(held)
            held, at = [], c
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


class Memory:
    """What `fill` gives for words, remembered for the words met last: two generations of about `most` words.

    A generation that is full becomes the old one; a word met again comes back from there.
    """

    def __init__(self, fill, most: int):
        self.fill, self.most, self.known, self.old = fill, most, {}, {}

    def of(self, lists: list[list[str]]) -> list[list[bytes]]:
        """The value of every word of the lists; what is new is filled in one call."""
        if len(self.known) > self.most:
            self.old, self.known = self.known, {}
        get, back, put = self.known.get, self.old.get, self.known.__setitem__
        out, new = [list(map(get, words)) for words in lists], {}
        late = [(words, found, [i for i, x in enumerate(found) if x is None]) for words, found in zip(lists, out) if None in found]
        for words, found, gaps in late:
            for i in gaps:
                w = words[i]
                x = found[i] = get(w) or back(w)
                if x is None:
                    new[w] = None
                else:
                    put(w, x)
        if new:
            self.known.update(zip(new, self.fill(list(new))))
            for words, found, gaps in late:
                for i in gaps:
                    if found[i] is None:
                        found[i] = get(words[i])
        return out


class Union:
    """Union-find over 0..n-1, the smaller root wins."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y
