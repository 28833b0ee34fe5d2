"""Exact dedup against history, by a minimal perfect hash over the history's distinct digests.

The history's distinct digests are dealt into buckets by their first bytes. Each bucket gets a minimal perfect hash
(levels of bit arrays, as in BBHash: Limasset et al. 2017) whose slots hold the full digest, the winner's doc_id and
the number of rows. A batch of new rows is aggregated by digest, looked up in its bucket, and a hit counts only if the
slot's 32 bytes agree. Nonmembers form groups of their own.

Null text counts as empty, empty texts are equal to each other. Texts are equal when identical after lower-casing A-Z.
Very long texts are hashed whole, a row at a time. Repeated rows and rows of one doc_id count each; of rows with the winning
doc_id all are kept. Rows without doc_id never win over one that has an id; where no row of a text has one, keep_id is null
and all are kept, so that the text is not lost. Empty history or batch: the other side alone decides; an empty table gives no
rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibloom.llm.common import U64, mix, texts_of, written

#: Digests in a bucket, about; buckets are counted from history and batch, so a task's memory is bounded.
BUCKET = 20_000
#: Stands for a missing doc_id where digests meet the index.
NO_ID = -(1 << 63)
GAMMA, LEVELS = 2.0, 40


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 of the whole text, A-Z lower-cased, in UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashlib.sha256(t.encode("utf-8", "surrogatepass").lower()).digest() for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "digest"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary")


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys ^ mix(np.array([level + 1], np.uint64) * U64(0xA0761D6478BD642F))[0]) % U64(size)).astype(np.int64)


def build_levels(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The levels of a minimal perfect hash over distinct 64-bit keys, and each key's slot in 0..n-1."""
    levels, slot, left, base = [], np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    while len(left):
        if len(levels) == LEVELS:
            raise ValueError("two digests share 64 bits; keys must be distinct")
        size = max(8, int(GAMMA * len(left)))
        at = _place(keys[left], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        rank = np.cumsum(alone) - 1
        fits = alone[at]
        slot[left[fits]] = base + rank[at[fits]]
        base += int(alone.sum())
        levels.append(alone)
        left = left[~fits]
    return levels, slot


def find_slots(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The slot that each key would have; -1 where no level takes it. A nonmember may get a member's slot."""
    slot, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, bits in enumerate(levels):
        if not len(left):
            break
        at = _place(keys[left], level, len(bits))
        hit = bits[at]
        slot[left[hit]] = base + (np.cumsum(bits) - 1)[at[hit]]
        base += int(bits.sum())
        left = left[~hit]
    return slot


_INDEX = "bucket long, keys long, level_sizes array<long>, levels binary, slots binary, winners binary, counts binary"


def _word(raw: np.ndarray, at: int) -> np.ndarray:
    return np.ascontiguousarray(raw[:, at : at + 8]).view(np.uint64).ravel()


def _rows(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), 32)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    raw = _rows(pdf["digest"])
    levels, slot = build_levels(_word(raw, 8))
    order = np.argsort(slot)
    return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "keys": [len(pdf)], "level_sizes": [[len(b) for b in levels]], "levels": [b"".join(np.packbits(b).tobytes() for b in levels)], "slots": [raw[order].tobytes()], "winners": [pdf["winner"].to_numpy(np.int64)[order].tobytes()], "counts": [pdf["n"].to_numpy(np.int64)[order].tobytes()]})


def _lookup(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """All digests of a bucket after the batch: (digest, winner, n, member); members of either side."""
    parts = []
    if len(index):
        row = index.iloc[0]
        slots = np.frombuffer(row["slots"], np.uint8).reshape(-1, 32)
        winner, n = (np.frombuffer(row[c], np.int64).copy() for c in ("winners", "counts"))
        if len(new):
            bits, levels, at = np.frombuffer(row["levels"], np.uint8), [], 0
            for size in row["level_sizes"]:
                width = (size + 7) // 8
                levels.append(np.unpackbits(bits[at : at + width])[:size].astype(bool))
                at += width
            raw = _rows(new["digest"])
            slot = find_slots(levels, _word(raw, 8))
            member = slot >= 0
            member[member] = (slots[slot[member]] == raw[member]).all(axis=1)
            np.maximum.at(winner, slot[member], new["winner"].to_numpy(np.int64)[member])
            np.add.at(n, slot[member], new["n"].to_numpy(np.int64)[member])
            new = new[~member]
        parts.append(pd.DataFrame({"digest": [s.tobytes() for s in slots], "winner": winner, "n": n, "member": True}))
    if len(new):
        parts.append(new[["digest", "winner", "n"]].assign(member=False))
    return pd.concat(parts)


def grouped(digest: DataFrame) -> DataFrame:
    """(digest, winner, n), aggregated map-side first."""
    return digest.groupBy("digest").agg(F.coalesce(F.max("doc_id"), F.lit(NO_ID)).alias("winner"), F.count("*").alias("n"))


def with_bucket(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), F.lit(buckets)))


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """One row a bucket: the perfect hash and its slots. history: (digest, winner, n), distinct digests."""
    return with_bucket(history, buckets).groupBy("bucket").applyInPandas(_build, _INDEX)


def lookup(batch: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """(digest, winner, n, member) after the batch (digest, winner, n) met the index."""
    new = with_bucket(batch, buckets)
    return new.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(_lookup, "digest binary, winner long, n long, member boolean")


def dedup(docs: DataFrame, split: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): of equal texts the row with the largest doc_id stays.

    Rows with doc_id up to `split` (None: halfway between the least and the greatest) are the history, the rest is the
    batch. The result is the same for every split.
    """
    rows = written(digests(docs), "digests")
    if split is None:
        low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
        split = ((low or 0) + (high or 0)) // 2
    past = F.coalesce(F.col("doc_id") <= split, F.lit(True))
    history, batch = written(grouped(rows.where(past)), "history"), written(grouped(rows.where(~past)), "batch")
    buckets = max(1, -(-(history.count() + batch.count()) // BUCKET))
    index = written(build_index(history, buckets), "index")
    classes = written(lookup(batch, index, buckets), "classes")
    out = rows.join(classes, "digest")
    kept = F.coalesce("doc_id", F.lit(NO_ID)) == F.col("winner")
    return out.select("doc_id", F.when(F.col("winner") != NO_ID, F.col("winner")).alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
