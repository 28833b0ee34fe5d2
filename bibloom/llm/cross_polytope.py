"""Embedding near-dedup by cross-polytope hashing.

Vectors of equal label and equal components collapse into one class. A class is rotated by three rounds of random signs
and fast Hadamard transforms; the largest coordinate with its sign is a cross-polytope hash (Andoni et al. 2015). Each
of TABLES tables joins two such hashes, and a class also enters the buckets in which either hash takes its second
largest coordinate. Buckets are compared by matrix products in double precision; a bucket over BLOCK classes is dealt
into blocks, and every pair of blocks is a task. A pair is counted in the first bucket that holds both, so link counts
need no list of pairs; a task returns sums and spanning links only.

Null labels, null or zero vectors and vectors with null or non-finite components link with nothing. Vectors of other
lengths link with their own length only. Repeated rows link with each other. Ties: the smallest vec_id leads. Rows without
vec_id count as links of equal vectors and follow those with an id; a vector that no row names is no one's link but its
copies', has no component and stays. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibloom.llm.common import Union, components, groups, partitions, written

TABLES, PROBES, BLOCK = 12, 3, 768


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows of a power of two of columns."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2)
        h *= 2
        x = x.reshape(n, d)
    return x


def codes(x: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """(n, tables, PROBES) bucket codes of unit rows."""
    n, d = x.shape
    wide = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, wide))
    padded[:, :d] = x
    out = np.zeros((n, tables, PROBES), np.int64)
    for t in range(tables):
        found = []
        for k in range(2):
            rng, y = np.random.default_rng(1000 * wide + 2 * t + k), padded
            for _ in range(3):
                y = hadamard(y * rng.choice((-1.0, 1.0), wide)) / np.sqrt(wide)
            two = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            size = np.take_along_axis(np.abs(y), two, 1)
            two = np.where((size[:, :1] >= size[:, 1:]), two, two[:, ::-1])
            found.append(2 * two + (np.take_along_axis(y, two, 1) < 0))
        (a, a2), (b, b2) = found[0].T, found[1].T
        for j, (p, q) in enumerate(((a, b), (a2, b), (a, b2))):
            out[:, t, j] = p * (4 * wide) + q
    return out


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column("embedding").to_pylist()
        size = np.array([len(r) for r in rows])
        for d in np.unique(size) if len(size) else []:
            pick = np.flatnonzero(size == d)
            x = _unit([rows[i] for i in pick])
            c = codes(x)
            part = batch.take(pa.array(pick))
            flat = pa.array(c.reshape(len(pick), -1).tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("label"), part.column("n"), pa.array([int(d)] * len(pick), pa.int32()), flat, pa.array([r.tobytes() for r in x], pa.binary())], names=["rep", "label", "n", "dim", "codes", "unit"])


def _compare(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "task"):
            rep, n, side = (table.column(c).to_numpy() for c in ("rep", "n", "side"))
            slot, both = table.column("slot")[0].as_py(), table.column("pair")[0].as_py()
            x = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64).reshape(len(rep), -1)
            i, j = np.nonzero(np.triu(x @ x.T >= cosine, 1))
            if both:  # two blocks: what lies in one block is another task's
                cross = side[i] != side[j]
                i, j = i[cross], j[cross]
            if not len(i):
                continue
            code = np.array(table.column("codes").to_pylist(), np.int64).reshape(len(rep), TABLES, PROBES)
            t, mine = slot // PROBES, table.column("code")[0].as_py()
            first = np.ones(len(i), bool)
            for at in range(0, len(i), 1 << 14):
                s = slice(at, at + (1 << 14))
                a, b = code[i[s], : t + 1], code[j[s], : t + 1]
                meet = (a[:, :, :, None] == b[:, :, None, :]).any(3)
                least = np.where(meet[:, t], a[:, t], np.iinfo(np.int64).max).min(1)
                first[s] = ~meet[:, :t].any((1, 2)) & (least == mine)
            tree, add = Union(len(rep)), np.zeros(len(rep), np.int64)
            np.add.at(add, i[first], n[j[first]])
            np.add.at(add, j[first], n[i[first]])
            for a, b in zip(i.tolist(), j.tolist()):
                tree.join(a, b)
            hit = np.unique(np.concatenate((i, j)))
            root = rep[[tree.find(k) for k in hit.tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(add[hit]), pa.array(root)], names=["rep", "add", "root"])

    return run


def link(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    n = partitions(spark)
    e = F.col("embedding")
    ok = F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(e, lambda v: v != 0)
    fits = vectors.where(F.coalesce(ok, F.lit(False))).select("vec_id", "label", "embedding", F.xxhash64("label", "embedding").alias("d1"), F.xxhash64(F.lit(1), "embedding", "label").alias("d2"))
    classes = written(fits.groupBy("d1", "d2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    leads = fits.join(classes, (fits["vec_id"] == classes["rep"]) & (fits["d1"] == classes["d1"]) & (fits["d2"] == classes["d2"])).select("rep", "label", "n", "embedding").dropDuplicates(["rep"])
    label = vectors.schema["label"].dataType.simpleString()
    sketch = written(leads.mapInArrow(_sketch, f"rep long, label {label}, n long, dim int, codes array<long>, unit binary"), "sketch")
    keys = sketch.select("rep", "label", "dim", F.posexplode("codes").alias("slot", "code")).select("rep", F.xxhash64("label", "dim", F.expr(f"slot div {PROBES}"), "code").alias("bucket"), "slot", "code")
    keys = keys.groupBy("bucket", "rep").agg(F.min("slot").alias("slot"), F.first("code").alias("code"))
    keys = written(keys, "keys")
    size = keys.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    held = keys.join(size, "bucket").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = held.select(F.xxhash64("bucket", F.least("side", "other"), F.greatest("side", "other")).alias("task"), "rep", "side", "code", F.expr(f"slot - slot % {PROBES}").alias("slot"), (F.col("side") != F.col("other")).alias("pair"))
    tasks = tasks.join(sketch.select("rep", "n", "codes", "unit"), "rep").repartition(n, "task").sortWithinPartitions("task", "rep")
    found = written(tasks.mapInArrow(_compare(cosine), "rep long, add long, root long"), "found")
    comps = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    sums = found.groupBy("rep").agg(F.sum("add").alias("add"))
    done = classes.join(sums, "rep", "left").join(comps, "rep", "left").select("d1", "d2", (F.col("n") - 1 + F.coalesce("add", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = vectors.select("vec_id", F.when(F.coalesce(ok, F.lit(False)), F.xxhash64("label", "embedding")).alias("d1"), F.when(F.coalesce(ok, F.lit(False)), F.xxhash64(F.lit(1), "embedding", "label")).alias("d2")).join(done, ["d1", "d2"], "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
