"""Embedding whitening: leading principal components by matrix-free block Lanczos, rows projected on them.

Entries become integers (floor of 256 times the entry), so counts, sums and deviations are exact. The fit list holds each
distinct integer vector once, as a Parquet table in the shared folder. The covariance is never formed: every Lanczos step
is one distributed pass over the fit list that adds up (x - mean) ((x - mean)' Q) for a narrow block Q. The driver keeps
the basis (dimensions times at most `basis` columns) and the sums of at most FAN tasks. New blocks are orthogonalised
against the whole basis twice; columns that break down are replaced by random directions; a full basis restarts from the
leading Ritz vectors. A pair counts as found when its residual, from the stored products, is below `tolerance` of the
largest eigenvalue, or when the basis spans all dimensions.

Rows with a null vector, a null entry or a non-finite entry are dropped. Vectors shorter than the longest count as 0 in the
dimensions they lack; empty vectors are such. Entries beyond 64 bits are held at the ends of that range. Repeated vectors
enter the fit once and come out once a row, repeated and null ids as they are. Components whose eigenvalue is no more than
1e-12 of the trace cannot be scaled and are left out, so that equal vectors, a single vector and an empty table give no
rows. `deviation` is null where it does not fit 64 bits, `deviation_exact` has it up to 38 digits. Other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibloom.llm.common import bounded_batches, written

SCALE = 256
#: Tasks that add up what the partitions found; as many vectors reach the driver.
FAN = 16
#: Bytes of centred rows that a task multiplies at once, about.
SLICE_BYTES = 8 << 20
LOW, HIGH = -(1 << 63), (1 << 63) - 1


@dataclass
class Model:
    """n vectors of the fit list with exact sums a dimension; components as columns, eigenvalues, shares of the trace."""

    n: int
    sums: list[int]
    widest: int
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])


def integers(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, length, x): the rows of a list column that remain, how long each is, and their entries one after another."""
    row = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    held = column.take(pa.array(row))
    length = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    value = held.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become nan
    owner = np.repeat(np.arange(len(row)), length)
    good = np.bincount(owner[~np.isfinite(value)], minlength=len(row)) == 0
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * value[good[owner]])
    x = np.where(scaled >= HIGH, HIGH, np.where(scaled <= LOW, LOW, 0))
    inside = (scaled < HIGH) & (scaled > LOW)
    x[inside] = scaled[inside].astype(np.int64)
    return row[good], length[good], x


def padded(length: np.ndarray, x: np.ndarray, d: int) -> np.ndarray:
    out = np.zeros((len(length), d), np.int64)
    out[np.arange(d) < length[:, None]] = x
    return out


def _vectors(embeddings: DataFrame, vector: str) -> DataFrame:
    return embeddings.select(F.col(vector).cast("array<double>").alias("v"))


def fit_list(embeddings: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """(x) of each distinct integer vector, as little-endian 64-bit integers, and the number of dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, length, x = integers(batch.column("v"))
            ends = np.concatenate(([0], np.cumsum(8 * length))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])], names=["x"])

    found = written(_vectors(embeddings, vector).mapInArrow(run, "x binary").distinct(), "fit")
    least, most = found.agg(F.min(F.octet_length("x")), F.max(F.octet_length("x"))).first()
    if most and least != most:
        found = written(found.select(F.rpad("x", F.lit(most), F.lit(b"\0")).alias("x")).distinct(), "fit")
    return found, (most or 0) // 8


def _matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    """The vectors of a partition in slices of bounded size."""
    step = max(1, SLICE_BYTES // (8 * d))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield np.frombuffer(b"".join(batch.column("x").slice(at, step).to_pylist()), "<i8").reshape(-1, d)


def summed(fit: DataFrame, part: Callable[[Iterator[np.ndarray]], np.ndarray], d: int, dtype: str) -> np.ndarray:
    """The sum over partitions of what `part` makes of a partition's slices; FAN tasks add up before the driver does.

    Integers come as (high, low) halves of 32 bits along the last axis and are carried after every addition.
    """

    def added(parts: list[np.ndarray]) -> np.ndarray:
        total = np.sum(parts, axis=0)
        if dtype == "<i8":
            carry = total[..., 1] >> 32
            total = np.stack((total[..., 0] + carry, total[..., 1] - (carry << 32)), axis=-1)
        return total

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = part(_matrices(batches, d))
        yield pa.RecordBatch.from_arrays([pa.array([repr(found.shape)]), pa.array([found.astype(dtype).tobytes()], pa.binary())], names=["shape", "part"])

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shape = None, None
        for batch in batches:
            for s, raw in zip(batch.column("shape").to_pylist(), batch.column("part").to_pylist()):
                one, shape = np.frombuffer(raw, dtype).reshape([int(k) for k in s.strip("(),").split(",") if k.strip()]), s
                total = one if total is None else added([total, one])
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([shape]), pa.array([total.tobytes()], pa.binary())], names=["shape", "part"])

    schema = "shape string, part binary"
    rows = fit.select("x").mapInArrow(first, schema).repartition(FAN).mapInArrow(then, schema).collect()  # FAN rows at most
    return added([np.frombuffer(r["part"], dtype).reshape([int(k) for k in r["shape"].strip("(),").split(",") if k.strip()]) for r in rows])


def moments(fit: DataFrame, d: int) -> tuple[int, list[int], int]:
    """(n, exact sums a dimension, largest absolute entry) of the fit list."""

    def part(slices: Iterator[np.ndarray]) -> np.ndarray:
        # column d holds the count; of the last column only the bits of the widest entry's length matter
        total = np.zeros((d + 1 + 65, 2), np.int64)
        for x in slices:
            total[:d, 0] += (x >> 32).sum(axis=0)
            total[:d, 1] += (x & 0xFFFFFFFF).sum(axis=0)
            total[d, 1] += len(x)
            widest = max(int(x.max()), -int(x.min()))
            total[d + 1 + widest.bit_length(), 1] = 1
            carry = total[:, 1] >> 32
            total[:, 0] += carry
            total[:, 1] -= carry << 32
        return total

    total = summed(fit, part, d, "<i8")
    exact = [(int(h) << 32) + int(low) for h, low in total]
    return exact[d], exact[:d], (1 << max(i for i in range(65) if exact[d + 1 + i])) - 1


def leading(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int, tolerance: float, basis: int, most: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int]:
    """(values, vectors, passes): the k largest eigenpairs of a symmetric d by d operator, by block Lanczos.

    product(Q) multiplies a block, of k columns at least: a narrower one would miss equal eigenvalues. Raises if `most` passes do not reach the tolerance.
    """
    k, block = min(k, d), min(max(block, k), d)
    basis = min(d, max(basis, k + 2 * block))
    random = np.random.default_rng(seed)
    q_all, a_all = np.zeros((d, 0)), np.zeros((d, 0))

    def fresh(z: np.ndarray, scale: float, width: int) -> np.ndarray:
        """An orthonormal block from z, outside the basis; directions that broke down are drawn anew."""
        out = np.zeros((d, 0))
        for trial in range(50):
            if out.shape[1] == width:
                break
            if trial:
                z, scale = random.standard_normal((d, width - out.shape[1])), 1.0
            for _ in range(2):
                for held in (q_all, out):
                    z = z - held @ (held.T @ z)
            u, s, _ = np.linalg.svd(z, full_matrices=False)
            u = u[:, s > 1e-12 * scale]
            for held in (q_all, out):  # svd vectors of small singular values need it once more
                u = u - held @ (held.T @ u)
            out = np.hstack((out, np.linalg.qr(u)[0]))[:, :width]
        return out

    q = fresh(random.standard_normal((d, block)), 1.0, block)
    for passes in range(1, most + 1):
        q_all, a_all = np.hstack((q_all, q)), np.hstack((a_all, product(q)))
        t = q_all.T @ a_all
        value, s = np.linalg.eigh((t + t.T) / 2)
        value, s = value[::-1], s[:, ::-1]
        y = q_all @ s[:, :k]
        residual = np.linalg.norm(a_all @ s[:, :k] - y * value[:k], axis=0)
        if q_all.shape[1] == d or (q_all.shape[1] >= k and (residual <= tolerance * max(value[0], 0.0)).all()):
            return value[:k], y, passes
        z = a_all[:, -q.shape[1] :]
        if q_all.shape[1] + block > basis and basis < d:
            kept = min(q_all.shape[1], basis - block)
            z = a_all @ s[:, :k] - y * value[:k]  # the residuals lead on from the kept Ritz vectors
            q_all, a_all = q_all @ s[:, :kept], a_all @ s[:, :kept]
        q = fresh(z, max(abs(value[0]), 1e-300), min(block, d - q_all.shape[1]))
    raise RuntimeError(f"block Lanczos: no convergence after {most} passes; residuals {residual}")


def fit(embeddings: DataFrame, vector: str = "embedding", k: int = 4, block: int = 8, tolerance: float = 1e-13, basis: int = 512, most: int = 400) -> Model | None:
    """The whitening of the fit list; None without vectors, without dimensions or without variance."""
    bounded_batches(embeddings.sparkSession)
    found, d = fit_list(embeddings, vector)
    if not d:
        return None
    n, sums, widest = moments(found, d)
    model = Model(n, sums, widest, np.zeros((d, 0)), np.zeros(0), np.zeros(0), 0.0, 0)
    mean = model.mean

    def trace_part(slices: Iterator[np.ndarray]) -> np.ndarray:
        return np.array([math.fsum(v / (n * n) for x in slices for v in deviations(x, n, sums, widest))])

    trace = float(summed(found, trace_part, d, "<f8")[0]) / n
    if not trace > 0:
        return None

    def product(q: np.ndarray) -> np.ndarray:
        def part(slices: Iterator[np.ndarray]) -> np.ndarray:
            total = np.zeros(q.shape)
            for x in slices:
                centred = x - mean
                total += centred.T @ (centred @ q)
            return total

        return summed(found, part, d, "<f8") / n

    value, y, passes = leading(product, d, k, block, tolerance, basis, most)
    real = value > 1e-12 * trace
    value, y = value[real], y[:, real]
    y = y * np.where(y[np.abs(y).argmax(axis=0), np.arange(y.shape[1])] < 0, -1.0, 1.0)
    width = len(value)

    def cover(slices: Iterator[np.ndarray]) -> np.ndarray:
        total = np.zeros((width + 1, width))
        for x in slices:
            w = (x - mean) @ y / np.sqrt(value)
            total += np.vstack((w.sum(axis=0)[None], w.T @ w))
        return total

    held = summed(found, cover, d, "<f8") / n
    error = float(np.abs(held[1:] - np.outer(held[0], held[0]) - np.eye(width)).max())
    return Model(n, sums, widest, y, value, value / trace, error, passes)


def deviations(x: np.ndarray, n: int, sums: list[int], widest: int) -> list[int]:
    """Sum over dimensions of (n * x - S) ** 2 of each row, exact."""
    far = max(abs(s) for s in sums)
    square, cross = len(sums) * widest * widest < 1 << 63, len(sums) * widest * far < 1 << 63
    xs = x if square and cross else x.astype(object)
    a = ((x if square else xs) ** 2).sum(axis=1)
    b = (x @ np.array(sums, np.int64)) if cross and far <= HIGH else xs @ np.array(sums, object)
    c = sum(s * s for s in sums)
    return [n * n * int(p) - 2 * n * int(q) + c for p, q in zip(a, b)]


COLUMNS = "component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"


def whitened(embeddings: DataFrame, model: Model | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error, deviation_exact) of every remaining row."""
    kind = embeddings.schema[key].dataType.simpleString()
    rows = embeddings.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    schema = f"k {kind}, {COLUMNS}"
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema).withColumnRenamed("k", key)
    mean, scale, width, d = model.mean, np.sqrt(model.values), len(model.values), len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, SLICE_BYTES // (8 * d))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                row, length, x = integers(batch.column("v"))
                if not len(row):
                    continue
                x = padded(length, x, d)
                w = (x - mean) @ model.components / scale
                exact = deviations(x, model.n, model.sums, model.widest)
                again = np.repeat(np.arange(len(row)), width)
                take = pa.array(again)
                one = lambda v: pa.array(np.full(len(again), v))
                yield pa.RecordBatch.from_arrays([
                    batch.column("k").take(pa.array(row)).take(take), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(row))), one(np.int64(model.n)),
                    pa.array([v if v <= HIGH else None for v in exact], pa.int64()).take(take), pa.array(w.ravel()), pa.array(np.tile(model.explained, len(row))), one(model.identity_error),
                    pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0)).take(take),
                ], names=["k", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)
