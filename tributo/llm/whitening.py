"""Embedding whitening: blockwise QR of the centred rows, then one-sided Jacobi rotations of the small factor."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gathered, map_arrow
from .top_k import matrix, usable

#: Rows factored at once.
CHUNK = 4_096
#: Tasks that merge what all others have found; the driver merges what these give.
FAN = 16
#: Whole numbers are held within this, so that a chunk's sums stay below 2**63.
LARGEST = 1 << 50
#: Singular values below this share of the largest are rounding errors of a direction without variance.
RANK = 1e-13


def whole(vec: Column, scale: float) -> Column:
    """floor(scale * x) of each entry, as longs; beyond 2**50 in size, 2**50."""
    near = lambda y: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), y))
    return F.transform(vec, lambda x: F.floor(near(F.lit(float(scale)) * x.cast("double"))))


def rotate(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors (columns) of r, by one-sided Jacobi rotations.

    Each rotation makes two columns orthogonal; the rounds of a sweep take disjoint pairs, each pair once. Column norms
    are never squared into a covariance, so small values keep their relative accuracy.
    """
    d = r.shape[1]
    a, v = np.array(r, dtype=np.float64), np.eye(d)
    if d % 2:
        a, v = np.pad(a, ((0, 0), (0, 1))), np.eye(d + 1)
    ring = np.arange(a.shape[1])
    half = len(ring) // 2
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(max(1, len(ring) - 1)):
            p, q = ring[:half], ring[half:][::-1]
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(xx) * np.sqrt(yy)
            angle = np.divide(np.abs(xy), size, out=np.zeros_like(xy), where=size > 0)
            worst = max(worst, float(angle.max(initial=0.0)))
            turn = angle > 1e-16
            zeta = np.divide(yy - xx, 2 * xy, out=np.zeros_like(xy), where=turn)
            with np.errstate(over="ignore"):
                t = np.where(turn, np.copysign(1.0, zeta) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            s = c * t
            for m in (a, v):
                x, y = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * x - s * y, s * x + c * y
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if worst < 1e-15:
            break
    a, v = a[:, :d], v[:d, :d]
    norms = np.sqrt((a * a).sum(0))
    order = np.argsort(-norms, kind="stable")
    return norms[order], v[:, order]


def stacked(blocks: Iterator[np.ndarray], d: int) -> np.ndarray:
    """The triangular factor of all rows of the blocks, one block at a time, as d rows."""
    r = np.zeros((0, d))
    for block in blocks:
        r = np.linalg.qr(np.concatenate([r, block]), mode="r")
    return np.concatenate([r, np.zeros((d - len(r), d))])


@dataclass
class Moments:
    """Count, mean and centred products of rows, which add up without squaring means."""

    n: float
    mean: np.ndarray
    products: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        mean = rows.mean(0)
        return cls(float(len(rows)), mean, (rows - mean).T @ (rows - mean))

    def plus(self, other: Moments) -> Moments:
        n, apart = self.n + other.n, other.mean - self.mean
        if not n:
            return self
        return Moments(n, self.mean + apart * (other.n / n), self.products + other.products + np.outer(apart, apart) * (self.n * other.n / n))

    def flat(self) -> np.ndarray:
        return np.concatenate([[self.n], self.mean, self.products.ravel()])

    @classmethod
    def read(cls, flat: np.ndarray, k: int) -> Moments:
        return cls(flat[0], flat[1 : k + 1], flat[k + 1 :].reshape(k, k))


def offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: 64-bit whole numbers, or Python's where those don't hold it."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def deviations(apart: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exact; None where a long doesn't hold it."""
    if apart.dtype != object and int(np.abs(apart).max(initial=0)) ** 2 * max(1, apart.shape[1]) < 1 << 63:
        return (apart * apart).sum(1).tolist()
    sums = [sum(int(y) * int(y) for y in row) for row in apart.tolist()]
    return [s if s < 1 << 63 else None for s in sums]


@dataclass
class Whitening:
    """A fitted transform: n rows, their sums by dimension, unit components (columns), their standard deviations and shares."""

    n: int
    sums: list[int]
    components: np.ndarray
    deviation: np.ndarray
    explained: np.ndarray

    def apart(self, x: np.ndarray) -> np.ndarray:
        return offsets(x, self.n, self.sums)

    def white(self, apart: np.ndarray) -> np.ndarray:
        return (apart.astype(np.float64) / self.n) @ self.components / self.deviation


def _blocks(batches: Iterator[pa.RecordBatch], d: int, shift: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of at most CHUNK rows, and their vectors with shift added to each entry, missing ones included."""
    for batch in gathered(batches, CHUNK):
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            yield part, matrix(part.column("v"), d, np.int64) + shift


def merged(rows: DataFrame, first: Callable, again: Callable) -> np.ndarray:
    """What ``first`` makes of each task's batches, an array of doubles each, merged by ``again`` in FAN tasks, then here."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch({"a": pa.array([first(batches)], pa.list_(pa.float64()))})

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch({"a": pa.array([again(np.array(a) for b in batches for a in b.column("a").to_pylist())], pa.list_(pa.float64()))})

    each = map_arrow(rows, own, "a array<double>").withColumn("task", F.spark_partition_id() % FAN)
    few = map_arrow(each.repartition(FAN, "task").select("a"), met, "a array<double>").collect()
    return again(np.array(r.a) for r in few)


def fit(vectors: DataFrame, components: int, shift: int = 0) -> Whitening:
    """The transform of vectors (v: array of whole numbers; a shorter one is filled with zeros) with shift added.

    Three small results come to the driver: the sums of each dimension, FAN triangular factors, and none of the rows.
    """
    n, d = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    d = d or 0
    if not n or not d:
        return Whitening(n, [0] * d, np.zeros((d, 0)), np.zeros(0), np.zeros(0))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _blocks(batches, d, shift):
            yield pa.record_batch({"i": np.arange(d), "s": x.sum(0)})

    found = map_arrow(vectors.select("v"), totals, "i long, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = [int(s) for _, s in sorted((r.i, r.s) for r in found)]

    def first(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        return stacked((offsets(x, n, sums).astype(np.float64) / n for _, x in _blocks(batches, d, shift)), d).ravel()

    r = merged(vectors.select("v"), first, lambda parts: stacked((p.reshape(d, d) for p in parts), d).ravel()).reshape(d, d)
    values, directions = rotate(r)
    total = float((values * values).sum())
    keep = min(components, int((values > RANK * values[0]).sum()) if total > 0 else 0)
    directions = directions[:, :keep] * np.where(directions[np.abs(directions).argmax(0), np.arange(d)] < 0, -1.0, 1.0)[:keep]
    return Whitening(n, sums, directions, values[:keep] / np.sqrt(n), values[:keep] ** 2 / total if total else values[:0])


def identity_error(vectors: DataFrame, model: Whitening, shift: int = 0) -> float:
    """The largest entry of the whitened rows' covariance less the identity, measured over all rows."""
    k, d = len(model.deviation), len(model.sums)

    def first(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = Moments(0.0, np.zeros(k), np.zeros((k, k)))
        for _, x in _blocks(batches, d, shift):
            out = out.plus(Moments.of(model.white(model.apart(x))))
        return out.flat()

    def again(parts: Iterator[np.ndarray]) -> np.ndarray:
        out = Moments(0.0, np.zeros(k), np.zeros((k, k)))
        for p in parts:
            out = out.plus(Moments.read(p, k))
        return out.flat()

    all_ = Moments.read(merged(vectors.select("v"), first, again), k)
    return float(np.abs(all_.products / all_.n - np.eye(k)).max(initial=0.0))


def whiten(embeddings: DataFrame, *, components: int = 8, scale: float = 1024.0, shift: int = 100_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each row of embeddings and component.

    Entries c count as the whole numbers x = floor(scale * c) + shift. n is the number of rows, S their sums; deviation is
    the sum of (n * x - S)**2 over the dimensions, exact, null where a long can't hold it. Components are the unit
    eigenvectors of the covariance of x (divisor n), numbered from 1 by falling variance, the largest entry positive.

    Rows whose vector is null or holds null or non-finite entries are dropped; null ids and repeated rows stay, of vectors
    of different lengths the shorter are filled with c = 0, other columns are ignored. A direction without variance can't
    be whitened: there are as many components as directions that vary, at most ``components``; none at all (one row,
    equal rows, no rows) give an empty result. Equal variances have components in no set order.

    Vectors are never shuffled. Each task folds its rows, centred by exact sums, into a triangular factor, FAN tasks and the
    driver fold the factors, whose size is that of one block of rows, and rotations orthogonalise the last one's columns.
    """
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable(F.col("embedding"))).select("vec_id", whole(F.col("embedding"), scale).alias("v"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = fit(vectors, components, shift)
    k, d = len(fitted.deviation), len(fitted.sums)
    if not k:
        return embeddings.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, fitted, shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, d, shift):
            apart = fitted.apart(x)
            m = len(x)
            yield pa.record_batch(
                {
                    "vec_id": batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m),
                    "n": np.full(m * k, fitted.n, np.int64),
                    "deviation": pa.array([y for y in deviations(apart) for _ in range(k)], pa.int64()),
                    "whitened": fitted.white(apart).ravel(),
                    "explained": np.tile(fitted.explained, m),
                    "identity_error": np.full(m * k, error),
                }
            )

    return map_arrow(vectors, run, schema)
