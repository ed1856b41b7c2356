"""Retrieval by an inverted file: vectors in cells around centroids, and exact bounds by which a query passes over cells."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import nested

#: Vectors that centroids are fitted on, at most, and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 8
#: Scores are rounded to six decimals; bounds give way by more than that.
SLACK = 2e-6


def centroids(vectors: DataFrame, cells: int, *, column: str = "embedding", key: str = "vec_id", seed: int = 3) -> np.ndarray:
    """Unit directions fitted to a sample of bounded size, chosen by a hash of the key; those that lose all vectors go."""
    usable = vectors.where(_scores(F.col(column)))
    total = usable.count()
    share = min(1.0, 0.9 * SAMPLE / max(1, total))
    chosen = usable.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 20)) < int((1 << 20) * share)).limit(SAMPLE)
    rows = [r[0] for r in chosen.select(F.transform(column, lambda x: x.cast("double"))).collect()]
    if not rows:
        return np.zeros((0, 0))
    size = max(set(map(len, rows)), key=[len(r) for r in rows].count) if len(set(map(len, rows))) > 1 else len(rows[0])
    x = np.array([r for r in rows if len(r) == size])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = x[np.random.default_rng(seed).permutation(len(x))[: max(1, min(cells, len(x)))]]
    for _ in range(ROUNDS):
        at = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        norms = np.linalg.norm(sums, axis=1)
        c = sums[norms > 0] / norms[norms > 0, None]
    return c


def _length(v: Column) -> Column:
    """The norm; null and 0 for vectors that are alike to nothing."""
    return F.sqrt(nested.dot(v, v))


def _scores(v: Column) -> Column:
    return F.coalesce((_length(v) > 0) & (_length(v) < float("inf")), F.lit(False))


@dataclass
class InvertedFile:
    """Where the cells are, their centroids, and a row a cell: how many vectors, and the widest angle to its centroid.

    Vectors of another length than the centroids are in cell -1, which is always read; null vectors, those of length zero
    and those that aren't finite score nothing and are left out.
    """

    path: str
    schema: StructType
    centroids: np.ndarray
    counts: dict[int, int]
    angles: dict[int, float]

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)


def build(vectors: DataFrame, path: str, *, cells: int = 64, column: str = "embedding", key: str = "vec_id") -> InvertedFile:
    """Writes the vectors in folders by cell, each to the centroid that it is most alike to."""
    c = centroids(vectors, cells, column=column, key=key)
    size = c.shape[1] if len(c) else 0
    lit = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in c]) if len(c) else F.array().cast("array<array<double>>")
    rows = vectors.select(key, column).where(_scores(F.col(column))).withColumn("_norm", _length(F.col(column)))
    likeness = F.transform(lit, lambda row: nested.dot(F.col(column), row) / F.col("_norm"))
    usable = F.size(column) == size
    placed = rows.withColumn("_like", F.when(usable, likeness)).withColumn("_most", F.array_max("_like"))
    cell = F.when(usable, F.array_position("_like", F.col("_most")) - 1).otherwise(-1).cast("int")
    placed = placed.select(key, column, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "_most"))).alias("_angle"), cell.alias("_cell"))
    # Cells of many vectors are several files: a hash of the key parts them, so no cell is one task.
    placed.repartition("_cell", F.pmod(F.xxhash64(key), F.lit(8))).write.mode("overwrite").partitionBy("_cell").parquet(path)
    index = InvertedFile(path, placed.schema, c, {}, {})
    for r in index.rows(vectors.sparkSession).groupBy("_cell").agg(F.count("*").alias("n"), F.max("_angle").alias("angle")).collect():
        index.counts[r["_cell"]], index.angles[r["_cell"]] = r["n"], r["angle"]
    return index


def bounds(index: InvertedFile, query: list[float]) -> dict[int, float]:
    """By cell the most that any of its vectors can score: the angle to the query is that to the centroid less the cell's at least."""
    q = np.array(query, dtype=float)
    norm = np.linalg.norm(q)
    out = {}
    for cell, angle in index.angles.items():
        if cell < 0 or len(q) != index.centroids.shape[1] or not norm:
            out[cell] = 1.0
        else:
            between = math.acos(max(-1.0, min(1.0, float(index.centroids[cell] @ q / norm))))
            out[cell] = math.cos(max(0.0, between - angle - 1e-7))
    return out


def plan(spark: SparkSession, index: InvertedFile, query: list[float], k: int, *, column: str = "embedding", key: str = "vec_id") -> list[int]:
    """The cells that can hold one of the k best: the most promising ones give a k-th score, and what can't reach it is left out."""
    most = bounds(index, query)
    order = sorted(most, key=lambda c: (-most[c], c))
    first, held = [], 0
    for cell in order:
        first.append(cell)
        held += index.counts[cell]
        if held >= 4 * k:
            break
    found = _scored(spark, index, first, query, column, key).limit(k).collect()
    least = found[-1]["score"] if len(found) == k else 0.0
    return sorted(set(first) | {c for c in order if most[c] + SLACK >= least and most[c] > -SLACK})


def _scored(spark: SparkSession, index: InvertedFile, cells: list[int], query: list[float], column: str, key: str) -> DataFrame:
    score = nested.cosine(F.col(column), F.array(*[F.lit(float(x)) for x in query]))
    rows = index.rows(spark).where(F.col("_cell").isin(cells))
    return rows.select(key, F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), key)


def cosine_top(spark: SparkSession, index: InvertedFile, query: list[float], k: int = 5, *, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """retrieval.cosine_top over an inverted file: the same rows, read from the folders of the cells that ``plan`` names alone."""
    k = max(1, k)
    if not index.counts:
        return index.rows(spark).select(key, F.lit(0.0).alias("score")).limit(0)
    return _scored(spark, index, plan(spark, index, query, k, column=column, key=key), query, column, key).limit(k)
