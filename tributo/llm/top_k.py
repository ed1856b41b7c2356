"""Exact top-k search by columnar branch-and-bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow

#: Queries broadcast at once: 64 dimensions of 8 bytes each, 16 MB at most, whatever the input.
QUERY_BLOCK = 32_768
#: Vectors, broadcast once, whose scores give each query its first lower bound.
INCUMBENTS = 2_048
#: Dimensions added up between two rounds of pruning.
DIM_BLOCK = 16
#: Vectors scored together in vertical layout.
CHUNK = 8_192


def quantised(vec: Column, scale: float) -> Column:
    return F.transform(vec, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vec: Column) -> Column:
    """Neither null nor holding null or non-finite entries; an empty vector holds none."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True))


def matrix(column: pa.Array, dims: int, kind: type = np.float64) -> np.ndarray:
    """Rows as numbers of one kind, shorter vectors filled with zeros."""
    lengths = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), dtype=kind)
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims), kind)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def _tails(m: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Euclidean mass of each row beyond each cut."""
    squares = np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1]
    squares = np.concatenate([squares, np.zeros((len(m), 1))], axis=1)
    return np.sqrt(squares[:, cuts])


class Search:
    """Keeps the k best candidates of every query over all the chunks it is shown.

    Scores are whole numbers held in float64, which is exact below 2**53.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.q, self.k = ids, vectors, k
        dims = vectors.shape[1]
        self.cuts = list(range(DIM_BLOCK, dims, DIM_BLOCK)) + [dims]
        self.tails = _tails(vectors, self.cuts)
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor.copy()
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        columns, tails = np.ascontiguousarray(vectors.T), _tails(vectors, self.cuts)
        for j, query in enumerate(self.q):
            alive, start = np.flatnonzero(ids != self.ids[j]), 0
            score = np.zeros(len(alive))
            for c, stop in enumerate(self.cuts):
                block = columns[start:stop] if len(alive) == columns.shape[1] else columns[start:stop, alive]
                score = score + query[start:stop] @ block
                start = stop
                bound = score + self.tails[j, c] * tails[alive, c] * (1 + 1e-9)
                keep = bound >= self.floor[j] - 1e-6
                alive, score = alive[keep], score[keep]
                if not len(alive):
                    break
            if len(alive):
                self._merge(j, score, ids[alive])

    def _merge(self, j: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.best[j][0], score]), np.concatenate([self.best[j][1], ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.best[j] = score[order], ids[order]
        if len(order) == self.k:
            self.floor[j] = max(self.floor[j], score[order[-1]])


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, *, block: int = QUERY_BLOCK) -> DataFrame:
    """The k candidates with the largest inner product for each query: query_id, rank, vec_id, score.

    Both inputs have vec_id (long) and v (array of whole numbers). Ties go to the smaller vec_id; a query is not its
    own candidate. Rows with a null id or vector take no part, of repeated query ids one row is answered, and a shorter
    vector counts as filled with zeros. Fewer than k candidates: all of them. Empty inputs give an empty result.

    Queries go out in blocks of bounded size, one pass over the vectors for each, and a pass's result is written before
    the next begins, so the driver and the tasks hold one block at a time however many there are. A pass adds up
    dimensions block by block in vertical layout and drops a candidate as soon as the mass left in the other dimensions
    can't lift it to the k-th score known so far. The first such scores come from a few vectors, a sound lower bound
    that tasks find for their share of the queries.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "v").where("vec_id is not null and v is not null")
    queries = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "v").where("vec_id is not null and v is not null")
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    total, dims = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = max(dims, vectors.agg(F.max(F.size("v"))).first()[0] or 1, 1)
    blocks = -(-total // block)
    some = vectors.limit(INCUMBENTS).collect()
    incumbents = spark.sparkContext.broadcast((np.array([r.vec_id for r in some], np.int64), matrix(pa.array([r.v for r in some], pa.list_(pa.int64())), dims)))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = incumbents.value
        for batch in batches:
            known = Search(np.asarray(batch.column("vec_id")), matrix(batch.column("v"), dims), k)
            if len(ids):
                known.add(ids, rows)
            yield batch.append_column("floor", pa.array(known.floor))

    bounded = cut(map_arrow(queries, bound, "vec_id long, v array<long>, floor double"))
    # A task gives k rows a query at most, so a query's window is small.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = None
    for b in range(blocks):
        mine = bounded.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow().combine_chunks()
        ids = np.asarray(mine["vec_id"])
        v = mine["v"].chunk(0) if len(ids) else pa.array([], pa.list_(pa.int64()))
        sent = spark.sparkContext.broadcast((ids, matrix(v, dims), np.asarray(mine["floor"])))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q, floor = sent.value
            search = Search(ids, q, k, floor)
            held: list[pa.RecordBatch] = []

            def flush() -> None:
                table = pa.Table.from_batches(held).combine_chunks()
                search.add(np.asarray(table["vec_id"]), matrix(table["v"].chunk(0), dims))
                held.clear()

            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                if sum(x.num_rows for x in held) >= CHUNK:
                    flush()
            if held:
                flush()
            for j, (score, found) in enumerate(search.best):
                if len(found):
                    yield pa.record_batch({"query_id": np.full(len(found), ids[j]), "vec_id": found, "score": score.astype(np.int64)})

        found = map_arrow(vectors, scan, "query_id long, vec_id long, score long")
        part = cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
        # Written, so the block's queries are needed no more.
        sent.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def embeddings_top_k(embeddings: DataFrame, k: int = 20, scale: float = 64.0, every: int = 20) -> DataFrame:
    """exact_top_k over floor(scale * x); every n-th id is a query. Vectors that are null or hold null or non-finite
    parts are left out; an empty one takes part with a score of 0. Ties go to the smaller vec_id. Of repeated rows each is
    a candidate, but none of its own id; as a query an id is answered once, by the least of its vectors. Other columns are
    ignored, and no rows give none.
    """
    chosen = embeddings.select("vec_id", "embedding").where(usable(F.col("embedding")))
    whole = chosen.select("vec_id", quantised(F.col("embedding"), scale).alias("v"))
    return exact_top_k(whole, whole.where(F.col("vec_id") % every == 0), k)
