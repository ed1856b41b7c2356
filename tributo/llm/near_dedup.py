"""MinHash near-dedup with HyperMinHash registers."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, cut, map_arrow, passes, release, texts
from .components import components, joined
from .tokens import SPACED, bounds, mix, pieces, powers, words

#: A signature has BANDS * ROWS registers. Two sets that are 0.8 alike agree in none of the bands with a chance of 1e-7.
BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
#: Sets of up to SMALL_MOST shingles have a signature of REGISTERS hash functions with one bucket each; those of LARGE_LEAST
#: and more one of SKETCHES functions with BUCKETS buckets. Alike sets always share a kind: 40 < 0.8 * 63.
SMALL_MOST, LARGE_LEAST = 62, 40
SKETCHES = 8
BUCKETS = REGISTERS // SKETCHES
MANTISSA = 10
#: Estimates this far below the threshold still go to verification: five standard deviations of REGISTERS draws.
MARGIN = 0.15
#: Rows of one bucket compared in one task; larger buckets are split into pairs of such blocks.
BLOCK = 1_024
#: Type of a row's name: two 64-bit hashes of its columns.
ROW = "struct<a:bigint,b:bigint>"

_SEEDS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _layout() -> np.ndarray:
    """Register of (sketch, bucket) that stands at each place of a large signature: a band mixes ROWS sketches."""
    used = [0] * SKETCHES
    out = []
    for band in range(BANDS):
        for row in range(ROWS):
            s = (band + row) % SKETCHES
            out.append(s * BUCKETS + used[s])
            used[s] += 1
    return np.array(out)


LAYOUT = _layout()


def registers(value: np.ndarray) -> np.ndarray:
    """Leading zeros and the MANTISSA bits after the first one of 32-bit minima, in 16 bits."""
    fraction, exponent = np.frexp(value.astype(np.float64) + 0.5)
    return ((32 - exponent).clip(0, 33).astype(np.uint16) << MANTISSA) | ((fraction - 0.5) * (2 << MANTISSA)).astype(np.uint16)


@lru_cache(maxsize=256)
def collision(a: int, b: int) -> float:
    """Chance that registers of two disjoint buckets of a and b elements agree all the same."""
    total = 0.0
    for zeros in range(33):
        width = 2.0 ** -(zeros + 1) / 2**MANTISSA
        x = 2.0 ** -(zeros + 1) + np.arange(2**MANTISSA) * width
        cell = lambda n: (1 - x) ** n - np.maximum(0, 1 - x - width) ** n  # noqa: E731,B023
        total += float((cell(a) * cell(b)).sum())
    return total


def estimate(agree: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, buckets: int) -> np.ndarray:
    """Jaccard similarity from the share of registers that agree, less what agrees by collision."""
    near = lambda n: np.maximum(0, np.log2(np.maximum(1.0, np.asarray(n) / buckets)) + 0.5).astype(np.int64)
    pair, at = np.unique(near(sizes_a) * 64 + near(sizes_b), return_inverse=True)
    chance = np.array([collision(1 << (p // 64), 1 << (p % 64)) for p in pair.tolist()])[at]
    return (agree / REGISTERS - chance) / (1 - chance)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; of fewer than k words the whole sequence, of none an empty set."""
    found, _, offsets = words(column, SPACED)
    at = bounds(found.row, len(offsets) - 1)
    h, out, p = found.hash, [], powers(k, 0xC2B2AE3D27D4EB4F)
    rolled = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        rolled += h[j : j + len(rolled)] * p[j]
    rolled = mix(rolled)
    for a, b in zip(at, at[1:], strict=False):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            out.append(mix((h[a:b] * p[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> int:
    """A 64-bit name of the set, equal for equal sets."""
    n = np.uint64(len(s))
    with np.errstate(over="ignore"):
        both = mix(np.array([s.sum(dtype=np.uint64) + n])) ^ mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64, keepdims=True)
    return int(mix(both)[0].view(np.int64))


def small_signature(s: np.ndarray) -> bytes:
    return registers((mix(s[:, None] ^ _SEEDS[None, :]) >> np.uint64(32)).min(0)).tobytes()


def large_signature(s: np.ndarray) -> bytes:
    low = np.full(REGISTERS, _EMPTY)
    for t in range(SKETCHES):
        h = mix(s ^ _SEEDS[t])
        bucket = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(BUCKETS)) >> np.uint64(32)
        own = low[t * BUCKETS : (t + 1) * BUCKETS]
        np.minimum.at(own, bucket.astype(np.int64), h >> np.uint64(32))
        filled = np.flatnonzero(own != _EMPTY)
        # An empty bucket takes over the next filled one, offset so that the copy isn't taken for the original.
        for gap in np.flatnonzero(own == _EMPTY):
            source = filled[np.searchsorted(filled, gap) % len(filled)]
            own[gap] = (own[source] + np.uint64(int(gap - source) % BUCKETS) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
    return registers(low[LAYOUT]).tobytes()


def _signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                sets = shingle_sets(batch.column("text"), k)
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id"),
                        "row": batch.column("row"),
                        "n": pa.array([len(s) for s in sets], pa.int64()),
                        "node": pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()),
                        "small": pa.array([small_signature(s) if 0 < len(s) <= SMALL_MOST else None for s in sets], pa.binary()),
                        "large": pa.array([large_signature(s) if len(s) >= LARGE_LEAST else None for s in sets], pa.binary()),
                    }
                )

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weight = powers(ROWS, 0x9FB21C651E98DF25)
    for batch in batches:
        for kind, name in enumerate(("small", "large")):
            column = batch.column(name)
            has = np.flatnonzero(np.asarray(column.is_valid()))
            if len(has):
                sig = np.frombuffer(b"".join(column.take(pa.array(has)).to_pylist()), np.uint16).reshape(len(has), BANDS, ROWS)
                key = mix((sig.astype(np.uint64) * weight).sum(2) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x51ED2701) + np.uint64(kind << 62))
                node = np.asarray(batch.column("node").take(pa.array(has)))
                yield pa.record_batch({"key": key.view(np.int64).ravel(), "band": np.tile(np.arange(BANDS, dtype=np.int32) + kind * BANDS, len(has)), "node": np.repeat(node, BANDS)})


def _agreement(a: pa.Array, b: pa.Array) -> np.ndarray:
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(len(c), REGISTERS) for c in (a, b))
    return (x == y).sum(1)


def _likely(threshold: float):
    """Keeps the pairs whose estimate from either kind of signature comes near the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            n, m = np.asarray(batch.column("n")), np.asarray(batch.column("m"))
            for name, buckets in (("small", 1), ("large", BUCKETS)):
                a, b = batch.column(name), batch.column(f"{name}_b")
                has = np.flatnonzero(np.asarray(a.is_valid()) & np.asarray(b.is_valid()))
                if len(has):
                    at = pa.array(has)
                    keep[has] |= estimate(_agreement(a.take(at), b.take(at)), n[has], m[has], buckets) >= threshold - MARGIN
            keep &= np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


class NearDuplicates:
    """Finds the links of one corpus step by step; see near_duplicates. signed carries row, a name of each row of docs."""

    def __init__(self, docs: DataFrame, k: int, threshold: int, row: Column | None = None):
        self.docs, self.k, self.threshold = texts(docs), k, threshold
        row = F.lit(None).cast(ROW) if row is None else row
        self.signed = cut(map_arrow(texts(docs, row.alias("row")), _signed(k), f"doc_id long, row {ROW}, n long, node long, small binary, large binary"))
        # Copies with one set are one node; partial aggregation settles large groups where they lie.
        self.nodes = cut(self.signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("small").alias("small"), F.first("large").alias("large")))
        self.count = self.nodes.count()
        keyed = map_arrow(self.nodes.select("node", "small", "large"), _bands, "key long, band int, node long")
        shared = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("first")).where("size > 1")
        self.buckets = cut(keyed.join(shared.select("key", "first"), "key"))
        release(docs.sparkSession)

    def likely(self, pairs: DataFrame) -> DataFrame:
        a = self.nodes.select(F.col("node").alias("a"), "n", "small", "large")
        b = self.nodes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("small").alias("small_b"), F.col("large").alias("large_b"))
        return map_arrow(pairs.distinct().join(a, "a").join(b, "b"), _likely(self.threshold / 100), "a long, b long")

    def sets(self, ids: DataFrame) -> DataFrame:
        """node and its full set, read again from the texts of the nodes in ids alone."""
        wanted = self.nodes.select("node", "doc_id").join(ids, "node")
        sent = self.docs.sparkSession.sparkContext.broadcast(bit_filter(wanted, F.xxhash64("doc_id"), self.count))
        k = self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = sent.value
            for whole in batches:
                for batch in pieces(whole.filter(pa.array(passes(bits, np.asarray(whole.column("h")))))):
                    sets = shingle_sets(batch.column("text"), k)
                    yield pa.record_batch({"node": pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()), "s": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))})

        found = map_arrow(self.docs.select(F.xxhash64("doc_id").alias("h"), "text"), run, "node long, s array<long>")
        out = cut(found.join(ids, "node").groupBy("node").agg(F.first("s").alias("s")))
        # The result is a checkpoint, which needs the filter no more.
        sent.destroy()
        return out

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that the full sets confirm."""
        pairs = cut(pairs)
        sets = self.sets(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        out = cut(both.where(100 * common >= self.threshold * (F.size("x") + F.size("y") - common)).select("a", "b"))
        release(self.docs.sparkSession)
        return out

    def stars(self) -> DataFrame:
        """Every node of a bucket with the bucket's first node."""
        return self.buckets.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))

    def split(self, state: DataFrame) -> DataFrame:
        """The buckets that hold several components as yet, with each node's.

        main is the component with most nodes in the bucket and pivot one of them, another one in each bucket; mains and
        strays count the nodes inside and outside it.
        """
        placed = self.buckets.select("key", "band", "node").join(state, "node", "left").withColumn("component", F.coalesce("component", "node"))
        each = placed.groupBy("key", "component").agg(F.count("*").alias("many"), F.min(F.struct(F.xxhash64("key", "node"), "node")).alias("one"))
        several = each.groupBy("key").agg(F.count("*").alias("parts"), F.sum("many").alias("size"), F.max(F.struct("many", "component", F.col("one.node").alias("pivot"))).alias("top")).where("parts > 1")
        several = several.select("key", F.col("top.component").alias("main"), "top.pivot", F.col("top.many").alias("mains"), (F.col("size") - F.col("top.many")).alias("strays"))
        return cut(placed.join(several, "key"))

    def spread(self, split: DataFrame) -> DataFrame:
        """Nodes outside their bucket's largest component, each with a node of that."""
        return split.where("component <> main").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))

    def rest(self, split: DataFrame) -> DataFrame:
        """All links across components of a bucket, compared block by block, a pair in the first band that it shares.

        Nodes of the largest component are compared with strays alone, and strays with all: blocks of strays meet each
        other and blocks of the largest component, so a node is sent as often as there are blocks of strays, a stray as
        often as there are blocks. A bucket's rows carry registers and 16-bit prints of their shingles. The prints two
        sets share are never fewer than their shingles, so no link is missed, and a task gives out hardly more than what
        verification confirms: nodes that resemble many others without being linked cost comparisons in a task, but no rows.
        """
        prints = map_arrow(self.sets(split.select("node").distinct()), _prints, "node long, prints binary")
        n_strays, n_mains = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("strays", "mains"))
        stray = F.col("component") != F.col("main")
        own = F.when(stray, F.pmod(F.xxhash64("node"), n_strays)).otherwise(n_strays + F.pmod(F.xxhash64("node"), n_mains)).cast("int")
        met = F.sequence(F.lit(0), F.when(stray, n_strays + n_mains).otherwise(n_strays) - 1)
        dealt = split.select("key", "band", "node", "component", stray.alias("stray"), own.alias("own"), F.explode(met).alias("other"))
        dealt = dealt.select("key", "band", "node", "component", "stray", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        signature = F.when(F.col("band") < BANDS, F.col("small")).otherwise(F.col("large")).alias("signature")
        full = dealt.join(self.nodes.select("node", "n", "small", "large").join(prints, "node"), "node").select("key", "i", "j", "band", "node", "component", "stray", "own", "n", signature, "prints")
        return map_arrow(full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), _across(self.threshold / 100), "a long, b long")


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.array(s, np.int64).astype(np.uint16).tobytes() for s in batch.column("s").to_pylist()]
        yield pa.record_batch({"node": batch.column("node"), "prints": pa.array(rows, pa.binary())})


def _across(threshold: float):
    def group(rows: pa.Table) -> pa.RecordBatch:
        node, part, n, own, stray = (np.asarray(rows[c]) for c in ("node", "component", "n", "own", "stray"))
        band, within = rows["band"][0].as_py(), rows["i"][0].as_py() == rows["j"][0].as_py()
        buckets = 1 if band < BANDS else BUCKETS
        sig = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint16).reshape(len(node), REGISTERS)
        prints = [np.frombuffer(p, np.uint16) for p in rows["prints"].to_pylist()]
        a_out, b_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        has = np.zeros(1 << 16, bool)
        for x in np.flatnonzero(stray):
            # Within a block each pair once; across blocks those of the other one, once if both are strays.
            facing = node > node[x] if within else (own != own[x]) & (~stray | (own > own[x]))
            at = np.flatnonzero(facing & (part != part[x]) & (np.minimum(n, n[x]) >= threshold * np.maximum(n, n[x]) - 1e-9))
            same = sig[at] == sig[x]
            close = estimate(same.sum(1), n[at], np.full(len(at), n[x]), buckets) >= threshold - MARGIN
            at = at[close & (same.reshape(-1, BANDS, ROWS).all(2).argmax(1) == band % BANDS)]
            if not len(at):
                continue
            has[prints[x]] = True
            shared = np.add.reduceat(has[np.concatenate([prints[y] for y in at])], np.cumsum([0] + [len(prints[y]) for y in at[:-1]]), dtype=np.int64)
            has[prints[x]] = False
            at = at[shared >= threshold * (n[at] + n[x] - shared) - 1e-9]
            a_out.append(np.full(len(at), node[x]))
            b_out.append(node[at])
        a, b = np.concatenate(a_out), np.concatenate(b_out)
        return pa.record_batch({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = list(zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j")), strict=True))
            at = 0
            while at < len(names):
                to = at
                while to < len(names) and names[to] == names[at]:
                    to += 1
                if last is not None and names[at] != last:
                    yield group(pa.Table.from_batches(held))
                    held = []
                last = names[at]
                held.append(batch.slice(at, to - at))
                at = to
        if held:
            yield group(pa.Table.from_batches(held))

    return run


def _placed(docs: DataFrame, k: int, threshold: int, row: Column | None = None) -> tuple[NearDuplicates, DataFrame]:
    """What was found, and node, doc_id, component of every node."""
    found = NearDuplicates(docs, k, threshold, row)
    state = components(found.verified(found.likely(found.stars())))
    split = found.split(state)
    if split.limit(1).count():
        state = joined(state, found.verified(found.likely(found.spread(split))))
        split = found.split(state)
        if split.limit(1).count():
            state = joined(state, found.verified(found.rest(split).distinct()))
    release(docs.sparkSession)
    return found, found.nodes.select("node", "doc_id").join(state, "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_duplicates(docs: DataFrame, *, k: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs.

    Words are what ASCII white space separates, A-Z in lower case; a set holds the distinct shingles of k words, of a
    shorter text its whole sequence; null, empty and blank texts have an empty set and are linked with nothing. Texts
    whose sets have 100 * intersection >= threshold * union are linked, and a component is what links reach. component_id
    is its smallest doc_id; kept marks the rows with that id. Repeated rows are in one component, and have all the same
    values; rows with a null id take part in links, and are kept only where a component has no other.

    Texts with one set are a single node. Nodes that share a band of registers are candidates: first each with the first
    node of its bucket, then what is left outside a bucket's largest component with one of that, then all pairs across
    components. So a group of near copies costs a few pairs a copy and no link is left out that could join two components.
    Candidates whose estimate is near the threshold are confirmed on the full sets.
    """
    found, named = _placed(docs, k, threshold)
    # The smallest id of each component; partial sums keep a large component from meeting in one task.
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = named.select("node", "component").join(least, "component").select("node", "component_id")
    out = found.signed.select("doc_id", F.col("n").alias("n_shingles"), "node").join(of, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, *, k: int = 5, threshold: int = 80) -> DataFrame:
    """One row, all columns, of each component of near_duplicates: that with the smallest doc_id, one without only if no
    row has any; between rows of one id that with the least hash of its columns.

    Rows are told apart by all their columns, not by doc_id: different texts under one id or none are each their own
    component's. Null, empty and blank texts are linked with nothing, so all stay but repeats of a whole row.
    """
    # A hash passes over nulls, so what is null is hashed as well.
    hashed = [x for f in docs.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant")) for x in (F.col(f"`{f.name}`"), F.col(f"`{f.name}`").isNull())]
    row = F.struct(F.xxhash64(*hashed).alias("a"), F.xxhash64(F.lit(1), *hashed).alias("b"))
    found, named = _placed(docs, k, threshold, row)
    rows = found.signed.select("doc_id", "row", "node").join(named.select("node", "component"), "node", "left")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    best = rows.where("component is not null").groupBy("component").agg(first).select(F.col("first.row").alias("_row"))
    kept = best.unionByName(rows.where("component is null").select(F.col("row").alias("_row"))).distinct()
    return docs.withColumn("_row", row).join(kept, "_row").dropDuplicates(["_row"]).select(docs.columns)
