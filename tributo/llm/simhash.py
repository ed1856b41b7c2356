"""SimHash near-dedup: fingerprints of whole texts, and vantage-point trees that find all that lie within a few bits."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, release, texts
from .components import components

#: Fingerprints that the shared tree is grown from, at most: 2 MB on the driver, whatever the input.
SAMPLE = 1 << 18
#: Fingerprints that a shard of the shared tree should hold, and the least of a sample that a shard stands on.
SHARD, LEAST = 1 << 16, 32
#: Residents that a task holds at once; a shard of more is dealt into blocks, which all its guests visit.
BLOCK = 1 << 17
#: Residents of a leaf of the trees that tasks grow.
LEAF = 256
#: Vantage points tried at each node.
CHOICES = 12
#: Fingerprints placed, or compared, at once.
PIECE = 1 << 13
#: Bytes of text split into words at once, but for a longer word.
RUN = 1 << 20

_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _runs(body: bytes) -> Iterator[list[bytes]]:
    """The words of the text, a run of whole words at a time. bytes.split() parts at the contract's six characters."""
    at = 0
    while at < len(body):
        gap = _GAP.search(body, at + RUN)
        to = gap.start() if gap else len(body)
        yield body[at:to].split()
        at = to


def fingerprint(body: bytes, k: int = 3) -> int:
    """64 bits, each set where over half the hashes of the text's shingles of k words have it; 0 without words."""
    total, n, carried = np.zeros(64, np.int64), 0, []
    for run in _runs(body.lower()):
        words = carried + run
        if len(words) < k:
            carried = words
            continue
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths)
        starts, joined = (ends - lengths).tolist(), b" ".join(words)
        spans = zip(starts, (ends[k - 1 :] - 1).tolist(), strict=False)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, (joined[a:b] for a, b in spans), repeat(42)), np.uint64, len(words) - k + 1)
        for at in range(0, len(hashes), PIECE):
            total += np.unpackbits(hashes[at : at + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n, carried = n + len(hashes), words[len(words) - k + 1 :]
    if not n and carried:
        return xxhash.xxh64_intdigest(b" ".join(carried), 42)
    return int(np.packbits((2 * total > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_buffer().to_pybytes(), k) for t in batch.column("text")], np.uint64)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "fp": found.view(np.int64)})

    return run


@dataclass
class Tree:
    """Nodes part fingerprints by their distance to a vantage point; a child is a node, or shard s as -1 - s."""

    vantage: np.ndarray
    cut: np.ndarray
    near: np.ndarray
    far: np.ndarray
    shards: int
    radius: int

    @classmethod
    def grow(cls, some: np.ndarray, most: int, radius: int, seed: int = 7) -> Tree:
        """Parts ``some`` until a shard has ``most`` of them or can't be parted so that it saves comparisons.

        Of a few vantage points and all distances the cut with the least work is taken: rows on a side times those that
        have to look at it, which counts what lies within the radius of the border on both sides.
        """
        rng = np.random.default_rng(seed)
        vantage, cut_, near, far, shards = [], [], [], [], 0
        todo: list[tuple[np.ndarray, int, bool]] = [(some, -1, False)]
        while todo:
            own, parent, is_far = todo.pop()
            best = None
            if len(own) > most:
                for v in own[rng.integers(0, len(own), CHOICES)]:
                    at = np.bincount(np.bitwise_count(own ^ v), minlength=65)[:65]
                    inner = np.cumsum(at).astype(np.float64)
                    outer = len(own) - inner
                    # What would look at the near side (up to radius beyond the cut) and at the far one (from radius before it).
                    near_by = np.append(inner[radius:], np.full(radius, inner[-1]))
                    far_by = len(own) - np.append(np.zeros(radius), inner[:-radius])
                    work = np.where((inner > 0) & (outer > 0), inner * near_by + outer * far_by, np.inf)
                    t = int(work.argmin())
                    if work[t] < 0.98 * len(own) ** 2 and (best is None or work[t] < best[0]):
                        best = (work[t], v, t)
            if best is None:
                child, shards = -1 - shards, shards + 1
            else:
                child = len(vantage)
                _, v, t = best
                vantage.append(v), cut_.append(t), near.append(0), far.append(0)
                inside = np.bitwise_count(own ^ v) <= t
                todo += [(own[~inside], child, True), (own[inside], child, False)]
            if parent >= 0:
                (far if is_far else near)[parent] = child
        return cls(np.array(vantage, np.uint64), np.array(cut_, np.int64), np.array(near, np.int64), np.array(far, np.int64), shards, radius)

    def place(self, fp: np.ndarray, visiting: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, shard and whether it is a guest there.

        A resident lies in one shard. Of two residents within the radius whose ways part, the one on the near side visits
        the far one's shard: distances to a vantage point differ by the radius at most, so a guest follows each side that
        has residents within that bound, and a branch without any is pruned. Visiting rows are guests everywhere.
        """
        row, node = np.arange(len(fp)), np.full(len(fp), 0 if len(self.vantage) else -1)
        guest = np.full(len(fp), visiting)
        out = []
        while len(row):
            done = node < 0
            out.append((row[done], -1 - node[done], guest[done]))
            row, node, guest = row[~done], node[~done], guest[~done]
            d = np.bitwise_count(fp[row] ^ self.vantage[node]).astype(np.int64) - self.cut[node]
            inner, outer = d <= np.where(guest, self.radius, 0), d > -self.radius
            away = guest | (d <= 0)
            row, node, guest = np.concatenate([row[inner], row[outer]]), np.concatenate([self.near[node[inner]], self.far[node[outer]]]), np.concatenate([guest[inner], away[outer]])
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))


def hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins the labels of linked rows i, j, in place, and gives the links that were needed: one less than what they join."""
    kept = [(i[:0], j[:0])]
    while True:
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            break
        high, at = np.unique(np.maximum(a, b), return_index=True)
        kept.append((i[at], j[at]))
        to = np.arange(len(label))
        # Each label moves to a smaller one, so there are no circles.
        to[high] = np.minimum(a, b)[at]
        while (to[to] != to).any():
            to = to[to]
        label[:] = to[label]
    return tuple(np.concatenate(x) for x in zip(*kept, strict=True))


class Block:
    """Residents of a shard in a tree of their own: links among them, and from guests to them."""

    def __init__(self, residents: np.ndarray, radius: int):
        self.fp, self.radius = residents, radius
        self.label = np.arange(len(residents))
        self.tree = Tree.grow(residents, LEAF, radius)
        self.members: list[np.ndarray] = [np.zeros(0, np.int64)] * self.tree.shards
        rows, leaves, guests = self._placed(residents, False)
        for leaf, at in self._by_leaf(leaves[~guests]):
            self.members[leaf] = rows[~guests][at]
        links = [self._near(rows[at], residents, leaf, within=True) for leaf, at in self._by_leaf(leaves)]
        self.links = tuple(np.concatenate([x[s] for x in links]) if links else np.zeros(0, np.int64) for s in (0, 1))

    def _placed(self, fp: np.ndarray, visiting: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [(r + at, s, g) for at in range(0, len(fp), PIECE) for r, s, g in [self.tree.place(fp[at : at + PIECE], visiting)]]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))

    @staticmethod
    def _by_leaf(leaves: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(leaves, kind="stable")
        found, at = np.unique(leaves[order], return_index=True)
        yield from zip(found.tolist(), np.split(order, at[1:]), strict=True)

    def _near(self, rows: np.ndarray, fp: np.ndarray, leaf: int, within: bool) -> tuple[np.ndarray, np.ndarray]:
        """Links from rows of fp to members of the leaf, compared in parts: those that join something."""
        own, out = self.members[leaf], []
        step = max(1, (1 << 20) // max(1, len(own)))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            i, j = np.divmod(np.flatnonzero((np.bitwise_count(fp[part][:, None] ^ self.fp[own][None, :]) <= self.radius).ravel()), len(own))
            i, j = part[i], own[j]
            if within:
                out.append(hook(self.label, i, j))
            elif len(i):
                # Residents with one label are linked already; a guest needs one of each.
                _, first = np.unique(i * len(self.label) + self.label[j], return_index=True)
                out.append((i[first], j[first]))
        return tuple(np.concatenate([x[s] for x in out]) if out else np.zeros(0, np.int64) for s in (0, 1))

    def visit(self, guests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links from guests to residents, as fingerprints: one for each guest and group of linked residents in a leaf."""
        rows, leaves, _ = self._placed(guests, True)
        found = [self._near(rows[at], guests, leaf, within=False) for leaf, at in self._by_leaf(leaves)]
        i, j = (np.concatenate([x[s] for x in found]) if found else np.zeros(0, np.int64) for s in (0, 1))
        return guests[i], self.fp[j]


def _links(radius: int):
    """Rows sorted by shard, block and guest: a block's residents come first and are held, guests pass by."""

    def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"a": a.view(np.int64), "b": b.view(np.int64)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, block = None, [], None

        def settled() -> Iterator[pa.RecordBatch]:
            nonlocal block
            if block is None and held:
                block = Block(np.concatenate(held), radius)
                held.clear()
                yield edges(*(block.fp[x] for x in block.links))

        for batch in batches:
            shard, part, guest = (np.asarray(batch.column(c)) for c in ("shard", "part", "guest"))
            fp = np.asarray(batch.column("fp")).view(np.uint64)
            turns = np.flatnonzero(np.diff(shard) | np.diff(part) | np.diff(guest)) + 1
            for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(fp)], strict=True):
                if a == b:
                    continue
                if name != (shard[a], part[a]):
                    yield from settled()
                    name, held, block = (shard[a], part[a]), [], None
                if not guest[a]:
                    held.append(fp[a:b])
                    continue
                yield from settled()
                if block is not None:
                    for at in range(a, b, PIECE):
                        yield edges(*block.visit(fp[at : min(b, at + PIECE)]))
        yield from settled()

    return run


def links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """a, b: links between the distinct fingerprints fp (long) of prints, as many as connect all that lie within radius.

    Whatever two of them differ in at most radius bits are connected by links, each of which is exact; a group of m costs
    hardly more than m - 1 of them. prints must have no repeats and no nulls.

    A tree grown from a bounded sample deals all fingerprints into shards; those near a border also visit the shard beyond
    it. Shards of more than BLOCK residents are dealt into blocks, each resident looking at those of later blocks as a guest.
    """
    spark = prints.sparkSession
    total = prints.count()
    share = min(1.0, 0.95 * SAMPLE / max(1, total))
    some = prints.where(F.pmod(F.xxhash64(F.lit(5), "fp"), F.lit(1 << 20)) < int((1 << 20) * share)) if share < 1 else prints
    sample = np.sort(np.array(some.select("fp").toArrow()["fp"].to_numpy(), np.int64)).view(np.uint64)
    tree = Tree.grow(sample, max(LEAST, int(SHARD * len(sample) / max(1, total))), radius)
    sent = spark.sparkContext.broadcast(tree)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column("fp")).view(np.uint64)
            for at in range(0, len(fp), PIECE):
                _, shard, guest = sent.value.place(fp[at : at + PIECE])
                yield pa.record_batch({"shard": shard[~guest].astype(np.int32)})

    # A row a shard: there are at most SAMPLE / LEAST.
    sizes = map_arrow(prints, home, "shard int").groupBy("shard").count().collect()
    parts = np.ones(max(1, tree.shards), np.int64)
    for r in sizes:
        parts[r["shard"]] = -(-r["count"] // BLOCK)
    counts = spark.sparkContext.broadcast(parts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = np.asarray(batch.column("fp")).view(np.uint64)
            for at in range(0, len(whole), PIECE):
                fp = whole[at : at + PIECE]
                row, shard, guest = sent.value.place(fp)
                many = counts.value[shard]
                own = (fp[row] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % many
                # Residents go to their own block and, as guests, to later ones; guests to all.
                start = np.where(guest, 0, own)
                times = many - start
                row, shard, guest, own = (np.repeat(x, times) for x in (row, shard, guest, own))
                part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(start, times)
                yield pa.record_batch({"shard": shard.astype(np.int32), "part": part.astype(np.int32), "guest": (guest | (part != own)).astype(np.int8), "fp": fp[row].view(np.int64)})

    dealt = map_arrow(prints, deal, "shard int, part int, guest byte, fp long").repartition("shard", "part").sortWithinPartitions("shard", "part", "guest")
    return map_arrow(dealt, _links(radius), "a long, b long")


def simhash_duplicates(docs: DataFrame, *, k: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id: one row for each row of docs.

    Words are what ASCII white space separates, A-Z in lower case. A bit of the fingerprint is set where over half of the
    XXH64 values (seed 42) of the text's shingles of k words have it, repeats counted; fewer words are one shingle, null,
    empty and blank texts have fingerprint zero, which is linked like any other. Fingerprints that differ in at most radius
    bits are linked; a component is what links reach, component_id its smallest doc_id, null where no row has any.
    Repeated rows have the same values each; rows with a null id take part in links. Other columns are ignored; no rows
    give none.

    Texts are read once. Equal fingerprints are one node, however many rows have them, and all links between different
    ones are searched exactly; see links.
    """
    # A fingerprint a row, written once.
    signed = cut(map_arrow(texts(docs), _fingerprints(k), "doc_id long, fp long"))
    nodes = cut(signed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    release(docs.sparkSession)
    state = components(links(nodes.select("fp"), radius))
    named = nodes.join(state.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.select("fp", "component").join(ids, "component").select("fp", "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return signed.join(of, "fp").select("doc_id", hexed, "component_id")
