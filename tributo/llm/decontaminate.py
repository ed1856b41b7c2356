"""Benchmark decontamination by template canonicalisation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, cut, map_arrow, passes
from .tokens import LETTERED, hash_of, mix, pieces, powers, words

#: Units of a window, and the least number of literal ones with which its template alone is compared.
WINDOW = 8
LITERALS = 5
#: Names of contaminated rows that are broadcast at most, some 30 MB.
BROADCAST_ROWS = 500_000
#: Items of fewer units than this match only texts that hold nothing else.
WHOLE = 3

# Units that, after a number, are a slot.
UNITS = (
    "kg g mg km m cm mm l ml s h min hour hours minute minutes second seconds day days week weeks month months year years "
    "mile miles foot feet inch inches pound pounds dollar dollars euro euros cent cents percent degree degrees watt watts volt volts"
).split()
NUMBER, UNIT, NAME = (np.uint64(x) for x in (0x6E756D626572, 0x756E6974, 0x6E616D65))

_BREAKS = np.zeros(256, bool)
_BREAKS[[ord(c) for c in ".!?:;|\n"]] = True
_JOINS = np.zeros(256, bool)
_JOINS[[ord(","), ord(".")]] = True


@dataclass
class Template:
    """One entry a unit: its canonical and raw hash, whether it is a slot, and its row."""

    canonical: np.ndarray
    raw: np.ndarray
    slot: np.ndarray
    row: np.ndarray


def canonicalise(column: pa.Array, opening_names: bool = False) -> Template:
    """Numbers, units after a number, and capitalised words inside a sentence become typed placeholders.

    A number with marks inside (1,200 or 3.50) is one unit, and so is a name of several words. With opening_names a
    text's first word is a name too if it is capitalised, as it would be inside a sentence.
    """
    found, body, offsets = words(column, LETTERED, letters=True)
    size = len(found.start)
    if not size:
        return Template(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64))
    base = int(offsets[0])
    own = body[base : int(offsets[-1])]
    start, end = found.start - base, found.end - base
    digits = np.concatenate([[0], np.cumsum((own >= 48) & (own < 58))])
    breaks = np.concatenate([[0], np.cumsum(_BREAKS[own])])
    number = digits[end] > digits[start]
    follows = np.concatenate([[False], found.row[1:] == found.row[:-1]])
    before = np.concatenate([start[:1], end[:-1]])
    opens = follows & (breaks[start] > breaks[np.minimum(before, start)])
    if not opening_names:
        opens |= ~follows
    capital = (own[start] >= 65) & (own[start] < 91) & (end - start > 1) & (own[np.minimum(start + 1, len(own) - 1)] >= 97)
    name = capital & ~opens & ~number
    unit = np.zeros(size, bool)
    unit[1:] = number[:-1]
    unit &= follows & np.isin(found.hash, np.array(sorted(hash_of(u) for u in UNITS), np.uint64)) & ~number
    canonical = found.hash.copy()
    canonical[number], canonical[unit], canonical[name] = NUMBER, UNIT, NAME
    near = follows & (start - before == 1)
    gap = own[np.minimum(before, len(own) - 1)]
    continues = near & (np.concatenate([[False], name[:-1]]) & name & (gap == 32) | np.concatenate([[False], number[:-1]]) & number & _JOINS[gap])
    first = np.flatnonzero(~continues)
    place = np.arange(size) - np.repeat(first, np.diff(np.append(first, size)))
    raw = mix(np.add.reduceat(found.hash * powers(int(place.max()) + 1, 0x9FB21C651E98DF25)[place], first))
    return Template(canonical[first], raw, (number | unit | name)[first], found.row[first])


def windows(t: Template, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n units from each place on, and which of these windows lie in one text.

    A window with LITERALS literal units (or none but such) goes by its template, one with fewer by its raw words, as
    placeholders alone would say too little. Windows of fewer than WHOLE units must be the whole text.
    """
    size = len(t.raw) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    slots = np.concatenate([[0], np.cumsum(t.slot)])
    template = n - (slots[n:] - slots[:size]) >= min(LITERALS, n)
    h, exact = np.full(size, n, np.uint64), np.full(size, n, np.uint64)
    for i, p in enumerate(powers(n, 0xD6E8FEB86659FD93)):
        h += t.canonical[i : size + i] * p
        exact += t.raw[i : size + i] * p
    inside = t.row[:size] == t.row[n - 1 :]
    if n < WHOLE:
        counts = np.bincount(t.row)
        inside &= counts[t.row[:size]] == n
    return np.where(template, mix(h), mix(exact ^ np.uint64(0xE7037ED1A0B428DB))), inside


def spans(t: Template, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and length of the stretches of more than ``window`` units from a literal unit to the LITERALS-th.

    Where slots stand so dense that windows hold too few literals, these have as many, however long they are; they go by
    their template. There is one a literal unit at most.
    """
    literal = np.flatnonzero(~t.slot)
    start, last = literal[: max(0, len(literal) - LITERALS + 1)], literal[LITERALS - 1 :]
    keep = (last - start >= window) & (t.row[start] == t.row[last])
    start, length = start[keep], (last - start)[keep] + 1
    if not len(start):
        return np.zeros(0, np.uint64), start, length
    base = 0xD6E8FEB86659FD93
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(t.canonical * powers(len(t.canonical), base), dtype=np.uint64)])
    back = powers(int(start.max()) + 1, pow(base, -1, 1 << 64))
    return mix((sums[start + length] - sums[start]) * back[start] + length.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)), start, length


def _of_items(window: int):
    """The windows of benchmark items, one row each: h, n (0: a stretch), item_id, raw (its units' raw hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                ids = np.asarray(batch.column("item_id"))
                for opening in (False, True):
                    t = canonicalise(batch.column("text"), opening)
                    size = np.bincount(t.row, minlength=batch.num_rows)
                    for n in range(1, window + 1):
                        h, inside = windows(t, n)
                        # Shorter items are one window.
                        at = np.flatnonzero(inside & ((size[t.row[: len(h)]] == n) if n < window else True))
                        raw = [t.raw[i : i + n].view(np.int64) for i in at]
                        yield pa.record_batch({"h": h[at].view(np.int64), "n": np.full(len(at), n, np.int32), "item_id": ids[t.row[at]], "raw": pa.array(raw, pa.list_(pa.int64()))})
                    h, at, n = spans(t, window)
                    raw = [t.raw[i : i + m].view(np.int64) for i, m in zip(at, n, strict=True)]
                    yield pa.record_batch({"h": h.view(np.int64), "n": np.zeros(len(at), np.int32), "item_id": ids[t.row[at]], "raw": pa.array(raw, pa.list_(pa.int64()))})

    return run


class Index:
    """The benchmark's windows as a table, a filter over their hashes, the window lengths that occur, and whether stretches do."""

    def __init__(self, benchmark: DataFrame, window: int):
        items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
        # The two readings of an item's first word give most windows twice.
        self.table = cut(map_arrow(items, _of_items(window), "h long, n int, item_id long, raw array<long>").distinct())
        counts = {r.n: r["count"] for r in self.table.groupBy("n").count().collect()}
        self.lengths, self.dense = sorted(n for n in counts if n), 0 in counts
        self.sent = benchmark.sparkSession.sparkContext.broadcast(bit_filter(self.table, F.col("h"), sum(counts.values())))


def _row(docs: DataFrame) -> list[Column]:
    """Two hashes that name a row by doc_id and text; rows alike in both have the same windows."""
    return [F.xxhash64(F.lit(s), F.col("doc_id").cast("long"), F.col("doc_id").isNull(), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias(c) for s, c in ((1, "_a"), (2, "_b"))]


def _hits(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """_a, _b, item_id, at, changed: windows of texts, by name and place, that are one of an item's with consistent slots."""
    index = Index(benchmark, window)
    sent, lengths, dense = index.sent, index.lengths, index.dense

    def told(batch: pa.RecordBatch, t: Template, h: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        row = pa.array(t.row[at])
        raw = [t.raw[i : i + m].view(np.int64) for i, m in zip(at, n, strict=True)]
        return pa.record_batch({"_a": batch.column("_a").take(row), "_b": batch.column("_b").take(row), "at": at.astype(np.int64) - np.searchsorted(t.row, t.row[at]), "h": h.view(np.int64), "own": pa.array(raw, pa.list_(pa.int64()))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for whole in batches:
            for batch in pieces(whole):
                t = canonicalise(batch.column("text"))
                for n in lengths:
                    h, inside = windows(t, n)
                    at = np.flatnonzero(inside & passes(bits, h))
                    if len(at):
                        yield told(batch, t, h[at], at, np.full(len(at), n))
                if dense:
                    h, at, n = spans(t, window)
                    if (found := passes(bits, h)).any():
                        yield told(batch, t, h[found], at[found], n[found])

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    met = map_arrow(docs.select(*_row(docs), text), run, "_a long, _b long, at long, h long, own array<long>")
    # An item's value must be one value of the text: each unit equals that at its first place in the item's window.
    consistent = F.expr("size(raw) = size(own) and forall(sequence(0, size(raw) - 1), i -> own[i] = own[array_position(raw, raw[i]) - 1])")
    hits = met.join(index.table, "h").where(consistent).select("_a", "_b", "item_id", "at", (F.col("raw") != F.col("own")).alias("changed"))
    # Repeated rows give one window several times; a window with the item's own values in one place isn't changed.
    return hits.groupBy("_a", "_b", "item_id", "at").agg(F.min("changed").alias("changed"))


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """doc_id, contaminated, items (sorted item_ids), n_windows, reparameterised; one row for each row of docs.

    A document is contaminated if a window of template units is also one of a benchmark item and the slots fit: a value
    of the item must be one value in the document's window; different ones may become equal, and each window is judged
    by itself. reparameterised says that some value then differs. Windows with few literals must have the item's own
    words; where slots are dense, stretches of as many literals as a window needs, and all that lies between them, count
    as windows too, however long. An item of few literals as a whole is found in its own words alone. An item of fewer units than a window is one window; one of fewer than WHOLE units is too common to be told
    from other text and matches only texts of these units alone. Letters of scripts without blanks are units each.

    Null and empty documents are clean, null and empty items never match, items with one text are reported each, and a
    null item_id is left out. Repeated rows get the same values each. Very long texts are split between words.

    Windows that pass a filter sized by the benchmark's are joined by hash with the table of all items' windows, so the benchmark
    may be of any size.
    """
    hits = _hits(docs, benchmark, window)
    each = hits.groupBy("_a", "_b", "item_id").agg(F.count("*").alias("n"), F.max("changed").alias("changed"))
    found = each.groupBy("_a", "_b").agg(F.sort_array(F.collect_list("item_id")).alias("items"), F.sum("n").alias("n_windows"), F.max("changed").alias("changed"))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_row(docs))
    out = named.join(found, ["_a", "_b"], "left")
    return out.select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce("items", F.array().cast("array<long>")).alias("items"),
        F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"),
        F.coalesce("changed", F.lit(False)).alias("reparameterised"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns whatever their names, that contamination finds clean; nulls and empty texts are.

    The contaminated rows' names, 16 bytes each, are broadcast if they are BROADCAST_ROWS at most, so that texts aren't
    shuffled; more of them are joined.
    """
    bad = cut(_hits(docs, benchmark, window).select("_a", "_b").distinct())
    names = [f"_{c}_{len(docs.columns)}" for c in ("first", "second")]
    bad = bad.select(F.col("_a").alias(names[0]), F.col("_b").alias(names[1]))
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    named = docs.select("*", *(c.alias(n) for c, n in zip(_row(docs), names, strict=True)))
    return named.join(bad, names, "left_anti").select(docs.columns)
