"""Removal of repeated byte strings by merging shard Burrows-Wheeler columns with interleave refinement."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import GRAM, anchors, gram_hashes
from .common import cut, map_arrow, release, texts, utf8
from .tokens import mix, pieces

#: Segments of one shard transform, and segments whose shards are merged at once: their columns take some megabytes.
SHARD = 2_048
UNIT = 4_096
#: More segments than this aren't merged in one task: they are split by more of what the strings they share must have.
HOT = 16_384
#: Stands for bytes beyond a text's ends; no byte of UTF-8.
PAD = 0xFF


def transform(rows: np.ndarray) -> np.ndarray:
    """The Burrows-Wheeler columns of a shard of equally long rows: column c lists the bytes before the suffixes from c + 1
    on, in the order of these suffixes."""
    columns, order = np.ascontiguousarray(rows.T), np.arange(len(rows))
    out = np.empty_like(columns)
    for c in range(len(columns) - 1, -1, -1):
        out[c] = columns[c][order]
        order = order[np.argsort(out[c], kind="stable")]
    return out


def interleaved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The transform of two shards' rows together, from their transforms alone.

    The interleave says, place by place, from which shard the next suffix comes. It starts with one shard after the
    other and is refined a byte a round: the next bytes, read from each shard's column in turn, deal it out stably.
    """
    from_b = np.repeat([False, True], [a.shape[1], b.shape[1]])
    out = np.empty((len(a), len(from_b)), a.dtype)
    for c in range(len(a) - 1, -1, -1):
        out[c][~from_b], out[c][from_b] = a[c], b[c]
        from_b = from_b[np.argsort(out[c], kind="stable")]
    return out


def _lowest(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Least of values[start:stop] for each pair, all start < stop, by minima over powers of two."""
    width = stop - start
    level = np.frexp(width.astype(np.float64))[1] - 1
    out = np.empty(len(start), values.dtype)
    table, span = values, 1
    for k in range(int(level.max()) + 1 if len(level) else 0):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[start[at]], table[stop[at] - span])
        table, span = np.minimum(table[:-span], table[span:]), span * 2
    return out


def refine(segments: np.ndarray, before_: np.ndarray, after_: np.ndarray, left: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the least and the greatest offset o for which its string of ``length`` bytes from left - o on is another row's too.

    Rows are the surroundings of one anchor occurrence each, ``left`` bytes before it and ``length`` from it on. Each
    shard of SHARD rows has its transform; shards are merged two by two by refining their interleave. In the rounds of
    the last merge, neighbours' common prefixes follow from those of the round before: suffixes that get the same byte
    in front have one more in common than all that lay between them. Places where ``length`` is reached are the repeated
    intervals. No suffix is compared or sorted again. A row has before_ real bytes before its anchor and after_ from it
    on; strings that reach into the padding don't count. Without any: (length, -1).
    """
    n = len(segments)
    least, most = np.full(n, length), np.full(n, -1)
    if n < 2:
        return least, most
    shards = [transform(segments[at : at + SHARD]) for at in range(0, n, SHARD)]
    while len(shards) > 1:
        shards = [interleaved(*two) if len(two) == 2 else two[0] for two in (shards[i : i + 2] for i in range(0, len(shards), 2))]
    merged, order, common = shards[0], np.arange(n), np.zeros(n, np.int16)
    for c in range(left + length - 1, -1, -1):
        step = np.argsort(merged[c], kind="stable")
        byte = merged[c][step]
        same = np.flatnonzero(byte[1:] == byte[:-1]) + 1
        between = _lowest(common, step[same - 1] + 1, step[same] + 1)
        common = np.zeros(n, np.int16)
        common[same] = np.minimum(between + 1, length)
        order = order[step]
        if c <= left and len(full := np.flatnonzero(common >= length)):
            o = left - c
            rows = np.unique(order[np.concatenate([full - 1, full])])
            rows = rows[(o <= before_[rows]) & (o >= length - after_[rows])]
            most[rows] = np.maximum(most[rows], o)
            least[rows] = np.minimum(least[rows], o)
    return least, most


def _place(pos: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return (pos << 20) | (before << 10) | after


def _occurrences(length: int):
    left = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                body, offsets = utf8(batch.column("text"))
                base = int(offsets[0])
                own, at = body[base : int(offsets[-1])], offsets - base
                pos = anchors(own, at[1:], at[:-1], length)
                if not len(pos):
                    continue
                h = mix(gram_hashes(own)[pos])
                row = np.searchsorted(at, pos, side="right") - 1
                before, after = np.minimum(left, pos - at[row]), np.minimum(length, at[row + 1] - pos)
                raw = own.tobytes()
                digest = xxhash.xxh3_64_intdigest
                seg = np.array([digest(raw[p - b : p + a], b) for p, b, a in zip(pos.tolist(), before.tolist(), after.tolist(), strict=True)], np.uint64)
                # One row a text, as long as its rows are only stored.
                rows, first = np.unique(row, return_index=True)
                spans = pa.array(np.append(first, len(pos)).astype(np.int32))
                found = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(_place(pos - at[row], before, after))], ["h", "seg", "place"])
                yield pa.record_batch({"key": batch.column("key").take(pa.array(rows)), "found": pa.ListArray.from_arrays(spans, found)})

    return run


def _segments(length: int):
    left = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in _KINDS}
            for text, key, reps in zip(batch.column("text").to_pylist(), batch.column("key").to_pylist(), batch.column("reps").to_pylist(), strict=True):
                body = text.encode()
                for r in reps:
                    pos, b, a = r["place"] >> 20, (r["place"] >> 10) & 1023, r["place"] & 1023
                    own = bytes([PAD]) * (left - b) + body[pos - b : pos + a] + bytes([PAD]) * (length - a)
                    for c, v in zip(out, (r["h"], key, pos, b, a, r["single"], r["hot"], own), strict=True):
                        out[c].append(v)
                    if len(out["g"]) >= UNIT:
                        yield pa.record_batch({c: pa.array(v, _KINDS[c]) for c, v in out.items()})
                        out = {c: [] for c in out}
            if out["g"]:
                yield pa.record_batch({c: pa.array(v, _KINDS[c]) for c, v in out.items()})

    return run


_KINDS = {"g": pa.int64(), "key": pa.int64(), "pos": pa.int64(), "before": pa.int64(), "after": pa.int64(), "single": pa.bool_(), "hot": pa.bool_(), "bytes": pa.binary()}


def _merged(length: int):
    """Spans of segments that stand alone in their whole, from batches in which all segments of a group follow each other."""
    left = length - GRAM

    def unit(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        key, pos, before, after, lo, hi = (np.asarray(rows[c]) for c in ("key", "pos", "before", "after", "lo", "hi"))
        single = np.asarray(rows["single"])
        segments = np.frombuffer(b"".join(rows["bytes"].to_pylist()), np.uint8).reshape(-1, left + length)
        for range_ in np.unique(lo * 1024 + hi).tolist():
            low, high = divmod(range_, 1024)
            at = np.flatnonzero((lo == low) & (hi == high))
            # Offsets from low to high are those from 0 on of an anchor that begins so much earlier.
            least, most = refine(segments[at, left - high : left - low + length], before[at] - low, after[at] + low, high - low, length)
            keep = single[at] & (most >= least)
            start = pos[at] - low
            yield pa.record_batch({"key": key[at][keep], "start": (start - most)[keep], "stop": (start - least + length)[keep]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            g, at = np.asarray(batch.column("g")), 0
            cuts = np.flatnonzero(np.diff(g)) + 1
            if size >= UNIT and g[0] != last:
                yield from unit(held)
                held, size = [], 0
            # A unit ends where a group ends, once it has enough segments.
            while at < len(g):
                k = np.searchsorted(cuts, at + max(1, UNIT - size))
                to = int(cuts[k]) if k < len(cuts) else len(g)
                held.append(batch.slice(at, to - at))
                size += to - at
                at = to
                if k < len(cuts):
                    yield from unit(held)
                    held, size = [], 0
            last = g[-1]
        if held:
            yield from unit(held)

    return run


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """key, start, stop: byte spans, possibly overlapping, that cover what repeats, by the text's key (see keyed).

    Every string of ``length`` bytes has an anchor that its bytes alone choose, so equal strings meet under one anchor
    hash. Anchors met once are done with. Of the others, an occurrence whose surroundings occur again as a whole is
    covered from end to end. Of the surroundings that differ one each is read from the texts and merged, anchor by anchor.
    """
    left = length - GRAM
    if not GRAM < length < 1 << 10:
        raise ValueError(f"length must be from {GRAM + 1} to 1023")
    keyed_docs = keyed(docs)
    met = _met(keyed_docs, length)
    # What only led there is out of scope, so its shuffles and its stored rows can go.
    release(docs.sparkSession)
    pos, before, after = F.shiftright("place", 20), F.shiftright("place", 10).bitwiseAND(1023), F.col("place").bitwiseAND(1023)
    whole = lambda df: df.select("key", (pos - before).alias("start"), (pos + after).alias("stop"))
    mixed = met.where("not alike").select("h", "seg", "key", "place")
    kinds = cut(mixed.groupBy("h", "seg").agg(F.count("*").alias("n"), F.min(F.struct("key", "place")).alias("first")))
    copies = mixed.join(kinds.where("n > 1").select("h", "seg"), ["h", "seg"])
    busy = cut(kinds.groupBy("h").agg(F.count("*").alias("kinds")).where(F.col("kinds") > HOT).select("h", F.lit(True).alias("hot")))
    named = kinds.join(busy, "h", "left").select("first.key", F.struct("h", "first.place", (F.col("n") == 1).alias("single"), F.coalesce("hot", F.lit(False)).alias("hot")).alias("rep"))
    reps = named.groupBy("key").agg(F.collect_list("rep").alias("reps"))
    # Rows repeated as a whole have one key; their text is needed once.
    found = map_arrow(keyed_docs.join(reps, "key").select("text", "key", "reps").dropDuplicates(["key"]), _segments(length), _FOUND)
    found = found.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(left))
    spans = whole(met.where("alike")).unionByName(whole(copies))
    if busy.limit(1).count():
        found = cut(found)
        calm, equal = _split(found.where("hot"), left, length)
        found, spans = found.where("not hot").unionByName(calm), spans.unionByName(equal)
    by_group = found.drop("hot").repartition("g").sortWithinPartitions("g")
    return cut(spans.unionByName(map_arrow(by_group, _merged(length), "key long, start long, stop long")))


def _met(keyed_docs: DataFrame, length: int) -> DataFrame:
    """h, seg, key, place, alike of the occurrences of anchors that occur more than once."""
    stored = cut(map_arrow(keyed_docs.select("key", "text"), _occurrences(length), "key long, found array<struct<h:bigint,seg:bigint,place:bigint>>"))
    seen = stored.select("key", F.explode("found").alias("o")).select("o.h", "o.seg", "key", "o.place")
    again = cut(_repeated(seen))
    release(keyed_docs.sparkSession)
    # Both sides are shuffled for this join alone, so a hot anchor's partition can be split.
    return cut(seen.join(again, "h"))


def _repeated(seen: DataFrame) -> DataFrame:
    counts = seen.groupBy("h").agg(F.count("*").alias("n"), F.min("seg").alias("low"), F.max("seg").alias("high"))
    return counts.where("n > 1").select("h", (F.col("low") == F.col("high")).alias("alike"))


_FOUND = "g long, key long, pos long, before long, after long, single boolean, hot boolean, bytes binary"


def _split(found: DataFrame, left: int, length: int) -> tuple[DataFrame, DataFrame]:
    """Groups too large to be merged in one task, as smaller ones, and the spans of strings that were met on the way.

    All strings at offsets lo to hi of a group share the bytes that each of them covers. Half of the offsets share more
    of them, so each segment goes to the groups of both halves, named by these bytes, and leaves those that it has no
    string for or is alone in. A half of one offset has a whole string in common: its segments are covered.
    """
    calm = equal = None
    while True:
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("hi").alias("hi")))
        each = found.withColumn("half", F.explode(halves)).withColumn("lo", F.col("half.lo")).withColumn("hi", F.col("half.hi")).drop("half")
        each = each.where((F.col("before") >= F.col("lo")) & (F.lit(length) - F.col("after") <= F.col("hi")))
        shared = F.substring(F.col("bytes"), F.lit(left + 1) - F.col("lo"), F.lit(length) - F.col("hi") + F.col("lo"))
        each = cut(each.withColumn("g", F.xxhash64("g", "lo", "hi", shared)))
        sizes = cut(each.groupBy("g").agg(F.count("*").alias("size")).where("size > 1"))
        met = cut(each.join(sizes, "g"))
        done = met.where("lo = hi and single").select("key", (F.col("pos") - F.col("lo")).alias("start"), (F.col("pos") - F.col("lo") + length).alias("stop"))
        small = met.where((F.col("lo") < F.col("hi")) & (F.col("size") <= HOT)).drop("size")
        calm, equal = (small, done) if calm is None else (calm.unionByName(small), equal.unionByName(done))
        found = met.where((F.col("lo") < F.col("hi")) & (F.col("size") > HOT)).drop("size")
        if not found.limit(1).count():
            return calm, equal


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key that only rows repeated as a whole share."""
    return texts(docs).withColumn("key", F.xxhash64(F.lit(4), "doc_id", "text"))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            body = text.encode()
            gone = merged_spans([(s["start"], s["stop"]) for s in spans or ()])
            kept, at = [], 0
            for a, b in gone:
                kept.append(body[at:a])
                at = b
            kept.append(body[at:])
            out["n_bytes"].append(len(body))
            out["n_removed"].append(sum(b - a for a, b in gone))
            out["n_spans"].append(len(gone))
            out["kept"].append(b"".join(kept))
        yield pa.record_batch({"doc_id": batch.column("doc_id"), **{c: pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")}, "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in out["kept"]], pa.string())})


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row for each row of docs.

    Removed is every byte covered by a string of ``length`` bytes that also starts anywhere else in docs, in the same text
    or another; strings are judged on the texts as given. Null texts are empty; texts shorter than ``length`` lose
    nothing; rows repeated as a whole lose all that is long enough; very long texts are treated whole, other columns are
    left out. Rows are named by 64 bits of hash of id and text.
    """
    spans = repeated_spans(docs, length)
    release(docs.sparkSession)
    spans = spans.groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    joined = keyed(docs).join(spans, "key", "left").select("doc_id", "text", "spans")
    return map_arrow(joined, _removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
