"""LM scoring: marginal likelihood of texts over all segmentations into the pieces of an existing vocabulary."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold, gathered, map_arrow, release
from .tokens import SPACED, mix, pieces, powers, words

#: Most frequent words whose statistics are broadcast, 32 bytes each; all others are joined.
HOT_WORDS = 200_000
#: Rounds of expectation maximisation over the training words, from the weights that the vocabulary file gives.
ROUNDS = 2
#: Share that the vocabulary's own scores keep in the weights of the pieces, whatever the size of the corpus.
VOCABULARY = 0.1
#: Words of one length taken together, and words of any length sorted by it at once.
ROWS = 4_096
AT_ONCE = 32_768
_FILTER = 1 << 20
_LN10 = float(np.log(10))


@dataclass
class Lattice:
    """Pieces by hash, the log probability of each, and that of the end of a text (the last entry)."""

    hashes: np.ndarray
    order: np.ndarray
    longest: int
    log_p: np.ndarray

    @classmethod
    def load(cls, pieces_: list[tuple[bytes, float]]) -> Lattice:
        """pieces_: (bytes, score). Scores that are merge ranks are read as Zipf weights, others as log probabilities."""
        p = powers(max(len(b) for b, _ in pieces_))
        hashed = np.array([mix(((np.frombuffer(b, np.uint8).astype(np.uint64) + np.uint64(1)) * p[: len(b)]).sum(dtype=np.uint64, keepdims=True))[0] for b, _ in pieces_], np.uint64)
        scores = np.array([s for _, s in pieces_])
        if scores.min() < -1_000:
            scores = -np.log(10 - scores)
        order = np.argsort(hashed)
        weight = np.append(np.exp(scores - scores.max()), 0.0)
        weight[-1] = weight[:-1].mean()
        return cls(hashed[order], order, len(p), np.log(weight / weight.sum()))

    @property
    def filter(self) -> np.ndarray:
        out = np.zeros(_FILTER, bool)
        out[self.hashes % np.uint64(_FILTER)] = True
        return out

    def retrained(self, own: np.ndarray, counts: np.ndarray) -> Lattice:
        """own: log probabilities from the vocabulary's scores, which keep their share."""
        used = counts / counts.sum() if counts.sum() else np.exp(own)
        return Lattice(self.hashes, self.order, self.longest, np.log(VOCABULARY * np.exp(own) + (1 - VOCABULARY) * used))


class Recursion:
    """Forward and backward recursions in log space, over words of one length at a time."""

    def __init__(self, lattice: Lattice):
        self.lattice, self.filter, self.p = lattice, lattice.filter, powers(lattice.longest)

    def _edges(self, m: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) of every piece found, by start and end. m: rows x bytes."""
        lattice, out = self.lattice, []
        value = m.T.astype(np.uint64) + np.uint64(1)
        for i in range(m.shape[1]):
            h = np.zeros(len(m), np.uint64)
            for j in range(i, min(m.shape[1], i + lattice.longest)):
                h = h + value[j] * self.p[j - i]
                mixed = mix(h)
                rows = np.flatnonzero(self.filter[(mixed % np.uint64(_FILTER)).astype(np.int64)])
                if len(rows):
                    at = np.minimum(np.searchsorted(lattice.hashes, mixed[rows]), len(lattice.hashes) - 1)
                    same = lattice.hashes[at] == mixed[rows]
                    if same.any():
                        out.append((i, j + 1, rows[same], lattice.order[at[same]]))
        return out

    def _forward(self, m: np.ndarray, edges: list) -> np.ndarray:
        alpha = np.full((m.shape[1] + 1, len(m)), -np.inf)
        alpha[0] = 0
        for i, j, rows, piece in edges:
            alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + self.lattice.log_p[piece])
        return alpha

    def matrices(self, rows: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and bytes (a blank put in front, for the mark of a word's start) of words of equal length."""
        lengths = np.array([len(r) for r in rows])
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for own in np.split(order, cuts):
            if len(own):
                n = int(lengths[own[0]])
                step = max(1, min(ROWS, (1 << 20) // (n + 1)))
                for a in range(0, len(own), step):
                    part = own[a : a + step]
                    m = np.frombuffer(b"".join(rows[i] for i in part), np.uint8).reshape(len(part), n)
                    yield part, np.concatenate([np.full((len(part), 1), 32, np.uint8), m], axis=1)

    def log_marginals(self, rows: list[bytes]) -> np.ndarray:
        """Natural log of each word's probability, summed over all its segmentations."""
        out = np.zeros(len(rows))
        for part, m in self.matrices(rows):
            out[part] = self._forward(m, self._edges(m))[-1]
        return out

    def expected(self, rows: list[bytes], counts: np.ndarray) -> np.ndarray:
        """How often each piece is expected to be used in the words, met counts times."""
        log_p = self.lattice.log_p
        out = np.zeros(len(log_p))
        for part, m in self.matrices(rows):
            edges = self._edges(m)
            alpha = self._forward(m, edges)
            beta = np.full_like(alpha, -np.inf)
            beta[-1] = 0
            for i, j, r, piece in reversed(edges):
                beta[i, r] = np.logaddexp(beta[i, r], beta[j, r] + log_p[piece])
            for i, j, r, piece in edges:
                share = np.exp(alpha[i, r] + log_p[piece] + beta[j, r] - alpha[-1, r]) * counts[part[r]]
                out += np.bincount(piece, share, len(out))
        return out


def read_pieces(path: str) -> list[tuple[bytes, float]]:
    """The pieces of a sentencepiece file as bytes, its word mark as a blank; pieces with a mark inside never match and are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        text, score = model.id_to_piece(i), model.get_score(i)
        if model.is_byte(i):
            out.append((bytes([int(text[3:-1], 16)]), -float(model.get_piece_size())))
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and "▁" not in text[1:]:
            out.append((text.replace("▁", " ").encode(), float(score)))
    # A byte that is also a piece of its own stands once, with the better score.
    best: dict[bytes, float] = {}
    for piece, score in out:
        best[piece] = max(score, best.get(piece, score))
    return sorted(best.items())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    for whole in batches:
        for batch in pieces(whole):
            found, body, _ = words(batch.column("text"), SPACED)
            if len(found.hash):
                h, first, at = np.unique(found.hash, return_index=True, return_inverse=True)
                trains = np.asarray(batch.column("trains").cast(pa.int8()), np.float64)[found.row]
                c, t = np.bincount(at, trains, len(h)).astype(np.int64), np.bincount(at, minlength=len(h)).astype(np.int64)
                w = pa.array([lower[body[a:b]].tobytes() for a, b in zip(found.start[first], found.end[first], strict=True)], pa.binary())
                yield pa.record_batch({"h": h.view(np.int64), "w": w, "c": c, "t": t})


def _looked_up(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places of h in the sorted table, -1 where it isn't there."""
    if not len(table):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, at, -1)


def lm_scores(docs: DataFrame, piece_file: str, *, folds: int = 5, held: int = 1, rounds: int = ROUNDS, hot_words: int = HOT_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, hybrid_score; one row for each row of docs.

    base_score is a smoothed unigram's log10 probability over words (A-Z in lower case, between ASCII white space) and one
    end a text; score is the lattice's: the marginal probability of the text's words and its end, summed over all
    segmentations into pieces of the vocabulary, whose weights come from its scores and, by expectation maximisation, from
    the training words. hybrid_score gives each training word one more arc, itself as a whole, with its share of the
    corpus (Good-Turing leaves the share of words met once to the pieces). Any byte is a piece, so every text has a finite
    score. Null and empty texts are one end. Without training rows c, N and V are 0, so base_score is 0. Repeated rows are scored each; other columns are left out; a very long text is read in parts
    that end between words, and a very long word is one row of the lattice.

    Words are told apart by 64 bits of hash: of a thousand million different ones two share their counts with a chance
    of about 3 in 100.

    Words are counted, and run through the lattice, once each in a table that grows with the corpus. The statistics of the
    most frequent are broadcast; documents' other words are joined with the table, so no word is too frequent for a join.
    """
    spark = docs.sparkSession
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        (fold(F.col("doc_id"), folds) != held).alias("trains"),
    )
    table = cut(map_arrow(own, _counted, "h long, w binary, c long, t long").groupBy("h").agg(F.first("w").alias("w"), F.sum("c").alias("c"), F.sum("t").alias("t")))
    ends = own.where("trains").count()
    total, kinds, once = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1)).first()
    # The end is one of the training tokens where there is a training text.
    total, kinds = total + ends, kinds + (ends > 0)
    # Good-Turing: the words met once tell how much of new text is new words. That share is left to the pieces alone,
    # the rest to arcs that span a training word as a whole.
    pieces_share = min(1.0, max(once, 1) / max(total, 1))
    lattice = Lattice.load(read_pieces(piece_file))
    own_scores = lattice.log_p
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(lattice)

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            recursion, sums = Recursion(sent.value), np.zeros(len(sent.value.log_p))
            for batch in gathered(batches, AT_ONCE):
                sums += recursion.expected(batch.column("w").to_pylist(), np.asarray(batch.column("c"), np.float64))
            used = np.flatnonzero(sums)
            yield pa.record_batch({"piece": used, "n": sums[used]})

        # One row a piece at most comes back: the vocabulary bounds it.
        got = map_arrow(table.where("c > 0").select("w", "c"), expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros(len(lattice.log_p))
        counts[got["piece"].to_numpy(dtype=np.int64)] = got["n"].to_numpy()
        counts[-1] = ends
        lattice = lattice.retrained(own_scores, counts)
        sent.destroy()
    sent = spark.sparkContext.broadcast(lattice)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recursion = Recursion(sent.value)
        for batch in gathered(batches, AT_ONCE):
            log_p = recursion.log_marginals(batch.column("w").to_pylist())
            seen = np.asarray(batch.column("c"), np.float64)
            known = seen > 0
            hybrid = np.log(pieces_share) + log_p
            hybrid[known] = np.logaddexp(hybrid[known], np.log1p(-min(pieces_share, 1 - 1e-12)) + np.log(seen[known] / total))
            yield pa.record_batch({"h": batch.column("h"), "c": batch.column("c"), "t": batch.column("t"), "log_p": log_p / _LN10, "hybrid": hybrid / _LN10})

    weighed = cut(map_arrow(table, weigh, "h long, c long, t long, log_p double, hybrid double"))
    release(spark)
    # The words from the lowest frequency band on at which there are hot_words at most: a row a band comes back to find
    # it, then only these words; a sort with a limit would send so many from every task.
    band = F.floor(F.log2("t") * 8).cast("int")
    bands = weighed.groupBy(band.alias("band")).agg(F.count("*").alias("n")).toPandas().sort_values("band", ascending=False)
    fits = bands["band"][bands["n"].cumsum() <= hot_words]
    top = weighed.where(band >= int(fits.min()) if len(fits) else F.lit(False)).toPandas().sort_values("h", kind="stable")
    hot = spark.sparkContext.broadcast((top["h"].to_numpy(np.int64), top["c"].to_numpy(np.int64), top["log_p"].to_numpy(np.float64), top["hybrid"].to_numpy(np.float64)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h_hot, c_hot, p_hot, y_hot = hot.value
        for whole in batches:
            for batch in pieces(whole):
                found, _, offsets = words(batch.column("text"), SPACED)
                rows = len(offsets) - 1
                at = _looked_up(found.hash.view(np.int64), h_hot)
                is_hot = at >= 0
                row, hit = found.row[is_hot], at[is_hot]
                # The others once a text, with their number.
                away = np.flatnonzero(~is_hot)
                sort = np.lexsort((found.hash[away], found.row[away]))
                r, h = found.row[away][sort], found.hash.view(np.int64)[away][sort]
                first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])])) if len(r) else np.zeros(0, np.int64)
                spans = np.concatenate([[0], np.cumsum(np.bincount(r[first], minlength=rows))]).astype(np.int32)
                others = pa.StructArray.from_arrays([pa.array(h[first]), pa.array(np.diff(np.append(first, len(r))))], ["h", "m"])
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id"),
                        "n": np.bincount(found.row, minlength=rows).astype(np.int64),
                        "known": np.bincount(row, c_hot[hit] > 0, rows).astype(np.int64),
                        "base": np.bincount(row, np.log10(c_hot[hit] + 0.5), rows).astype(float),
                        "log_p": np.bincount(row, p_hot[hit], rows).astype(float),
                        "hybrid": np.bincount(row, y_hot[hit], rows).astype(float),
                        "others": pa.ListArray.from_arrays(pa.array(spans), others),
                    }
                )

    # The row number is settled by the checkpoint.
    looked = cut(map_arrow(own.select("doc_id", "text"), look, "doc_id long, n long, known long, base double, log_p double, hybrid double, others array<struct<h:bigint,m:bigint>>").withColumn("row", F.monotonically_increasing_id()))
    rare = looked.select("row", F.explode("others").alias("o")).select("row", "o.h", "o.m").join(weighed.select("h", "c", F.col("log_p").alias("p"), F.col("hybrid").alias("y")), "h")
    sums = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("known_r"),
        F.sum(F.col("m") * F.log10(F.col("c") + 0.5)).alias("base_r"),
        F.sum(F.col("m") * F.col("p")).alias("log_p_r"),
        F.sum(F.col("m") * F.col("y")).alias("hybrid_r"),
    )
    each = looked.drop("others").join(sums, "row", "left")
    add = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    end = float(np.log10(pieces_share * np.exp(lattice.log_p[-1]) + (1 - pieces_share) * ends / max(total, 1)))
    plain_end = float(lattice.log_p[-1] / _LN10)
    per = float(np.log10(total + 0.5 * (kinds + 1)))
    return each.select(
        "doc_id",
        (fold(F.col("doc_id"), folds) == held).alias("held_out"),
        (F.col("n") + 1).alias("n_tokens"),
        (add("known", "known_r") + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (add("base", "base_r") + float(np.log10(ends + 0.5)) - (F.col("n") + 1) * per).alias("base_score"),
        (add("log_p", "log_p_r") + plain_end).alias("score"),
        (add("hybrid", "hybrid_r") + end).alias("hybrid_score"),
    )
