"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled, map_arrow
from .tokens import LETTERED, bounds, words

#: Labelled rows that the network is fitted on, at most.
TRAIN_ROWS = 12_000
BUCKETS = 1 << 15
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 10
#: Labelled rows of which a bucket must occur in to get an embedding; the rest, and all words unseen, count for nothing.
LEAST_ROWS = 2
#: Share of the labelled rows that only decide when training stops.
INNER = 0.15
#: Parts of the labelled rows that are scored by networks of the other parts, and the toxic rows that pull a threshold halfway.
PARTS, POOL = 3, 60
#: Share of words left out of each row in a step, factor by which weights shrink in one, and weight of a toxic row.
DROP, DECAY, POSITIVE = 0.2, 2e-3, 3.0


def buckets(texts_: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of each word and of its first four bytes, and where each text's words begin.

    The second bucket lets inflected forms share what is learned. Bucket 0 is padding.
    """
    found, _, offsets = words(texts_, LETTERED, head=4)
    both = np.stack([found.hash % np.uint64(BUCKETS - 1), found.head % np.uint64(BUCKETS - 1)], axis=1).astype(np.int32) + 1
    return both, bounds(found.row, len(offsets) - 1)


@dataclass
class Network:
    """embedding: BUCKETS x DIM, row 0 is padding; taps[w]: w x DIM x FILTERS; bias and out: one for each pooled filter."""

    embedding: np.ndarray
    taps: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    shift: float
    thresholds: dict[str | None, float]

    def limit(self, lang: str | None, default: float) -> float:
        """The threshold of a language, the common one where it has none, the default without any."""
        return self.thresholds.get(lang, self.thresholds.get(None, default))

    def tables(self) -> np.ndarray:
        """Response of every tap to every bucket, BUCKETS x (sum of widths * FILTERS): convolving is then adding up rows."""
        return np.concatenate([self.embedding @ tap[i] for tap in self.taps for i in range(len(tap))], axis=1).astype(np.float32)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out + self.shift


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            both, at = buckets(batch.column("text"))
            rows = [both[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "x": pa.array(rows, pa.binary()), "lang": batch.column("lang"), "label": batch.column("label")})


def evidence(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By bucket: rows that hold it, and by how many standard deviations more of them are toxic than its share of all is."""
    held = np.zeros((2, BUCKETS))
    for x, label in zip(rows, y, strict=True):
        held[int(label)][np.unique(x)] += 1
    n, share = held.sum(0), y.mean() if len(y) else 0.0
    return n, (held[1] - n * share) / np.sqrt(n * share * (1 - share) + 1)


class Trainer:
    """Adam on the logistic loss; a max-pooled filter passes its gradient to the window that won alone.

    A few dozen toxic rows can be learned by heart from any rare word. So buckets of fewer than LEAST_ROWS rows have no
    embedding, the first dimension starts from how far a bucket leans to the toxic rows, words are dropped at random,
    weights shrink, and the parameters kept are those of the epoch with the least loss on rows not trained on.
    """

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, seed: int = 7):
        self.rows, self.y, self.rng = rows, y, np.random.default_rng(seed)
        n, leaning = evidence(rows, y)
        self.known = (n >= LEAST_ROWS)[:, None]
        self.known[0] = False
        embedding = self.rng.normal(0, 0.02, (BUCKETS, DIM))
        embedding[:, 0] = np.clip(leaning / 4, -2, 2)
        taps = [self.rng.normal(0, 0.2, (w, DIM, FILTERS)) for w in WIDTHS]
        for tap in taps:
            tap[:, 0] = np.abs(tap[:, 0]) + 0.3
        pooled = len(WIDTHS) * FILTERS
        self.params = [embedding * self.known, *taps, np.full(pooled, -0.5), 0.3 + self.rng.normal(0, 0.05, pooled), np.full(1, -2.0)]
        self.first, self.second, self.step = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params], 0

    def network(self) -> Network:
        embedding, *taps, bias, out, shift = (p.copy() for p in self.params)
        return Network(embedding, taps, bias, out, float(shift[0]), {})

    def update(self, mine: np.ndarray, rate: float) -> None:
        embedding, *taps, bias, out, shift = self.params
        pad = max(WIDTHS) - 1
        gap = np.zeros((pad, 2), np.int32)
        flat = np.concatenate([x for i in mine for x in (gap, self.rows[i])] + [gap])
        flat = np.where(self.rng.random((len(flat), 1)) < DROP, 0, flat)
        starts = np.cumsum([0] + [len(self.rows[i]) + pad for i in mine])
        vectors = embedding[flat[:, 0]] + embedding[flat[:, 1]]
        won, pooled = [], []
        for tap in taps:
            w = len(tap)
            respond = sum(vectors[i : len(vectors) - w + 1 + i] @ tap[i] for i in range(w))
            pooled.append(np.maximum.reduceat(respond, starts[:-1], axis=0))
            won.append(np.stack([a + respond[a:b].argmax(0) for a, b in zip(starts, starts[1:], strict=False)]))
        hidden = np.maximum(np.concatenate(pooled, axis=1) + bias, 0)
        p = 1 / (1 + np.exp(-np.clip(hidden @ out + shift[0], -40, 40)))
        error = (p - self.y[mine]) * np.where(self.y[mine] == 1, POSITIVE, 1.0) / len(mine)
        back = np.outer(error, out) * (hidden > 0)
        grads = [np.zeros_like(q) for q in self.params]
        for k, tap in enumerate(taps):
            g, pick = back[:, k * FILTERS : (k + 1) * FILTERS], won[k]
            for i in range(len(tap)):
                at_words = flat[pick + i]
                grads[1 + k][i] = np.einsum("nfd,nf->df", vectors[pick + i], g)
                into = (g[:, :, None] * tap[i].T[None]).reshape(-1, DIM)
                for side in (0, 1):
                    np.add.at(grads[0], at_words[:, :, side].ravel(), into)
        grads[0] *= self.known
        grads[-3], grads[-2], grads[-1] = back.sum(0), hidden.T @ error, np.array([error.sum()])
        self.step += 1
        rate *= np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for q, g, m, v in zip(self.params, grads, self.first, self.second, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            q -= rate * m / (np.sqrt(v) + 1e-8)
        for q in self.params[:-2]:
            q *= 1 - DECAY


def train(rows: list[np.ndarray], y: np.ndarray, *, epochs: int = EPOCHS, seed: int = 7) -> tuple[Network, np.ndarray]:
    """The network, and the places of the rows that it wasn't trained on."""
    trainer = Trainer(rows, y, seed)
    order = trainer.rng.permutation(len(rows))
    inner, mine = order[: int(len(rows) * INNER)], order[int(len(rows) * INNER) :]
    best, least = trainer.network(), np.inf
    for _ in range(epochs if len(rows) else 0):
        turn = trainer.rng.permutation(mine)
        for at in range(0, len(turn), 64):
            trainer.update(turn[at : at + 64], 0.01)
        net = trainer.network()
        loss = 0.0
        if len(inner):
            p = Scorer(net).of_buckets([rows[i] for i in inner])
            loss = -np.where(y[inner] == 1, POSITIVE * np.log(p + 1e-9), np.log(1 - p + 1e-9)).mean()
        if loss <= least:
            best, least = net, loss
    return best, inner


class Scorer:
    """Scores whole texts: filter responses are rows of a table, added up and pooled."""

    def __init__(self, net: Network):
        self.net, self.tables = net, net.tables()

    def score(self, column: pa.Array) -> np.ndarray:
        both, at = buckets(column)
        return self.of_buckets([both[a:b] for a, b in zip(at, at[1:], strict=False)])

    def of_buckets(self, rows: list[np.ndarray]) -> np.ndarray:
        pooled = np.array([self.pool(x) for x in rows]).reshape(len(rows), len(WIDTHS) * FILTERS)
        return 1 / (1 + np.exp(-np.clip(self.net.logits(pooled), -40, 40)))

    def pool(self, both: np.ndarray, most: int = 1 << 16) -> np.ndarray:
        """Largest response of each filter over the padded text, taken in parts that overlap by the widest filter."""
        pad = max(WIDTHS) - 1
        both = np.concatenate([np.zeros((pad, 2), np.int32), both, np.zeros((pad, 2), np.int32)])
        best = np.full(len(WIDTHS) * FILTERS, -np.inf)
        for a in range(0, max(1, len(both) - pad), most):
            part = both[a : a + most + pad]
            every, column = self.tables[part[:, 0]] + self.tables[part[:, 1]], 0
            for k, w in enumerate(WIDTHS):
                n = len(part) - w + 1
                respond = every[:n, column : column + FILTERS]
                for i in range(1, w):
                    respond = respond + every[i : n + i, column + i * FILTERS : column + (i + 1) * FILTERS]
                column += w * FILTERS
                own = best[k * FILTERS : (k + 1) * FILTERS]
                np.maximum(own, respond.max(0), out=own)
        return best


def out_of_fold(rows: list[np.ndarray], y: np.ndarray, *, parts: int = PARTS, seed: int = 11) -> np.ndarray:
    """A score of each row by a network that was fitted on the other parts alone; each part has its share of either label."""
    rng, part = np.random.default_rng(seed), np.zeros(len(rows), np.int64)
    for label in (0, 1):
        own = rng.permutation(np.flatnonzero(y == label))
        part[own] = np.arange(len(own)) % parts
    score = np.zeros(len(rows))
    for i in range(parts):
        mine, other = np.flatnonzero(part == i), np.flatnonzero(part != i)
        if len(mine):
            net, _ = train([rows[j] for j in other], y[other])
            score[mine] = Scorer(net).of_buckets([rows[j] for j in mine])
    return score


def _best(score: np.ndarray, y: np.ndarray, near: float) -> float:
    """The threshold of the best F1, of several the one nearest to ``near``."""
    grid = np.arange(0.10, 0.951, 0.01)
    f1 = [2 * (y * (score >= g)).sum() / max(1, y.sum() + (score >= g).sum()) for g in grid]
    return float(min((abs(g - near), g) for g, f in zip(grid, f1, strict=True) if f >= max(f1) - 1e-9)[1])


def calibrate(score: np.ndarray, y: np.ndarray, lang: list[str | None], default: float) -> dict[str | None, float]:
    """Thresholds by language, and under None that of all others.

    The common one lies between the default and the best for all rows, a language's between the common one and its own
    best: nearer the latter the more toxic rows stand behind it, halfway for POOL of them. Without rows of both labels
    there is no threshold; a language without toxic rows has the common one.
    """
    if not 0 < y.sum() < len(y):
        return {}
    drawn = lambda own, to: to + (_best(score[own], y[own], to) - to) * y[own].sum() / (y[own].sum() + POOL)
    common = float(drawn(np.ones(len(y), bool), default))
    out: dict[str | None, float] = {None: common}
    for code in sorted({x for x in lang if x}):
        own = np.array([x == code for x in lang])
        if y[own].sum():
            out[code] = float(drawn(own, common))
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, folds: int = 3, held: int = 1, most: int = TRAIN_ROWS, default: float = 0.7) -> Network:
    """The network of all labelled rows outside the held fold, with thresholds from scores of networks that hadn't seen the row."""
    got = map_arrow(labelled(docs, labels, "toxic", folds, held, most), _hashed, "doc_id long, x binary, lang string, label int").toPandas()
    got = got.sort_values("doc_id", kind="stable")
    rows = [np.frombuffer(x, dtype=np.int32).reshape(-1, 2) for x in got["x"]]
    y = got["label"].to_numpy(dtype=float)
    net, _ = train(rows, y)
    if len(rows):
        net.thresholds = calibrate(out_of_fold(rows, y), y, got["lang"].tolist(), default)
    return net


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, folds: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, and by language: limit and rejected; a row for every row of docs.

    The score comes from the whole text alone. predicted uses the one threshold given, rejected that of the row's
    language, calibrated on scores that labelled rows get from networks fitted without them (without labels: the one given). Null and empty texts get the score of padding; without labels all scores stay where training starts. Very
    long texts are pooled in parts, whole. Repeated rows get the same score; other columns are left out.
    """
    net = fit_toxicity(docs, labels, folds=folds, held=held, default=threshold)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            if batch.num_rows:
                score = scorer.score(batch.column("text"))
                limit = [sent.value.limit(x, threshold) for x in batch.column("lang").to_pylist()]
                yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": score.astype(float), "threshold": pa.array(limit, pa.float64())})

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), lang.alias("lang"))
    scored = map_arrow(own, run, "doc_id long, score double, threshold double")
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), folds) == held).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        F.col("threshold").alias("limit"),
        (F.col("score") >= F.col("threshold")).alias("rejected"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, *, folds: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns whatever their names, that the threshold of their language doesn't reject.

    Null and empty texts have the score of padding, which stays below; repeated rows share their fate.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, folds=folds, held=held, default=threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            if batch.num_rows:
                score = scorer.score(batch.column("text").fill_null(""))
                langs = batch.column("lang").to_pylist() if "lang" in batch.schema.names else [None] * batch.num_rows
                limit = np.array([sent.value.limit(x, threshold) for x in langs])
                yield batch.filter(pa.array(score < limit))

    return map_arrow(docs, run, docs.schema)
