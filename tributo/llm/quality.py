"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled, map_arrow, texts

#: Labelled rows that the discriminant is fitted on, at most.
TRAIN_ROWS = 12_000
#: Share of the diagonal target in each class covariance.
SHRINKAGE = 0.1

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = b"0123456789"
_SPACE = b" \t\n\r\x0b\x0c"
_PROSE = b".,;:'\"-()?"

NAMES = ("words", "word_length", "upper", "shout", "symbol", "table", "variety", "stutter", "digit", "repeated_lines", "prose_marks", "top_word", "longest_word")


def statistics(text: str) -> list[float]:
    """Raw statistics of one whole text, each on a log scale so that rare marks and lengths are closer to normal."""
    body = text.encode("utf-8", "replace")
    n = len(body) or 1
    words = text.lower().split()
    w = len(words) or 1
    kept = lambda drop: len(body.translate(None, drop))
    letters = len(body) - kept(_LETTERS)
    marks = kept(_LETTERS + _DIGITS + _SPACE + _PROSE)
    counts = Counter(words)
    top = counts.most_common(1)[0][1] if counts else 0
    stutter = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    log = lambda x: float(np.log(x + 1e-3))
    return [
        float(np.log1p(w)),
        log(letters / w),
        log((len(body) - kept(_UPPER)) / max(1, letters)),
        log(body.count(b"!") / w),
        log(marks / n),
        log(body.count(b"|") / w),
        log(len(counts) / w**0.8),
        log(stutter / w),
        log((len(body) - kept(_DIGITS)) / n),
        log(1 - len(set(lines)) / len(lines) if lines else 0.0),
        log((body.count(b".") + body.count(b",")) / w),
        log(top / w),
        float(np.log1p(max(map(len, counts), default=0))),
    ]


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors and log determinants, computed once."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    whiten: list[np.ndarray]
    offset: list[float]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, shrinkage: float = SHRINKAGE) -> Discriminant:
        d = x.shape[1] if x.ndim == 2 else len(NAMES)
        x = x.reshape(-1, d)
        centre, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(d), np.ones(d))
        z = (x - centre) / scale
        means, whiten, offset = [], [], []
        for c in (0, 1):
            own = z[y == c]
            mean = own.mean(0) if len(own) else np.zeros(d)
            cov = np.cov(own.T, bias=True).reshape(d, d) if len(own) > 1 else np.eye(d)
            # A class with few rows leans more on the target.
            s = min(1.0, shrinkage + d / (len(own) + 1))
            cov = (1 - s) * cov + s * np.diag(0.5 * np.diag(cov) + 0.5)
            factor = np.linalg.cholesky(cov)
            means.append(mean)
            whiten.append(np.linalg.inv(factor))
            offset.append(float(np.log((len(own) + 1) / (len(z) + 2)) - np.log(np.diag(factor)).sum()))
        return cls(centre, scale, means, whiten, offset)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        log = [o - 0.5 * (((z - m) @ w.T) ** 2).sum(1) for m, w, o in zip(self.means, self.whiten, self.offset, strict=True)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [statistics(t) for t in batch.column("text").to_pylist()]
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "x": pa.array(x, pa.list_(pa.float64())), "label": batch.column("label")})


def fit_quality(docs: DataFrame, labels: DataFrame, *, folds: int = 5, held: int = 0, most: int = TRAIN_ROWS) -> Discriminant:
    rows = map_arrow(labelled(docs, labels, "quality", folds, held, most), _features, "doc_id long, x array<double>, label int").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    return Discriminant.fit(np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), len(NAMES)), rows["label"].to_numpy())


def quality_scores(docs: DataFrame, labels: DataFrame, *, folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, from its whole text alone.

    Null and empty texts get the score of the empty text's statistics; without labels every score is the same. A null
    doc_id counts as empty text for its fold. Repeated rows get the same score each.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, folds=folds, held=held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column("text").to_pylist()], dtype=float).reshape(batch.num_rows, len(NAMES))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": model.value.score(x)})

    scored = map_arrow(texts(docs), run, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
