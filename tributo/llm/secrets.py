"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, texts

# The three base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

#: Shortest run of code letters that the battery tests, and its false-discovery rate within a document.
LEAST = 16
RATE = 1e-3
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
_BREAK = re.compile(r"[+/_-]+")
_HEX_MAP = bytes(1 if chr(i) in "0123456789abcdef" else 0 for i in range(256))
_CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Ordinary text, against which a token must stand out: chance that two of its letters agree, chance that the class of
#: letter changes from one to the next, correlation of being a vowel with the next letter's.
AGREE, SWITCH, VOWEL = 0.066, 0.06, -0.3
#: Third moment of ordinary letter shares, for the spread of the chi-squared statistic.
TRIPLE = 0.0054
#: Shares of letters in ordinary text of Western European languages, in percent, and how much more than of independent
#: letters the spread of their mean surprise is in long words.
SHARES = dict(zip("etaoinsrhldcumfpgwybvkxjqz", (12.5, 8, 8, 7, 7.3, 7.5, 7, 7, 4.2, 4.2, 3.6, 3.2, 2.8, 2.6, 2, 2, 1.9, 1.4, 1.4, 1.4, 1.1, 0.8, 0.25, 0.25, 0.2, 0.4), strict=True))
WIDER = 1.5
_SURPRISE = {c: -math.log(v / sum(SHARES.values())) for c, v in SHARES.items()}
_MEAN = sum(math.exp(-x) * x for x in _SURPRISE.values())
_SPREAD = WIDER * math.sqrt(sum(math.exp(-x) * (x - _MEAN) ** 2 for x in _SURPRISE.values()))


def encoding(token: str) -> tuple[str, int]:
    """The narrowest encoding whose alphabet holds the token, and the size of that alphabet."""
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", token):
        return "hex", 16
    if re.fullmatch(r"[A-Z2-7]+", token):
        return "base32", 32
    if re.fullmatch(r"[0-9a-z]+", token):
        return "base36", 36
    if re.fullmatch(r"[0-9A-Za-z]+", token):
        return "base62", 62
    return "base64", 64


_LOWER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: The letters of each encoding in the order of their values.
ALPHABETS = {"hex": _DIGITS + "abcdef", "base32": _LOWER.upper() + "234567", "base36": _DIGITS + _LOWER, "base62": _LOWER.upper() + _LOWER + _DIGITS, "base64": _LOWER.upper() + _LOWER + _DIGITS + "+/"}
_VALUES = {kind: {c: float(i) for i, c in enumerate(letters)} for kind, letters in ALPHABETS.items()}
#: Standard deviations of serial correlation between values that a random code may well have.
ORDERED = 2.0


def serial(values: list[float]) -> float | None:
    """Correlation of each value with the next; None if they are all one."""
    mean = sum(values) / len(values)
    var = sum((v - mean) ** 2 for v in values)
    return sum((a - mean) * (b - mean) for a, b in zip(values, values[1:], strict=False)) / var if var else None


def _below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


@lru_cache(maxsize=4096)
def _at_least(hits: int, n: int, p: float) -> float:
    """P(Binomial(n, p) >= hits)."""
    if hits <= 0:
        return 1.0
    return min(1.0, sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(hits, n + 1)))


def _inverse(p: float) -> float:
    """z with P(Z >= z) = p, to some decimals, by bisection."""
    p = min(max(p, 1e-300), 1 - 1e-12)
    low, high = -8.0, 38.0
    for _ in range(60):
        mid = (low + high) / 2
        if 0.5 * math.erfc(mid / math.sqrt(2)) > p:
            low = mid
        else:
            high = mid
    return low


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def battery(token: str) -> float:
    """p-value of a token under ordinary text: small if its letters are spread, switched and ordered as a random code's.

    Three tests for the inferred encoding: uniformity of the alphabet (chi-squared, lower tail against the value that
    ordinary letter shares give; but for hex, how rare the letters are in ordinary text, if they aren't repeated), runs of
    letter classes, and serial correlation: of vowels, which words alternate and codes don't, and of the values that the
    letters have in the encoding, which a random code hasn't; what rises or falls step by step, as counters and alphabets
    do, loses what its correlation is beyond ORDERED deviations. A token of one class has no runs to test. Stouffer's sum
    joins the tests, with the variance of dependent ones so that agreement between them isn't taken for evidence.
    Separators join words and paths, and count for nothing; tokens without a letter have p = 1.
    """
    own = _BREAK.sub("", token)
    letters = [_SURPRISE[c] for c in own.lower() if c in _SURPRISE]
    if len(own) < 2 or not letters:
        return 1.0
    n = len(own)
    kind, size = encoding(own)
    uniform = _inverse(_agreeing(own, size))
    # Letters that agree more often than words' do aren't spread, however rare they are.
    if kind != "hex" and uniform > -2:
        uniform = (sum(letters) / len(letters) - _MEAN) / _SPREAD * math.sqrt(len(letters))
    kinds = [_class(c) for c in own]
    vowels = serial([1.0 if c in "aeiouAEIOU" else 0.0 for c in own])
    z = [uniform, ((VOWEL if vowels is None else vowels) - VOWEL) * math.sqrt(n)]
    if len(set(kinds)) > 1:
        z.append(_inverse(_at_least(sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)), n - 1, SWITCH)))
    # One test alone, however sure of a long token, doesn't outvote the other two.
    total = sum(min(6.0, max(-3.0, x)) for x in z)
    ordered = serial([_VALUES[kind][c] for c in (own.lower() if kind == "hex" else own)])
    total -= max(0.0, abs(ordered or 0.0) * math.sqrt(n) - ORDERED)
    return 0.5 * math.erfc(total / math.sqrt(2 * (2 * len(z) - 1)))


def _agreeing(token: str, size: int) -> float:
    """Chance that ordinary text has letters as evenly spread as the token's; size is that of the token's alphabet."""
    n = len(token)
    counts: dict[str, int] = {}
    for c in token:
        counts[c] = counts.get(c, 0) + 1
    squares = sum(v * v for v in counts.values())
    agree = max(AGREE, 2.5 / size)
    triple = max(TRIPLE, agree * agree * 1.25)
    chi, ordinary = size / n * squares - n, size * (1 + (n - 1) * agree) - n
    spread = size / n * math.sqrt(2 * n * (n - 1) * agree * (1 - agree) + 4 * n * (n - 1) * (n - 2) * max(0.0, triple - agree * agree))
    return _below((chi - ordinary) / spread)


def discoveries(p: list[float], lengths: list[int], rate: float = RATE) -> list[bool]:
    """Benjamini-Hochberg with weights in proportion to length: a longer token has said more for the same p-value."""
    if not p:
        return []
    mean = sum(lengths) / len(lengths)
    weighted = [x * mean / n for x, n in zip(p, lengths, strict=True)]
    ranked = sorted(weighted)
    limit = max((x for i, x in enumerate(ranked, 1) if x <= rate * i / len(ranked)), default=-1.0)
    return [x <= limit for x in weighted]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns: start, end (exclusive, in code points), kind; by start, then kind as listed."""
    found: list[tuple[int, int, str]] = []
    lower = text.lower()
    if any(c in lower for c in _CUES):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    if b"\1" * 24 in text.encode("utf-8", "replace").translate(_HEX_MAP):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def all_spans(text: str, rate: float = RATE) -> list[tuple[int, int, str]]:
    """The base spans and the tokens that the battery discovers outside them."""
    base = base_spans(text)
    if max(map(len, text.split()), default=0) < LEAST:
        return base
    tokens = [m.span() for m in _RUN.finditer(text)]
    p = [battery(text[a:b]) for a, b in tokens]
    hit = discoveries(p, [b - a for a, b in tokens], rate)
    extra = [(a, b, "random") for (a, b), h in zip(tokens, hit, strict=True) if h and not any(a < y and x < b for x, y, _ in base)]
    return sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id and the arrays base and found of (start, end, kind) for every row of docs.

    Null and empty texts have none. Spans of one kind never overlap; found holds base.
    """
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [all_spans(t) for t in batch.column("text").to_pylist()]
            row = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "base": pa.array([row(s for s in x if s[2] != "random") for x in both], kind), "found": pa.array([row(x) for x in both], kind)})

    spans = "array<struct<start:int,end:int,kind:string>>"
    return map_arrow(texts(docs), run, f"doc_id long, base {spans}, found {spans}")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """The digest of secret_spans: doc_id, n_assign, n_access, n_hex, base_sha256, spans; one row for each row of docs."""
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return secret_spans(docs).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))


def redact(text: str) -> str:
    """text with every found span, overlapping ones as one, replaced by a mark."""
    out, at = [], 0
    for a, b, _ in all_spans(text):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with secrets in text replaced and n_chars counted anew; other columns and all rows stay. A null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = pa.array([None if t is None else redact(t) for t in batch.column("text").to_pylist()], pa.string())
            yield batch.set_column(batch.schema.get_field_index("text"), "text", clean)

    cleaned = map_arrow(docs.withColumn("text", F.col("text").cast("string")), run, docs.withColumn("text", F.col("text").cast("string")).schema)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned
