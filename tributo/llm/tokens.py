"""Words of whole texts as numpy arrays: hashes and places, computed on the UTF-8 bytes of a batch at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import utf8

#: Bytes handled at once; a slice ends between words, so no word is split.
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def _table(word: np.ndarray) -> np.ndarray:
    """Value of each byte in a hash: 0 outside words, A-Z as a-z."""
    value = np.arange(1, 257, dtype=np.uint64)
    value[65:91] += 32
    value[~word] = 0
    return value


def _spaced() -> np.ndarray:
    word = np.ones(256, bool)
    word[list(_SPACES)] = False
    return word


def _lettered() -> np.ndarray:
    word = np.zeros(256, bool)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        word[a:b] = True
    return word


#: Words between ASCII white space; and runs of ASCII letters, digits and non-ASCII bytes.
SPACED, LETTERED = _table(_spaced()), _table(_lettered())


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, base: int = _BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """One entry a word, in order: hash of the word in lower case, hash of its first bytes, its row, start and end byte."""

    hash: np.ndarray
    head: np.ndarray | None
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _unspaced(body: np.ndarray) -> np.ndarray:
    """Where letters of scripts written without blanks start: kana and Han (U+3000 to U+9FFF), Thai and Lao; three bytes each."""
    after = np.append(body[1:], np.uint8(0))
    return np.flatnonzero((body >= 0xE3) & (body <= 0xE9) | (body == 0xE0) & (after >= 0xB8) & (after <= 0xBB))


def _slice(body: np.ndarray, breaks: np.ndarray, values: np.ndarray, head: int, letters: bool = False) -> tuple:
    """breaks: places, within body, where a text starts. letters: a letter of an unspaced script is a word by itself."""
    value = values[body]
    inside = value != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = np.zeros(len(body) + 1, bool)
    cut[breaks] = True
    if letters:
        at = _unspaced(body)
        cut[at] = True
        cut[np.minimum(at + 3, len(body))] = True
    first |= cut[:-1] & inside
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last |= cut[1:] & inside
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        return (np.zeros(0, np.uint64),) * 2 + (start, end)
    lengths = np.diff(np.append(start, len(body)))
    place = np.arange(start[0], len(body)) - np.repeat(start, lengths)
    weight = powers(int(lengths.max()) + 1)[place]
    weight *= value[start[0] :]
    at = start - start[0]
    whole = mix(np.add.reduceat(weight, at) + (end - start).astype(np.uint64))
    lead = whole
    if head:
        weight[place >= head] = 0
        lead = mix(np.add.reduceat(weight, at) ^ np.uint64(0x5851F42D4C957F2D))
    return whole, lead, start, end


def words(column: pa.Array, values: np.ndarray = SPACED, head: int = 0, letters: bool = False) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of each text, with the bytes and offsets of the column. letters: see _slice."""
    body, offsets = utf8(column)
    at, stop, parts = int(offsets[0]), int(offsets[-1]), []
    while at < stop:
        to = min(stop, at + SLICE)
        while to < stop:
            gaps = np.flatnonzero(values[body[to : min(stop, to + SLICE)]] == 0)
            if len(gaps):
                to += int(gaps[0])
                break
            to = min(stop, to + SLICE)
        a, b = np.searchsorted(offsets, (at, to))
        whole, lead, start, end = _slice(body[at:to], offsets[a:b] - at, values, head, letters)
        parts.append((whole, lead, start + at, end + at))
        at = to
    whole, lead, start, end = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    row = np.searchsorted(offsets, start, side="right") - 1
    return Words(whole, lead if head else None, row, start, end), body, offsets


def bounds(row: np.ndarray, rows: int) -> np.ndarray:
    """Where each row's words begin; one more entry than rows."""
    return np.searchsorted(row, np.arange(rows + 1))


def hash_of(word: str, values: np.ndarray = LETTERED) -> int:
    return int(words(pa.array([word]), values)[0].hash[0])


def pieces(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes of text, whole rows each, to bound what numpy holds at once."""
    offsets = utf8(batch.column("text"))[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
