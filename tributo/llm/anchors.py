"""Anchors: places that every long enough repeated string shares, chosen from its bytes alone."""

from __future__ import annotations

import numpy as np

from .tokens import mix, powers

#: Bytes hashed at an anchor.
GRAM = 48
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_ROUND = 1 << 18
_PLACE = np.uint64((1 << 20) - 1)


def gram_hashes(body: np.ndarray, n: int = GRAM, base: int = _BASE) -> np.ndarray:
    """Hash of the n bytes from each place on, by differences of prefix sums modulo 2**64."""
    size = len(body) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(size, np.uint64)
    up, down = powers(_ROUND + n, base), powers(_ROUND + 1, pow(base, -1, 1 << 64))
    for a in range(0, size, _ROUND):
        b = min(size, a + _ROUND)
        part = (body[a : b + n - 1].astype(np.uint64) + np.uint64(1)) * up[: b - a + n - 1]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)])
        out[a:b] = (sums[n:] - sums[: b - a]) * down[: b - a]
    return out


def anchors(body: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int, n: int = GRAM) -> np.ndarray:
    """Places of anchors in the texts body[starts[i]:ends[i]], which follow each other.

    Of every string of ``length`` bytes the n-byte part with the least hash is one, the first of equals; so two equal
    strings have an anchor at the same distance from their start.
    """
    width = length - n + 1
    hashes = mix(gram_hashes(body, n))
    found = []
    for a in range(0, max(0, len(body) - length + 1), _ROUND):
        b = min(len(body) - length + 1, a + _ROUND)
        part = hashes[a : b + width - 1]
        key = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64)
        span, low = 1, key
        while span * 2 <= width:
            low = np.minimum(low[: len(low) - span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        pick = (low & _PLACE).astype(np.int64)
        # Strings that would cross into the next text don't count.
        text = np.searchsorted(ends, np.arange(a, b), side="right")
        pick = pick[np.arange(a, b) + length <= ends[np.minimum(text, len(ends) - 1)]]
        mark = np.zeros(len(part), bool)
        mark[pick] = True
        found.append(np.flatnonzero(mark) + a)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
