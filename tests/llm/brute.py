"""Plain Python versions of the corpus contracts."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import statistics
import zlib

GAP = re.compile(r"[\x20\x09-\x0D]+")


def lower(x: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def words(x: str | None) -> list[str]:
    return [w for w in GAP.split(lower(x or "")) if w]


def fold(doc_id, n: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def shingles(x: str | None, k: int) -> frozenset:
    w = words(x)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def components(rows: list[tuple[int, str | None]], k: int, threshold: int) -> dict[int, tuple[int, int, bool]]:
    sets = {d: shingles(x, k) for d, x in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    named = sorted((d for d in sets if sets[d]), key=lambda d: len(sets[d]))
    for i, a in enumerate(named):
        for b in named[i + 1 :]:
            n, m = len(sets[a]), len(sets[b])
            if 100 * n < threshold * m:
                break
            c = len(sets[a] & sets[b])
            if 100 * c >= threshold * (n + m - c):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def repeats(rows: list[tuple[int, str | None]], length: int) -> list[tuple]:
    count = collections.Counter(b[i : i + length] for _, x in rows for b in [(x or "").encode()] for i in range(len(b) - length + 1))
    out = []
    for d, x in rows:
        b = (x or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def base_scores(rows: list[tuple[int, str | None]], folds: int, held: int) -> dict:
    tokens = {d: [*words(x), None] for d, x in rows}
    count = collections.Counter(t for d, ts in tokens.items() if fold(d, folds) != held for t in ts)
    total, kinds = sum(count.values()), len(count)
    return {d: (len(ts), sum(count[t] > 0 for t in ts), total, sum(math.log10((count[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in ts)) for d, ts in tokens.items()}


def marginal(x: str | None, pieces: list[tuple[bytes, float]]) -> float:
    """log10 of the sum over all segmentations of each word, with a blank in front, and of the end; merge ranks as Zipf weights."""
    weight = {p: 1 / (10 - s) for p, s in pieces}
    end = sum(weight.values()) / len(weight)
    total = sum(weight.values()) + end
    longest = max(map(len, weight))

    def of(word: bytes) -> float:
        at = [1.0] + [0.0] * len(word)
        for j in range(1, len(word) + 1):
            at[j] = sum(at[i] * weight.get(word[i:j], 0.0) / total for i in range(max(0, j - longest), j))
        return at[-1]

    return sum(math.log10(of(b" " + w.encode())) for w in words(x)) + math.log10(end / total)


def base_secrets(text: str) -> list[tuple[int, str, int]]:
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def top_k(rows: list[tuple[int, list[float] | None]], k: int = 20) -> list[tuple]:
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in whole:
        if q % 20 == 0:
            scored = sorted(((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in whole if i != q))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def mixed(tokens: dict, budget_share: float, share_of_entropy: float, repeats: float) -> dict:
    """Weights of sources by plain halving of the exponent."""
    used = {s: t for s, t in tokens.items() if t}
    budget = budget_share * sum(used.values())

    def at(a: float) -> dict:
        z = sum((t / max(used.values())) ** a for t in used.values())
        return {s: (t / max(used.values())) ** a / z if t else 0.0 for s, t in tokens.items()}

    def search(fits) -> float:
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if fits(at(mid)) else (low, mid)
        return low

    a = search(lambda w: -sum(x * math.log(x) for x in w.values() if x) >= share_of_entropy * math.log(len(used)))
    b = search(lambda w: max(w[s] * budget / t for s, t in used.items()) > repeats)
    return at(max(a, b))


def drawn(weights: dict, budget: float) -> dict:
    """Tokens of each source that a mixture should draw."""
    return {s: w * budget for s, w in weights.items()}


def text_statistics(x: str) -> list[float]:
    """The thirteen statistics, counted byte by byte."""
    body, w, lines = x.encode(), x.lower().split(), [y for y in x.split("\n") if y.strip()]
    upper = sum(65 <= b < 91 for b in body)
    letters = sum(65 <= b < 91 or 97 <= b < 123 or b >= 128 for b in body)
    digits = sum(48 <= b < 58 for b in body)
    marks = sum(not (65 <= b < 91 or 97 <= b < 123 or b >= 128 or 48 <= b < 58 or b in b" \t\n\r\x0b\x0c" or b in b".,;:'\"-()?") for b in body)
    n, k = max(1, len(body)), max(1, len(w))
    log = lambda v: math.log(v + 1e-3)
    top = max((w.count(u) for u in set(w)), default=0)
    return [
        math.log(1 + k), log(letters / k), log(upper / max(1, letters)), log(body.count(b"!") / k), log(marks / n), log(body.count(b"|") / k), log(len(set(w)) / k**0.8),
        log(sum(a == b for a, b in zip(w, w[1:], strict=False)) / k), log(digits / n), log(1 - len(set(lines)) / len(lines) if lines else 0.0), log((body.count(b".") + body.count(b",")) / k), log(top / k),
        math.log(1 + max((len(u) for u in w), default=0)),
    ]


def discriminant(x, y, row, shrinkage: float) -> float:
    """Probability of class 1 from the densities of two normals, with the covariances inverted outright."""
    import numpy as np

    centre, scale, d = x.mean(0), x.std(0) + 1e-3, x.shape[1]
    z, r, density = (x - centre) / scale, (row - centre) / scale, []
    for c in (0, 1):
        own = z[y == c]
        cov = np.cov(own.T, bias=True)
        s = min(1.0, shrinkage + d / (len(own) + 1))
        cov = (1 - s) * cov + s * np.diag(0.5 * np.diag(cov) + 0.5)
        away = r - own.mean(0)
        density.append((len(own) + 1) / (len(z) + 2) * math.exp(-0.5 * away @ np.linalg.inv(cov) @ away) / math.sqrt(np.linalg.det(cov)))
    return density[1] / sum(density)


def convolved(words_: list[list[int]], embedding, taps, bias, out, shift) -> float:
    """Score of a text by convolution word by word; words_ are the buckets of each word."""
    pad = max(map(len, taps)) - 1
    padded = [[0]] * pad + words_ + [[0]] * pad
    total, column = shift, 0
    for tap in taps:
        for f in range(tap.shape[2]):
            best = max(sum(sum(float(embedding[b] @ tap[i][:, f]) for b in padded[at + i]) for i in range(len(tap))) for at in range(len(padded) - len(tap) + 1))
            total += max(0.0, best + bias[column]) * out[column]
            column += 1
    return 1 / (1 + math.exp(-total))


UNIT_WORDS = set("kg g mg km m cm mm l ml s h min hour hours minute minutes second seconds day days week weeks month months year years mile miles foot feet inch inches pound pounds dollar dollars euro euros cent cents percent degree degrees watt watts volt volts".split())


def units(x: str, opening_names: bool = False) -> list[tuple[str, str, bool]]:
    """(template form, own words, is a slot) of each unit of a text."""
    found = list(re.finditer("[\u3000-\u9fff\u0e00-\u0eff]|[0-9A-Za-z\u0080-\u0dff\u0f00-\u2fff\ua000-\U0010ffff]+", x))
    out: list[list] = []
    for i, m in enumerate(found):
        w, gap = m[0], x[found[i - 1].end() : m.start()] if i else None
        opens = not opening_names if gap is None else any(c in ".!?:;|\n" for c in gap)
        if any(c in "0123456789" for c in w):
            kind = "#number"
        elif len(w) > 1 and "A" <= w[0] <= "Z" and w[1] >= "a" and not opens:
            kind = "#name"
        elif i and lower(w) in UNIT_WORDS and any(c in "0123456789" for c in found[i - 1][0]):
            kind = "#unit"
        else:
            kind = None
        if out and kind == out[-1][3] and (kind == "#name" and gap == " " or kind == "#number" and gap in (",", ".")):
            out[-1][1] += "+" + lower(w)
        else:
            out.append([kind or lower(w), lower(w), kind is not None, kind])
    return [(a, b, c) for a, b, c, _ in out]


def contamination(x: str | None, items: list[tuple[int, str]], window: int = 8, literals: int = 5, whole: int = 3) -> tuple:
    own = units(x or "")
    hits: dict[int, dict[int, bool]] = {}
    for item, text in items:
        for opening in (False, True):
            theirs = units(text, opening)
            n = min(window, len(theirs))
            if not n or n < whole and len(own) != n:
                continue
            for p in range(len(theirs) - n + 1):
                a = theirs[p : p + n]
                for q in range(len(own) - n + 1):
                    b = own[q : q + n]
                    forms = [sum(not u[2] for u in w) >= min(literals, n) for w in (a, b)]
                    if forms[0] != forms[1] or any(u[0] != v[0] if forms[0] else u[1] != v[1] for u, v in zip(a, b, strict=True)):
                        continue
                    there: dict[str, str] = {}
                    if all(there.setdefault(u[1], v[1]) == v[1] for u, v in zip(a, b, strict=True)):
                        changed = any(u[1] != v[1] for u, v in zip(a, b, strict=True))
                        places = hits.setdefault(item, {})
                        places[q] = places.get(q, True) and changed
            for p, m in _stretches(theirs, window, literals):
                for q, k in _stretches(own, window, literals):
                    a, b = theirs[p : p + m], own[q : q + k]
                    there = {}
                    if m == k and all(u[0] == v[0] for u, v in zip(a, b, strict=True)) and all(there.setdefault(u[1], v[1]) == v[1] for u, v in zip(a, b, strict=True)):
                        changed = any(u[1] != v[1] for u, v in zip(a, b, strict=True))
                        places = hits.setdefault(item, {})
                        places[q] = places.get(q, True) and changed
    return bool(hits), sorted(hits), sum(map(len, hits.values())), any(any(p.values()) for p in hits.values())


def _stretches(own: list[tuple], window: int, literals: int) -> list[tuple[int, int]]:
    """Start and length of what reaches from a literal unit to the literals-th, where that is longer than a window."""
    at = [i for i, u in enumerate(own) if not u[2]]
    return [(a, b - a + 1) for a, b in zip(at, at[literals - 1 :], strict=False) if b - a >= window]


# The randomness battery, each test by its definition. Fixed values as in the operator: what ordinary text has.
_LETTER_SHARES = {c: w for c, w in zip("etaoinsrhldcumfpgwybvkxjqz", (12.5, 8, 8, 7, 7.3, 7.5, 7, 7, 4.2, 4.2, 3.6, 3.2, 2.8, 2.6, 2, 2, 1.9, 1.4, 1.4, 1.4, 1.1, 0.8, 0.25, 0.25, 0.2, 0.4), strict=True)}
_ORDER = {16: "0123456789abcdef", 32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 36: "0123456789abcdefghijklmnopqrstuvwxyz", 62: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"}


def _lag(x: list[float]) -> float | None:
    m = statistics.fmean(x)
    below = sum((v - m) ** 2 for v in x)
    return None if below == 0 else sum((x[i] - m) * (x[i + 1] - m) for i in range(len(x) - 1)) / below


def battery(token: str) -> float:
    own = re.sub("[+/_-]", "", token)
    letters = [c for c in own.lower() if c in _LETTER_SHARES]
    if len(own) < 2 or not letters:
        return 1.0
    n, normal = len(own), statistics.NormalDist()
    one_case = not (re.search("[a-z]", own) and re.search("[A-Z]", own))
    size = 16 if one_case and set(own.lower()) <= set(_ORDER[16]) else 32 if set(own) <= set(_ORDER[32]) else 36 if set(own) <= set(_ORDER[36]) else 62
    z_of = lambda p: -normal.inv_cdf(min(max(p, 1e-300), 1 - 1e-12)) if p > 1e-15 else 8.0
    # Chi-squared of the alphabet, against what ordinary letters give.
    agree = max(0.066, 2.5 / size)
    triple = max(0.0054, 1.25 * agree**2)
    chi = sum((own.count(c) - n / size) ** 2 / (n / size) for c in set(own)) + (size - len(set(own))) * n / size
    expected = size * (1 + (n - 1) * agree) - n
    spread = size / n * math.sqrt(2 * n * (n - 1) * agree * (1 - agree) + 4 * n * (n - 1) * (n - 2) * max(0.0, triple - agree**2))
    uniform = z_of(normal.cdf((chi - expected) / spread))
    if size != 16 and uniform > -2:
        total = sum(_LETTER_SHARES.values())
        share = {c: w / total for c, w in _LETTER_SHARES.items()}
        mean = -sum(p * math.log(p) for p in share.values())
        sd = 1.5 * math.sqrt(sum(p * (math.log(p) + mean) ** 2 for p in share.values()))
        uniform = (statistics.fmean(-math.log(share[c]) for c in letters) - mean) / sd * math.sqrt(len(letters))
    vowels = _lag([float(c in "aeiouAEIOU") for c in own])
    tests = [uniform, ((-0.3 if vowels is None else vowels) + 0.3) * math.sqrt(n)]
    kinds = ["a" if c.islower() else "A" if c.isupper() else "0" for c in own]
    if len(set(kinds)) > 1:
        turns = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
        tail = math.fsum(math.comb(n - 1, i) * 0.06**i * 0.94 ** (n - 1 - i) for i in range(turns, n)) if turns else 1.0
        tests.append(z_of(min(1.0, tail)))
    summed = sum(min(6.0, max(-3.0, z)) for z in tests)
    values = _lag([float(_ORDER[size].index(c)) for c in (own.lower() if size == 16 else own)])
    summed -= max(0.0, abs(values or 0.0) * math.sqrt(n) - 2)
    return 1 - normal.cdf(summed / math.sqrt(2 * len(tests) - 1)) if summed < 6 else 0.5 * math.erfc(summed / math.sqrt(2 * (2 * len(tests) - 1)))


def discoveries(p: list[float], lengths: list[int], rate: float) -> list[bool]:
    """Benjamini and Hochberg's step-up rule by trying every number of discoveries, p-values weighted by length."""
    mean = sum(lengths) / len(lengths) if p else 0
    weighted = [x * mean / n for x, n in zip(p, lengths, strict=True)]
    for k in range(len(p), 0, -1):
        limit = rate * k / len(p)
        if sum(x <= limit for x in weighted) >= k:
            return [x <= limit for x in weighted]
    return [False] * len(p)
