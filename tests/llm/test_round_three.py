"""Operators 11 to 13: filter audit, whitening, fingerprints."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tributo.llm import filter_audit, simhash, whitening

from . import brute
from .test_operators import ODD, docs, labels, none

# 11: filter audit.


def _fails(rows):
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    for d, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), re.search(r"[#$%&*|]", t) is not None, d is not None and d > least[t])
        yield d, lang or "", "".join(x for x, y in zip("ABCDE", tests, strict=True) if y)


def _audit(rows, good, toxic):
    """Each order is gone through document by document."""
    failed, out = list(_fails(rows)), {}
    for part in {p for _, p, _ in failed}:
        own = [(d, f) for d, p, f in failed if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                total[x] += len(gone)
                all_ = sum(x in f for _, f in own)
                out[part, "".join(order), step] = [x, len(left), len(gone), all_ - len(gone), sum(f == x for _, f in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for key, v in out.items():
            if key[0] == part:
                v.append(total[v[0]])
    return out


def test_audit_equals_plain_python(spark):
    rng = random.Random(5)
    long = " ".join(f"w{i}" for i in range(210))
    pool = [None, "", "  \n", "short", long, long + " |", "A" * 50 + " " + long, "same " * 300, "same " * 300 + "$", long.upper(), "x" * 40_000, "é" * 300, long + "\x0b\x1c#"]
    rows = [(i, rng.choice(pool), rng.choice(["en", "de", None, ""])) for i in range(120)] + [(None, long, "en"), (None, long, None), (7, long, "fr"), (7, long, "en"), (500, "only", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("n", "A", "part", "print", "good", "mask", "step", "id", "quality")})
    marks = labels(spark, [(i, int(i % 3 == 0), int(i % 7 == 0)) for i in range(60)] + [(3, 0, 1), (None, 1, 1), (61, None, None)])
    good = {i for i in range(60) if i % 3 == 0}
    toxic = {i for i in range(60) if i % 7 == 0} | {3}
    got = filter_audit.audit(df, marks).collect()
    assert {(r.part, r.filter_order, r.step): [r.filter, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == _audit(rows, good, toxic)
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_audit_edges(spark):
    assert filter_audit.audit(none(spark), labels(spark, [])).count() == 0
    rows = filter_audit.audit(docs(spark, ODD).drop("lang"), labels(spark, [])).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""} and {r.kept + r.removed for r in rows if r.step == 1} == {len(ODD)}
    two = spark.createDataFrame([("p", True, False, 3, 1, 0), ("p", True, True, 2, 0, 2)], "part string, A boolean, B boolean, n long, good long, toxic long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in filter_audit.interactions(two, ("A", "B")).collect()}
    assert got == {("AB", 1): (0, 5, 0, 8), ("AB", 2): (0, 0, 2, 2), ("BA", 1): (3, 2, 0, 2), ("BA", 2): (0, 3, 2, 8)}
    with pytest.raises(ValueError):
        filter_audit.interactions(two, ())


# 12: whitening.


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"n": F.lit(1), "v": F.lit("x"), "component": F.lit(0), "task": F.lit(0)})


def test_whitening_equals_the_eigenvectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "CHUNK", 32)
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.2, (300, 9)) @ np.diag([5, 3, 2, 1.5, 1, 0.5, 0.4, 0.2, 0.1]) + 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (None, x[1].tolist())]
    odd = [(900, None), (901, [float("nan")] * 9), (902, [None] + [1.0] * 8), (903, [float("inf")] * 9)]
    df = _vectors(spark, rows + odd).repartition(5)
    for k in (8, 9, 20):
        got = whitening.whiten(df, components=k).toPandas()
        assert sorted(got.component.unique()) == list(range(1, min(k, 9) + 1)) and len(got) == len(rows) * min(k, 9)
    whole = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in rows], dtype=np.int64)
    n, sums = len(whole), whole.sum(0)
    z = (n * whole - sums) / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = z @ vectors / np.sqrt(values)
    assert set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10
    assert np.allclose(got.groupby("component").explained.first(), values / values.sum(), rtol=1e-9)
    for i in range(0, 300, 7):
        own = got[got.vec_id == i].drop_duplicates("component").sort_values("component")
        assert set(own.deviation) == {int(((n * whole[i] - sums) ** 2).sum())}
        assert np.allclose(np.abs(own.whitened), np.abs(want[i]), atol=1e-8)
    # One sign for a component, whatever the row.
    first = got[(got.component == 1) & got.vec_id.between(1, 299)].sort_values("vec_id").whitened.to_numpy()
    assert abs(abs((first * want[1:300, 0]).sum()) - np.abs(first * want[1:300, 0]).sum()) < 1e-6


@pytest.mark.parametrize("shape", [(1, 1), (2, 2), (7, 5), (9, 9), (12, 8), (6, 1)])
def test_rotations_give_the_singular_values(shape):
    rng = np.random.default_rng(sum(shape))
    r = np.linalg.qr(rng.normal(size=shape) * np.logspace(0, -12, shape[1]), mode="r")
    values, directions = whitening.rotate(r)
    assert np.allclose(values, np.linalg.svd(r, compute_uv=False), rtol=1e-8, atol=0) and np.allclose(directions.T @ directions, np.eye(shape[1]), atol=1e-13)
    assert np.allclose(np.abs((r @ directions).T @ (r @ directions)), np.diag(values**2), atol=1e-13)


def test_small_variances_are_accurate():
    """Columns that differ by 10 orders of size: a covariance would lose the small ones."""
    r = np.triu(np.ones((4, 4)) + np.eye(4)) * np.array([1.0, 1e-4, 1e-8, 1e-10])
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(4, 4)))[0]
    assert np.allclose(whitening.rotate(q @ r)[0][-1], whitening.rotate(r)[0][-1], rtol=1e-5)


def test_whitening_edges(spark):
    assert whitening.whiten(_vectors(spark, [])).count() == 0
    assert whitening.whiten(_vectors(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(_vectors(spark, [(1, []), (2, [])])).count() == 0
    assert whitening.whiten(_vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    # A direction without variance has no component; a shorter vector is filled.
    got = whitening.whiten(_vectors(spark, [(1, [1.0, 5.0]), (2, [3.0, 5.0]), (3, [2.0, 5.0])])).collect()
    assert {r.component for r in got} == {1} and abs(sum(r.whitened for r in got)) < 1e-12
    short = {r.vec_id: r.whitened for r in whitening.whiten(_vectors(spark, [(1, [1.0]), (2, [1.0, 4.0])])).collect()}
    assert abs(abs(short[1]) - 1) < 1e-12 and abs(short[1] + short[2]) < 1e-12
    # Numbers beyond a long: no crash, and no wrong deviation.
    huge = whitening.whiten(_vectors(spark, [(1, [1e300]), (2, [-1e300]), (3, [0.0])])).collect()
    assert len(huge) == 3 and {r.deviation for r in huge if r.vec_id < 3} == {None}


def test_exact_sums_beyond_64_bits():
    x = np.array([[1 << 50, -(1 << 50)]])
    apart = whitening.offsets(x, 1 << 20, [5, 7])
    assert apart.tolist() == [[(1 << 70) - 5, -(1 << 70) - 7]] and whitening.deviations(apart) == [None]
    assert whitening.deviations(whitening.offsets(np.array([[3, 4]]), 2, [1, 1])) == [25 + 49]


def test_moments_add_up():
    rng = np.random.default_rng(1)
    x = rng.normal(1e6, 1, (50, 3))
    one = whitening.Moments.of(x[:20]).plus(whitening.Moments.of(x[20:]))
    assert np.allclose(one.products / 50, np.cov(x.T, bias=True)) and np.allclose(whitening.Moments.read(one.flat(), 3).mean, x.mean(0))


# 13: fingerprints.


def _print(text, k=3):
    words = brute.words(text)
    if not words:
        return 0
    parts = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _groups(prints, radius=3):
    """The component of each fingerprint, by all pairs."""
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(list(parent), 2):
        if (a ^ b).bit_count() <= radius:
            parent[find(a)] = find(b)
    return {p: find(p) for p in parent}


def _want(rows):
    group = _groups({_print(t) for _, t in rows})
    least = {}
    for d, t in rows:
        g = group[_print(t)]
        least[g] = min((x for x in (least.get(g), d) if x is not None), default=None)
    return sorted(((d, f"{_print(t):016x}", least[group[_print(t)]]) for d, t in rows), key=repr)


def test_fingerprints_of_runs(monkeypatch):
    texts = ["", " \n", "One", "one TWO", "a b c", "A\tb\x0bc  a b c a b c", "é É ß 漢字 x y", "w " * 500, "x" * 3000 + " b c d"]
    want = [_print(t) for t in texts]
    assert [simhash.fingerprint(t.encode()) for t in texts] == want
    monkeypatch.setattr(simhash, "RUN", 3)
    monkeypatch.setattr(simhash, "PIECE", 2)
    assert [simhash.fingerprint(t.encode()) for t in texts] == want


def test_simhash_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(3))
    rows = [(i, x) for i, x in ODD]
    for g in range(25):
        base = [word() for _ in range(rng.choice([2, 5, 60, 400]))]
        for c in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((1000 + 10 * g + c, " ".join(copy)))
    df = docs(spark, rows).withColumns({"fp": F.lit("x"), "component_id": F.lit("y")}).repartition(3)
    run = lambda: sorted((tuple(r) for r in simhash.simhash_duplicates(df).collect()), key=repr)
    want = _want(rows)
    assert run() == want
    assert len({c for _, _, c in want}) < len({f for _, f, _ in want}), "near copies are linked"
    # Small trees, shards of several blocks, tiny leaves and pieces: the same.
    for name, value in (("SHARD", 8), ("LEAST", 4), ("BLOCK", 3), ("LEAF", 2), ("PIECE", 5)):
        monkeypatch.setattr(simhash, name, value)
    assert run() == want


def test_simhash_edges(spark):
    assert simhash.simhash_duplicates(none(spark)).count() == 0
    got = simhash.simhash_duplicates(docs(spark, [(None, "a b c"), (None, "a b c"), (4, None), (3, " "), (4, None)])).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == sorted([(None, f"{_print('a b c'):016x}", None)] * 2 + [(4, "0" * 16, 3)] * 2 + [(3, "0" * 16, 3)], key=repr)


def _clusters(rng, n, size):
    centres = rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)
    out = [c ^ (np.uint64(1) << np.uint64(b)) ^ (np.uint64(1) << np.uint64(e)) for c in centres for b, e in rng.integers(0, 64, (size, 2))]
    return np.unique(np.concatenate([centres, np.array(out, np.uint64)]))


@pytest.mark.parametrize("most", [1, 4, 50, 10_000])
def test_a_tree_brings_together_all_that_is_near(most):
    fp = _clusters(np.random.default_rng(most), 40, 12)
    tree = simhash.Tree.grow(fp[::2], most, 3)
    row, shard, guest = tree.place(fp)
    home = dict(zip(row[~guest].tolist(), shard[~guest].tolist(), strict=True))
    assert len(home) == len(fp) == (~guest).sum()
    seen = {(r, s) for r, s in zip(row.tolist(), shard.tolist(), strict=True)}
    visits = {(r, s) for r, s, _ in zip(*(x.tolist() for x in tree.place(fp, visiting=True)), strict=True)}
    for a, b in itertools.combinations(range(len(fp)), 2):
        if int(fp[a] ^ fp[b]).bit_count() <= 3:
            assert (a, home[b]) in seen or (b, home[a]) in seen
            assert (a, home[b]) in visits and (b, home[a]) in visits
    if most < 50:
        assert tree.shards > 1 and len(visits) < len(fp) * tree.shards, "branches are pruned"


def test_a_block_links_its_residents_and_guests(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 8)
    fp = _clusters(np.random.default_rng(3), 30, 10)
    own, guests = fp[::2], fp[1::2]
    block = simhash.Block(own, 3)
    got = _groups([])
    parent = {int(x): int(x) for x in fp}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    edges = [*zip(own[block.links[0]].tolist(), own[block.links[1]].tolist(), strict=True), *zip(*(x.tolist() for x in block.visit(guests)), strict=True)]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    assert len(block.links[0]) < len(own), "a forest of links"
    for a, b in edges:
        parent[find(a)] = find(b)
    # Guests are not compared with each other, so residents' links and guests' alone must show.
    got = {(a, b) for a in own.tolist() for b in fp.tolist() if (a ^ b).bit_count() <= 3}
    assert all(find(a) == find(b) for a, b in got)


def test_hooking_needs_one_link_less_than_rows():
    label = np.arange(6)
    i, j = simhash.hook(label, np.array([0, 1, 2, 0, 4, 1]), np.array([1, 2, 0, 2, 5, 0]))
    assert len(i) == 3 and label[0] == label[1] == label[2] and label[4] == label[5] and label[3] == 3
