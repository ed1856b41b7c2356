from __future__ import annotations

import base64
import hashlib
import os
import random
import string

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tributo.llm import bpe_count, components, decontaminate, lm_score, mixing, near_dedup, quality, queries, repeats, secrets, tokens, top_k, toxicity

from . import brute

ODD = [(1, None), (2, ""), (3, "   \t\n"), (4, "a"), (5, "a"), (None, "orphan text here"), (7, "É ß İ Σ 漢字 " * 40), (8, "x" * 30_000), (9, "word " * 5_000)]
EXTRA = "lang string, source string, n_chars long, score double, h long, node long, key long, items string, label int, component string"


def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in EXTRA.split(", ")})


def none(spark):
    return docs(spark, [])


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(4)
    parts = ["the", "on", "er", "and", "tion", "ing", "re", "at", "en", "es", "or", "th"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    return lambda n: " ".join(word() for _ in range(n))


# Words.


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aAbZé漢 \t\n\x0b.,'\u0085 "), max_size=30), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    found, body, offsets = tokens.words(pa.array(texts, pa.string()))
    raw = body.tobytes()
    got = [[] for _ in texts]
    for r, a, b in zip(found.row, found.start, found.end, strict=True):
        got[r].append(brute.lower(raw[a:b].decode()))
    assert got == [brute.words(t) for t in texts]
    by_word = {}
    for r, a, b, h in zip(found.row, found.start, found.end, found.hash, strict=True):
        assert by_word.setdefault(brute.lower(raw[a:b].decode()), h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_words_across_slices(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE", 7)
    found, _, _ = tokens.words(pa.array(["one three fourteen", "", "a" * 40, " b "]))
    whole = [int(tokens.words(pa.array([w]))[0].hash[0]) for w in ("one", "three", "fourteen", "a" * 40, "b")]
    assert found.hash.tolist() == whole and found.row.tolist() == [0, 0, 0, 2, 3]


# 1, 3: classifiers.


def test_quality(spark, prose):
    rows = [(i, prose(80) + "." if i % 4 else " ".join(w.upper() + "!!" for w in prose(60).split())) for i in range(300)]
    marks = labels(spark, [(i, int(i % 4 > 0), 0) for i in range(300)] + [(5, None, None), (None, 1, 1), (9999, 1, 0)])
    got = {r.doc_id: r for r in quality.quality_scores(docs(spark, rows + ODD[:1]), marks).collect()}
    assert all(got[i].held_out == (brute.fold(i, 5) == 0) for i in range(1, 300))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [i for i in range(2, 300) if got[i].held_out]
    assert np.mean([got[i].predicted == int(i % 4 > 0) for i in held]) > 0.9


def test_statistics_and_discriminant_equal_plain_ones(prose):
    texts_ = [prose(50) + ". | x!! 12\nsame line\nsame line\n", "", " ", "ÉÉ ß 漢字 ok ok", "A" * 50, prose(9).upper()]
    got = [quality.statistics(t) for t in texts_]
    assert got == [pytest.approx(brute.text_statistics(t), abs=1e-9) for t in texts_]
    rng = np.random.default_rng(1)
    x, y = rng.normal(0, 1, (80, len(quality.NAMES))), np.arange(80) % 3 // 2
    model = quality.Discriminant.fit(x, y)
    assert model.score(x[:9]) == pytest.approx([brute.discriminant(x, y, row, quality.SHRINKAGE) for row in x[:9]], rel=1e-6)


def test_quality_edges(spark):
    assert quality.quality_scores(none(spark), labels(spark, [])).count() == 0
    got = quality.quality_scores(docs(spark, ODD + ODD[3:4]), labels(spark, [(1, 1, 0)])).collect()
    assert len(got) == len(ODD) + 1 and all(np.isfinite(r.score) for r in got)


def test_held_out_labels_are_never_used(spark, prose):
    rows = docs(spark, [(i, prose(30)) for i in range(60)])
    marks = [(i, i % 2, i % 2) for i in range(60)]
    flipped = [(i, 1 - q if brute.fold(i, 5) == 0 else q, 1 - t if brute.fold(i, 3) == 1 else t) for i, q, t in marks]
    score = lambda f, m: [r.score for r in f(rows, labels(spark, m)).orderBy("doc_id").collect()]
    assert score(quality.quality_scores, marks) == score(quality.quality_scores, flipped)
    assert score(toxicity.toxicity_scores, marks) == score(toxicity.toxicity_scores, flipped)


def test_toxicity(spark, prose):
    rows = [(i, prose(40) + (" rotten" + random.Random(i).choice(["est", "ly", "ish"]) if i % 3 == 0 else "") + " " + prose(20)) for i in range(600)]
    marks = labels(spark, [(i, 1, int(i % 3 == 0)) for i in range(600)])
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs(spark, rows), marks).collect()}
    held = [i for i in range(600) if got[i].held_out]
    assert all(got[i].held_out == (brute.fold(i, 3) == 1) for i in range(600))
    assert np.mean([got[i].predicted == int(i % 3 == 0) for i in held]) > 0.9
    kept = {r.doc_id for r in toxicity.drop_toxic(docs(spark, rows), marks).collect()}
    assert np.mean([(i in kept) == (i % 3 > 0) for i in held]) > 0.9


def test_toxicity_edges(spark):
    assert toxicity.toxicity_scores(none(spark), labels(spark, [])).count() == 0
    got = toxicity.toxicity_scores(docs(spark, ODD), labels(spark, [])).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.drop_toxic(docs(spark, ODD), labels(spark, [])).columns == docs(spark, ODD).columns


def test_pooling_in_parts(prose):
    net, _ = toxicity.train([], np.zeros(0))
    scorer = toxicity.Scorer(net)
    both, _ = toxicity.buckets(pa.array([prose(300)]))
    assert np.allclose(scorer.pool(both, most=17), scorer.pool(both))


def test_convolution_equals_a_plain_one(prose):
    texts_ = [prose(n) for n in (1, 2, 3, 40, 200)] + ["", "ß 漢字 " * 3]
    rng = np.random.default_rng(2)
    net, _ = toxicity.train([], np.zeros(0))
    net.embedding[1:] = rng.normal(0, 1, (toxicity.BUCKETS - 1, toxicity.DIM))
    both, at = toxicity.buckets(pa.array(texts_))
    want = [brute.convolved(both[a:b].tolist(), net.embedding, net.taps, net.bias, net.out, net.shift) for a, b in zip(at, at[1:], strict=False)]
    assert toxicity.Scorer(net).score(pa.array(texts_)) == pytest.approx(want, rel=1e-4)


@pytest.mark.parametrize("size, auc, recall", [("sf0.01", 0.9, 0.75), ("sf0.1", 0.95, 0.9)])
def test_toxicity_on_rows_held_out(spark, size, auc, recall):
    folder = f"/root/testdata/{size}"
    if not os.path.exists(folder):
        pytest.skip("driver tables are not here")
    labels_ = spark.read.parquet(f"{folder}/labels.parquet")
    marks = {r.doc_id: r.toxic for r in labels_.collect()}
    got = [(r.score, r.predicted, marks[r.doc_id]) for r in toxicity.toxicity_scores(spark.read.parquet(f"{folder}/documents.parquet"), labels_).where("held_out").collect() if marks.get(r.doc_id) is not None]
    yes, no = [s for s, _, y in got if y], [s for s, _, y in got if not y]
    assert np.mean([[(a > b) + (a == b) / 2 for b in no] for a in yes]) >= auc
    assert np.mean([p for _, p, y in got if y]) >= recall and np.mean([p for _, p, y in got if not y]) < 0.03


def test_thresholds_by_language():
    score, y = np.array([0.2] * 30 + [0.5] * 30), np.array([0] * 30 + [1] * 30)
    both = toxicity.calibrate(np.append(score, score + 0.3), np.append(y, y), ["de"] * 60 + ["fr"] * 60, 0.7)
    # All rows are best parted at 0.5, and 60 toxic ones draw the common threshold there; French ones fit it, German ones lie below.
    assert both == {None: pytest.approx(0.6), "de": pytest.approx(0.6 - 0.1 / 3), "fr": pytest.approx(0.6)}
    few = toxicity.calibrate(np.append(score, 0.1), np.append(y, 1), ["de"] * 60 + ["fr"], 0.7)
    assert abs(few["fr"] - few[None]) < 0.03, "one toxic row hardly moves a threshold"
    assert toxicity.calibrate(score[:30], y[:30], ["de"] * 30, 0.7) == {}


def test_scores_out_of_fold_come_from_other_rows(prose):
    rng = random.Random(1)
    y = np.array([float(i % 4 == 0) for i in range(240)])
    texts_ = [prose(20) + (" rotten" if label else "") + f" own{i}" for i, label in enumerate(y)]
    both, at = toxicity.buckets(pa.array(texts_))
    rows = [both[a:b] for a, b in zip(at, at[1:], strict=False)]
    score = toxicity.out_of_fold(rows, y)
    assert np.mean([(a > b) for a in score[y == 1] for b in score[y == 0]]) > 0.95
    # A label that says nothing can't be learned from other rows, though it could be by heart.
    noise = np.array([float(rng.random() < 0.3) for _ in range(240)])
    score = toxicity.out_of_fold(rows, noise)
    assert abs(np.mean([(a > b) for a in score[noise == 1] for b in score[noise == 0]]) - 0.5) < 0.15


def test_calibrated_thresholds_take_effect(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.exists(folder):
        pytest.skip("driver tables are not here")
    documents, labels_ = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    net = toxicity.fit_toxicity(documents, labels_)
    assert {"en", "fr", "de", "es", None} <= set(net.thresholds) and all(0.1 <= t <= 0.95 for t in net.thresholds.values())
    assert len({round(t, 3) for t in net.thresholds.values()}) > 1
    got = toxicity.toxicity_scores(documents, labels_).join(documents.select("doc_id", "lang"), "doc_id").join(labels_, "doc_id", "left").collect()
    assert all(r.limit == pytest.approx(net.limit(r.lang, 0.7)) and r.rejected == (r.score >= r.limit) for r in got)
    assert any(r.rejected != bool(r.predicted) for r in got), "thresholds change what is rejected"
    held = [r for r in got if r.held_out and r.toxic is not None]
    f1 = lambda said: 2 * sum(said(r) and r.toxic for r in held) / (sum(map(said, held)) + sum(r.toxic for r in held))
    assert f1(lambda r: bool(r.rejected)) >= f1(lambda r: bool(r.predicted)) - 0.02


# 2: decontamination.

ITEM = "The train leaves Paris for Berlin at 14 hours and every ticket costs about 30 euros in the second class"


def _hits(spark, rows, items, **options):
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("items", F.lit(1))
    return {r.doc_id: r for r in decontaminate.contamination(docs(spark, rows), bench, **options).collect()}


def test_templates(spark, prose):
    other = ITEM.replace("Paris", "Madrid").replace("Berlin", "New York").replace("14", "9").replace("30", "1,275.50")
    rows = [(1, prose(30) + " " + ITEM + " " + prose(9)), (2, prose(20) + ". " + other), (3, prose(60)), (5, " ".join(ITEM.split()[3:13])), (6, None), (7, "")]
    got = _hits(spark, rows, [(10, ITEM), (11, ITEM), (12, None), (13, ""), (14, "only four words here"), (None, ITEM)])
    assert got[1].items == [10, 11] and not got[1].reparameterised and got[2].items == [10, 11] and got[2].reparameterised
    assert not any(got[i].contaminated for i in (3, 6, 7)) and got[5].contaminated
    short = _hits(spark, [(1, "x alpha beta gamma delta omega y")], [(1, "Alpha beta gamma delta omega")])
    assert short[1].contaminated


def test_items_of_few_literals_match_word_for_word(spark, prose):
    items = ["Solve 3 x + 5 = 20 , 4 y - 7 = 9 and 2 z + 8 = 16", "Maria Silva met John Smith and Anna Jones in New York City near Central Park", "Compute 12 + 30", "东京到大阪的距离是多少公里", "Yes"]
    inside = [(i, f"{prose(12)}. {x} {prose(12)}") for i, x in enumerate(items)]
    rows = inside + [(10, "they said Maria Silva met John Smith and Anna Jones in New York City near Central Park"), (11, "Compute 13 + 30"), (12, "yes"), (13, "东京到大阪的火车需要多长时间")]
    got = _hits(spark, rows, list(enumerate(items)))
    assert [got[i].items for i in range(4)] == [[0], [1], [2], [3]]
    assert not got[4].contaminated and got[10].items == [1] and not got[11].contaminated and got[12].items == [4] and not got[13].contaminated


def test_dense_items_are_found_with_other_numbers(spark, prose):
    items = ["Solve 3 x + 5 = 20 , 4 y - 7 = 9 and 2 z + 8 = 16", "Add 1 2 3 4 5 6 7 8 9 to 10 11 12 13 14 15 and then double 16 17 18 of what remains"]
    twice = "Solve 1 x + 2 = 3 , 4 y - 5 = 6 and 7 z + 8 = 9"
    rows = [(1, prose(9) + ". " + items[0].replace("3", "6").replace("20", "41")), (2, items[1].replace("10 11", "77 78")), (3, "Solve 1 x + 2 = 3 , 4 y - 6 and nothing"), (4, twice), (5, "Add 21 22 23 24 25 26 27 28 to 30 31 32 33 34 35 and then double 46 47 48")]
    got = _hits(spark, rows, [*enumerate(items), (9, "Solve 5 x + 5 = 5 , 5 y - 5 = 5 and 5 z + 5 = 5")])
    assert got[1].items == [0] and got[1].reparameterised and got[2].items == [1] and got[2].reparameterised
    # Other words or another number of slots are another template, and equal values of an item must be equal in the text.
    assert not got[3].contaminated and not got[5].contaminated and got[4].items == [0]


@pytest.mark.parametrize("share, least", [(0.25, 1.0), (0.5, 1.0), (0.7, 0.85)])
def test_recall_of_questions_with_other_values(spark, prose, share, least):
    """Items of 24 units, a share of them slots, each in a text with all numbers changed; the README has the figures."""
    rng = random.Random(int(100 * share))
    items, rows = [], []
    for i in range(60):
        units = [str(rng.randint(2, 99)) if rng.random() < share else prose(1) for _ in range(24)]
        items.append((i, " ".join(units)))
        rows.append((i, f"{prose(20)}. " + " ".join(str(int(u) + 100) if u.isdigit() else u for u in units) + f". {prose(20)}"))
    got = _hits(spark, rows + [(1000 + i, prose(80)) for i in range(40)], items)
    recall = np.mean([i in got[i].items for i in range(60)])
    print(f"recall at {share}: {recall:.2f}")
    assert recall >= least and not any(got[1000 + i].contaminated for i in range(40))


def test_windows_are_judged_alone(spark, prose):
    twisted = ITEM.replace("30 euros", "14 euros")
    pair = "they bought 14 apples and sold 30 pears at the old market by the river"
    rows = [(1, twisted), (2, pair.replace("14", "20").replace("30", "20")), (3, pair.replace("14", "7")), (4, prose(60)), (5, "we saw 5 red and 8 red birds over there")]
    items = [(10, ITEM), (11, pair), (12, "we saw 5 red and 5 red birds")]
    got = _hits(spark, rows, items)
    assert [got[i].items for i in (1, 2, 3, 4, 5)] == [[10], [11], [11], [], []]
    assert got[1].reparameterised and got[2].reparameterised and got[3].reparameterised
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs(spark, rows), bench).collect()) == [4, 5]
    # Windows of one value each stay though the item's equal values differ in another window.
    far = "the 5 boxes came by the early boat and later all of the 5 crates came by road"
    assert _hits(spark, [(1, far.replace("5 crates", "6 crates"))], [(1, far)])[1].contaminated


def test_contamination_equals_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    bits = ["red", "blue", "the", "of", "Paris", "New York", "Bob", "7", "8", "1,200", "3.5", "kg", "hours", ".", ",", "?", "x2", "中", "国", "Ünder"]
    text = lambda n: " ".join(rng.choice(bits) for _ in range(n))
    items = [(i, text(rng.randint(1, 14))) for i in range(40)]
    rows = [(i, text(rng.randint(0, 25)) + " " + (rng.choice(items)[1] if i % 3 == 0 else "") + text(rng.randint(0, 9))) for i in range(150)] + ODD + [(9, "word " * 5_000)]
    got = sorted(((r.doc_id, r.contaminated, r.items, r.n_windows, r.reparameterised) for r in decontaminate.contamination(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()), key=repr)
    assert got == sorted(((d, *brute.contamination(x, items)) for d, x in rows), key=repr)
    kept = sorted((r.doc_id for r in decontaminate.drop_contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()), key=repr)
    assert kept == sorted((g[0] for g in got if not g[1]), key=repr)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert kept == sorted((r.doc_id for r in decontaminate.drop_contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()), key=repr)


def test_decontamination_edges(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(none(spark), empty).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs(spark, ODD), empty).collect())


# 4: repeats.


def test_repeats(spark, monkeypatch):
    rng = random.Random(5)
    base = "".join(rng.choice("abcdé ") for _ in range(700))
    rows = [(i, base[rng.randint(0, 200) : rng.randint(300, 700)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 150))) + base[rng.randint(0, 400) :]) for i in range(25)]
    # Pieces at a text's ends, where a segment is padded, and rows repeated as a whole.
    rows += [(100 + i, base[50 : 50 + n]) for i, n in enumerate((199, 200, 201, 230, 260))] + [(200, "a" * 900), (201, "ab" * 400), (202, "a" * 199)] + [rows[3]] * 2 + ODD
    want = brute.repeats(rows, 200)
    run = lambda: sorted((tuple(r) for r in repeats.remove_repeats(docs(spark, rows)).collect()), key=repr)
    assert run() == want
    monkeypatch.setattr(repeats, "HOT", 2)
    assert run() == want


def test_large_groups_are_split(spark, monkeypatch):
    """Sixty texts share a line shorter than a repeat, in surroundings that differ; some of them share more."""
    rng = random.Random(9)
    line = "".join(rng.choice(string.ascii_lowercase) for _ in range(120))
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.choice((150, 90)))) + line + "".join(rng.choice("cd") for _ in range(150))) for i in range(60)]
    rows += [(100 + i, rows[i][1][20:-30] + "tail") for i in range(0, 60, 7)]
    monkeypatch.setattr(repeats, "HOT", 8)
    got = sorted((tuple(r) for r in repeats.remove_repeats(docs(spark, rows)).collect()), key=repr)
    assert got == brute.repeats(rows, 200) and sum(r[2] > 0 for r in got) == 18


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 20), st.integers(1, 20))
def test_merged_transforms_are_that_of_all_rows(seed, n, m):
    rows = np.random.default_rng(seed).integers(97, 100, (n + m, 9)).astype(np.uint8)
    merged = repeats.interleaved(repeats.transform(rows[:n]), repeats.transform(rows[n:]))
    for c in range(9):
        order = sorted(range(n + m), key=lambda i: (rows[i, c + 1 :].tobytes(), i))
        assert merged[c].tolist() == rows[order, c].tolist()


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 30))
def test_refinement_finds_the_same_windows(seed, n):
    rng = np.random.default_rng(seed)
    left, length = 6, 10
    rows = rng.integers(97, 99, (n, left + length)).astype(np.uint8)
    rows[:, left : left + 3] = 99
    before, after = rng.integers(2, left + 1, n), rng.integers(5, length + 1, n)
    for r, b, a in zip(rows, before, after, strict=True):
        r[: left - b], r[left + a :] = repeats.PAD, repeats.PAD
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(repeats, "SHARD", 1 + seed % 7)
        least, most = repeats.refine(rows, before, after, left, length)
    for i in range(n):
        valid = lambda j, o: o <= before[j] and length - o <= after[j]
        same = [o for o in range(left + 1) if valid(i, o) and any(j != i and valid(j, o) and (rows[i][left - o : left - o + length] == rows[j][left - o : left - o + length]).all() for j in range(n))]
        assert (least[i], most[i]) == ((min(same), max(same)) if same else (length, -1))


def test_repeats_edges(spark):
    assert repeats.remove_repeats(none(spark)).count() == 0
    assert sorted((tuple(r) for r in repeats.remove_repeats(docs(spark, ODD)).collect()), key=repr) == brute.repeats(ODD, 200)
    with pytest.raises(ValueError):
        repeats.repeated_spans(none(spark), 10)


# 5: secrets.


def test_base_secrets_equal_the_patterns(spark):
    rng = random.Random(2)
    bits = ["password", "PassWD", "secret = ", "token", ":", "=", "'", '"', " ", "AKIA", "0123456789abcdef" * 2, "ABCDEF0123456789", "abc", "é", "apikey: ", "api_KEY=", "xyz.123-", "ſecret=abcdefg", "deadbeef"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(600)] + ["token = token = abcdef", "AKIAAKIA" + "B" * 12]
    for t in texts:
        got = [(a, secrets.KINDS.index(k), b) for a, b, k in secrets.base_spans(t)]
        assert got == brute.base_secrets(t), t


def test_secret_digest(spark):
    text = "é password='hunter22x' AKIA" + "Q" * 16 + " " + "ab12" * 6
    r = secrets.scan_secrets(docs(spark, [(1, text)])).first()
    spans = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in brute.base_secrets(text))
    assert (r.n_assign, r.n_access, r.n_hex, r.spans) == (1, 1, 1, spans) and r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
    got = secrets.scan_secrets(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(x.spans == "" for x in got) and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.scan_secrets(none(spark)).count() == 0


def test_battery(prose):
    rng = random.Random(3)
    codes = [base64.b64encode(rng.randbytes(36)).decode()[:40] for _ in range(100)] + ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40)) for _ in range(100)]
    found = sum(any(k == "random" for _, _, k in secrets.all_spans(f"{prose(30)} {c} {prose(30)}")) for c in codes)
    assert found > 190
    long_words = ["".join(prose(8).split()) for _ in range(300)] + ["https", "snake_case_name_of_some_length", "CamelCaseNameOfSomeLength"]
    assert sum(len(secrets.all_spans(w)) for w in long_words) == 0
    assert secrets.discoveries([], []) == [] and secrets.discoveries([1e-9, 0.5], [40, 20]) == [True, False]


def test_battery_equals_its_definitions(prose):
    rng = random.Random(12)
    alphabets = [string.ascii_uppercase + "234567", string.ascii_lowercase + string.digits, "0123456789ABCDEF", "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.digits + "x"]
    tokens_ = ["".join(rng.choice(a) for _ in range(rng.randint(16, 60))) for a in alphabets for _ in range(40)]
    tokens_ += ["".join(prose(6).split())[:40] for _ in range(60)] + ["aaaaaaaaaaaaaaaa", "ABCDEFGHIJKLMNOPQRST", "0123456789abcdef0123456789abcdef", "2024-01-15-release-notes", "1234567890123456", "a1" * 10]
    for token in tokens_:
        assert secrets.battery(token) == pytest.approx(brute.battery(token), rel=1e-4, abs=1e-12), token
    for _ in range(200):
        p = [rng.choice([1e-9, 1e-5, 3e-4, 1e-3, 0.01, 0.5]) * rng.random() for _ in range(rng.randint(0, 12))]
        lengths = [rng.randint(16, 80) for _ in p]
        assert secrets.discoveries(p, lengths, 1e-3) == brute.discoveries(p, lengths, 1e-3)


def test_what_rises_step_by_step_is_no_code():
    rising = ["0123456789abcdefABCDEF0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0a1b2c3d4e5f6g7h8i9j", "AaBbCcDdEeFfGgHhIiJj"]
    assert all(secrets.battery(x) > 1e-3 for x in rising[1:2]) and secrets.serial([1.0, 1.0]) is None
    shuffled = "".join(random.Random(3).sample(rising[1], 32))
    assert secrets.battery(shuffled) < 1e-2 < secrets.battery(rising[1])


def test_battery_by_encoding(prose):
    alphabets = {"base32": string.ascii_uppercase + "234567", "base36": string.ascii_lowercase + string.digits, "hex": "0123456789ABCDEF", "base62": string.ascii_letters + string.digits, "lower": string.ascii_lowercase}
    least = {"base32": (25, 45, 65, 85), "base36": (45, 60, 78, 92), "hex": (35, 65, 80, 92), "base62": (85, 90, 95, 95), "lower": (5, 15, 25, 50)}
    rng = random.Random(6)
    for name, alphabet in alphabets.items():
        for n, share in zip((16, 20, 24, 32), least[name], strict=True):
            codes = ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(200)]
            found = sum(any(k == "random" for _, _, k in secrets.all_spans(f"{prose(5)} {c}.")) for c in codes)
            assert found >= 2 * share, (name, n, found)
    ordinary = ["/usr/share/doc/python3/examples/readme", "state-of-the-art-methods-for-everyone", "internationalization", "getElementsByClassName", "CONFIGURATION_DIRECTORY_PATH", "4000123412341234", "Donaudampfschifffahrtsgesellschaft", "desafortunadamente", "2024-01-15-release-notes", "x" * 3000, "zq" * 20, "abcdefghijklmnopqrstuvwxyz"]
    assert [w for w in ordinary if secrets.all_spans(w)] == []


def test_redaction(spark):
    rows = docs(spark, [(1, "a password=abcdefgh z"), (2, None), (3, "clean")])
    got = secrets.redact_documents(rows).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["a [SECRET] z", None, "clean"] and got[0].n_chars == 12 and got[0].__fields__ == rows.columns


# 6: near duplicates.


def _near(prose, n_groups=6):
    rng, out = random.Random(8), []
    for g in range(n_groups):
        base = prose([3, 12, 45, 60, 75, 200][g % 6]).split()
        for c in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = prose(1)
            out.append((len(out), " ".join(copy)))
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, prose, k):
    rows = _near(prose) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "One"), (1004, "one"), (1005, "x y"), (1006, "X\ty"), (1007, "word " * 3000), (1008, "word " * 4000)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs(spark, rows), k=k).collect()}
    assert got == brute.components(rows, k, 80)


def test_chains_and_wide_groups(spark, prose, monkeypatch):
    """A chain whose ends have nothing in common is one component; a bucket larger than a block is compared whole."""
    words = prose(200).split()
    rows = [(i, " ".join(words[i * 4 : i * 4 + 60])) for i in range(30)]
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs(spark, rows), k=2).collect()}
    assert got == brute.components(rows, 2, 80)


def test_near_edges(spark):
    assert near_dedup.near_duplicates(none(spark), k=2).count() == 0
    got = near_dedup.near_duplicates(docs(spark, [(5, "a b c"), (5, "a b c"), (None, "a b c"), (None, "q r s"), (6, None)]), k=2).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=repr) == [(5, 5, True), (5, 5, True), (6, 6, True), (None, 5, False), (None, None, True)]
    kept = near_dedup.keep_one(docs(spark, [(5, "a b c"), (5, "a b c"), (7, "a b c"), (6, None)]), k=2)
    assert sorted(r.doc_id for r in kept.collect()) == [5, 6] and kept.columns == docs(spark, []).columns


def test_one_row_of_each_component_stays(spark, prose):
    one, two, three, four = (prose(30) for _ in range(4))
    rows = [(None, one), (None, two), (None, two + " end"), (None, three), (1, three), (7, four), (7, one + " " + four), (7, one + " " + four), (None, ""), (None, " "), (8, None), (8, None)]
    for df in (docs(spark, rows), docs(spark, rows).repartition(3)):
        got = [(r.doc_id, r.text) for r in near_dedup.keep_one(df, k=2).collect()]
        assert sum(d is None and t in (two, two + " end") for d, t in got) == 1
        assert sorted((x for x in got if two not in (x[1] or "")), key=repr) == sorted([(None, one), (1, three), (7, four), (7, one + " " + four), (None, ""), (None, " "), (8, None)], key=repr)
    # Rows of one id and text that differ elsewhere: the same one stays however they are dealt.
    some = docs(spark, [(3, one)]).drop("source").crossJoin(spark.createDataFrame([("x",), ("y",), ("z",)], "source string"))
    assert len({tuple(r.source for r in near_dedup.keep_one(some.repartition(n), k=2).collect()) for n in (1, 2, 3)}) == 1


def test_estimate_corrects_collisions():
    rng = np.random.default_rng(1)
    for kind, buckets, n in ((near_dedup.small_signature, 1, 50), (near_dedup.large_signature, near_dedup.BUCKETS, 400)):
        got = []
        for _ in range(20):
            both = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
            a, b = np.sort(both[: n + n // 2]), np.sort(both[n // 2 :])
            same = sum(np.frombuffer(kind(a), np.uint16) == np.frombuffer(kind(b), np.uint16))
            got.append(near_dedup.estimate(np.array([same]), np.array([len(a)]), np.array([len(b)]), buckets)[0])
        assert abs(np.mean(got) - 0.5) < 0.05
    assert 0 < near_dedup.collision(4, 4) < 0.01


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7), (101, 100)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[101] == 100 and len(got) == 42
    assert components.components(edges.limit(0)).count() == 0


# 7: language model.


def test_base_score_and_folds(spark, prose):
    rows = [(i, prose(20)) for i in range(60)] + [r for r in ODD if r[0] is None or r[0] > 5]
    rows = list({d: (d, x) for d, x in rows}.values())
    want = brute.base_scores(rows, 5, 1)
    for r in lm_score.lm_scores(docs(spark, rows), queries.vocabulary("piece_bpe_32k.model"), hot_words=20).collect():
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, brute.fold(r.doc_id, 5) == 1)
        assert r.base_score == pytest.approx(base, rel=1e-9) and np.isfinite(r.score) and r.score < 0


def test_lattice_sums_all_segmentations():
    pieces = [(b" a", -1.0), (b" ab", -2.0), (b"b", -1.5), (b"c", -2.5), (b"bc", -1.0), (b" ", -3.0), (b"a", -2.0)]
    lattice = lm_score.Lattice.load(pieces)
    p = {piece: np.exp(lattice.log_p[i]) for i, (piece, _) in enumerate(pieces)}

    def total(word):
        return 1.0 if not word else sum(p[w] * total(word[len(w) :]) for w in p if word.startswith(w))

    r = lm_score.Recursion(lattice)
    got = r.log_marginals([b"abc", b"a", b"zz"])
    assert np.exp(got[0]) == pytest.approx(total(b" abc")) and np.exp(got[1]) == pytest.approx(total(b" a")) and got[2] == -np.inf
    used = r.expected([b"abc", b"a"], np.array([2.0, 1.0]))
    assert sum(len(piece) * used[i] for i, (piece, _) in enumerate(pieces)) == pytest.approx(2 * 4 + 2)


def test_score_is_the_sum_over_all_segmentations(spark):
    path = queries.vocabulary("piece_bpe_32k.model")
    rows = [(i, t) for i, t in enumerate(["The cat sat", "", None, "a b\tA", "naïve 漢字!", "zebra zebra zebra sat", "\x01 \x7f"])]
    got = {r.doc_id: r.score for r in lm_score.lm_scores(docs(spark, rows), path, rounds=0, hot_words=2).collect()}
    assert got == {d: pytest.approx(brute.marginal(t, lm_score.read_pieces(path)), rel=1e-9) for d, t in rows}


def test_training_helps(spark, prose):
    """What was learned from one half describes the other better than the untrained vocabulary."""
    rows = docs(spark, [(i, prose(40)) for i in range(200)])
    path = queries.vocabulary("piece_bpe_32k.model")
    held = lambda rounds: lm_score.lm_scores(rows, path, rounds=rounds).where("held_out").agg(F.sum("score")).first()[0]
    assert held(2) > held(0)


def test_base_score_without_training_rows(spark):
    held = [i for i in range(40) if brute.fold(i, 5) == 1][:3]
    got = lm_score.lm_scores(docs(spark, [(i, "a b") for i in held]), queries.vocabulary("piece_bpe_32k.model")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0)] * 3 and all(r.score < 0 for r in got)


def test_lm_edges(spark):
    path = queries.vocabulary("piece_bpe_32k.model")
    assert lm_score.lm_scores(none(spark), path).count() == 0
    only_held = next(i for i in range(100) if brute.fold(i, 5) == 1)
    r = lm_score.lm_scores(docs(spark, [(only_held, "a b"), (only_held, "a b")]), path).collect()
    assert len(r) == 2 and r[0].train_tokens == 0 and r[0].n_known == 0 and np.isfinite(r[0].score)


# 8: token counts.


def _library(name, texts):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(queries.vocabulary(name)).encode_batch(texts, add_special_tokens=False)]


def test_token_counts_equal_the_library(spark, prose):
    rng = random.Random(6)
    alphabet = string.printable + "éÉßΣσςǅİ漢字ไทยनमस्ते😀́‍\u0085  '’"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(800)] + [prose(300), "<|endoftext|>a<|startoftext|><|endoftext|>", "It's WE'LL i'd", "a" * 5000, ""]
    counter = bpe_count.Counter(open(queries.vocabulary(), encoding="utf-8").read())
    assert [counter.count(t) for t in texts] == _library("word_bpe_49k.json", texts)
    rows = docs(spark, list(enumerate(texts[-60:])) + [(99, None)])
    got = {r.doc_id: r for r in bpe_count.token_counts(rows, queries.vocabulary(), limit=100).collect()}
    want = _library("word_bpe_49k.json", texts[-60:])
    assert all((got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len(t.encode()), n > 100) for i, (n, t) in enumerate(zip(want, texts[-60:], strict=True)))
    assert (got[99].n_tokens, got[99].n_bytes) == (0, 0)
    assert bpe_count.token_counts(none(spark), queries.vocabulary()).count() == 0


def test_every_code_point_is_counted_as_by_the_library():
    counter = bpe_count.Counter(open(queries.vocabulary(), encoding="utf-8").read())
    every = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 50_000):
        texts = [f"a{chr(c)}b" for c in every[at : at + 50_000]]
        assert [counter.count(t) for t in texts] == _library("word_bpe_49k.json", texts)
    odd = "".join(map(chr, bpe_count.NO_LETTERS)) + "\ua7cb. \ua7dc\ue000!"
    assert counter.count(odd) == _library("word_bpe_49k.json", [odd])[0]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=12), st.permutations(["ab", "bc", "ca", "aa", "abc", "bca", "aab"]))
def test_merging_is_lowest_rank_first(word, order):
    pairs = {"ab": ("a", "b"), "bc": ("b", "c"), "ca": ("c", "a"), "aa": ("a", "a"), "abc": ("ab", "c"), "bca": ("bc", "a"), "aab": ("a", "ab")}
    ranks = {pairs[m]: i for i, m in enumerate(order)}
    symbols = list(word)
    while True:
        best = min(((ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks), default=None)
        if best is None:
            break
        i = best[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    assert bpe_count.count_merged(list(word), ranks) == len(symbols)


# 9: top-k.


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 64).astype(np.float32)]) for i in range(300)]
    rows += [(300, rows[20][1]), (301, rows[20][1]), (302, None), (303, []), (304, [float("nan")] * 64), (305, [None] * 64), (306, [float("inf")] * 64), (320, None), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit(1), "rank": F.lit(1)})
    want = brute.top_k(rows[:308])
    run = lambda: sorted(tuple(r) for r in top_k.embeddings_top_k(df).collect())
    assert run() == want
    assert sorted(tuple(r) for r in top_k.exact_top_k(df.select("vec_id", top_k.quantised(F.col("embedding"), 64).alias("v")).where("vec_id < 300"), df.select("vec_id", top_k.quantised(F.col("embedding"), 64).alias("v")).where("vec_id < 300 and vec_id % 20 = 0"), 5, block=4).collect()) == brute.top_k(rows[:300], 5)


def test_top_k_edges(spark):
    schema = "vec_id long, embedding array<double>"
    assert top_k.embeddings_top_k(spark.createDataFrame([], schema)).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0]), (2, [-1.0]), (3, []), (20, []), (4, None)], schema)
    got = [tuple(r) for r in top_k.embeddings_top_k(few).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 4096), (0, 2, 3, 0), (0, 3, 20, 0), (0, 4, 2, -4096), (20, 1, 0, 0), (20, 2, 1, 0), (20, 3, 2, 0), (20, 4, 3, 0)]


# 10: mixing.


def test_exponents(spark):
    of = lambda tokens_: mixing.Shares(spark.createDataFrame([(t,) for t in tokens_], "tokens long"))
    tokens_ = [1000, 100, 10]
    weights = lambda a: [t**a / sum(u**a for u in tokens_) for t in tokens_]
    a = of(tokens_).exponent(1110, target_entropy=0.9)
    assert -sum(w * np.log(w) for w in weights(a)) == pytest.approx(0.9 * np.log(3), abs=1e-7)
    b = of(tokens_).exponent(1110, most_repeats=4)
    assert max(w * 1110 / t for w, t in zip(weights(b), tokens_, strict=True)) == pytest.approx(4, rel=1e-7)
    assert of(tokens_).exponent(1110, target_entropy=0.0) == 1.0 and of([]).exponent(0) == 0.0 and of([5, 5]).exponent(10, most_repeats=1) == 0.0
    assert of([1000, 1]).exponent(1001, most_repeats=0.5) == 1.0


@pytest.fixture(scope="module")
def sourced(spark, prose):
    sizes = {"a": 300, "b": 60, "c": 15, None: 10}
    rows = [(i, prose(20), s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))] + [(9000, None, "a"), (9001, "", "d"), (9002, "word " * 40_000, "e")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"weight": F.lit(1), "copies": F.lit(1), "place": F.lit(1)})


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_mixture_is_realised(sourced, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", broadcast)
    rows, df = sourced
    options = {"target_entropy": 0.6, "most_repeats": 3.0}
    out = mixing.mix_sources(df, **options).collect()
    assert len(out) == len(rows)
    assert [tuple(r) for r in sorted(out, key=lambda r: r.doc_id)] == [tuple(r) for r in sorted(mixing.mix_sources(df.repartition(7), **options).collect(), key=lambda r: r.doc_id)]
    own = {}
    for r in out:
        t = own.setdefault(r.source, [0, 0, r.weight])
        t[0] += r.n_tokens
        t[1] += r.n_tokens * r.copies
    weights = brute.mixed({s: t for s, (t, _, _) in own.items()}, 1.0, 0.6, 3.0)
    total = sum(r.n_tokens for r in out)
    for s, (tokens_, drawn, weight) in own.items():
        assert weight == pytest.approx(weights[s], abs=1e-6)
        assert abs(drawn - brute.drawn(weights, total)[s]) <= (100 if s != "e" else tokens_) if tokens_ else drawn == 0
    assert all(r.n_tokens == len(brute.words(t)) for r, (_, t, _) in zip(sorted(out, key=lambda r: r.doc_id), rows, strict=True))
    assert mixing.mix_sources(df.limit(0)).count() == 0
    # The mixture has each document as often, block after block.
    drawn = mixing.mixture(df, **options).collect()
    copies = {r.doc_id: r.copies for r in out}
    assert {d: n for d, n in copies.items() if n} == {r.doc_id: sum(x.doc_id == r.doc_id for x in drawn) for r in drawn}
    assert {r.doc_id: r.text for r in drawn} == {d: t for d, t, _ in rows if copies[d]}
    last = {}
    for r in drawn:
        if r.draw == copies[r.doc_id]:
            last.setdefault((r.source, r.draw), []).append(r.place)
    # The blocks of the last, partial pass come before those that it doesn't reach.
    for (s, draw), places in last.items():
        assert all(p > max(places) for p in last.get((s, draw - 1), []))


def test_very_many_sources(spark):
    df = spark.range(120_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.col("id").cast("string").alias("source"))
    out = mixing.mix_sources(df).agg(F.sum("copies"), F.sum("weight"), F.count("*")).first()
    assert out[0] == 120_000 and out[1] == pytest.approx(1) and out[2] == 120_000
