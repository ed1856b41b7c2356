"""What the engine keeps and searches by itself: rank selection, sweeps, guarded statements, ledgers, runs, streams, inverted files."""

from __future__ import annotations

import random
import re
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributo.functions import nested
from tributo.operators import filters, inverted, link, metrics, quality, retrieval, sweep, trends
from tributo.plans import ask, guard
from tributo.sources import canonical, ledger, tables
from tributo.streaming import duplicates, windows

# Quantiles by rank selection.


def _quantile(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    low = int(at)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)


@pytest.mark.parametrize("kind", ["spread", "ties", "one value", "heavy ends"])
def test_ranks_of_narrowed_groups(spark, kind):
    rng = random.Random(3)
    draw = {"spread": lambda: rng.gauss(0, 100), "ties": lambda: float(rng.randint(0, 4)), "one value": lambda: 2.5, "heavy ends": lambda: rng.choice([-1e9, 1e9, rng.random()])}[kind]
    rows = [("hot", draw()) for _ in range(6000)] + [(f"k{i % 5}", draw()) for i in range(60)] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(6)
    at = {"low": 0.0, "a": 0.05, "b": 0.25, "c": 0.5, "d": 0.75, "e": 0.951, "high": 1.0}
    by = {}
    for k, x in rows:
        if x is not None:
            by.setdefault(k, []).append(x)
    want = {k: [len(v), *[_quantile(v, p) for p in at.values()]] for k, v in by.items()}
    for large in (1 << 20, 100):
        got = {r.k: [r.n, *[r[q] for q in at]] for r in trends.quantiles(df, ["k"], "x", at, large=large).collect()}
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == pytest.approx(want[k], rel=1e-12), (k, large)


def test_narrowing_keeps_few_rows_apart(spark):
    rows = spark.range(40_000).select(F.lit("hot").alias("k"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).cast("double").alias("_v"))
    kept = trends._narrowed(rows, ["k"], {"b": 0.25, "d": 0.75}, 1000)
    assert kept.count() < 200 and kept.agg(F.sum("_c")).first()[0] == 40_000


# Sweeps.


def test_swept_frames_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(sweep, "TILE", 3)
    rng = random.Random(1)
    cells = sorted({(rng.choice("ab"), rng.randint(-40, 40)) for _ in range(60)})
    asked = sorted({(rng.choice("abc"), rng.randint(-45, 45)) for _ in range(80)})
    a = spark.createDataFrame([(k, p, 100 - p) for k, p in cells], "k string, p long, t long")
    b = spark.createDataFrame(asked, "k string, p long")
    for reach in (0, 1, 4):
        got = {(r.k, r.p): (r.least, r.n) for r in sweep.swept(a, b, "p", reach, ["k"], {"least": F.min("t"), "n": F.count("t")}).collect()}
        near = {(k, p): [100 - q for j, q in cells if j == k and abs(p - q) <= reach] for k, p in asked}
        assert got == {x: (min(v, default=None), len(v)) for x, v in near.items()}


def test_band_links_equal_all_pairs(spark):
    rng = random.Random(2)
    day = lambda: str(date(2024, 1, 1) + timedelta(rng.randint(0, 6)))
    value = lambda: rng.randint(-30, 30) / 100
    docs = [(i, rng.choice(["NFe", "pdf", None]), None if rng.random() < 0.1 else value(), None if rng.random() < 0.1 else day()) for i in range(120)]
    partial = [(1000 + i, None if i % 4 == 1 else value(), None if i % 4 == 2 else day() + ("T10:00:00" if i % 3 == 0 else "")) for i in range(80)] + [(2000, None, None), (2001, None, "soon")]
    schema = "valor_total double, data_emissao string"
    a, b = spark.createDataFrame(partial, f"id long, {schema}"), spark.createDataFrame(docs, f"id long, tipo string, {schema}")
    for band, days in ((0.02, 1), (0.05, 2)):
        got = {r.id: r.alvo_id for r in link.by_value_and_date(a, b, value_band=band, days=days).collect()}
        want = {}
        for i, v, d in partial:
            d = d[:10] if d and d[:4] == "2024" else None
            near_v = lambda w: v is not None and w is not None and abs(round(100 * v) - round(100 * w)) <= round(100 * band)  # noqa: E731,B023
            near_d = lambda e: d is not None and e is not None and abs((date.fromisoformat(d) - date.fromisoformat(e)).days) <= days  # noqa: E731,B023
            if v is not None and d is not None:
                fits = [(k != "NFe", j) for j, k, w, e in docs if near_v(w) and near_d(e)]
            elif v is not None:
                fits = [(k != "NFe", j) for j, k, w, _ in docs if near_v(w)]
            else:
                fits = [(k != "NFe", j) for j, k, _, e in docs if near_d(e)]
            if fits:
                want[i] = min(fits)[1]
        assert got == want


def _invoices(spark, rows):
    return spark.createDataFrame(rows, "id long, emitente_cnpj string, emitente_cpf string, numero_nota string, serie string, valor_total double")


def _random_invoices(n, seed):
    rng = random.Random(seed)
    return [(i, rng.choice(["1", "2", None]), rng.choice([None, "9"]), rng.choice(["7", "8", ""]), rng.choice([None, "1"]), rng.randint(0, 40) / 100) for i in range(n)]


@pytest.mark.parametrize("cents", [0.01, 0.03])
def test_duplicates_shown_counted_and_listed_agree(spark, cents):
    rows = _random_invoices(150, 4)
    df = _invoices(spark, [*rows, rows[0]])
    key = lambda r: (r[1] or r[2], r[3], r[4] or "")
    own = [r for r in rows if key(r)[0] and r[3]]
    want = {r[0]: sorted(x[0] for x in own if x[0] != r[0] and key(x) == key(r) and abs(round(100 * x[5]) - round(100 * r[5])) < round(100 * cents)) for r in own}
    want = {k: v for k, v in want.items() if v}
    assert {r.id: r.duplicados for r in quality.duplicates(df, cents=cents).collect()} == want
    assert {r.id: (r.mostrados, r.mais) for r in quality.shown_duplicates(df, 2, cents=cents).collect()} == {k: (v[:2], len(v) > 2) for k, v in want.items()}
    assert {r.id for r in quality.duplicated(df, cents=cents).collect()} == set(want)


def test_runs_kept_up_to_date(spark, tmp_path):
    rows = _random_invoices(240, 6)
    random.Random(1).shuffle(rows)
    store = duplicates.RunStore(spark, str(tmp_path / "runs"), cents=0.03, buckets=3)
    for epoch in range(3):
        store.apply(_invoices(spark, rows[80 * epoch : 80 * epoch + 80]), epoch)
        if epoch == 1:
            store.apply(_invoices(spark, rows[80:160]), 1)  # a batch that is run again
        so_far = _invoices(spark, rows[: 80 * epoch + 80])
        assert sorted(map(tuple, store.classes(so_far).collect())) == sorted(map(tuple, quality.duplicate_classes(so_far, cents=0.03).collect()))
    before = store.runs().count()
    store.apply(_invoices(spark, []), 3)
    assert store.runs().count() == before


def test_runs_merge_extend_and_bridge(spark):
    one = lambda *values: _invoices(spark, [(i, "1", None, "1", "1", v) for i, v in values])
    runs = quality.value_runs(quality.values_of(one((5, 1.00), (6, 1.01), (7, 1.05), (8, 2.00))), cents=0.02)
    after, replaced = quality.extended_runs(runs, quality.values_of(one((1, 1.03), (2, 1.02), (3, 1.04))), cents=0.02)
    assert [(r._low, r._high, r.classe, r.n) for r in after.collect()] == [(100, 105, 1, 6)]
    assert sorted(r._low for r in replaced.collect()) == [100, 105]


# Guarded statements and kept answers.


@pytest.fixture(scope="module")
def catalog(spark, sf_dir):
    return canonical.catalog(spark, sf_dir)


@pytest.mark.parametrize(
    "statement",
    [
        "SELECT tipo, count(*) AS n FROM documentos GROUP BY tipo HAVING count(*) > 1 ORDER BY n DESC LIMIT 3",
        "with x as (select id, valor_total from documentos where status = 'F'), y as (select * from x) select avg(valor_total) from y",
        "SELECT * FROM itens i JOIN documentos d ON i.documento_id = d.id WHERE d.emitente_uf LIKE 'NATION_1%' AND i.valor_total > (SELECT avg(valor_total) FROM itens)",
        "SELECT id, row_number() OVER (PARTITION BY tipo ORDER BY valor_total DESC) AS r FROM documentos WHERE id IN (SELECT documento_id FROM itens)",
        "SELECT substr(data_emissao, 1, 7) AS mes, round(sum(valor_total), 2), stddev(valor_total), count(DISTINCT emitente_nome) FROM documentos GROUP BY 1 UNION ALL SELECT 'x', 0, 0, 0",
        "SELECT CASE WHEN valor_total > 10 THEN 'a' ELSE upper(tipo) END, coalesce(nullif(status, 'F'), 'z'), year(to_date(data_emissao)) FROM documentos;",
    ],
)
def test_reading_statements_run(catalog, statement):
    if statement.endswith(";"):
        with pytest.raises(ValueError):
            ask.read_only_sql(catalog, statement + " select 1")
        statement = statement[:-1]
    assert ask.read_only_sql(catalog, statement).limit(1).count() == 1


@pytest.mark.parametrize(
    "statement",
    [
        "DROP TABLE documentos", "INSERT INTO documentos SELECT * FROM documentos", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "CREATE TABLE t AS SELECT 1", "SET x = 1", "SHOW TABLES", "EXPLAIN SELECT 1",
        "SELECT count(*) FROM parquet.`{folder}/orders.parquet`", "SELECT * FROM text.`/etc/hostname`", "SELECT * FROM (SELECT * FROM csv.`/etc/passwd`)", "SELECT id FROM documentos WHERE id IN (SELECT 1 FROM json.`/etc/passwd`)",
        "WITH a AS (SELECT * FROM text.`/etc/passwd`) SELECT * FROM a", "SELECT reflect('java.lang.Math', 'abs', -3)", "SELECT java_method('java.lang.System', 'getProperty', 'user.home') FROM documentos", "SELECT try_reflect('java.lang.Math', 'abs', -3)",
        "SELECT * FROM other_view", "SELECT * FROM range(10)", "SELECT explode(sequence(1, 100000000))", "SELECT a_python_function(id) FROM documentos", "SELECT input_file_name() FROM documentos", "SELECT current_user()", "SELECT rand() FROM documentos",
        "SELECT raise_error('x')", "SELECT no_such_column FROM documentos", "SELECT 1 FROM documentos; DROP TABLE documentos", "nonsense", "", "SELECT TRANSFORM(id) USING 'cat' AS x FROM documentos", "FROM documentos INSERT OVERWRITE DIRECTORY '/tmp/x' SELECT *",
        "SELECT secret FROM spark_catalog.default.documentos", "SELECT assert_true(false)", "SELECT version()", "SELECT sum(id) OVER (ORDER BY reflect('java.lang.Math', 'abs', -3)) FROM documentos",
    ],
)
def test_other_statements_are_refused(spark, catalog, sf_dir, statement):
    spark.range(1).createOrReplaceTempView("other_view")
    spark.udf.register("a_python_function", lambda x: x)
    with pytest.raises(ValueError):
        ask.read_only_sql(catalog, statement.format(folder=sf_dir))


def test_a_guard_runs_nothing(spark, catalog):
    catalog.views()
    before = {t.name for t in spark.catalog.listTables()}
    with pytest.raises(ValueError):
        guard.check(spark, "CREATE OR REPLACE TEMP VIEW made AS SELECT 1", {"documentos"})
    assert {t.name for t in spark.catalog.listTables()} == before


def test_answers_belong_to_their_tables(spark):
    one = lambda total: tables.Catalog({"documentos": spark.createDataFrame([(1, "NFe", "SP", total)], "id long, tipo string, emitente_uf string, valor_total double").withColumn("data_emissao", F.lit("2024-01-01"))})
    answers = ask.Answers(4)
    first, second = answers.get(one(1.0), "oi"), answers.get(one(2.0), "oi")
    assert (first.frame.first().total, second.frame.first().total) == (1.0, 2.0)
    kept = one(3.0)
    assert answers.get(kept, "oi") is answers.get(kept, "OI  ") and len(answers.kept) == 3
    trend = answers.get(kept, "tendência mensal", analytic=True)
    assert trend.intent == "monthly_trend" and answers.get(kept, "tendência mensal").intent == "months" and answers.get(kept, "tendência mensal", analytic=True) is not None
    assert len(answers.kept) == 4


# The ledger of hashes.


def test_a_ledger_tells_what_is_new(spark, tmp_path):
    rows = lambda *hashes: spark.createDataFrame([(h, i) for i, h in enumerate(hashes)], "hash string, n long")
    book = ledger.Ledger(spark, str(tmp_path / "book"), buckets=4)
    new = lambda df, **at: sorted(r.hash for r in book.fresh(df, **at).collect())
    assert new(rows("a", "b", "a", None)) == ["a", "b"]
    book.add(rows("a", "b"), 0)
    assert new(rows("a", "c", "c")) == ["c"] and new(rows("a", "c"), before=0) == ["a", "c"] and new(rows("a", "c"), before=1) == ["c"]
    book.add(rows("c", None), 1)
    book.add(rows("c"), 1)  # run again
    book.compact()
    assert sorted(map(tuple, spark.table(book.name).collect())) == [("a", 0), ("b", 0), ("c", 1)]
    again = ledger.Ledger(spark, str(tmp_path / "book"), buckets=4)
    assert again.generation == 1 and sorted(r.hash for r in again.fresh(rows("a", "z")).collect()) == ["z"]


def test_a_ledger_is_never_moved(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "large"), buckets=4)
    hashes = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    book.add(hashes, 0)
    fresh = book.fresh(hashes.limit(100))
    fresh.collect()
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    scan = plan[: plan.index("Bucketed: true")].rsplit("SortMergeJoin", 1)[1]
    # Of the join's two sides only the batch's is dealt by hash.
    assert len(re.findall(r"Exchange hashpartitioning\(hash", plan.split("Initial Plan")[0])) == 1 and "BroadcastExchange" not in plan, scan


# Recent figures as a stream.


def test_a_stream_ends_with_the_figures_of_all_rows(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), None if rng.random() < 0.1 else round(rng.random(), 3), rng.random()) for i in range(900)]
    rng.shuffle(rows)
    schema = "id long, kind string, confidence double, latency_s double"
    for part in range(3):
        spark.createDataFrame(rows[300 * part : 300 * part + 300], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "p*"))
    figures = ("confidence", "latency_s")
    told = windows.recent_and_base_stream(stream, ["kind"], figures, recent=40, base=120)
    windows.latest(told, str(tmp_path / "out"), str(tmp_path / "mark"))
    answers = spark.read.parquet(str(tmp_path / "out"))
    assert answers.select("_epoch").distinct().count() == 3
    got = {r.kind: r for r in windows.last_answers(answers, ["kind"]).collect()}
    want = {r.kind: r for r in metrics.recent_and_base(spark.createDataFrame(rows, schema), ["kind"], figures, recent=40, base=120).collect()}
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert [got[k][c] for c in r.asDict() if c != "kind"] == pytest.approx([r[c] for c in r.asDict() if c != "kind"], abs=2e-6)


# Inverted files.


def test_an_inverted_file_loses_nothing(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.05 * rng.normal(size=16)).tolist()) for i in range(1200)]
    rows += [(5000, None), (5001, [0.0] * 16), (5002, [1.0, 2.0]), (5003, []), (5004, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = inverted.build(df, str(tmp_path / "index"), cells=12)
    skipped = []
    for i in (0, 5, 77):
        query = (centres[i % 12] + 0.05 * rng.normal(size=16)).tolist()
        want = [tuple(r) for r in retrieval.cosine_top(df, query, 8).collect()]
        got = [tuple(r) for r in inverted.cosine_top(spark, index, query, 8).collect()]
        assert got == want and len(got) == 8
        read = inverted.plan(spark, index, query, 8)
        skipped.append(1 - sum(index.counts[c] for c in read) / sum(index.counts.values()))
    assert min(skipped) > 0.5, "queries near a group pass over the others"
    for query in (rng.normal(size=16).tolist(), [1.0, 2.0], [0.0] * 16):
        want = [tuple(r) for r in retrieval.cosine_top(df, query, 5).collect()]
        assert [tuple(r) for r in inverted.cosine_top(spark, index, query, 5).collect()] == want
    empty = inverted.build(df.limit(0), str(tmp_path / "empty"))
    assert inverted.cosine_top(spark, empty, [1.0], 5).count() == 0


# Variants.


def test_metadata_is_parsed_once(spark):
    rows = spark.createDataFrame([(1, '{"risk":{"score":"0.5","duplicates":[1,[2],{}]},"nlp":{"coverage":0.25}}'), (2, "{broken"), (3, None), (4, '{"risk":{"score":true,"duplicates":7}}')], "id long, meta_json string")
    out = filters.with_risk(rows)
    got = {r.id: (r.risco, r.duplicados, r.cobertura) for r in out.collect()}
    assert got == {1: (0.5, 3, 0.25), 2: (0.0, 0, None), 3: (0.0, 0, None), 4: (1.0, 0, None)} or got[4][1] == 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") <= 1


def test_merging_variants(spark):
    pairs = [('{"a":{"b":{"c":{"d":1,"e":2}}},"l":[1,2]}', '{"a":{"b":{"c":{"d":9}}},"l":[3]}'), ('{"a":1}', "not json"), (None, '{"a":{}}'), ("[1]", '{"z":null}')]
    df = spark.createDataFrame(pairs, "x string, y string")
    import json

    got = [json.loads(r[0]) for r in df.select(nested.json_merge(F.col("x"), F.col("y"))).collect()]
    assert got[0] == {"a": {"b": {"c": {"d": 9, "e": 2}}}, "l": [3]} and got[1] == {"a": 1} and got[2] == {"a": {}} and got[3] == {"z": None}


