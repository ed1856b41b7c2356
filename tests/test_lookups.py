"""Lookups, settings, rows of every table, and small functions that pages use."""

from __future__ import annotations

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tributo.functions import nested, text
from tributo.operators import aggregates, filters, link, metrics, normalize, quality, retrieval, validate
from tributo.sources import rules, schema, sinks, tables

from .test_operators import GOOD, docs, items, judged


def one(spark, f, *values, kind="string"):
    """What a column function makes of each value."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_lookups(spark):
    rows = docs(spark, GOOD | {"hash": "h1"}, GOOD | {"id": 2, "hash": "h2"}, GOOD | {"id": 3})
    assert [r.id for r in tables.by_id(rows, 2).collect()] == [2] and tables.by_id(rows, 9).count() == 0
    assert [r.id for r in tables.by_hash(rows, "h1").collect()] == [1] and tables.by_hash(rows, "").count() == 0
    details = spark.createDataFrame([(1, 1, "cor", "azul"), (2, 1, "peso", "3"), (3, 2, "cor", "verde")], "id long, documento_id long, chave string, valor string")
    assert [r.valor for r in tables.detail(details, 1, "cor").collect()] == ["azul"] and tables.detail(details, 3, "cor").count() == 0
    config = spark.createDataFrame([("tema", None, "claro"), ("tema", "ana", "escuro")], "chave string, usuario string, valor string")
    assert [r.valor for r in tables.config_value(config, "tema").collect()] == ["claro"]
    assert [r.valor for r in tables.config_value(config, "tema", "ana").collect()] == ["escuro"] and tables.config_value(config, "tema", "rui").count() == 0


def test_rules_from_a_file(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    path = tmp_path / "rules.yaml"
    path.write_text(yaml.safe_dump({"cfop": {5102: "Venda"}, "cst_icms": {"00": "Tributada"}, "ufs_validas": ["SP", "RJ"], "outra": 1}), encoding="utf-8")
    loaded = rules.load(str(path))
    assert loaded == {"cfop": {"5102": "Venda"}, "cst_icms": {"00": "Tributada"}, "csosn_icms": {}, "ncm": {}, "uf": {"SP": "SP", "RJ": "RJ"}}
    dimension = rules.dimension(spark, loaded)
    assert sorted(map(tuple, dimension.collect())) == [("cfop", "5102", "Venda"), ("cst_icms", "00", "Tributada"), ("uf", "RJ", "RJ"), ("uf", "SP", "SP")]
    bad = validate.code_violations(items(spark, (1, 1, "5102", None, None), (2, 1, "6102", None, None), (3, 1, " ", None, None)), "cfop", dimension, ["cfop"], r"^\d{4}$")
    assert [r.id for r in bad.collect()] == [2]
    path.write_text("- 1: [", encoding="utf-8")
    (tmp_path / "list.yaml").write_text("- 1", encoding="utf-8")
    for broken in (str(path), str(tmp_path / "list.yaml"), str(tmp_path / "missing.yaml")):
        assert rules.load(broken) == {"cfop": {}, "cst_icms": {}, "csosn_icms": {}, "ncm": {}, "uf": {}}
    assert rules.load()["uf"] == rules.defaults()["uf"]
    # Without codes of a kind the form decides.
    bad = validate.code_violations(items(spark, (1, 1, "5102", None, None), (2, 1, "51", None, None)), "cfop", rules.dimension(spark, {"uf": {"SP": ""}}), ["cfop"], r"^\d{4}$")
    assert [r.id for r in bad.collect()] == [2]


@pytest.mark.parametrize("table", sorted(schema.TABLES))
def test_rows_of_every_table_are_appended(spark, tmp_path, table):
    """Columns that a table lacks are left out, missing ones are null, and rows add up."""
    path = str(tmp_path / table)
    row = spark.createDataFrame([(7, "x")], "id long, unknown string")
    sinks.append(row, table, path)
    sinks.append(row, table, path)
    got = spark.read.parquet(path)
    assert got.columns == [n for n, _ in schema.TABLES[table]] and got.count() == 2


def test_memory_and_event_rows(spark):
    asked = spark.createDataFrame([("quanto?", "10"), ("quem?", "ana")], "pergunta string, resposta_resumo string")
    rows = metrics.memory_rows(asked).collect()
    assert {(r.pergunta, r.resposta_resumo, r.duracao_s) for r in rows} == {("quanto?", "10", 0.0), ("quem?", "ana", 0.0)} and len({r.id for r in rows}) == 2
    logged = metrics.event_rows(spark.createDataFrame([(1, "falhou")], "doc long, erro string"), F.lit("etapa"), ["doc", "erro"]).first()
    assert (logged.evento, logged.usuario, json.loads(logged.detalhes)) == ("etapa", "sistema", {"doc": 1, "erro": "falhou"})
    run = metrics.agent_runs(docs(spark, GOOD).withColumns({"coverage": F.lit(0.5), "layout": F.lit("a")}), "ocr", extras=["layout"]).first()
    assert (run.agente, run.tipo_documento, run.coverage, json.loads(run.extras)) == ("ocr", "NFe", 0.5, {"layout": "a"}) and run.latency_s is None


def test_filters_of_the_grid(spark):
    rows = docs(spark, GOOD, GOOD | {"id": 2, "emitente_nome": "Casa"}, GOOD | {"id": 3})
    assert filters.first_filled_value(rows, ["motivo_rejeicao", "no_column", "tipo"]).first().valor == "NFe" and filters.first_filled_value(rows, ["motivo_rejeicao"]).first().valor is None
    lists = spark.createDataFrame([([1, 3],), ([3, 9],)], "duplicados array<long>")
    assert sorted(r.id for r in filters.with_ids(rows, lists, "duplicados").collect()) == [1, 3]
    mail = spark.createDataFrame([("Ana@X.com", "ana@x.COM"), ("ana@x.com", "rui@x.com"), (None, "a")], "a string, b string")
    assert [r[0] for r in mail.select(filters.same_text(F.col("a"), F.col("b"))).collect()] == [True, False, None]
    told = docs(spark, GOOD | {"meta_json": '{"decisions":[{"ts":1.5,"msg":"lido"},{"ts":2.0,"msg":"validado"}]}'}, {"id": 2, "meta_json": "x"})
    assert [tuple(r) for r in filters.decisions(told).orderBy("ordem").collect()] == [(1, 0, 1.5, "lido"), (1, 1, 2.0, "validado")]


def test_one_row_a_key_prefers_xml(spark):
    rows = docs(spark, GOOD | {"id": 5, "tipo": "pdf"}, GOOD | {"id": 7}, GOOD | {"id": 6}, GOOD | {"id": 1, "tipo": "png", "chave_acesso": "x"}, GOOD | {"id": 2, "tipo": None, "chave_acesso": "x"})
    assert {r.chave_acesso: r.id for r in link.preferred_first(rows, ["chave_acesso"]).collect()} == {GOOD["chave_acesso"]: 6, "x": 1}


def test_retrieval_in_scope(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [1.0, 0.0])], "vec_id long, embedding array<double>")
    scope = spark.createDataFrame([(2,), (3,), (3,)], "vec_id long")
    assert [r.vec_id for r in retrieval.cosine_top(vectors, [1.0, 0.0], 5, scope=scope).collect()] == [3, 2]
    assert retrieval.cosine_top(vectors, [1.0, 0.0], 0, scope=scope).count() == 1 and retrieval.cosine_top(vectors, [1.0, 0.0], 5, scope=scope.limit(0)).count() == 0


def test_small_functions(spark):
    assert one(spark, text.positive_int, "12", "a7b", "0", "", None, "-3") == [12, 7, None, None, None, 3]
    assert one(spark, text.city_registration, " 12-a ", "??", None) == ["12-A", None, None]
    assert one(spark, lambda c: text.day_before_after(c)[0].cast("string"), "2024-03-01", "x") == ["2024-02-29", None]
    assert one(spark, lambda c: text.day_before_after(c)[1].cast("string"), "2024-02-28", None) == ["2024-02-29", None]
    assert one(spark, lambda c: text.shortened(c, 12), "curto", "uma resposta bem longa", None) == ["curto", "uma…", ""]
    assert one(spark, nested.vector, "[1, 2.5]", "x", None) == [[1.0, 2.5], None, None]


def test_places_are_warnings_unless_strict(spark):
    bare = GOOD | {"emitente_municipio": None, "emitente_endereco": None, "emitente_uf": None}
    loose, strict = (judged(spark, [bare], [], [], **o)[1] for o in ({}, {"strict_location": True}))
    assert loose.avisos == ["uf_ausente", "municipio", "endereco"] and loose.erros == []
    assert strict.avisos == [] and strict.erros == ["uf_ausente", "municipio", "endereco"] and strict.motivos == ["estrutural"]


def test_normalising_places_and_context(spark):
    rows = spark.createDataFrame([(1, "Santos / sp", None, "  Rua  A ", None), (2, "Olinda", "pe", None, "RJ")], "id long, municipio string, uf string, endereco string, emitente_uf string")
    got = {r.id: r for r in normalize.normalise(rows).collect()}
    assert (got[1].municipio, got[1].uf, got[1].emitente_uf, got[1].endereco) == ("Santos", "SP", "SP", "Rua A")
    assert (got[2].municipio, got[2].uf, got[2].emitente_uf) == ("Olinda", "PE", "RJ")
    assert got[1].contexto.municipio == "Santos / sp" and got[1].contexto.uf is None
    dropped = normalize.normalise(rows, drop_generic=True)
    assert not {"uf", "municipio", "endereco"} & set(dropped.columns) and dropped.first().contexto is not None
    ids = spark.createDataFrame([(1, "11.222.333/0001-81", "529.982.247-25"), (2, " ", "x")], "id long, emitente_cnpj string, destinatario_cpf string")
    assert [(r.emitente_cnpj, r.destinatario_cpf) for r in normalize.normalise(ids).orderBy("id").collect()] == [("11222333000181", "52998224725"), ("", "")]


def test_fallback_coherence_and_means(spark):
    d = Decimal
    rows = docs(spark, GOOD, GOOD | {"id": 2, "valor_total": d("100.00")}, {"id": 3, "tipo": "NFe"}, GOOD | {"id": 4, "tipo": "CT-e", "valor_total": None, "total_icms": None})
    sums = spark.createDataFrame([(1, d("51.00")), (2, d("10.00"))], "documento_id long, soma_itens decimal(18,2)")
    assert {r.id: r.sanidade for r in quality.simple_coherence(rows, sums).collect()} == {1: 1.0, 2: 0.5, 3: 0.0, 4: pytest.approx(0.666667)}
    means = {r.tipo: r for r in aggregates.tax_means(rows).collect()}
    assert set(means) == {"NFe", "CT-e"}
    assert schema.evolve(rows.select("id"), {"id": "long", "novo": "string"}).columns == ["id", "novo"]
