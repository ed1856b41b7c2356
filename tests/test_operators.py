from __future__ import annotations

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributo.operators import filters, link, metrics, normalize, quality, retrieval, trends, validate
from tributo.plans import ask
from tributo.sources import rules, schema, sinks, tables
from tributo.sources.schema import conform

GOOD = dict(id=1, tipo="NFe", status="processando", emitente_cnpj="11222333000181", destinatario_cpf="52998224725", emitente_uf="SP", emitente_municipio="Santos", emitente_endereco="Rua A", data_emissao="2024-01-05", chave_acesso="35" + "0" * 42, valor_total=Decimal("51.00"), total_icms=Decimal("9.18"), numero_nota="1", serie="1")


def docs(spark, *rows):
    given = sorted({k for r in rows for k in r})
    kinds = dict(schema.TABLES["documentos"]) | {"texto": "string"}
    ddl = ", ".join(f"{c} {kinds[c]}" for c in given)
    return conform(spark.createDataFrame([tuple(r.get(c) for c in given) for r in rows], ddl), "documentos")


def items(spark, *rows):
    return conform(spark.createDataFrame(rows, "id long, documento_id long, cfop string, ncm string, valor_total decimal(18,2)"), "itens")


def taxes(spark, *rows):
    return conform(spark.createDataFrame(rows, "id long, item_id long, tipo_imposto string, cst string, valor decimal(18,2)"), "impostos")


def judged(spark, rows, item_rows, tax_rows, **options):
    out = validate.validate(docs(spark, *rows), items(spark, *item_rows), taxes(spark, *tax_rows), rules.dimension(spark), spark.createDataFrame([("22030000", "x")], "codigo string, descricao string"), **options)
    return {r.id: r for r in out.collect()}


def test_validation(spark):
    d = Decimal
    rows = [
        GOOD,
        GOOD | {"id": 2, "valor_total": d("51.05")},
        GOOD | {"id": 3, "valor_total": d("51.06")},
        GOOD | {"id": 4, "valor_total": d("200.00"), "emitente_cnpj": "11222333000182"},
        GOOD | {"id": 5, "status": "revisado", "valor_total": d("1.00")},
        GOOD | {"id": 6, "emitente_uf": "RJ"},
        {"id": 7, "status": "", "tipo": None},
        GOOD | {"id": 8, "tipo": "NFSe", "chave_acesso": None, "valor_total": None},
        GOOD | {"id": 9, "status": "revisao_pendente"},
    ]
    item_rows = [(10 * i + j, i, "5102" if i != 9 else "9999", "22030000" if i != 4 else "1", v) for i in (1, 2, 3, 4, 5, 6, 9) for j, v in ((1, d("21.00")), (2, d("30.00")))]
    tax_rows = [(i, 10 * i + 1, "ICMS", "00" if i != 3 else "77", d("9.18")) for i in (1, 2, 3, 4, 6, 9)]
    got = judged(spark, rows, item_rows, tax_rows)
    assert got[1].validacao == "valido" and got[1].novo_status == "processado" and got[1].confianca == 1.0
    assert "valor_total" not in got[2].erros and got[3].erros == ["valor_total", "cst_icms"]
    assert {"emitente_cnpj", "valor_total", "ncm"} <= set(got[4].erros) and got[4].reprocessar and got[4].novo_status == "revisao_pendente"
    assert got[5].validacao == "revisado" and got[5].erros == [] and got[5].confianca == 1.0
    assert "uf_chave" in got[6].erros and got[6].motivos == ["estrutural"]
    assert got[7].faltando == ["data_emissao", "valor_total", "chave_acesso", "emitente_cnpj"] and got[7].validacao == "invalido"
    assert got[8].faltando == ["valor_total"]
    assert got[9].erros == ["cfop"] and got[9].novo_motivo == "cfop"
    assert judged(spark, rows[4:5], item_rows, tax_rows, force=True)[5].validacao != "revisado"


def test_format_rules_without_dimension(spark):
    empty = rules.dimension(spark).where("kind = 'none'")
    rows = items(spark, (1, 1, "51", "", Decimal("1.00")), (2, 1, "5102", None, Decimal("1.00")), (3, 1, " ", None, None))
    assert [r.id for r in validate.code_violations(rows, "cfop", empty, ["cfop"], r"^\d{4}$").collect()] == [1]


def test_duplicates_and_risk(spark):
    rows = docs(spark, GOOD, GOOD | {"id": 2}, GOOD | {"id": 3, "valor_total": Decimal("51.01")}, GOOD | {"id": 4, "serie": None}, GOOD | {"id": 5, "serie": ""}, {"id": 6, "valor_total": Decimal("-1")}, GOOD | {"id": 7, "numero_nota": "9", "valor_total": Decimal("2000"), "data_emissao": "2030-01-01"})
    got = {r.id: r.duplicados for r in quality.duplicates(rows).collect()}
    assert got == {1: [2], 2: [1], 4: [5], 5: [4]}
    assert {r.id: r.duplicados for r in quality.duplicates(rows, causal=True).collect()} == {2: [1], 5: [4]}
    scores = {r.id: r for r in quality.risk(rows, quality.duplicates(rows), spark.createDataFrame([(1,)], "documento_id long"), "2024-12-31").collect()}
    assert scores[1].risco == 0.5 and scores[3].risco == 0.0 and scores[6].risco == 0.4 and scores[7].sinais == ["data_futura", "sem_impostos"]
    assert rows.sparkSession.range(1).select(quality.risk_gate(F.lit("processado"), F.lit(0.6)).alias("s")).first().s == "revisao_pendente"


def test_no_nested_loops(spark):
    rows = docs(spark, GOOD, GOOD | {"id": 2})
    for df in (quality.duplicates(rows), link.by_value_and_date(rows, rows)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_gates_and_coherence(spark):
    rows = docs(spark, GOOD | {"total_produtos": Decimal("50.00")}, {"id": 2, "status": "revisado"}, {"id": 3, "valor_total": Decimal("10"), "total_produtos": Decimal("100")})
    got = {r.id: r for r in quality.coherence(rows.withColumn("tipo_inferido", F.lit("NFE"))).collect()}
    assert got[1].sanidade == 1.0 and not got[1].sugerir
    assert got[3].problemas[0] == "total_inconsistente" and got[3].sanidade == 0.0
    scores = spark.createDataFrame([(1, 0.9, 0.9), (2, 0.1, 0.1), (3, 0.9, None)], "id long, completude double, sanidade double")
    gate = {r.id: r for r in quality.quality_gate(rows, scores).collect()}
    assert gate[1].status_novo == "processando" and gate[2].status_novo == "revisado" and gate[3].razoes == ["campos_criticos"]


def test_normalise(spark):
    raw = spark.createDataFrame(
        [(1, "05/01/2024", "R$ 1.234,56", "11.222.333/0001-81", "isento", "000123", "Maria Souza", "Padaria Sol LTDA me", "São Paulo/SP", "x 35240111222333000181550010000001231000001234", None), (2, None, "abc", "", "RUA 12345", "0", "Loja Comércio", "Ana Lima", " ", None, "9,5")],
        "id long, data_emissao string, valor_total string, emitente_cnpj string, emitente_ie string, numero_nota string, emitente_nome string, destinatario_nome string, municipio string, chave_acesso string, frete string",
    )
    out = normalize.normalise(raw.withColumns({"modelo": F.lit("55"), "uf": F.lit(None).cast("string")}))
    a, b = out.orderBy("id").collect()
    assert a.data_emissao == "2024-01-05" and a.valor_total == 1234.56 and a.emitente_ie == "ISENTO" and a.numero_nota == "123" and a.uf == "SP" and a.municipio == "São Paulo"
    assert a.invertido and a.emitente_nome == "Padaria Sol LTDA ME" and a.tipo_inferido == "NFE" and len(a.chave_acesso) == 44 and "data_emissao" in a.ajustes
    assert b.valor_total is None and b.emitente_cnpj is None and b.emitente_ie == "12345" and b.valor_frete == 9.5
    kept = normalize.write_back(raw, out, ["valor_total"]).orderBy("id").collect()
    assert kept[1].valor_total == "abc"
    twice = normalize.normalise(out.drop("invertido", "tipo_inferido", "contexto", "ajustes"))
    assert [r.numero_nota for r in twice.orderBy("id").collect()] == ["123", "0"]


def test_items_and_fusion(spark):
    rows = spark.createDataFrame([(" a  b ", "un", "1,5", "150", "2203.00.00", "AB-12", "51")], "descricao string, unidade string, quantidade string, aliquota_icms string, ncm string, codigo_produto string, cfop string")
    r = normalize.normalise_items(rows).first()
    assert (r.descricao, r.unidade, r.quantidade, r.aliquota_icms, r.ncm, r.codigo_produto, r.cfop) == ("a b", "UN", 1.5, 100.0, "22030000", "12", None)
    first = spark.createDataFrame([(1, "a", "b")], "id long, x string, total_produtos string")
    second = spark.createDataFrame([(1, "c", "")], "id long, x string, total_produtos string")
    got = normalize.fuse([first, second]).first()
    assert got.x == "c" and got.total_produtos == "b" and got.valor_produtos == "b"


def test_linkage(spark):
    known = docs(spark, GOOD | {"id": 10, "chave_acesso": "1" * 44}, GOOD | {"id": 11, "tipo": "pdf", "valor_total": Decimal("70.01"), "data_emissao": "2024-02-02"}, GOOD | {"id": 12, "valor_total": Decimal("70.00"), "data_emissao": "2024-02-01"})
    partial = docs(spark, {"id": 1, "chave_acesso": "1" * 44}, {"id": 2, "valor_total": Decimal("70.02"), "data_emissao": "2024-02-02"}, {"id": 3, "valor_total": Decimal("71.00")}, {"id": 4, "data_emissao": "2024-02-01"}, {"id": 5})
    got = {r.id: r for r in link.link(partial, known).collect()}
    assert (got[1].alvo_id, got[1].por, got[1].match_score, got[1].emitente_cnpj) == (10, "chave", 1.0, "11222333000181")
    assert (got[2].alvo_id, got[2].por, got[2].match_score) == (12, "valor_data", 0.88)
    assert got[3].por == "nenhum" and got[4].alvo_id == 12 and got[5].match_score == 0.0


def test_upserts_and_cascade(spark):
    ddl = "id long, documento_id long, chave string, valor string, origem string, criado_em string"
    now = spark.createDataFrame([(1, 1, "a", "x", "xml", "2024-01-01")], ddl)
    new = spark.createDataFrame([(2, 1, "a", "y", None, "2024-01-02"), (3, 1, "b", "z", None, "2024-01-02")], ddl)
    got = {r.chave: r for r in sinks.upsert_details(now, new).collect()}
    assert (got["a"].valor, got["a"].origem) == ("y", "xml") and got["b"].valor == "z"
    with pytest.raises(Exception, match="detail exists"):
        sinks.insert_new_details(now, new).collect()
    config = spark.createDataFrame([(1, "k", "old", None)], "id long, chave string, valor string, usuario string")
    merged = sinks.upsert_config(config, spark.createDataFrame([(2, "k", "new", None)], config.schema))
    assert [r.valor for r in merged.collect()] == ["new"]
    left = sinks.cascade({"documentos": docs(spark, GOOD, GOOD | {"id": 2}), "itens": items(spark, (1, 1, "", "", None), (2, 2, "", "", None)), "impostos": taxes(spark, (1, 1, "ICMS", "", None), (2, 2, "ICMS", "", None))}, spark.createDataFrame([(1,)], "id long"))
    assert [left[t].first().id for t in ("documentos", "itens", "impostos")] == [2, 2, 2]


def test_exports(spark, tmp_path):
    d, i, t = docs(spark, GOOD), items(spark, (1, 1, "5102", "", Decimal("1.00"))), taxes(spark, (1, 1, "ICMS", "00", None))
    sinks.export_package(d, i, t, str(tmp_path / "p"))
    assert sorted(p.name for p in (tmp_path / "p").iterdir()) == ["documento", "impostos", "itens", "meta", "origem"]
    sinks.export_csv(i, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().cfop == "5102"
    sinks.append(d, "documentos", str(tmp_path / "t"))
    sinks.append(d.select("id", F.lit(1).alias("other")), "documentos", str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    sinks.compact(spark.read.parquet(str(tmp_path / "t")), str(tmp_path / "u"), 1)


def test_catalog_and_questions(spark):
    c = tables.Catalog({"documentos": docs(spark, GOOD), "itens": items(spark), "impostos": taxes(spark)})
    with pytest.raises(ValueError):
        c.scan("sqlite_master")
    assert c.scan("documentos", limit=-1).count() == 1
    with pytest.raises(ValueError):
        ask.read_only_sql(c, "drop table documentos")
    with pytest.raises(ValueError):
        ask.read_only_sql(c, "select 1; select 2")
    want = {"top 5 emitentes": "issuers", "total por uf": "regions", "por mês": "months", "valor anual": "years", "plano": "years", "ncm": "ncm", "cfop": "cfop", "cst": "cst", "top 5 produtos": "items", "oi": "kinds"}
    assert {q: ask.intent(q) for q in want} == want
    assert [ask.top_n(q) for q in ("top 3", "top 500", "top0", "nada")] == [3, 100, 1, 5]
    assert ask.period("entre 2024-01 e 2024-03") == ("between", "2024-01", "2024-03") and ask.period("2024-02") == ("month", "2024-02") and ask.period("em 2023") == ("year", "2023") and ask.period("x") == ()
    answers = ask.Answers(1)
    assert answers.get(c, "oi") is answers.get(c, " OI ") and answers.get(c, "cst").intent == "cst" and len(answers.kept) == 1
    assert ask.analysis("tendência mensal") == "monthly_trend"


def test_metric_windows(spark):
    rows = spark.createDataFrame([(i, "ocr", "NFe", 0.9 if i < 200 else 0.5, 1.0, 0.5, 0.5, 0.5) for i in range(400)] + [(1000 + i, "nlp", "NFe", 1.0, 1.0, 0.5, 0.9, 0.9) for i in range(5)], "id long, agente string, tipo_documento string, confidence double, latency_s double, coverage double, precision double, recall double")
    got = {r.agente: r for r in metrics.suggestions(metrics.recent_and_base(rows, ["agente", "tipo_documento"])).collect()}
    assert got["ocr"].confidence_recente == 0.5 and got["ocr"].confidence_base == pytest.approx(0.7) and got["ocr"].sugestoes == ["reforcar_ocr"]
    assert got["nlp"].sugestoes == ["ativar_llm_nlp"]
    snap = spark.createDataFrame([(0.5, 0.7, 0.0, 0.5, 1)], "ocr double, nlp double, sanidade double, match_score double, erros_estruturais int")
    assert metrics.recommendations(snap).first().recomendacoes == ["reprocessar_ocr", "reforcar_associacao", "reprocessar_documento"]
    runs = spark.createDataFrame([("k", "a", 1)] * 3 + [("k", "b", 1)] * 2 + [("j", "a", 0)] * 5, "chave string, receita string, sucesso int")
    assert [(r.chave, r.receita) for r in metrics.recipes(runs, ["chave"]).collect()] == [("k", "a")]


def test_grid_helpers(spark):
    rows = docs(spark, GOOD | {"meta_json": '{"risk":{"score":0.7,"duplicates":[1,2]},"__meta__":{"normalizador":{"sanity_score":0.8}}}'}, {"id": 2, "meta_json": "broken"})
    got = {r.id: r for r in filters.with_risk(rows).collect()}
    assert (got[1].risco, got[1].duplicados, got[1].sanidade) == (0.7, 2, 0.8) and (got[2].risco, got[2].duplicados) == (0.0, 0)
    assert filters.at_least_risk(filters.with_risk(rows), 0.5).count() == 1
    assert filters.without_sparse(rows.select("id", "motivo_rejeicao", "tipo")).columns == ["id", "tipo"]
    assert filters.grid(rows).where("id = 1").first().emitente_id == "11.222.333/0001-81"
    assert filters.capped(spark.range(3).selectExpr("id as ` `", "id as b"), rows=2, columns=1).collect() == spark.range(2).toDF("col_0").collect()
    assert filters.tidy(spark.createDataFrame([(" a ", None)], "x string, y string"), ["x", "z"]).first().asDict() == {"x": "a", "y": "", "z": ""}
    assert schema.dropped_columns(rows.withColumn("zzz", F.lit(1)), "documentos") == ["zzz"]


def test_retrieval_and_trends(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [1.0]), (5, None)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in retrieval.cosine_top(vectors, [1.0, 0.0], 0).collect()] == [1]
    assert [r.vec_id for r in retrieval.cosine_top(vectors, [1.0, 0.0], 9).collect()] == [1, 3]
    chunks = spark.createDataFrame([(1, "a", 0, "x"), (2, "a", 0, "y")], "documento_id long, source string, ordem int, chunk string")
    made = retrieval.index(chunks, chunks.where("documento_id = 1"), lambda c: F.array(F.length(c).cast("double")))
    assert [(r.documento_id, r.embedding_json) for r in made.collect()] == [(2, "[1.0]")]
    months = docs(spark, *[GOOD | {"id": i, "emitente_nome": "a", "data_emissao": f"2024-{i:02d}-01", "valor_total": Decimal(i)} for i in (1, 2, 4)])
    got = {r.mes: r.variacao for r in trends.against_before(months, 1).collect()}
    assert got == {"2024-01": None, "2024-02": 1.0, "2024-04": None}
    assert trends.ewma(months, "emitente_nome").first().ewma == pytest.approx(0.7 * (0.7 * 1 + 0.3 * 2) + 0.3 * 4)


def test_normalising_keeps_every_row(spark):
    rows = spark.createDataFrame([(1, "01/02/2024"), (1, "2024-02-03"), (None, "x")], "id long, data_emissao string")
    got = normalize.normalise(rows).orderBy("data_emissao").collect()
    assert [(r.id, r.data_emissao, r.ajustes) for r in got] == [(None, None, ["data_emissao"]), (1, "2024-02-01", ["data_emissao"]), (1, "2024-02-03", [])]


def test_quantiles_are_exact(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice([None, rng.uniform(0, 9), float(rng.randint(0, 3))])) for g in "abc" for _ in range(rng.randint(1, 60))] + [("d", 5.0)]
    got = trends.quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", {"p05": 0.05, "p50": 0.5, "p99": 0.99}).collect()
    for r in got:
        own = [x for g, x in rows if g == r.g and x is not None]
        assert r.n == len(own) and [r.p05, r.p50, r.p99] == pytest.approx(list(np.quantile(own, [0.05, 0.5, 0.99])))


def test_date_alone_meets_the_best_of_a_day(spark):
    schema = "id long, tipo string, chave_acesso string, valor_total double, data_emissao string"
    known = spark.createDataFrame([(i, "pdf" if i % 2 else "NFe", None, float(i), f"2024-01-0{i % 3 + 1}") for i in range(1, 9)], schema)
    partial = spark.createDataFrame([(100, "pdf", None, None, "2024-01-01")], schema)
    assert [tuple(r) for r in link.by_value_and_date(partial, known).collect()] == [(100, 4)]


def test_only_some_problems_ask_for_another_extraction(spark):
    row = lambda **gaps: {"id": 1, "tipo_inferido": "NFE", "emitente_cnpj": "1", "destinatario_cnpj": "2", "data_emissao": "2024-01-01", "numero_nota": "3"} | gaps
    of = lambda **gaps: quality.coherence(spark.createDataFrame([row(**gaps)], "id long, tipo_inferido string, emitente_cnpj string, destinatario_cnpj string, data_emissao string, numero_nota string")).first().sugerir
    assert [of(), of(emitente_cnpj=None), of(destinatario_cnpj=None), of(data_emissao=None), of(numero_nota=None)] == [False, False, False, True, True]


def test_coherence_of_written_values(spark):
    rows = spark.createDataFrame([(1, "1.000,00", "R$ 990,00"), (2, "1.000,00", "100,00")], "id long, valor_total string, total_produtos string").withColumn("tipo_inferido", F.lit("NFE"))
    assert {r.id: "total_inconsistente" in r.problemas for r in quality.coherence(rows).collect()} == {1: False, 2: True}


def test_packages_by_bucket(spark, tmp_path):
    rows = docs(spark, *[GOOD | {"id": n, "caminho_arquivo": f"/in/{n}.xml" if n % 2 else None} for n in range(1, 41)])
    item_rows = items(spark, *[(n, n, "5102", "", Decimal("1.00")) for n in range(1, 41)])
    sinks.export_package(rows, item_rows, taxes(spark, (1, 7, "ICMS", "00", None)), str(tmp_path / "p"), buckets=4)
    assert {p.name for p in (tmp_path / "p" / "documento").iterdir() if p.is_dir()} == {f"pacote={n}" for n in range(4)}
    read = spark.read.json(str(tmp_path / "p" / "origem"))
    assert read.count() == 20 and read.where("documento_id = 7").first().caminho_arquivo == "/in/7.xml"
    bucket = spark.range(7, 8).select(sinks.package_bucket(F.col("id"), 4).alias("b")).first().b
    assert spark.read.option("header", True).csv(str(tmp_path / "p" / "impostos" / f"pacote={bucket}")).first().documento_id == "7"


def test_analytic_families(spark):
    days = [GOOD | {"id": n, "emitente_nome": "A", "data_emissao": f"2024-0{n}-01", "valor_total": Decimal(10 * n)} for n in (1, 2, 3)]
    c = tables.Catalog({"documentos": docs(spark, *days), "itens": items(spark, (1, 1, "5102", "22030000", Decimal("1.00"))), "impostos": taxes(spark, *[(n, 1, "ICMS", "00", Decimal(1000 if n == 30 else 1)) for n in range(31)])})
    assert [r.valor for r in ask.analyse(c, "há anomalia nos impostos?").frame.collect()] == [Decimal("1000.00")]
    assert [r.desvio for r in ask.analyse(c, "variação por fornecedor").frame.orderBy("mes").collect()] == [None, 1.0, 1.0]
    assert ask.analyse(c, "preço por classe").frame.first().n == 1
    assert [r.variacao for r in ask.analyse(c, "tendência").frame.orderBy("mes").collect()] == [None, 1.0, 0.5]
    assert ask.analyse(c, "top 5 emitentes").intent == "issuers"


def test_rows_about_runs(spark):
    rows = docs(spark, GOOD | {"status": "quarentena"}, GOOD | {"id": 2, "tipo": None, "status": None}).withColumns({"completude": F.lit(None).cast("double"), "tempo": F.lit(0.25)})
    got = {r.id: r for r in metrics.events(rows).collect()}
    assert (got[1].taxa_erro, got[1].acuracia_media, got[1].tempo_medio) == (1.0, 0.0, 0.25) and got[2].taxa_erro == 0.0
    assert '"total_documentos":1' in got[2].meta_json and got[2].tipo_documento is None
    kept = metrics.memory_rows(spark.createDataFrame([("q", "a")], "pergunta string, resposta_resumo string")).first()
    assert (kept.pergunta, kept.duracao_s) == ("q", 0.0) and kept.criado_em
    gone = validate.enrich(docs(spark, {"id": 1, "valor_total": None, "serie": "1"}), spark.createDataFrame([(1, "sem valor", "2")], "id long, valor_total string, serie string")).first()
    assert (gone.valor_total, gone.serie) == (Decimal("0.00"), "1")


def test_statistics_of_nothing(spark):
    got = {r.coluna: r for r in tables.statistics(docs(spark, GOOD).where("id < 0").select("id", "tipo")).collect()}
    assert set(got) == {"id", "tipo"} and got["id"].linhas == 0 and got["id"].minimo is None
