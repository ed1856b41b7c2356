"""Queries over the canonical views, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nested, text
from ..operators import aggregates, filters, link, metrics, quality, retrieval, trends, validate
from ..sources import canonical, rules, sinks, tables
from . import ask

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}

#: The canonical views in SQL.
VIEWS = """
documentos AS (
    SELECT o_orderkey AS id, o_orderpriority AS tipo, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS data_emissao, c_name AS emitente_nome,
           n_name AS emitente_uf, CAST(NULL AS VARCHAR) AS destinatario_uf, CAST(o_totalprice AS DECIMAL(18,2)) AS valor_total, o_custkey AS cust
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), itens AS (
    SELECT l_orderkey AS documento_id, l_linenumber AS numero_item, p_name AS descricao, p_type AS ncm, p_brand AS cfop, l_quantity AS quantidade,
           round(l_extendedprice / l_quantity, 4) AS valor_unitario, CAST(l_extendedprice AS DECIMAL(18,2)) AS valor_total, l_returnflag AS cst, l_suppkey,
           round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(9,4)), 2) AS icms, round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(9,4)), 2) AS ipi,
           l_tax, l_discount
    FROM lineitem JOIN part ON l_partkey = p_partkey
), impostos AS (
    SELECT documento_id, 'ICMS' AS tipo_imposto, cst, l_tax AS aliquota, icms AS valor, valor_total AS item FROM itens
    UNION ALL SELECT documento_id, 'IPI', cst, l_discount, ipi, valor_total FROM itens
)
"""


def query(sql: str | None, *, views: bool = True) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f, (f"WITH {VIEWS} {sql}" if views else sql) if sql else None
        return f

    return add


def _ask(spark: SparkSession, sf_dir: str, question: str, **scope) -> DataFrame:
    return ask.ask(canonical.catalog(spark, sf_dir), question, **scope).frame


# Questions.


@query("SELECT emitente_nome, CAST(sum(valor_total) AS DOUBLE) AS total FROM documentos GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_issuers(spark, sf_dir):
    return _ask(spark, sf_dir, "top 5 emitentes")


@query("SELECT emitente_nome, CAST(sum(valor_total) AS DOUBLE) AS total FROM documentos WHERE emitente_uf = 'NATION_3' AND tipo IN ('1-URGENT', '2-HIGH') AND data_emissao[1:4] = '1996' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7")
def top_issuers_scoped(spark, sf_dir):
    return _ask(spark, sf_dir, "top 7 fornecedores em 1996", region="NATION_3", kinds=["1-URGENT", "2-HIGH"])


@query("SELECT emitente_uf AS uf, CAST(sum(valor_total) AS DOUBLE) AS total FROM documentos GROUP BY 1")
def totals_by_region(spark, sf_dir):
    return _ask(spark, sf_dir, "faturamento por uf")


@query("SELECT data_emissao[1:7] AS mes, CAST(sum(valor_total) AS DOUBLE) AS total FROM documentos GROUP BY 1")
def totals_by_month(spark, sf_dir):
    return _ask(spark, sf_dir, "valores por mês")


@query("SELECT data_emissao[1:4] AS ano, CAST(sum(valor_total) AS DOUBLE) AS total FROM documentos GROUP BY 1")
def totals_by_year(spark, sf_dir):
    return _ask(spark, sf_dir, "valor anual")


@query("SELECT data_emissao[1:7] AS mes, CAST(sum(valor_total) AS DOUBLE) AS total FROM documentos WHERE data_emissao[1:7] BETWEEN '1995-03' AND '1996-02' GROUP BY 1")
def totals_between_months(spark, sf_dir):
    return _ask(spark, sf_dir, "resumo mensal entre 1995-03 e 1996-02")


@query("SELECT ncm, CAST(sum(i.valor_total) AS DOUBLE) AS total FROM itens i JOIN documentos d ON d.id = i.documento_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_item_class(spark, sf_dir):
    return _ask(spark, sf_dir, "valores por ncm")


@query("SELECT cfop, CAST(sum(i.valor_total) AS DOUBLE) AS total FROM itens i JOIN documentos d ON d.id = i.documento_id WHERE d.data_emissao[1:7] = '1996-05' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def top_item_code(spark, sf_dir):
    return _ask(spark, sf_dir, "top 3 cfop em 1996-05")


@query("SELECT cst, CAST(sum(t.valor) AS DOUBLE) AS total_imposto, CAST(sum(t.item) AS DOUBLE) AS base_itens FROM impostos t JOIN documentos d ON d.id = t.documento_id GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10")
def top_tax_code(spark, sf_dir):
    return _ask(spark, sf_dir, "impostos por cst")


@query("SELECT descricao AS item, CAST(sum(i.valor_total) AS DOUBLE) AS total FROM itens i JOIN documentos d ON d.id = i.documento_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def top_products(spark, sf_dir):
    return _ask(spark, sf_dir, "top 8 produtos")


@query("SELECT tipo, count(*) AS qtd, CAST(sum(valor_total) AS DOUBLE) AS total FROM documentos GROUP BY 1")
def summary_by_type(spark, sf_dir):
    return _ask(spark, sf_dir, "oi")


@query("SELECT tipo, count(*) AS qtd, CAST(sum(valor_total) AS DOUBLE) AS total FROM documentos WHERE emitente_uf = 'NATION_7' GROUP BY 1")
def read_only_statement(spark, sf_dir):
    return ask.read_only_sql(ask.scoped(canonical.catalog(spark, sf_dir), region="NATION_7"), "SELECT tipo, count(*) AS qtd, CAST(sum(valor_total) AS DOUBLE) AS total FROM documentos GROUP BY tipo")


# Indicators and pivots.


@query("SELECT count(*) FILTER (status = 'F') AS processados, count(*) FILTER (status = 'O') AS em_revisao, count(*) FILTER (status = 'P') AS com_erro, count(*) AS total FROM documentos")
def status_counts(spark, sf_dir):
    return aggregates.status_counts(canonical.documents(spark, sf_dir), "F", "O", "P")


_METRICS = "metricas AS (SELECT event_id AS id, event_type AS tipo_documento, value AS acuracia_media, CAST(event_type = 'view' AS INT) AS taxa_revisao, CAST(event_type = 'error' AS INT) AS taxa_erro, value / 10 AS tempo_medio, ts FROM events)"


@query(f"WITH {_METRICS} SELECT round(avg(acuracia_media) * 100, 4) AS acuracia, round(avg(taxa_revisao) * 100, 4) AS revisao, round(avg(tempo_medio), 4) AS tempo, round(avg(taxa_erro) * 100, 4) AS erro, count(*) AS eventos FROM metricas", views=False)
def kpi_means(spark, sf_dir):
    return aggregates.indicators(canonical.metrics(spark, sf_dir))


@query(f"WITH {_METRICS} SELECT tipo_documento, round(avg(acuracia_media), 4) AS acuracia, round(avg(taxa_erro) * 100, 4) AS erro FROM metricas GROUP BY 1", views=False)
def kpi_by_type(spark, sf_dir):
    return aggregates.indicators_by_kind(canonical.metrics(spark, sf_dir))


@query("SELECT documento_id, CAST(sum(icms) AS DOUBLE) AS icms_valor, CAST(sum(ipi) AS DOUBLE) AS ipi_valor, round(avg(l_tax), 6) AS icms_aliquota, round(avg(l_discount), 6) AS ipi_aliquota FROM itens GROUP BY 1")
def tax_pivot(spark, sf_dir):
    return aggregates.tax_pivot(canonical.taxes(spark, sf_dir), "documento_id", ("ICMS", "IPI"))


@query("SELECT documento_id, numero_item, descricao, CAST(valor_total AS DOUBLE) AS valor_total, CAST(icms AS DOUBLE) AS icms_valor, CAST(ipi AS DOUBLE) AS ipi_valor, round(l_tax, 6) AS icms_aliquota, round(l_discount, 6) AS ipi_aliquota FROM itens")
def items_with_taxes(spark, sf_dir):
    joined = aggregates.items_with_taxes(canonical.items(spark, sf_dir), canonical.taxes(spark, sf_dir), ("ICMS", "IPI"))
    return joined.select("documento_id", "numero_item", "descricao", F.col("valor_total").cast("double").alias("valor_total"), "icms_valor", "ipi_valor", "icms_aliquota", "ipi_aliquota")


@query("SELECT i.ncm, count(*) AS n, CAST(sum(i.valor_total) AS DOUBLE) AS total FROM itens i WHERE documento_id IN (SELECT id FROM documentos WHERE emitente_uf = 'NATION_5' AND tipo IN ('3-MEDIUM')) GROUP BY 1")
def scope_items(spark, sf_dir):
    docs = filters.in_scope(canonical.documents(spark, sf_dir), "NATION_5", ["3-MEDIUM"])
    return filters.items_in_scope(canonical.items(spark, sf_dir), docs).groupBy("ncm").agg(F.count("*").alias("n"), aggregates.money(F.col("valor_total")).alias("total"))


@query("SELECT tipo_imposto, count(*) AS n, CAST(sum(valor) AS DOUBLE) AS total FROM impostos WHERE documento_id IN (SELECT id FROM documentos WHERE emitente_uf = 'NATION_5') GROUP BY 1")
def scope_taxes(spark, sf_dir):
    docs = filters.in_scope(canonical.documents(spark, sf_dir), "NATION_5")
    return filters.taxes_in_scope(canonical.taxes(spark, sf_dir), canonical.item_values(spark, sf_dir), docs).groupBy("tipo_imposto").agg(F.count("*").alias("n"), aggregates.money(F.col("valor")).alias("total"))


_DETAILS = "detalhes AS (SELECT event_id AS id, user_id AS documento_id, 'k' AS chave, json_extract_string(props, '$.k') AS valor, event_type AS origem, ts AS criado_em FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL)"


@query(f"WITH {_DETAILS} SELECT d.id, d.documento_id, d.valor FROM detalhes d WHERE d.documento_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')", views=False)
def scope_details(spark, sf_dir):
    docs = filters.grid_filter(canonical.documents(spark, sf_dir), status="F")
    return filters.details_in_scope(canonical.details(spark, sf_dir), docs).select("id", "documento_id", "valor")


@query("SELECT id, tipo, status, data_emissao, emitente_uf, CAST(valor_total AS DOUBLE) AS valor_total FROM documentos WHERE status = 'O' AND emitente_uf = 'NATION_2' AND data_emissao >= '1996-01-01' AND data_emissao <= '1997-06-30'")
def grid_filtered(spark, sf_dir):
    docs = filters.grid_filter(canonical.documents(spark, sf_dir), status="O", region="NATION_2", since="1996-01-01", until="1997-06-30")
    return docs.select("id", "tipo", "status", "data_emissao", "emitente_uf", F.col("valor_total").cast("double").alias("valor_total"))


@query("SELECT id, tipo, CAST(valor_total AS DOUBLE) AS valor_total FROM documentos WHERE status = 'F' ORDER BY valor_total DESC, id LIMIT 25")
def table_scan(spark, sf_dir):
    rows = canonical.catalog(spark, sf_dir).scan("documentos", "status = 'F'", [F.desc("valor_total"), F.col("id")], 25)
    return rows.select("id", "tipo", F.col("valor_total").cast("double").alias("valor_total"))


# Deduplication and rules.


@query("SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS copias FROM documents GROUP BY 1", views=False)
def hash_dedupe(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.content_hash(F.col("text")).alias("hash"))
    return docs.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copias"))


@query("SELECT DISTINCT sha256(text) AS hash FROM documents WHERE doc_id >= 100 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id < 100 AND text IS NOT NULL) AND text IS NOT NULL", views=False)
def anti_existing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.content_hash(F.col("text")).alias("hash")).where("hash is not null")
    return tables.new_only(docs.where("doc_id >= 100"), docs.where("doc_id < 100")).select("hash")


@query(
    """, s AS (SELECT documento_id, count(*) AS n, sum(valor_total) AS soma FROM itens GROUP BY 1)
    SELECT id, n AS n_itens, CAST(soma AS DOUBLE) AS soma_itens, abs(soma - valor_total) <= 20000 AS perto,
           CASE WHEN valor_total > 0 THEN CAST(abs(soma - valor_total) AS DOUBLE) / CAST(valor_total AS DOUBLE) <= 0.25 ELSE TRUE END AS dentro
    FROM documentos JOIN s ON id = documento_id"""
)
def doc_totals_check(spark, sf_dir):
    joined = canonical.documents(spark, sf_dir).join(aggregates.item_sums(canonical.item_values(spark, sf_dir)).withColumnRenamed("documento_id", "id"), "id")
    near, within = validate.close(F.col("soma_itens"), F.col("valor_total"), F.col("valor_total"), tolerance=20000)
    return joined.select("id", "n_itens", F.col("soma_itens").cast("double").alias("soma_itens"), near.alias("perto"), within.alias("dentro"))


@query("SELECT documento_id, count(*) AS n_impostos, CAST(sum(CASE WHEN tipo_imposto = 'ICMS' THEN valor ELSE 0 END) AS DOUBLE) AS soma_icms, CAST(sum(CASE WHEN tipo_imposto = 'IPI' THEN valor ELSE 0 END) AS DOUBLE) AS soma_ipi FROM impostos GROUP BY 1")
def tax_totals(spark, sf_dir):
    sums = aggregates.tax_sums(canonical.taxes(spark, sf_dir).drop("documento_id"), canonical.item_values(spark, sf_dir))
    return sums.select("documento_id", "n_impostos", F.col("soma_icms").cast("double").alias("soma_icms"), F.col("soma_ipi").cast("double").alias("soma_ipi"))


def _brands(spark) -> DataFrame:
    return rules.dimension(spark, {"cfop": {f"Brand#{i}{j}": "" for i in (1, 2, 3) for j in range(1, 6)}})


@query("SELECT cfop, count(*) AS n FROM itens WHERE cfop NOT IN (SELECT 'Brand#' || i || j FROM range(1, 4) a(i), range(1, 6) b(j)) GROUP BY 1")
def rule_violations(spark, sf_dir):
    return validate.code_violations(canonical.items(spark, sf_dir), "cfop", _brands(spark), ["cfop"], r"^\d{4}$").groupBy("cfop").agg(F.count("*").alias("n"))


@query("SELECT ncm, count(*) AS n, count(*) FILTER (NOT regexp_full_match(ncm, '[0-9]{8}')) AS erros FROM itens WHERE trim(ncm) <> '' GROUP BY 1")
def class_findings(spark, sf_dir):
    catalogue = spark.createDataFrame([("22030000", "")], "codigo string, descricao string")
    return validate.class_findings(canonical.items(spark, sf_dir), catalogue).groupBy("ncm").agg(F.count("*").alias("n"), F.count("erro").alias("erros"))


@query(
    """SELECT id, CASE WHEN faltando = '' THEN 'completo' ELSE faltando END AS faltando FROM (
        SELECT id, concat_ws(',', CASE WHEN data IS NULL THEN 'data_emissao' END, CASE WHEN valor IS NULL THEN 'valor_total' END, CASE WHEN tipo <> 'NFSe' THEN 'chave_acesso' END) AS faltando
        FROM (SELECT id, CASE WHEN status = 'F' THEN 'NFSe' ELSE tipo END AS tipo, CASE WHEN id % 7 = 0 THEN NULL ELSE data_emissao END AS data, CASE WHEN id % 5 = 0 THEN NULL ELSE valor_total END AS valor FROM documentos))"""
)
def required_fields(spark, sf_dir):
    docs = canonical.documents(spark, sf_dir).withColumns(
        {"tipo": F.when(F.col("status") == "F", "NFSe").otherwise(F.col("tipo")), "data_emissao": F.when(F.col("id") % 7 != 0, F.col("data_emissao")), "valor_total": F.when(F.col("id") % 5 != 0, F.col("valor_total")), "total_servicos": F.lit(None).cast("double"), "chave_acesso": F.lit("")}
    )
    return docs.select("id", F.array_join(validate.required_missing(docs), ",").alias("faltando")).withColumn("faltando", F.when(F.col("faltando") == "", "completo").otherwise(F.col("faltando")))


@query(
    """WITH t AS (SELECT DISTINCT l_linenumber AS ok, l_linenumber + CAST(l_quantity AS INT) % 9 AS total FROM lineitem)
    SELECT ok, total, CASE WHEN total = 0 THEN 0 ELSE round(least(1.0, ok / total + CASE WHEN total >= 12 AND ok / total > 0.7 THEN 0.05 ELSE 0 END), 4) END AS confianca FROM t""",
    views=False,
)
def confidence(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_linenumber").alias("ok"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 9).alias("total")).distinct()
    return rows.withColumn("confianca", F.round(validate.confidence(F.col("ok"), F.col("total")), 4))


_PERTURBED = ", copias AS (SELECT id, cust, id % 50 AS numero, valor_total FROM documentos UNION ALL SELECT id + 10000000, cust, id % 50, valor_total + CAST(CASE WHEN id % 3 = 0 THEN 0.01 ELSE 0.00 END AS DECIMAL(18,2)) FROM documentos WHERE id % 4 = 0)"


def _copies(spark, sf_dir) -> DataFrame:
    docs = canonical.documents(spark, sf_dir).withColumn("numero_nota", (F.col("id") % 50).cast("string"))
    again = docs.where("id % 4 = 0").withColumns({"valor_total": (F.col("valor_total") + F.when(F.col("id") % 3 == 0, 0.01).otherwise(0.0).cast("decimal(18,2)")).cast("decimal(18,2)"), "id": F.col("id") + 10000000})
    return docs.unionByName(again)


@query(f"{_PERTURBED} SELECT a.id, list_aggregate(list_sort(list(DISTINCT b.id)), 'string_agg', ',') AS duplicados FROM copias a JOIN copias b ON a.cust = b.cust AND a.numero = b.numero AND a.id <> b.id AND abs(a.valor_total - b.valor_total) < 0.01 GROUP BY 1")
def duplicates_self(spark, sf_dir):
    return quality.duplicates(_copies(spark, sf_dir)).select("id", F.array_join(F.col("duplicados").cast("array<string>"), ",").alias("duplicados"))


@query(
    f"""{_PERTURBED}, d AS (SELECT DISTINCT a.id FROM copias a JOIN copias b ON a.cust = b.cust AND a.numero = b.numero AND a.id <> b.id AND abs(a.valor_total - b.valor_total) < 0.01), x AS (SELECT DISTINCT documento_id FROM itens)
    SELECT c.id, round(least(1.0, CASE WHEN d.id IS NULL THEN 0 ELSE 0.5 END + CASE WHEN valor_total <= 0 THEN 0.2 ELSE 0 END + CASE WHEN o_orderdate > TIMESTAMP '1997-01-01' THEN 0.2 ELSE 0 END + CASE WHEN valor_total > 1000 AND x.documento_id IS NULL THEN 0.2 ELSE 0 END), 3) AS risco
    FROM copias c JOIN orders ON o_orderkey = c.id % 10000000 LEFT JOIN d ON d.id = c.id LEFT JOIN x ON x.documento_id = c.id"""
)
def risk_score(spark, sf_dir):
    docs = _copies(spark, sf_dir)
    return quality.risk(docs, quality.duplicated(docs), canonical.item_values(spark, sf_dir), "1997-01-01").select("id", "risco")


@query(
    """, alvos AS (SELECT id, valor_total, CAST(data_emissao AS DATE) AS dia FROM documentos), linhas AS (SELECT id, valor_total, dia + CAST(unnest([-1, 0, 1]) AS INTEGER) AS dia FROM alvos)
    SELECT p.id + 1 AS id, min(d.id) AS alvo_id FROM alvos p JOIN linhas d ON d.dia = p.dia AND abs(d.valor_total - p.valor_total) <= 5 GROUP BY 1"""
)
def link_value_date_band(spark, sf_dir):
    docs = canonical.documents(spark, sf_dir)
    partial = docs.select((F.col("id") + 1).alias("id"), "valor_total", "data_emissao")
    return link.by_value_and_date(partial, docs.withColumn("tipo", F.lit("NFe")), value_band=5)


_BEST = "min_by(d.id, CASE WHEN d.tipo = '1-URGENT' THEN 0 ELSE 1 END * 100000000000 + d.id)"


@query(
    f""", alvos AS (SELECT id, tipo, valor_total, CAST(data_emissao AS DATE) AS dia FROM documentos),
    parciais AS (SELECT id, CASE WHEN id % 3 <> 1 THEN valor_total END AS valor, CASE WHEN id % 3 <> 2 THEN dia END AS dia FROM alvos),
    linhas AS (SELECT id, tipo, valor_total, dia + CAST(unnest([-1, 0, 1]) AS INTEGER) AS dia FROM alvos)
    SELECT p.id, {_BEST} AS alvo_id FROM parciais p JOIN linhas d ON d.dia = p.dia AND abs(d.valor_total - p.valor) <= 2 GROUP BY 1
    UNION ALL SELECT p.id, {_BEST} FROM parciais p JOIN alvos d ON d.valor_total BETWEEN p.valor - 2 AND p.valor + 2 WHERE p.dia IS NULL GROUP BY 1
    UNION ALL SELECT p.id, {_BEST} FROM parciais p JOIN linhas d ON d.dia = p.dia WHERE p.valor IS NULL GROUP BY 1"""
)
def link_value_date_band_all(spark, sf_dir):
    """Every document as a partial record: a third with both, a third with a date alone, a third with a value alone."""
    docs = canonical.documents(spark, sf_dir)
    partial = docs.select("id", F.when(F.col("id") % 3 != 1, F.col("valor_total")).alias("valor_total"), F.when(F.col("id") % 3 != 2, F.col("data_emissao")).alias("data_emissao"))
    return link.by_value_and_date(partial, docs.withColumn("tipo", F.when(F.col("tipo") == "1-URGENT", "NFe").otherwise("pdf")), value_band=2)


@query("SELECT doc_id AS id, min(item_id) AS alvo_id FROM (SELECT doc_id, md5(CAST(doc_id % 60 AS VARCHAR)) AS k FROM documents) JOIN (SELECT item_id, md5(CAST(item_id % 45 AS VARCHAR)) AS k FROM benchmark) USING (k) GROUP BY 1", views=False)
def link_exact(spark, sf_dir):
    # A key of 44 digits from each id's residue, so that several documents share one.
    key = lambda c, m: F.lpad((F.col(c) % m).cast("string"), 44, "0")
    partial = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), key("doc_id", 60).alias("chave_acesso"))
    docs = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("id"), key("item_id", 45).alias("chave_acesso"), F.lit("NFe").alias("tipo"))
    return link.by_key(partial, docs)


# Key/value rows, JSON, windows.


@query(f"WITH {_DETAILS} SELECT documento_id, max_by(valor, id) AS k FROM detalhes GROUP BY 1", views=False)
def detail_map(spark, sf_dir):
    return tables.detail_map(canonical.details(spark, sf_dir)).select("documento_id", F.try_element_at("detalhes", F.lit("k")).alias("k"))


@query(f"WITH {_DETAILS} SELECT id, documento_id, valor FROM detalhes WHERE lower(chave) LIKE 'k%'", views=False)
def detail_prefix(spark, sf_dir):
    return tables.details_with_prefix(canonical.details(spark, sf_dir), "K").select("id", "documento_id", "valor")


@query(f"WITH {_DETAILS} SELECT documento_id, chave, max_by(valor, CASE WHEN id % 2 = 0 THEN id ELSE id + 1000000000 END) AS valor FROM detalhes GROUP BY 1, 2", views=False)
def detail_latest(spark, sf_dir):
    rows = canonical.details(spark, sf_dir)
    return sinks.upsert(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), ["documento_id", "chave"], order="id").select("documento_id", "chave", "valor")


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS k, CAST(coalesce(json_array_length('[1,2,' || event_id || ']'), 0) AS INTEGER) AS n FROM events", views=False)
def json_paths(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    meta = F.concat(F.lit('{"risk":{"score":'), F.coalesce(F.get_json_object("props", "$.k"), F.lit("null")), F.lit(',"duplicates":[1,2,'), F.col("event_id").cast("string"), F.lit("]}}"))
    rows = filters.with_risk(events.select("event_id", meta.alias("meta_json")))
    return rows.select("event_id", F.col("risco").alias("k"), F.col("duplicados").alias("n"))


@query("SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS posicao FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3", views=False)
def last_turns(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return metrics.last_turns(rows, 3, ["conv_id"], "turn").select("conv_id", "turn", "role", "posicao")


@query(f"WITH {_METRICS} SELECT id, tipo_documento FROM (SELECT *, row_number() OVER (PARTITION BY tipo_documento ORDER BY id DESC) AS n FROM metricas) WHERE n <= 100", views=False)
def last_100_per_type(spark, sf_dir):
    return metrics.last_per_kind(canonical.metrics(spark, sf_dir)).select("id", "tipo_documento")


@query(
    f"""WITH {_METRICS}, r AS (SELECT *, row_number() OVER (PARTITION BY tipo_documento ORDER BY id DESC) AS n, count(*) OVER (PARTITION BY tipo_documento) AS c FROM metricas),
    s AS (SELECT *, least(c, 100) AS nr, least(c, 300) AS nb FROM r)
    SELECT tipo_documento, round(avg(acuracia_media) FILTER (n <= 100), 6) AS recente, round(avg(acuracia_media) FILTER (n <= nb AND n > nb - CASE WHEN nb > nr THEN greatest(10, nb - nr) ELSE nb END), 6) AS base FROM s GROUP BY 1""",
    views=False,
)
def recent_vs_base(spark, sf_dir):
    rows = canonical.metrics(spark, sf_dir).withColumn("confidence", F.col("acuracia_media"))
    return metrics.recent_and_base(rows, ["tipo_documento"], ("confidence",)).select("tipo_documento", F.col("confidence_recente").alias("recente"), F.col("confidence_base").alias("base"))


@query("SELECT emitente_nome, count(*) AS documentos, round(CAST(sum(valor_total) AS DOUBLE) / count(*), 4) AS valor_medio, max(data_emissao) AS ultima FROM documentos GROUP BY 1")
def entity_profiles(spark, sf_dir):
    return metrics.entity_profiles(canonical.documents(spark, sf_dir)).select("emitente_nome", "documentos", "valor_medio", "ultima")


# Retrieval.


@query("SELECT doc_id, i AS ordem, substr(trim(text, ' '), CAST(i * 800 + 1 AS BIGINT), 800) AS chunk FROM documents, LATERAL (SELECT unnest(range(0, CAST(ceil(length(trim(text, ' ')) / 800.0) AS BIGINT))) AS i)", views=False)
def chunk_800(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("documento_id"), F.lit("texto").alias("source"), F.col("text").alias("texto"))
    return retrieval.chunked(docs).select(F.col("documento_id").alias("doc_id"), F.col("ordem").cast("long").alias("ordem"), "chunk")


def query_vector() -> list[float]:
    return [((i * 37) % 64 - 32) / 64 for i in range(64)]


@query(
    """WITH q AS (SELECT list_transform(range(0, 64), lambda i: ((i * 37) % 64 - 32) / 64.0) AS q), v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
    SELECT vec_id, round(list_cosine_similarity(e, list_transform(q, lambda x: CAST(x AS DOUBLE))), 6) AS score FROM v, q WHERE round(list_cosine_similarity(e, list_transform(q, lambda x: CAST(x AS DOUBLE))), 6) > 0 ORDER BY 2 DESC, 1 LIMIT 6""",
    views=False,
)
def cosine_topk(spark, sf_dir):
    return retrieval.cosine_top(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), query_vector(), 6)


@query("SELECT documento_id, count(*) AS linhas, sum(valor_total) :: DOUBLE AS total FROM itens GROUP BY 1")
def text_blocks(spark, sf_dir):
    items = canonical.items(spark, sf_dir).withColumn("codigo_produto", F.lit(None).cast("string"))
    taxes = canonical.taxes(spark, sf_dir).drop("documento_id").withColumns({"id": F.xxhash64("item_id", "tipo_imposto"), "origem": F.lit(None).cast("string")})
    blocks = retrieval.text_blocks(canonical.details(spark, sf_dir), items, taxes).where("source = 'itens'")
    lines = F.split("texto", "\n")
    value = F.transform(lines, lambda x: F.element_at(F.split(x, r" \| "), -1).cast("decimal(18,2)"))
    return blocks.select("documento_id", F.size(lines).cast("long").alias("linhas"), F.aggregate(value, F.lit(0).cast("decimal(18,2)"), lambda a, x: (a + x).cast("decimal(18,2)")).cast("double").alias("total"))


_LINE_ID = "CAST('0x' || md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), CAST(l_extendedprice AS DECIMAL(18,2))))[1:15] AS BIGINT)"


@query(
    f"""WITH {_DETAILS}, linha AS (
        SELECT {_LINE_ID} AS id, l_orderkey AS documento_id, l_linenumber AS n, p_name AS nome, l_returnflag AS cst, CAST(l_extendedprice AS DECIMAL(18,2)) AS valor FROM lineitem JOIN part ON p_partkey = l_partkey
    ), bloco AS (
        SELECT documento_id, 'detalhes' AS source, chave || ': ' || coalesce(valor, '') AS linha FROM detalhes
        UNION ALL SELECT documento_id, 'itens', n || ' | ' || nome || ' |  |  |  |  |  | ' || valor FROM linha
        UNION ALL SELECT documento_id, 'impostos', id || ' | ' || id || ' | ICMS | ' || cst || ' |  |  |  | ' || valor FROM linha
    ) SELECT documento_id, source, count(*) AS linhas, string_agg(linha, chr(10) ORDER BY linha) AS texto FROM bloco GROUP BY 1, 2""",
    views=False,
)
def text_blocks_all(spark, sf_dir):
    """The blocks of details, items and taxes, their lines in order, with ids that both dialects can make of a line."""
    number = F.conv(F.substring(F.md5(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint"), F.col("l_extendedprice").cast("decimal(18,2)"))), 1, 15), 16, 10).cast("bigint")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("descricao"))
    none = lambda *names: [F.lit(None).cast("string").alias(c) for c in names]
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(part, "l_partkey")
    lines = lines.select(number.alias("id"), F.col("l_orderkey").alias("documento_id"), F.col("l_linenumber").alias("numero_item"), "descricao", F.col("l_returnflag").alias("cst"), F.col("l_extendedprice").cast("decimal(18,2)").alias("valor_total"))
    items = lines.drop("cst").select("*", *none("codigo_produto", "ncm", "cfop", "quantidade", "valor_unitario"))
    taxes = lines.select("id", F.col("id").alias("item_id"), F.lit("ICMS").alias("tipo_imposto"), "cst", *none("origem", "base_calculo", "aliquota"), F.col("valor_total").alias("valor"))
    blocks = retrieval.text_blocks(canonical.details(spark, sf_dir), items, taxes)
    parts = F.array_sort(F.split("texto", "\n"))
    return blocks.select("documento_id", "source", F.size(parts).cast("long").alias("linhas"), F.array_join(parts, "\n").alias("texto"))


# Analytic families.


@query(
    """, s AS (SELECT cst, avg(CAST(valor AS DOUBLE)) AS m, stddev_samp(CAST(valor AS DOUBLE)) AS sd FROM impostos WHERE tipo_imposto = 'ICMS' GROUP BY 1)
    SELECT cst, count(*) AS n, round(max((CAST(valor AS DOUBLE) - m) / sd), 4) AS maior FROM impostos JOIN s USING (cst) WHERE tipo_imposto = 'ICMS' AND abs(round((CAST(valor AS DOUBLE) - m) / sd, 6)) > 3 GROUP BY 1"""
)
def tax_zscore(spark, sf_dir):
    out = trends.zscores(canonical.taxes(spark, sf_dir).where("tipo_imposto = 'ICMS'"), ["cst"], "valor", few=True)
    return out.groupBy("cst").agg(F.count("*").alias("n"), F.round(F.max("z"), 4).alias("maior"))


@query(
    """, q AS (SELECT cst, quantile_cont(CAST(valor AS DOUBLE), 0.25) AS a, quantile_cont(CAST(valor AS DOUBLE), 0.75) AS b FROM impostos WHERE tipo_imposto = 'ICMS' GROUP BY 1)
    SELECT cst, round(a - 1.5 * (b - a), 4) AS abaixo, round(b + 1.5 * (b - a), 4) AS acima, count(*) AS n FROM impostos JOIN q USING (cst) WHERE tipo_imposto = 'ICMS' AND (CAST(valor AS DOUBLE) < round(a - 1.5 * (b - a), 6) OR CAST(valor AS DOUBLE) > round(b + 1.5 * (b - a), 6)) GROUP BY 1, 2, 3"""
)
def tax_iqr(spark, sf_dir):
    out = trends.quartile_outliers(canonical.taxes(spark, sf_dir).where("tipo_imposto = 'ICMS'"), ["cst"], "valor", few=True)
    return out.groupBy("cst", F.round("abaixo", 4).alias("abaixo"), F.round("acima", 4).alias("acima")).agg(F.count("*").alias("n"))


@query("SELECT ncm, count(*) AS n, round(quantile_cont(valor_unitario, 0.05), 6) AS p05, round(quantile_cont(valor_unitario, 0.5), 6) AS p50, round(quantile_cont(valor_unitario, 0.95), 6) AS p95 FROM itens GROUP BY 1")
def unit_price_quantiles(spark, sf_dir):
    return trends.price_quantiles(canonical.items(spark, sf_dir))


def _against(months: int) -> str:
    return f""", m AS (SELECT data_emissao[1:7] AS mes, sum(valor_total) AS total, CAST(data_emissao[1:4] AS INT) * 12 + CAST(data_emissao[6:7] AS INT) AS n FROM documentos GROUP BY 1, 3)
    SELECT a.mes, CAST(a.total AS DOUBLE) AS total, CAST(b.total AS DOUBLE) AS antes, CASE WHEN b.total > 0 THEN round((CAST(a.total AS DOUBLE) - CAST(b.total AS DOUBLE)) / CAST(b.total AS DOUBLE), 6) END AS variacao FROM m a LEFT JOIN m b ON a.n = b.n + {months}"""


@query(_against(1))
def monthly_mom(spark, sf_dir):
    return trends.against_before(canonical.documents(spark, sf_dir), 1)


@query(_against(1))
def ask_monthly_trend(spark, sf_dir):
    return ask.analyse(canonical.catalog(spark, sf_dir), "qual a tendência mensal do total?").frame


@query(
    """SELECT ncm, count(*) AS n, round(quantile_cont(valor_unitario, 0.05)) AS p05, round(quantile_cont(valor_unitario, 0.5)) AS p50, round(quantile_cont(valor_unitario, 0.95)) AS p95
    FROM itens WHERE documento_id IN (SELECT id FROM documentos WHERE data_emissao[1:4] = '1997' AND emitente_uf = 'NATION_5') GROUP BY 1"""
)
def ask_price_by_class(spark, sf_dir):
    answer = ask.analyse(canonical.catalog(spark, sf_dir), "preço unitário por classe em 1997", region="NATION_5")
    return answer.frame.select("ncm", "n", *[F.round(c).alias(c) for c in ("p05", "p50", "p95")])


@query(
    """, s AS (SELECT tipo_imposto, avg(CAST(valor AS DOUBLE)) AS m, stddev_samp(CAST(valor AS DOUBLE)) AS sd FROM impostos GROUP BY 1)
    SELECT tipo_imposto, count(*) AS n, round(max((CAST(valor AS DOUBLE) - m) / sd), 4) AS maior FROM impostos JOIN s USING (tipo_imposto) WHERE abs(round((CAST(valor AS DOUBLE) - m) / sd, 6)) > 3 GROUP BY 1"""
)
def ask_tax_outliers(spark, sf_dir):
    out = ask.analyse(canonical.catalog(spark, sf_dir), "quais impostos estão fora da média?").frame
    return out.groupBy("tipo_imposto").agg(F.count("*").alias("n"), F.round(F.max("z"), 4).alias("maior"))


@query(
    """, m AS (SELECT emitente_nome, data_emissao[1:7] AS mes, CAST(sum(valor_total) AS DOUBLE) AS total FROM documentos WHERE data_emissao[1:4] = '1996' GROUP BY 1, 2),
    w AS (SELECT *, avg(total) OVER (PARTITION BY emitente_nome ORDER BY mes ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS mm FROM m)
    SELECT emitente_nome, mes, total, round(mm, 4) AS media_movel, CASE WHEN mm > 0 THEN round(total / mm - 1, 6) END AS desvio FROM w"""
)
def ask_supplier_change(spark, sf_dir):
    return ask.analyse(canonical.catalog(spark, sf_dir), "variação por fornecedor em 1996").frame


@query(_against(12))
def monthly_yoy(spark, sf_dir):
    return trends.against_before(canonical.documents(spark, sf_dir), 12)


@query(
    """, m AS (SELECT emitente_uf, data_emissao[1:7] AS mes, CAST(sum(valor_total) AS DOUBLE) AS total FROM documentos GROUP BY 1, 2),
    w AS (SELECT *, avg(total) OVER (PARTITION BY emitente_uf ORDER BY mes ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS mm FROM m)
    SELECT emitente_uf, mes, total, round(mm, 4) AS media_movel, CASE WHEN mm > 0 THEN round(total / mm - 1, 6) END AS desvio FROM w"""
)
def supplier_rolling(spark, sf_dir):
    return trends.supplier_rolling(canonical.documents(spark, sf_dir), "emitente_uf")


# Shaping.


@query(
    """SELECT 'id' AS coluna, 1.0 AS parte UNION ALL SELECT 'vazia', 0.0 UNION ALL SELECT 'rara', round(avg(CASE WHEN id % 40 = 0 THEN 1.0 ELSE 0.0 END), 6) FROM documentos"""
)
def sparse_columns(spark, sf_dir):
    docs = canonical.documents(spark, sf_dir).select("id", F.lit("").alias("vazia"), F.when(F.col("id") % 40 == 0, "x").alias("rara"))
    return filters.filled_shares(docs)


@query("SELECT id, campo, antes, depois FROM (SELECT id, 'status' AS campo, status AS antes, 'X' AS depois FROM documentos WHERE id % 5 = 0 UNION ALL SELECT id, 'serie', '1', NULL FROM documentos WHERE id % 9 = 0)")
def item_diff(spark, sf_dir):
    before = canonical.documents(spark, sf_dir).select("id", "status", "serie")
    after = before.select("id", F.when(F.col("id") % 5 == 0, "X").otherwise(F.col("status")).alias("status"), F.when(F.col("id") % 9 != 0, F.col("serie")).alias("serie"))
    return sinks.changed_cells(before, after)


@query("SELECT d.id, CASE WHEN id % 6 = 0 THEN 'revisado' WHEN id % 4 = 0 THEN 'b' ELSE status END AS status FROM documentos d")
def manual_overrides(spark, sf_dir):
    docs = canonical.documents(spark, sf_dir).select("id", "status", F.lit("m").alias("motivo_rejeicao"))
    edit = lambda every, value, at: docs.where(F.col("id") % every == 0).select("id", F.lit("status").alias("campo"), F.lit(value).alias("valor"), F.lit(at).alias("em"))
    edits = edit(4, "a", "2024-01-01").unionByName(edit(4, "b", "2024-01-02")).unionByName(sinks.approve(docs.where("id % 6 = 0"), "2024-01-03"))
    return sinks.apply_overrides(docs, edits).select("id", "status")


@query(
    """SELECT 'documentos' AS tabela, tipo AS chave, count(*) AS n FROM documentos WHERE id % 10 <> 0 GROUP BY 2
    UNION ALL SELECT 'itens', cfop, count(*) FROM itens WHERE documento_id % 10 <> 0 GROUP BY 2
    UNION ALL SELECT 'impostos', tipo_imposto, count(*) FROM impostos WHERE documento_id % 10 <> 0 GROUP BY 2"""
)
def cascade_delete(spark, sf_dir):
    """What is left of documents, items and tax rows once a tenth of the documents is deleted."""
    c = canonical.catalog(spark, sf_dir).tables
    left = sinks.cascade({k: c[k] for k in ("documentos", "itens", "impostos")}, c["documentos"].where("id % 10 = 0"))
    count = lambda table, key: left[table].groupBy(F.lit(table).alias("tabela"), F.col(key).alias("chave")).agg(F.count("*").alias("n"))
    return count("documentos", "tipo").unionByName(count("itens", "cfop")).unionByName(count("impostos", "tipo_imposto"))


@query("SELECT event_id, lower(regexp_extract('f.' || CASE event_id % 3 WHEN 0 THEN 'XML' WHEN 1 THEN 'pdf' ELSE 'png' END, '\\.([a-zA-Z]+)$', 1)) AS ext, event_id % 3 = 0 AS lido FROM events", views=False)
def route_by_extension(spark, sf_dir):
    from ..sources import ingest

    ext = F.element_at(F.array(F.lit("XML"), F.lit("pdf"), F.lit("png")), (F.col("event_id") % 3 + 1).cast("int"))
    files = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.concat(F.lit("f."), ext).alias("nome_arquivo"), F.lit(b"").alias("content"))
    good, other = ingest.route(files)
    mark = lambda df, v: df.select("event_id", ingest.extension().alias("ext"), F.lit(v).alias("lido"))
    return mark(good, True).unionByName(mark(other, False))


@query(None)
def html_wellformed(spark, sf_dir):
    """Every page through the tolerant reader; what doesn't parse is quarantined, not lost."""
    from ..sources import xml

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("string").alias("nome_arquivo"), F.col("html").cast("binary").alias("content"))
    return xml.documents(xml.parse(pages)).select("nome_arquivo", "tipo", "status")


@query("SELECT vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_transform(embedding, lambda x: CAST(x * x AS DOUBLE))), 4) AS c FROM embeddings", views=False)
def cosine_pairs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select("vec_id", F.round(nested.cosine(F.col("embedding"), F.transform("embedding", lambda x: (x * x).cast("double"))), 4).alias("c"))
