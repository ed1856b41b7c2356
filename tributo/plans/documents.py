"""Queries over documents written from the orders table, a layout each, and over what is derived from them.

Every order becomes one XML document whose fields vary with it; the SQL says what must be read from it again.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nested
from ..operators import link, metrics, normalize, quality, validate
from ..sources import ingest, rules, tables, xml

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}

#: What the documents are made of, in both dialects: name, Spark, SQL.
MADE = (
    ("id", "o_orderkey", "o_orderkey"),
    ("k", "cast(o_orderkey as string)", "CAST(o_orderkey AS VARCHAR)"),
    ("d", "date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')"),
    ("v", "cast(cast(o_totalprice as decimal(18,2)) as string)", "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)"),
    ("c", "lpad(cast(o_custkey as string), 14, '1')", "lpad(CAST(o_custkey AS VARCHAR), 14, '1')"),
    ("p", "lpad(cast(o_custkey as string), 11, '2')", "lpad(CAST(o_custkey AS VARCHAR), 11, '2')"),
    ("u", "element_at(array('SP', 'RJ', 'PR', 'SC'), cast(o_orderkey % 4 + 1 as int))", "['SP', 'RJ', 'PR', 'SC'][CAST(o_orderkey % 4 + 1 AS INTEGER)]"),
    ("y", "concat('3', lpad(cast(o_orderkey as string), 43, '0'))", "'3' || lpad(CAST(o_orderkey AS VARCHAR), 43, '0')"),
)
ORDERS = "m AS (SELECT " + ", ".join(f"{sql} AS {name}" for name, _, sql in MADE) + ", o_totalprice FROM orders)"

ISSUER = "<emit><CNPJ>{c}</CNPJ><xNome>Casa  {k}</xNome><enderEmit><xLgr>Rua {k}</xLgr><nro>7</nro><xMun>Santos</xMun><UF>{u}</UF></enderEmit><IE>12{k}</IE></emit>"
DATED = "<dhEmi>{d}T10:00:00-03:00</dhEmi>"

TEMPLATES = {
    "nfe": "<nfeProc versao='4.00' xmlns='urn:nfe'><NFe><infNFe Id='NFe{y}'><ide><natOp>Venda {k}</natOp><mod>55</mod><serie>1</serie><nNF>{k}</nNF>" + DATED + "</ide>" + ISSUER
    + "<dest><CPF>{p}</CPF><xNome>Cliente {k}</xNome><enderDest><UF>BA</UF></enderDest></dest>"
    "<det nItem='1'><prod><xProd>Item {k}</xProd><NCM>22030000</NCM><CFOP>5102</CFOP><qCom>2.0000</qCom><vUnCom>1.5</vUnCom><vProd>{v}</vProd></prod>"
    "<imposto><ICMS><ICMS00><orig>0</orig><CST>00</CST><vBC>{v}</vBC><pICMS>18.00</pICMS><vICMS>{k}.10</vICMS><vFCP>0.42</vFCP></ICMS00></ICMS>"
    "<PIS><PISAliq><CST>01</CST><vBC>{v}</vBC><pPIS>1.65</pPIS><vPIS>0.35</vPIS></PISAliq></PIS></imposto></det>"
    "<det nItem='2'><prod><xProd>Frete</xProd><CFOP>6108</CFOP><qCom>1</qCom><vProd>3.00</vProd></prod><imposto><ICMS/></imposto></det>"
    "<total><ICMSTot><vProd>{v}</vProd><vICMS>{k}.10</vICMS><vNF>{v}</vNF></ICMSTot></total><transp><veicTransp><placa>AB{k}</placa></veicTransp></transp>"
    "<pag><detPag><tPag>17</tPag><vPag>{v}</vPag></detPag></pag></infNFe></NFe><protNFe><infProt><nProt>1{k}</nProt></infProt></protNFe></nfeProc>",
    "nfce": "<n:NFe xmlns:n='urn:x'><n:infNFe Id='NFe{y}'><n:ide><n:mod>65</n:mod><n:serie>2</n:serie><n:nNF>{k}</n:nNF><n:dEmi>{d}</n:dEmi></n:ide><n:EMIT><n:CNPJ>{c}</n:CNPJ><n:xNome>Loja {k}</n:xNome></n:EMIT>"
    "<n:total><n:ICMSTot><n:vNF>{v}</n:vNF></n:ICMSTot></n:total><n:pag><n:detPag><n:tPag>01</n:tPag><n:vPag>{v}</n:vPag></n:detPag><n:vTroco>0.50</n:vTroco></n:pag></n:infNFe></n:NFe>",
    "cte": "<cteProc><CTe><infCte Id='CTe{y}'><ide><mod>57</mod><serie>1</serie><nCT>{k}</nCT>" + DATED + "</ide>" + ISSUER + "<rem><CNPJ>{c}</CNPJ><xNome>Remetente {k}</xNome><enderReme><UF>{u}</UF></enderReme></rem>"
    "<vPrest><vTPrest>{v}</vTPrest></vPrest><infCTeNorm><infCarga><infQ><cUnid>01</cUnid><qCarga>5.0</qCarga></infQ><infQ><cUnid>03</cUnid><qCarga>{k}</qCarga></infQ></infCarga>"
    "<infModal><rodo><veic><placa>XY{k}</placa></veic></rodo></infModal></infCTeNorm></infCte></CTe></cteProc>",
    "mdfe": "<MDFe><infMDFe><ide><mod>58</mod><serie>1</serie><nMDF>{k}</nMDF><dIniViagem>{d}</dIniViagem></ide>" + ISSUER
    + "<infModal><rodo><veicTracao><placa>ZZ{k}</placa><UF>RS</UF></veicTracao></rodo></infModal><infDoc><chNFe>{y}</chNFe></infDoc><tot><qCTe>4</qCTe><vCarga>{v}</vCarga></tot></infMDFe></MDFe>",
    "cfe": "<CFe><infCFe Id='CFe1'><ide><mod>59</mod><nCFe>{k}</nCFe><serie>3</serie><dEmi>{d}</dEmi></ide>" + ISSUER + "<dest/><total><vCFe>{v}</vCFe></total>"
    "<pgto><MP><cMP>01</cMP><vMP>5.00</vMP></MP><MP><cMP>03</cMP><vMP>{v}</vMP></MP><vTroco>5.00</vTroco></pgto></infCFe></CFe>",
    "nfse": "<CompNfse><Nfse><InfNfse><DataEmissao>{d}T00:00:00</DataEmissao><PrestadorServico><RazaoSocial>Oficina {k}</RazaoSocial><Cnpj>{c}</Cnpj><Endereco><Endereco>Rua {k}</Endereco><Numero>1</Numero>"
    "<CodigoMunicipio>3550308</CodigoMunicipio></Endereco></PrestadorServico><TomadorServico><RazaoSocial>Cliente {k}</RazaoSocial><Cpf>{p}</Cpf></TomadorServico>"
    "<Servico><Valores><ValorServicos>{v}</ValorServicos></Valores></Servico></InfNfse></Nfse></CompNfse>",
    "generic": "<qualquer><ide><nNF>{k}</nNF><dEmi>{d}</dEmi></ide><emit><xNome>Alguém {k}</xNome><CNPJ>{c}</CNPJ></emit><total><vNF>{v}</vNF></total></qualquer>",
}


def _text(template: str):
    """The template as a column: its text, and the made columns in braces."""
    parts = [F.col(p[1:-1]) if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", template) if p]
    return F.concat(*parts)


def _made(orders: DataFrame) -> DataFrame:
    return orders.select("o_totalprice", *[F.expr(made).alias(name) for name, made, _ in MADE])


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark.read.parquet(f"{sf_dir}/orders.parquet"))


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_orders, the short rows dealt to several tasks a core before documents are made of them: a table may be one block of a file."""
    table = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return _made(table.repartition(4 * spark.sparkContext.defaultParallelism, "o_orderkey"))


def _written(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """id, k, nome_arquivo, content."""
    return _dealt(spark, sf_dir).select("id", "k", F.concat("k", F.lit(".xml")).alias("nome_arquivo"), _text(TEMPLATES[kind]).cast("binary").alias("content"))


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f, f"WITH {ORDERS} {sql}" if sql else None
        return f

    return add


def _extraction(kind: str, **columns: str) -> None:
    """A query that reads documents of a layout; columns: what each field must be, in SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = xml.documents(xml.parse(_written(spark, sf_dir, kind), items=False))
        types = dict(docs.dtypes)
        return docs.select("id", *[F.col(c).cast("double" if types[c].startswith("decimal") else types[c]).alias(c) for c in columns])

    QUERIES[f"xml_extract_{kind}"] = run, f"WITH {ORDERS} SELECT id, {', '.join(f'{value} AS {name}' for name, value in columns.items())} FROM m"


_COMMON = {"data_emissao": "d", "valor_total": "CAST(v AS DOUBLE)", "emitente_cnpj": "c"}
_ISSUER = {"emitente_nome": "'Casa ' || k", "emitente_uf": "u", "emitente_ie": "'12' || k", "emitente_endereco": "'Rua ' || k || ', 7, Santos, ' || u", "emitente_municipio": "'Santos'"}
_NONE = "CAST(NULL AS VARCHAR)"
_extraction("nfe", tipo="'NFe'", numero_nota="k", serie="'1'", modelo="'55'", natureza_operacao="'Venda ' || k", chave_acesso="y", destinatario_cpf="p", destinatario_nome="'Cliente ' || k", destinatario_uf="'BA'", total_icms="CAST(k || '.10' AS DOUBLE)", forma_pagamento="'17'", valor_pagamento="CAST(v AS DOUBLE)", placa_veiculo="'AB' || k", protocolo_autorizacao="'1' || k", versao_schema="'4.00'", **_COMMON, **_ISSUER)
_extraction("nfce", tipo="'NFCe'", numero_nota="k", serie="'2'", chave_acesso="y", emitente_nome="'Loja ' || k", forma_pagamento="'01'", troco="CAST(0.5 AS DOUBLE)", destinatario_nome=_NONE, **_COMMON)
_extraction("cte", tipo="'CTe'", numero_nota="k", chave_acesso="y", destinatario_nome="'Remetente ' || k", destinatario_cnpj="c", destinatario_uf="u", qtd_volumes="CAST(k AS DOUBLE)", placa_veiculo="'XY' || k", **_COMMON, **_ISSUER)
_extraction("mdfe", tipo="'MDF-e'", numero_nota="k", chave_acesso="y", placa_veiculo="'ZZ' || k", uf_veiculo="'RS'", **_COMMON, **_ISSUER)
_extraction("cfe", tipo="'CF-e'", numero_nota="k", serie="'3'", forma_pagamento="'01'", valor_pagamento="CAST(CAST(v AS DECIMAL(18,2)) + 5 AS DOUBLE)", troco="CAST(5 AS DOUBLE)", destinatario_nome=_NONE, **_COMMON, **_ISSUER)
_extraction("nfse", tipo="'NFSe'", emitente_nome="'Oficina ' || k", emitente_uf="'SP'", destinatario_nome="'Cliente ' || k", destinatario_cpf="p", total_servicos="CAST(v AS DOUBLE)", numero_nota=_NONE, **_COMMON)
_extraction("generic", tipo="'xml/desconhecido'", numero_nota="k", emitente_nome="'Alguém ' || k", modelo=_NONE, **_COMMON)


@query("SELECT id, 1 AS numero_item, 'Item ' || k AS descricao, '22030000' AS ncm, '5102' AS cfop, CAST(2 AS DOUBLE) AS quantidade, CAST(v AS DOUBLE) AS valor_total FROM m UNION ALL SELECT id, 2, 'Frete', NULL, '6108', 1, 3 FROM m")
def xml_items(spark, sf_dir):
    rows = xml.items(xml.parse(_written(spark, sf_dir, "nfe")), "id")
    return rows.select("id", F.col("numero_item").cast("int").alias("numero_item"), "descricao", "ncm", "cfop", F.col("quantidade").cast("double").alias("quantidade"), F.col("valor_total").cast("double").alias("valor_total"))


@query(
    """SELECT id, 'ICMS' AS tipo_imposto, '00' AS cst, '0' AS origem, CAST(v AS DOUBLE) AS base_calculo, CAST(18 AS DOUBLE) AS aliquota, CAST(k || '.10' AS DOUBLE) AS valor FROM m
    UNION ALL SELECT id, 'FCP', NULL, NULL, NULL, NULL, 0.42 FROM m UNION ALL SELECT id, 'PIS', '01', NULL, CAST(v AS DOUBLE), 1.65, 0.35 FROM m"""
)
def xml_taxes(spark, sf_dir):
    rows = xml.taxes(xml.items(xml.parse(_written(spark, sf_dir, "nfe")), "id"), "id")
    return rows.select("id", "tipo_imposto", "cst", "origem", *[F.col(c).cast("double").alias(c) for c in ("base_calculo", "aliquota", "valor")])


@query(
    """SELECT id, round(CASE id % 3 WHEN 0 THEN 13 WHEN 1 THEN 7 ELSE 0 END / 19.0, 3) AS completude, round(CASE id % 3 WHEN 0 THEN 14 WHEN 1 THEN 7 ELSE 0 END / 20.0, 3) AS cobertura,
    id % 3 = 2 AS quarentena FROM m"""
)
def completeness(spark, sf_dir):
    """Documents of two layouts, and a third of them cut short, which don't parse."""
    made = _dealt(spark, sf_dir)
    nfe = _text(TEMPLATES["nfe"])
    content = F.when(F.col("id") % 3 == 0, nfe).when(F.col("id") % 3 == 1, _text(TEMPLATES["nfse"])).otherwise(F.left(nfe, F.lit(200)))
    docs = xml.documents(xml.parse(made.select("id", F.col("k").alias("nome_arquivo"), content.cast("binary").alias("content")), items=False))
    return docs.select("id", "completude", "cobertura", (F.col("status") == "quarentena").alias("quarentena"))


@query(
    """SELECT k || CASE id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.XML' ELSE '.xml' END AS nome_arquivo, CASE WHEN id % 4 = 0 THEN 'pdf' WHEN id % 4 = 1 THEN 'xml/invalido' ELSE 'CF-e' END AS tipo,
    CASE WHEN id % 4 < 2 THEN 'quarentena' ELSE 'processando' END AS status FROM m"""
)
def union_quarantine(spark, sf_dir):
    """Parsed, unreadable and foreign files come out of an ingestion as one table, a row each."""
    k = F.col("id") % 4
    name = F.concat("k", F.when(k == 0, ".pdf").when(k == 1, ".XML").otherwise(".xml")).alias("nome_arquivo")
    content = F.when(k < 2, F.concat(F.lit("<a>"), "k")).otherwise(_text(TEMPLATES["cfe"])).cast("binary")
    files = _dealt(spark, sf_dir).select(name, F.lit("/in").alias("caminho_arquivo"), content.alias("content")).withColumn("hash", F.sha2(F.concat(F.col("nome_arquivo").cast("binary"), "content"), 256))
    return ingest.ingest(files, day="2024-08-01")["documentos"].select("nome_arquivo", "tipo", "status")


@query(
    """SELECT id, d AS data_emissao, CAST(v AS DOUBLE) AS valor_total, c AS emitente_cnpj, k AS numero_nota, CASE WHEN id % 2 = 0 THEN NULL ELSE '5102' END AS cfop, 'data_emissao,valor_total,numero_nota' || CASE WHEN id % 2 = 0 THEN ',cfop' ELSE '' END AS ajustes
    FROM m UNION ALL SELECT NULL, d, CAST(v AS DOUBLE), c, k, '5102', 'data_emissao,valor_total,numero_nota' FROM m WHERE id % 5 = 0"""
)
def normalised_fields(spark, sf_dir):
    """Dates, Brazilian numbers, note numbers and codes; a fifth of the rows again, without an id."""
    made = _orders(spark, sf_dir)
    raw = made.select(
        "id",
        F.concat(F.substring("d", 9, 2), F.lit("/"), F.substring("d", 6, 2), F.lit("/"), F.substring("d", 1, 4)).alias("data_emissao"),
        F.concat(F.lit("R$ "), F.replace("v", F.lit("."), F.lit(","))).alias("valor_total"),
        F.col("c").alias("emitente_cnpj"),
        F.concat(F.lit("00"), "k").alias("numero_nota"),
        F.when(F.col("id") % 2 == 0, "51").otherwise("5102").alias("cfop"),
    )
    again = raw.where("id % 5 = 0").withColumn("id", F.lit(None).cast("long")).withColumn("cfop", F.lit("5102"))
    out = normalize.normalise(raw.unionByName(again))
    return out.select("id", "data_emissao", "valor_total", "emitente_cnpj", "numero_nota", "cfop", F.array_join("ajustes", ",").alias("ajustes"))


@query(
    """, t AS (SELECT id, round(greatest(0.0, 1.0 - CASE WHEN id % 2 = 0 THEN 0.45 ELSE 0 END - CASE WHEN id % 3 = 0 THEN 0.1 ELSE 0 END - CASE WHEN id % 5 = 0 THEN 0.15 ELSE 0 END - CASE WHEN id % 7 = 0 THEN 0.15 ELSE 0 END), 6) AS sanidade FROM m)
    SELECT id, sanidade, concat_ws(',', CASE WHEN id % 2 = 0 THEN 'total_inconsistente' END, CASE WHEN id % 3 = 0 THEN 'cfop_uf' END, CASE WHEN id % 5 = 0 THEN 'destinatario_ausente' END, CASE WHEN id % 7 = 0 THEN 'numero_ausente' END) AS problemas,
    sanidade < 0.65 OR id % 7 = 0 AS sugerir FROM t"""
)
def coherence(spark, sf_dir):
    k = F.col("id")
    docs = _orders(spark, sf_dir).select(
        "id", F.lit("NFE").alias("tipo_inferido"), F.lit(100.0).alias("valor_total"), F.when(k % 2 == 0, 50.0).otherwise(90.0).alias("total_produtos"), F.lit(5.0).alias("valor_frete"),
        F.lit("5102").alias("cfop"), F.lit("SP").alias("emitente_uf"), F.when(k % 3 == 0, "RJ").otherwise("sp").alias("destinatario_uf"),
        F.col("c").alias("emitente_cnpj"), F.when(k % 5 != 0, F.col("p")).alias("destinatario_cpf"), F.col("d").alias("data_emissao"), F.when(k % 7 != 0, F.col("k")).alias("numero_nota"),
    )
    return quality.coherence(docs).select("id", "sanidade", F.array_join("problemas", ",").alias("problemas"), "sugerir")


@query(
    """, r AS (SELECT id, id % 2 = 0 AS a, id % 3 = 0 AS b, id % 5 = 0 AS s, CASE id % 4 WHEN 0 THEN 'revisado' WHEN 1 THEN NULL ELSE 'processado' END AS status FROM m)
    SELECT id, CASE WHEN (a OR b OR s) AND coalesce(status, '') <> 'revisado' THEN 'revisao_pendente' ELSE coalesce(status, 'processado') END AS status_novo,
    concat_ws(',', CASE WHEN a THEN 'completude' END, CASE WHEN b THEN 'campos_criticos' END, CASE WHEN s THEN 'sanidade' END) AS razoes FROM r"""
)
def quality_gate(spark, sf_dir):
    k = F.col("id")
    made = _orders(spark, sf_dir)
    docs = made.select("id", F.when(k % 3 != 0, F.col("c")).alias("emitente_cnpj"), F.col("v").alias("valor_total"), F.when(k % 3 != 0, F.col("d")).alias("data_emissao"), F.when(k % 4 == 0, "revisado").when(k % 4 != 1, "processado").alias("status"))
    scores = made.select("id", F.when(k % 2 == 0, 0.5).otherwise(0.7).alias("completude"), F.when(k % 5 == 0, 0.7).otherwise(0.8).alias("sanidade"))
    return quality.quality_gate(docs, scores).select("id", "status_novo", F.array_join("razoes", ",").alias("razoes"))


@query(
    """, s AS (SELECT l_orderkey AS id, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS soma FROM lineitem GROUP BY 1
    ), d AS (SELECT m.id, soma, soma + CASE WHEN m.id % 5 = 0 THEN 1000 ELSE 0 END AS total, m.id % 3 <> 0 AS e, m.id % 4 <> 0 AS uf, m.id % 7 = 0 AS chave FROM m LEFT JOIN s ON m.id = s.id
    ), f AS (SELECT id, CASE WHEN soma IS NULL THEN NULL ELSE id % 5 <> 0 END AS near, soma IS NOT NULL AND id % 5 = 0 AND CAST(1000 AS DOUBLE) / CAST(total AS DOUBLE) > 0.25 AS far, e, uf, NOT (e AND chave AND soma IS NOT NULL) AS lacks FROM d
    ), g AS (SELECT *, round((e::INT + uf::INT + 2 + coalesce(near::INT, 0)) / (e::INT + 3.0 + (near IS NOT NULL)::INT), 4) AS confianca, lacks OR near IS FALSE AS bad, lacks OR far AS structural FROM f
    ), h AS (SELECT *, CASE WHEN NOT bad THEN 'valido' WHEN confianca >= 0.6 THEN 'parcial' ELSE 'invalido' END AS validacao FROM g)
    SELECT id, confianca, validacao, concat_ws(',', CASE WHEN near IS FALSE THEN 'valor_total' END, CASE WHEN lacks THEN 'obrigatorios' END) AS erros, CASE WHEN NOT uf THEN 'uf_ausente' ELSE '' END AS avisos,
    structural OR (validacao <> 'valido' AND confianca < 0.65) AS reprocessar, CASE WHEN bad THEN 'revisao_pendente' ELSE 'processado' END AS novo_status FROM h"""
)
def validate_documents(spark, sf_dir):
    """The rule engine over all orders: ids, regions, totals against items and required fields fail by turns."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    money = F.col("l_extendedprice").cast("decimal(18,2)")
    items = lines.select(F.monotonically_increasing_id().alias("id"), F.col("l_orderkey").alias("documento_id"), F.lit("5102").alias("cfop"), F.lit("22030000").alias("ncm"), money.alias("valor_total"))
    sums = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.sum(money).alias("soma"))
    k = F.col("id")
    none = lambda c: F.lit(None).cast("string").alias(c)
    docs = _orders(spark, sf_dir).join(sums, "id", "left").select(
        "id", F.lit("NFe").alias("tipo"), F.lit("processando").alias("status"), F.when(k % 3 != 0, "11222333000181").alias("emitente_cnpj"), *[none(c) for c in ("emitente_cpf", "destinatario_cnpj", "destinatario_cpf", "destinatario_uf", "destinatario_municipio", "destinatario_endereco")],
        F.when(k % 4 != 0, "SP").alias("emitente_uf"), F.lit("Santos").alias("emitente_municipio"), F.lit("Rua A").alias("emitente_endereco"), F.when(k % 7 == 0, F.concat(F.lit("35"), F.lpad("k", 42, "0"))).alias("chave_acesso"),
        F.col("d").alias("data_emissao"), (F.col("soma") + F.when(k % 5 == 0, 1000).otherwise(0)).cast("decimal(18,2)").alias("valor_total"), *[F.lit(None).cast("decimal(18,2)").alias(f"total_{c}") for c in ("servicos", "icms", "ipi", "pis", "cofins")],
    )
    taxes = spark.createDataFrame([], "id long, item_id long, tipo_imposto string, cst string, aliquota decimal(18,4), valor decimal(18,2)")
    catalogue = spark.createDataFrame([("22030000",)], "codigo string")
    out = validate.validate(docs, items, taxes, rules.dimension(spark), catalogue)
    return out.select("id", "confianca", "validacao", F.array_join("erros", ",").alias("erros"), F.array_join("avisos", ",").alias("avisos"), "reprocessar", "novo_status")


@query(
    """, l AS (
        SELECT l_orderkey AS id, count(*) AS n, bool_or(l_partkey % 40 = 0) AS cfop, bool_or(l_partkey % 40 = 1) AS seis, bool_or(l_partkey % 40 > 1) AS cinco,
               bool_or(l_suppkey % 30 = 0) AS forma, bool_or(l_suppkey % 30 = 1) AS fora, bool_or(l_partkey % 35 = 0) AS cst FROM lineitem GROUP BY 1
    ), d AS (
        SELECT m.id, n IS NOT NULL AS tem, cfop, forma, fora, cst, m.id % 6 <> 0 AS uf, m.id % 8 <> 0 AS municipio, m.id % 10 <> 0 AS endereco, m.id % 6 = 0 OR m.id % 7 = 0 AS chave, m.id % 11 <> 0 AS icms,
               CASE WHEN m.id % 6 = 0 OR m.id % 9 = 0 THEN cinco ELSE seis END AS cruza FROM m LEFT JOIN l ON m.id = l.id
    ), e AS (
        SELECT *, round((1 + uf::INT + municipio::INT + endereco::INT + CASE WHEN tem THEN 4 + icms::INT ELSE 0 END) / (4.0 + chave::INT + CASE WHEN tem THEN 5 ELSE 0 END), 4) AS confianca,
               concat_ws(',', CASE WHEN NOT uf THEN 'uf' END, CASE WHEN chave THEN 'uf_chave' END, CASE WHEN tem AND NOT icms THEN 'total_icms' END, CASE WHEN cfop THEN 'cfop' END, CASE WHEN forma THEN 'ncm' END,
                         CASE WHEN cst THEN 'cst_icms' END, CASE WHEN cruza THEN 'cfop_uf' END, CASE WHEN NOT tem THEN 'obrigatorios' END) AS erros,
               NOT tem OR coalesce(cruza, FALSE) OR chave AS estrutural FROM d
    ), f AS (SELECT *, CASE WHEN erros = '' THEN 'valido' WHEN confianca >= 0.6 THEN 'parcial' ELSE 'invalido' END AS validacao FROM e)
    SELECT id, confianca, validacao, erros, concat_ws(',', CASE WHEN NOT municipio THEN 'municipio' END, CASE WHEN NOT endereco THEN 'endereco' END, CASE WHEN fora THEN 'ncm' END) AS avisos,
           estrutural OR (validacao <> 'valido' AND confianca < 0.65) AS reprocessar FROM f"""
)
def validate_codes_and_taxes(spark, sf_dir):
    """The rule engine with codes, classes and taxes that vary by line, and regions, keys, places and tax totals by document."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    k, part, supplier = F.col("id"), F.col("l_partkey"), F.col("l_suppkey")
    money = F.col("l_extendedprice").cast("decimal(18,2)")
    tax = F.round(money * F.col("l_tax").cast("decimal(9,4)"), 2).cast("decimal(18,2)")
    items = lines.select(
        F.xxhash64(*lines.columns).alias("id"), F.col("l_orderkey").alias("documento_id"), F.when(part % 40 == 0, "9999").when(part % 40 == 1, "6108").otherwise("5102").alias("cfop"),
        F.when(supplier % 30 == 0, "123").when(supplier % 30 == 1, "84713019").otherwise("22030000").alias("ncm"), money.alias("valor_total"),
    )
    situation = F.when(part % 35 == 0, "77").when(part % 35 == 1, "102").otherwise("00").alias("cst")
    taxes = lines.select(F.xxhash64(*lines.columns).alias("item_id"), F.lit("ICMS").alias("tipo_imposto"), situation, F.col("l_tax").cast("decimal(18,4)").alias("aliquota"), tax.alias("valor")).withColumn("id", F.col("item_id"))
    sums = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.sum(money).alias("soma"), F.sum(tax).alias("icms"))
    key = F.concat(F.when(k % 7 == 0, "33").otherwise("35"), F.lpad("k", 42, "0"))
    none = [F.lit(None).cast("string").alias(c) for c in ("emitente_cpf", "destinatario_cnpj", "destinatario_cpf", "destinatario_municipio", "destinatario_endereco")]
    docs = _orders(spark, sf_dir).join(sums, "id", "left").select(
        "id", F.lit("NFe").alias("tipo"), F.lit("processando").alias("status"), F.lit("11222333000181").alias("emitente_cnpj"), *none, F.when(k % 6 == 0, "XX").otherwise("SP").alias("emitente_uf"),
        F.when(k % 9 == 0, "RJ").otherwise("SP").alias("destinatario_uf"), F.when(k % 8 != 0, "Santos").alias("emitente_municipio"), F.when(k % 10 != 0, "Rua A").alias("emitente_endereco"), key.alias("chave_acesso"),
        F.col("d").alias("data_emissao"), F.col("soma").cast("decimal(18,2)").alias("valor_total"), (F.col("icms") + F.when(k % 11 == 0, 5000).otherwise(0)).cast("decimal(18,2)").alias("total_icms"),
        *[F.lit(None).cast("decimal(18,2)").alias(f"total_{c}") for c in ("servicos", "ipi", "pis", "cofins")],
    )
    out = validate.validate(docs, items, taxes, rules.dimension(spark), spark.createDataFrame([("22030000",)], "codigo string"))
    return out.select("id", "confianca", "validacao", F.array_join("erros", ",").alias("erros"), F.array_join("avisos", ",").alias("avisos"), "reprocessar")


@query(
    "SELECT id, "
    + ", ".join([f"d AS {c}" for c in normalize.DATES] + [f"CAST(v AS DOUBLE) AS {c}" for c in normalize.VALUES] + [f"{'p' if c.endswith('cpf') else 'c'} AS {c}" for c in normalize.TAX_IDS])
    + ", CASE WHEN id % 2 = 0 THEN 'Santos' ELSE 'x' END AS municipio, CASE WHEN id % 2 = 0 THEN 'SP' END AS uf, 'Rua ' || k AS endereco FROM m"
)
def normalised_all_fields(spark, sf_dir):
    """All dates, values and ids of the normaliser, each written in another way, and the place that a city carries."""
    day = [F.date_format(F.to_date("d"), f) for f in ("dd/MM/yyyy", "yyyy/MM/dd", "'em 'yyyy-MM-dd", "dd-MM-yyyy", "yyyy-MM-dd'T'HH:mm:ss")]
    comma = F.replace("v", F.lit("."), F.lit(","))
    grouped = F.translate(F.format_number(F.col("v").cast("decimal(18,2)"), 2), ",.", ".,")
    value = [F.concat(F.lit("R$ "), grouped), comma, F.concat(F.lit(" "), F.col("v"), F.lit(" "))]
    cut = lambda c, *at: F.concat_ws("", *[x for a, b, mark in at for x in (F.substring(c, a, b), F.lit(mark))])
    ids = {True: cut("p", (1, 3, "."), (4, 3, "."), (7, 3, "-"), (10, 2, " ")), False: cut("c", (1, 2, "."), (3, 3, "."), (6, 3, "/"), (9, 4, "-"), (13, 2, ""))}
    raw = _orders(spark, sf_dir).select(
        "id",
        *[day[i % 5].alias(c) for i, c in enumerate(normalize.DATES)],
        *[value[i % 3].alias(c) for i, c in enumerate(normalize.VALUES)],
        *[ids[c.endswith("cpf")].alias(c) for c in normalize.TAX_IDS],
        F.when(F.col("id") % 2 == 0, "Santos / sp").otherwise(" x ").alias("municipio"),
        F.concat(F.lit("  Rua   "), "k").alias("endereco"),
        F.lit(None).cast("string").alias("uf"),
    )
    return normalize.normalise(raw).select("id", *normalize.DATES, *normalize.VALUES, *normalize.TAX_IDS, "municipio", "uf", "endereco")


@query(
    """SELECT -id AS id, id AS alvo_id, CASE WHEN id % 2 = 0 THEN 'chave' ELSE 'nenhum' END AS por, CASE WHEN id % 2 = 0 THEN 1.0 ELSE 0.0 END AS match_score, CASE WHEN id % 2 = 0 AND id % 3 <> 0 THEN 'Casa ' || k WHEN id % 3 = 0 THEN 'Outra' END AS emitente_nome FROM m WHERE id % 2 = 0
    UNION ALL SELECT -id, NULL, 'nenhum', 0.0, CASE WHEN id % 3 = 0 THEN 'Outra' END FROM m WHERE id % 2 = 1"""
)
def link_merge(spark, sf_dir):
    """Partial records take what they lack from the document of their key."""
    made = _orders(spark, sf_dir)
    docs = made.select("id", F.lit("NFe").alias("tipo"), F.col("y").alias("chave_acesso"), F.concat(F.lit("Casa "), "k").alias("emitente_nome"), F.lit(None).cast("decimal(18,2)").alias("valor_total"), F.lit(None).cast("string").alias("data_emissao"))
    partial = docs.select((-F.col("id")).alias("id"), F.lit("pdf").alias("tipo"), F.when(F.col("id") % 2 == 0, F.col("chave_acesso")).alias("chave_acesso"), F.when(F.col("id") % 3 == 0, "Outra").alias("emitente_nome"), "valor_total", "data_emissao")
    return link.link(partial, docs).select("id", "alvo_id", "por", "match_score", "emitente_nome")


@query("""SELECT id, k AS a, 'novo' AS b, CASE WHEN id % 2 = 0 THEN k ELSE NULL END AS c, '[2]' AS l, 'fica' AS d FROM m""")
def json_deep_merge(spark, sf_dir):
    left = F.concat(F.lit('{"x":{"a":"'), "k", F.lit('","b":"velho","y":{"c":"'), "k", F.lit('","d":"fica"},"l":[1]}}'))
    right = F.when(F.col("id") % 2 == 0, '{"x":{"b":"novo","y":{},"l":[2]}}').otherwise('{"x":{"b":"novo","y":{"c":null},"l":[2]}}')
    merged = _orders(spark, sf_dir).select("id", nested.json_merge(left, right).alias("j"))
    at = lambda path: F.get_json_object("j", f"$.x.{path}")
    return merged.select("id", at("a").alias("a"), at("b").alias("b"), at("y.c").alias("c"), at("l").alias("l"), at("y.d").alias("d"))


@query("SELECT id, (id % 20) // 4 AS n FROM m")
def json_array_len(spark, sf_dir):
    made = _orders(spark, sf_dir).withColumn("n", F.floor(F.col("id") % 20 / 4).cast("int"))
    body = F.concat(F.lit('{"risk":{"duplicates":['), F.array_join(F.array_repeat(F.lit("7"), F.col("n")), ","), F.lit("]}}"))
    return made.select("id", nested.json_length(body, "$.risk.duplicates").cast("long").alias("n"))


@query(
    """, g AS (SELECT o_custkey, id, o.n, CAST(floor(o_totalprice / 20000) AS BIGINT) AS b FROM (SELECT o_custkey, o_orderkey AS id, o_orderkey % 3 AS n, o_totalprice FROM orders) o
    ), w AS (SELECT *, CASE WHEN b - lag(b) OVER (PARTITION BY o_custkey, n ORDER BY b, id) <= 1 THEN 0 ELSE 1 END AS s FROM g
    ), r AS (SELECT *, sum(s) OVER (PARTITION BY o_custkey, n ORDER BY b, id ROWS UNBOUNDED PRECEDING) AS run FROM w)
    SELECT id, min(id) OVER (PARTITION BY o_custkey, n, run) AS classe, count(*) OVER (PARTITION BY o_custkey, n, run) AS n FROM r"""
)
def duplicates_classes(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    docs = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("emitente_cnpj"), F.lit(None).cast("string").alias("emitente_cpf"), (F.col("o_orderkey") % 3).alias("numero_nota"), F.lit("1").alias("serie"), (F.floor(F.col("o_totalprice") / 20000) * 0.01).alias("valor_total"))
    return quality.duplicate_classes(docs, cents=0.02)


@query("SELECT id, c AS emitente_cnpj, CAST(v AS DOUBLE) AS valor_total, CASE WHEN id % 5 = 0 THEN '9' ELSE '1' END AS serie FROM m")
def enriched_fields(spark, sf_dir):
    """Gaps filled from a second source, which writes ids with marks and values the Brazilian way."""
    made = _orders(spark, sf_dir)
    gap = lambda n, c: F.when(F.col("id") % n != 0, c)
    docs = made.select("id", gap(2, F.col("c")).alias("emitente_cnpj"), gap(3, F.col("v").cast("decimal(18,2)")).alias("valor_total"), gap(5, F.lit("1")).alias("serie"))
    found = made.select("id", F.concat(F.lit("CNPJ "), "c").alias("emitente_cnpj"), F.replace("v", F.lit("."), F.lit(",")).alias("valor_total"), F.lit("9").alias("serie"))
    return validate.enrich(docs, found).withColumn("valor_total", F.col("valor_total").cast("double"))


@query(
    """, g AS (SELECT o_orderkey AS id, o_custkey AS c, CAST(floor(o_totalprice / 100000) AS BIGINT) AS b FROM orders),
    p AS (SELECT a.id, list_sort(list(x.id)) AS l FROM g a JOIN g x ON a.c = x.c AND a.b = x.b AND a.id <> x.id GROUP BY 1)
    SELECT id, list_aggregate(l[1:3], 'string_agg', ',') AS mostrados, len(l) > 3 AS mais FROM p"""
)
def duplicates_shown(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    docs = orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("emitente_cnpj"), F.lit(None).cast("string").alias("emitente_cpf"),
        F.lit("1").alias("numero_nota"), F.lit("1").alias("serie"), F.floor(F.col("o_totalprice") / 100000).alias("valor_total"),
    )
    shown = quality.shown_duplicates(docs)
    return shown.select("id", F.array_join("mostrados", ",").alias("mostrados"), "mais")


_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "falta")


@query(
    ", t AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'x' END AS falta FROM orders) "
    + " UNION ALL ".join(f"SELECT '{c}' AS coluna, count(*) AS linhas, count(*) - count({c}) AS nulos, CAST(min({c}) AS VARCHAR) AS minimo, CAST(max({c}) AS VARCHAR) AS maximo FROM t" for c in _COLUMNS)
)
def table_statistics(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("falta", F.when(F.col("o_orderkey") % 3 == 0, "x"))
    return tables.statistics(orders.select(*_COLUMNS))


_STATES = ("processado", "revisao_pendente", "erro", "quarentena")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents of five kinds, with what a step has found out about each."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    total = F.col("o_totalprice").cast("decimal(18,2)")
    return orders.select(
        k.alias("id"), F.col("o_orderpriority").alias("tipo"), F.element_at(F.array(*[F.lit(s) for s in _STATES]), (k % 4 + 1).cast("int")).alias("status"), ((k % 10) / 10).alias("completude"), F.lit(0.5).alias("tempo"),
        total.alias("valor_total"), F.when(k % 2 == 0, (k % 50).cast("decimal(18,2)")).alias("total_icms"), *[F.lit(None).cast("decimal(18,2)").alias(f"total_{c}") for c in ("ipi", "pis", "cofins")],
    )


@query(
    """, t AS (SELECT o_orderkey AS id, o_orderpriority AS tipo, o_orderkey % 4 AS s, (o_orderkey % 10) / 10 AS a, CAST(o_totalprice AS DECIMAL(18,2)) AS v, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 50 AS DECIMAL(18,2)) END AS i FROM orders),
    g AS (SELECT tipo, count(*) AS n, round(CAST(sum(v) AS DOUBLE) / count(v), 6) AS mv, round(CAST(sum(i) AS DOUBLE) / count(i), 6) AS mi FROM t GROUP BY 1)
    SELECT id, tipo AS tipo_documento, a AS acuracia_media, CAST(s = 1 AS DOUBLE) AS taxa_revisao, CAST(s IN (2, 3) AS DOUBLE) AS taxa_erro, n AS total_documentos, round(mv, 2) AS media_valor_total, round(mi / mv * 100, 4) AS taxa_icms_media,
    ['processado', 'revisao_pendente', 'erro', 'quarentena'][CAST(s + 1 AS INTEGER)] AS status_evento FROM t JOIN g USING (tipo)"""
)
def metric_events(spark, sf_dir):
    """A metric row a document, with the means of its kind."""
    rows = metrics.events(_judged(spark, sf_dir))
    of = lambda c: F.get_json_object("meta_json", f"$.{c}")
    return rows.select(
        "id", "tipo_documento", "acuracia_media", "taxa_revisao", "taxa_erro", of("total_documentos").cast("long").alias("total_documentos"), F.round(of("media_valor_total").cast("double"), 2).alias("media_valor_total"),
        F.round(of("taxa_icms_media").cast("double"), 4).alias("taxa_icms_media"), of("status_evento").alias("status_evento"),
    )


@query(
    """SELECT o_orderkey AS doc_id, 'ocr' AS agente, o_orderpriority AS tipo_documento, (o_orderkey % 10) / 10 AS coverage, CAST(NULL AS DOUBLE) AS recall,
    '{"status":"' || ['processado', 'revisao_pendente', 'erro', 'quarentena'][CAST(o_orderkey % 4 + 1 AS INTEGER)] || '"}' AS extras, 'ocr:metric' AS evento,
    '{"doc_id":' || CAST(o_orderkey AS VARCHAR) || ',"coverage":' || CAST((o_orderkey % 10) / 10 AS VARCHAR) || '}' AS detalhes FROM orders"""
)
def agent_events(spark, sf_dir):
    """A row a document of an agent's run, and the same as an event."""
    runs = metrics.agent_runs(_judged(spark, sf_dir).withColumn("coverage", F.col("completude")), "ocr", extras=["status"])
    logged = metrics.event_rows(runs, F.concat("agente", F.lit(":metric")), ["doc_id", "coverage"])
    events = logged.select(F.get_json_object("detalhes", "$.doc_id").cast("long").alias("doc_id"), "evento", "detalhes")
    return runs.select("doc_id", "agente", "tipo_documento", "coverage", "recall", "extras").join(events, "doc_id")


@query("SELECT k || '.xml' AS nome_arquivo, 'reprocessamento' AS origem, k AS numero_nota, CAST(v AS DOUBLE) AS valor_total FROM m WHERE id % 3 = 0")
def reprocessed(spark, sf_dir):
    """All files come again; those known by their hash are derived anew."""
    # Never null, so that the join's test for nulls isn't made where the table is read, with all documents written for it there.
    digest = F.coalesce(F.sha2("content", 256), F.lit("")).alias("hash")
    files = _written(spark, sf_dir, "nfe").select("id", "nome_arquivo", F.lit(None).cast("string").alias("caminho_arquivo"), "content", digest)
    known = files.where("id % 3 = 0").select("hash")
    docs = ingest.reprocess(files.drop("id"), known, day="2024-08-01")["documentos"]
    return docs.select("nome_arquivo", "origem", "numero_nota", F.col("valor_total").cast("double").alias("valor_total"))
