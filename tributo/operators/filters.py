"""Filters, projections and the shaping of result grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nested, text


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def grid_filter(docs: DataFrame, *, status: str | None = None, kind: str | None = None, region: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows that meet every condition given; dates compare as text, both ends included; a region may be either party's."""
    tests = []
    if status:
        tests.append(F.col("status") == status)
    if kind:
        tests.append(F.col("tipo") == kind)
    if region:
        tests.append(in_region(region))
    if since:
        tests.append(F.col("data_emissao") >= since)
    if until:
        tests.append(F.col("data_emissao") <= until)
    return docs.where(_all(tests))


def in_region(region: str) -> Column:
    return (F.col("emitente_uf") == region) | (F.col("destinatario_uf") == region)


def in_scope(docs: DataFrame, region: str | None = None, kinds: list[str] | None = None) -> DataFrame:
    tests = ([in_region(region)] if region else []) + ([F.col("tipo").isin(*kinds)] if kinds else [])
    return docs.where(_all(tests))


def items_in_scope(items: DataFrame, docs: DataFrame) -> DataFrame:
    return items.join(docs.select(F.col("id").alias("documento_id")), "documento_id", "left_semi")


def taxes_in_scope(taxes: DataFrame, items: DataFrame, docs: DataFrame) -> DataFrame:
    return taxes.join(items_in_scope(items, docs).select(F.col("id").alias("item_id")), "item_id", "left_semi")


def details_in_scope(details: DataFrame, docs: DataFrame) -> DataFrame:
    return details.join(docs.select(F.col("id").alias("documento_id")), "documento_id", "left_semi")


def with_risk(docs: DataFrame) -> DataFrame:
    """risco, duplicados and the three scores kept in the metadata JSON, which is parsed once."""
    meta = F.col("_meta")
    paths = {"cobertura": "$.nlp.coverage", "sanidade": "$.__meta__.normalizador.sanity_score", "associacao": "$.associacao.match_score"}
    found = {"risco": nested.variant_double(meta, "$.risk.score", 0.0), "duplicados": nested.variant_length(meta, "$.risk.duplicates")}
    return docs.withColumn("_meta", nested.parsed(F.col("meta_json"))).withColumns(found | {c: nested.variant_double(meta, p) for c, p in paths.items()}).drop("_meta")


def at_least_risk(docs: DataFrame, least: float) -> DataFrame:
    return docs.where(F.coalesce("risco", F.lit(0.0)) >= least)


def grid(docs: DataFrame) -> DataFrame:
    """The columns of the result grid under their display names, tax ids masked."""
    party = lambda p: text.mask_tax_id(text.first_filled(F.col(f"{p}_cnpj"), F.col(f"{p}_cpf")))
    address = lambda p: text.joined_address(*[F.col(f"{p}_{f}") for f in ("logradouro", "numero", "bairro", "municipio", "uf")])
    return docs.select("id", "tipo", "status", F.col("numero_nota").alias("numero"), "serie", F.col("data_emissao").alias("emissao"), F.col("emitente_nome").alias("emitente"), party("emitente").alias("emitente_id"), F.col("destinatario_nome").alias("destinatario"), party("destinatario").alias("destinatario_id"), "valor_total", address("emitente").alias("endereco"))


def tidy(df: DataFrame, expected: list[str], tax_ids: tuple[str, ...] = ("emitente_cnpj", "emitente_cpf", "destinatario_cnpj", "destinatario_cpf")) -> DataFrame:
    """Expected columns added as empty text, text trimmed with null as empty, tax ids masked."""
    df = df.withColumns({c: F.lit("") for c in expected if c not in df.columns})
    df = df.withColumns({c: F.coalesce(F.trim(c), F.lit("")) for c, k in df.dtypes if k == "string"})
    return df.withColumns({c: text.mask_tax_id(F.col(c)) for c in tax_ids if c in df.columns})


def filled_shares(df: DataFrame) -> DataFrame:
    """coluna, parte: the share of rows in which a column is neither null nor empty; one pass."""
    share = df.agg(*[F.coalesce(F.avg((~text.missing(F.col(c))).cast("double")), F.lit(0.0)).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("coluna"), F.round(F.col(c), 6).alias("parte")) for c in df.columns])
    return share.select(F.explode(pairs).alias("x")).select("x.*")


def without_sparse(df: DataFrame, least: float = 0.05, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    shares = {r.coluna: r.parte for r in filled_shares(df).collect()}  # a row a column
    return df.select([c for c in df.columns if c in keep or shares[c] >= least])


def capped(df: DataFrame, rows: int = 5_000, columns: int = 50) -> DataFrame:
    """At most so many rows and columns for display; a blank column name becomes col_i, and one that comes again gets its place as well."""
    names: list[str] = []
    for i, c in enumerate(df.columns):
        names.append(f"col_{i}" if not c.strip() else f"{c}_{i}" if c.lower() in [n.lower() for n in names] else c)
    return df.toDF(*names).select(*[F.col(f"`{c}`") for c in names[:columns]]).limit(rows)


def first_filled_value(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.limit(1).select(F.coalesce(*[text.blank_to_null(F.col(c).cast("string")) for c in columns if c in df.columns]).alias("valor"))


def with_ids(df: DataFrame, ids: DataFrame, array: str) -> DataFrame:
    """Rows of df whose id is in an array column of ids."""
    return df.join(ids.select(F.explode(array).alias("id")), "id", "left_semi")


def xml_like(kind: Column) -> Column:
    return F.coalesce(kind.rlike("(?i)xml|nfe|nfce|cte|cfe|nfse"), F.lit(False))


def same_text(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def decisions(docs: DataFrame) -> DataFrame:
    """id, ordem, momento, mensagem: the decision log of the metadata, in order."""
    entries = F.from_json(F.get_json_object("meta_json", "$.decisions"), "array<struct<ts:double,msg:string>>")
    return docs.select("id", F.posexplode(entries).alias("ordem", "d")).select("id", "ordem", F.col("d.ts").alias("momento"), F.col("d.msg").alias("mensagem"))
