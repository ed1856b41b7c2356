"""Linkage of partial records to known documents: by key, else by value and date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fiscal, text
from .filters import xml_like
from .sweep import swept

# Fields that a linked document may fill.
CORE = (
    "tipo chave_acesso numero_nota serie modelo natureza_operacao emitente_nome emitente_cnpj emitente_cpf destinatario_nome destinatario_cnpj destinatario_cpf data_emissao valor_total"
    " total_produtos total_servicos total_icms total_ipi total_pis total_cofins valor_descontos valor_frete valor_seguro valor_outros valor_liquido modalidade_frete placa_veiculo uf_veiculo"
    " peso_bruto peso_liquido qtd_volumes forma_pagamento valor_pagamento valor_troco condicao_pagamento meio_pagamento bandeira_cartao caminho_xml versao_schema ambiente"
    " protocolo_autorizacao data_autorizacao cstat xmotivo responsavel_tecnico"
).split()


def _first(pairs: DataFrame, prefer: Column) -> DataFrame:
    """Of each id's candidates the preferred one with the smallest id."""
    return pairs.groupBy("id").agg(F.min(F.struct((~prefer).alias("_p"), F.col("alvo_id"))).alias("_b")).select("id", F.col("_b.alvo_id").alias("alvo_id"))


def by_key(partial: DataFrame, docs: DataFrame) -> DataFrame:
    """id, alvo_id of partial records whose access key (or one in their texto) is a document's of an XML kind."""
    given = F.coalesce(F.when(F.length(text.digits_or_null(F.col("chave_acesso"))) == 44, text.digits_or_null(F.col("chave_acesso"))), fiscal.key_in_text(F.col("texto")) if "texto" in partial.columns else F.lit(None))
    wanted = partial.select("id", given.alias("_key")).where("_key is not null")
    return _first(wanted.join(docs.select(F.col("id").alias("alvo_id"), F.col("chave_acesso").alias("_key"), "tipo").where(xml_like(F.col("tipo"))), "_key"), F.lit(True))


def by_value_and_date(partial: DataFrame, docs: DataFrame, *, value_band: float = 0.02, days: int = 1) -> DataFrame:
    """id, alvo_id where value and date are within the bands; a record with only one of them is linked by that.

    A sweep, not a join of pairs: what documents of one day and value, one value or one day have in common is their best
    (XML kinds first, then the smallest id), which a frame that passes over the values in order hands to each place asked
    for. Documents stand in the lines of the days around their own. However many documents and records share a day and a
    value, they are one row each while swept; the records then take their answer by an equi-join on what they hold.
    """
    cents = F.col("valor_total").cast("decimal(18,2)")
    day = lambda c: F.datediff(text.as_date(c), F.lit("1970-01-01").cast("date")).cast("long")
    place = (cents * 100).cast("long").alias("_c")
    left = partial.select("id", place, day(F.regexp_extract("data_emissao", r"^([^T]*)", 1)).alias("_d"))
    best = F.min(F.struct((~xml_like(F.col("tipo"))).alias("_p"), F.col("id").alias("alvo_id"))).alias("_t")
    cells = docs.select("id", "tipo", place, day(F.col("data_emissao")).alias("_d")).groupBy("_c", "_d").agg(best)
    reach = int(value_band * 100 + 1e-9)
    least = lambda rows, *by: rows.groupBy(*by).agg(F.min("_t").alias("_t"))
    lines = cells.where("_c is not null and _d is not null").withColumn("_d", F.explode(F.sequence(F.col("_d") - days, F.col("_d") + days)))
    both, alone, dated = (left.where(x) for x in ("_c is not null and _d is not null", "_c is not null and _d is null", "_c is null and _d is not null"))
    given = lambda *by: cells.where(" and ".join(f"{c} is not null" for c in by))
    answers = [
        (both, ["_d", "_c"], least(lines, "_d", "_c"), reach),
        (alone, ["_c"], least(given("_c"), "_c"), reach),
        (dated, ["_d"], least(given("_d"), "_d"), days),
    ]
    found = []
    for rows, by, targets, near in answers:
        told = swept(targets, rows.select(*by).distinct(), by[-1], near, by[:-1], {"_t": F.min("_t")}).where("_t is not null")
        found.append(rows.join(told, by).select("id", F.col("_t._p").alias("_p"), F.col("_t.alvo_id").alias("alvo_id")))
    # A record is one row in one of the three, unless its id is repeated.
    return found[0].unionByName(found[1]).unionByName(found[2]).groupBy("id").agg(F.min(F.struct("_p", "alvo_id")).alias("_b")).select("id", F.col("_b.alvo_id").alias("alvo_id"))


def link(partial: DataFrame, docs: DataFrame, **bands) -> DataFrame:
    """partial with gaps filled from the linked document, and alvo_id, por, match_score (1 by key, 0.88 by value and date, else 0)."""
    keyed = by_key(partial, docs).withColumnRenamed("alvo_id", "_k")
    rest = partial.join(keyed.select("id"), "id", "left_anti")
    banded = by_value_and_date(rest, docs, **bands).withColumnRenamed("alvo_id", "_n")
    out = partial.join(keyed, "id", "left").join(banded, "id", "left").withColumn("alvo_id", F.coalesce("_k", "_n"))
    out = out.withColumns({"por": F.when(F.col("_k").isNotNull(), "chave").when(F.col("_n").isNotNull(), "valor_data").otherwise("nenhum"), "match_score": F.when(F.col("_k").isNotNull(), 1.0).when(F.col("_n").isNotNull(), 0.88).otherwise(0.0)}).drop("_k", "_n")
    fields = [c for c in CORE if c in partial.columns and c in docs.columns]
    target = docs.select(F.col("id").alias("alvo_id"), *[F.col(c).alias(f"_{c}") for c in fields])
    return out.join(target, "alvo_id", "left").withColumns({c: F.when(text.missing(F.col(c)), F.col(f"_{c}")).otherwise(F.col(c)) for c in fields}).drop(*[f"_{c}" for c in fields])


def preferred_first(docs: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key, XML kinds first, then the smallest id."""
    order = Window.partitionBy(*keys).orderBy(F.desc(xml_like(F.col("tipo"))), "id")
    return docs.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
