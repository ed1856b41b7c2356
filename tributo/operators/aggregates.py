"""Totals, rankings, indicators and tax pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def money(c: Column) -> Column:
    """Sums of decimals don't depend on the order of rows."""
    return F.sum(F.coalesce(c.cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))).cast("double")


def item_value() -> Column:
    """An item's value, else quantity by unit price, else 0."""
    return F.coalesce(F.col("valor_total").cast("decimal(18,2)"), (F.col("quantidade") * F.col("valor_unitario")).cast("decimal(18,2)"))


def _ranked(df: DataFrame, by: str, key: str, n: int | None) -> DataFrame:
    """By value, largest first, ties by key; a bounded top never sorts the whole."""
    out = df.orderBy(F.desc(by), F.asc_nulls_first(key))
    return out.limit(n) if n else out


def top_issuers(docs: DataFrame, n: int = 5) -> DataFrame:
    return _ranked(docs.groupBy("emitente_nome").agg(money(F.col("valor_total")).alias("total")), "total", "emitente_nome", n)


def totals_by_region(docs: DataFrame) -> DataFrame:
    return _ranked(docs.groupBy(F.coalesce("emitente_uf", "destinatario_uf").alias("uf")).agg(money(F.col("valor_total")).alias("total")), "total", "uf", None)


def totals_by_month(docs: DataFrame) -> DataFrame:
    return docs.groupBy(text.month_key(F.col("data_emissao")).alias("mes")).agg(money(F.col("valor_total")).alias("total")).orderBy(F.asc_nulls_first("mes"))


def totals_by_year(docs: DataFrame) -> DataFrame:
    return docs.groupBy(text.year_key(F.col("data_emissao")).alias("ano")).agg(money(F.col("valor_total")).alias("total")).orderBy(F.asc_nulls_first("ano"))


def _of_documents(items: DataFrame, docs: DataFrame) -> DataFrame:
    return items.join(docs.select(F.col("id").alias("documento_id")), "documento_id")


def top_items(items: DataFrame, docs: DataFrame, key: str, n: int, name: str | None = None) -> DataFrame:
    """The n values of an item column with the largest item value."""
    name = name or key
    return _ranked(_of_documents(items, docs).groupBy(F.col(key).alias(name)).agg(money(item_value()).alias("total")), "total", name, n)


def top_tax_codes(taxes: DataFrame, items: DataFrame, docs: DataFrame, n: int = 10) -> DataFrame:
    """Tax and item value by tax situation; an item counts once for each of its tax rows."""
    owned = _of_documents(items, docs).select(F.col("id").alias("item_id"), item_value().alias("_item"))
    both = taxes.join(owned, "item_id").groupBy("cst").agg(money(F.col("valor")).alias("total_imposto"), money(F.col("_item")).alias("base_itens"))
    return _ranked(both, "base_itens", "cst", n)


def summary_by_kind(docs: DataFrame) -> DataFrame:
    return _ranked(docs.groupBy("tipo").agg(F.count("*").alias("qtd"), money(F.col("valor_total")).alias("total")), "total", "tipo", None)


def status_counts(docs: DataFrame, done: str = "processado", review: str = "revisao_pendente", error: str = "erro") -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s)
    return docs.agg(count(done).alias("processados"), count(review).alias("em_revisao"), count(error).alias("com_erro"), F.count("*").alias("total"))


def _mean(c: str) -> Column:
    """Mean over all rows, values that are no number as 0; rounded, as doubles add up in any order."""
    return F.coalesce(F.avg(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))), F.lit(0.0))


def indicators(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.round(_mean("acuracia_media") * 100, 4).alias("acuracia"), F.round(_mean("taxa_revisao") * 100, 4).alias("revisao"), F.round(_mean("tempo_medio"), 4).alias("tempo"), F.round(_mean("taxa_erro") * 100, 4).alias("erro"), F.count("*").alias("eventos"))


def indicators_by_kind(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("tipo_documento").agg(F.round(_mean("acuracia_media"), 4).alias("acuracia"), F.round(_mean("taxa_erro") * 100, 4).alias("erro"))


# Taxes that get a column of their own.
TAX_KINDS = ("ICMS", "FCP", "IPI", "PIS", "COFINS", "ISS")


def tax_pivot(taxes: DataFrame, key: str = "item_id", kinds: tuple[str, ...] = TAX_KINDS) -> DataFrame:
    """For each item the sum of values and the mean rate of each kind of tax, as <kind>_valor and <kind>_aliquota.

    The kinds are given, so no extra job looks for them, and both pivots are one aggregation.
    """
    of = lambda k, c: F.when(F.col("tipo_imposto") == k, F.col(c))
    values = [F.sum(of(k, "valor").cast("decimal(18,2)")).cast("double").alias(f"{k.lower()}_valor") for k in kinds]
    rates = [F.round(F.avg(of(k, "aliquota").cast("double")), 6).alias(f"{k.lower()}_aliquota") for k in kinds]
    return taxes.groupBy(key).agg(*values, *rates)


def items_with_taxes(items: DataFrame, taxes: DataFrame, kinds: tuple[str, ...] = TAX_KINDS) -> DataFrame:
    return items.join(tax_pivot(taxes, "item_id", kinds).withColumnRenamed("item_id", "id"), "id", "left")


def item_sums(items: DataFrame) -> DataFrame:
    return items.groupBy("documento_id").agg(F.count("*").alias("n_itens"), F.sum(F.coalesce(F.col("valor_total").cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))).alias("soma_itens"))


def tax_sums(taxes: DataFrame, items: DataFrame, **more: Column) -> DataFrame:
    """For each document the number of tax rows, the sum of each kind that documents carry a total of, and more sums by name."""
    owned = taxes.join(items.select(F.col("id").alias("item_id"), "documento_id"), "item_id")
    sums = [F.sum(F.when(F.col("tipo_imposto") == k, F.col("valor").cast("decimal(18,2)")).otherwise(F.lit(0).cast("decimal(18,2)"))).alias(f"soma_{k.lower()}") for k in ("ICMS", "IPI", "PIS", "COFINS")]
    return owned.groupBy("documento_id").agg(F.count("*").alias("n_impostos"), *sums, *[c.alias(name) for name, c in more.items()])


def tax_means(docs: DataFrame) -> DataFrame:
    """By kind of document the mean total and taxes, and each tax in percent of the mean total (0 without one)."""
    mean = lambda c: F.avg(F.col(c).cast("double"))
    taxes = ("icms", "ipi", "pis", "cofins")
    out = docs.groupBy("tipo").agg(F.count("*").alias("total_documentos"), mean("valor_total").alias("media_valor_total"), *[mean(f"total_{t}").alias(f"media_{t}") for t in taxes])
    share = lambda t: F.coalesce(F.when(F.col("media_valor_total") > 0, F.col(f"media_{t}") / F.col("media_valor_total") * 100), F.lit(0.0))
    return out.select("tipo", "total_documentos", *[F.round(c, 4).alias(c) for c in ("media_valor_total", *[f"media_{t}" for t in taxes])], *[F.round(share(t), 4).alias(f"taxa_{t}_media") for t in taxes])
