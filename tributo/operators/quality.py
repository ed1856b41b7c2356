"""Coherence, quality gates, duplicates and risk."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .sweep import swept
from .validate import crossing

COMPLETENESS_LEAST, CRITICAL_LEAST, SANITY_LEAST, RISK_REVIEW = 0.65, 2, 0.75, 0.6
#: Problems for which a document is worth extracting again, whatever its score.
ASK_AGAIN = ("data_ausente", "numero_ausente")
CRITICAL = ("emitente_cnpj", "valor_total", "data_emissao")


def _given(df: DataFrame, c: str) -> Column:
    return F.col(c) if c in df.columns else F.lit(None).cast("string")


def coherence(docs: DataFrame, kind: str = "tipo_inferido") -> DataFrame:
    """id, sanidade, problemas, sugerir: how well a document's own fields agree.

    Values may be numbers or written ones. The parts of the total may be a quarter off; each problem costs what its sort costs, an unknown kind a little.
    """
    written = {c for c, kind in docs.dtypes if kind == "string"}
    n = lambda c: text.number_br(_given(docs, c)) if c in written else _given(docs, c).try_cast("double")
    plus = ("total_produtos", "total_servicos", "total_icms", "total_ipi", "total_pis", "total_cofins", "valor_iss", "valor_outros", "valor_frete")
    parts = sum((F.coalesce(n(c), F.lit(0.0)) for c in plus), F.lit(0.0)) - F.coalesce(n("valor_descontos"), F.lit(0.0))
    total = n("valor_total")
    off = F.coalesce(total.isNotNull() & (parts > 0) & (F.abs(parts - total) / F.greatest(F.lit(1.0), total) >= 0.25), F.lit(False))
    no = lambda *cs: text.missing(F.concat_ws("", *[_given(docs, c).cast("string") for c in cs]))
    tests = [
        ("total_inconsistente", off, 0.25 + 0.2),
        ("cfop_uf", crossing(F.trim(_given(docs, "cfop")), _given(docs, "emitente_uf"), _given(docs, "destinatario_uf")), 0.10),
        ("emitente_ausente", no("emitente_cnpj", "emitente_cpf"), 0.15),
        ("destinatario_ausente", no("destinatario_cnpj", "destinatario_cpf"), 0.15),
        ("data_ausente", no("data_emissao"), 0.15),
        ("numero_ausente", no("numero_nota"), 0.15),
    ]
    penalty = sum((F.when(t, cost).otherwise(0.0) for _, t, cost in tests), F.when(_given(docs, kind) == "DESCONHECIDO", 0.05).otherwise(0.0))
    issues = F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t, _ in tests]))
    out = docs.select("id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - penalty)), 6).alias("sanidade"), issues.alias("problemas"))
    worrying = F.exists("problemas", lambda p: p.isin(*ASK_AGAIN))
    return out.withColumn("sugerir", (F.col("sanidade") < 0.65) | worrying)


def simple_coherence(docs: DataFrame, item_sums: DataFrame) -> DataFrame:
    """id, sanidade: the share of critical fields, halved where the items' sum is far from the total."""
    joined = docs.join(item_sums.select(F.col("documento_id").alias("id"), "soma_itens"), "id", "left")
    far = F.abs(F.col("soma_itens").cast("double") - F.col("valor_total").cast("double")) > F.greatest(F.lit(1.0), F.abs(F.col("valor_total").cast("double")) * 0.25)
    return joined.select("id", F.round(critical_hits(joined) / len(CRITICAL) * F.when(F.coalesce(far, F.lit(False)), 0.5).otherwise(1.0), 6).alias("sanidade"))


def critical_hits(df: DataFrame) -> Column:
    return sum(((~text.missing(F.col(c))).cast("int") for c in CRITICAL), F.lit(0))


def quality_gate(docs: DataFrame, scores: DataFrame, *, completeness: float = COMPLETENESS_LEAST, critical: int = CRITICAL_LEAST, sanity: float = SANITY_LEAST) -> DataFrame:
    """id, status_novo, razoes; scores: id, completude, sanidade. The gate only tightens, and a reviewed document stays so."""
    joined = docs.join(scores, "id", "left").withColumn("_hits", critical_hits(docs))
    tests = [("completude", F.coalesce("completude", F.lit(0.0)) < completeness), ("campos_criticos", F.col("_hits") < critical), ("sanidade", F.coalesce(F.col("sanidade") < sanity, F.lit(False)))]
    reasons = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests]))
    status = F.coalesce("status", F.lit("processado"))
    return joined.withColumn("razoes", reasons).select("id", F.when((F.size("razoes") > 0) & (status != "revisado"), "revisao_pendente").otherwise(status).alias("status_novo"), "razoes")


KEYS = ["_issuer", "_number", "_series"]


def _owned(docs: DataFrame) -> DataFrame:
    """id, issuer, number, series and value in cents of the documents that have an issuer and a number."""
    value = F.coalesce(F.col("valor_total").cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))
    own = docs.select("id", F.coalesce("emitente_cnpj", "emitente_cpf").alias("_issuer"), F.col("numero_nota").cast("string").alias("_number"), F.coalesce(F.col("serie").cast("string"), F.lit("")).alias("_series"), (value * 100).cast("long").alias("_c"))
    return own.where(~text.missing(F.col("_issuer")) & ~text.missing(F.trim("_number")))


def _reach(cents: float) -> int:
    """The most whole cents that are less than the tolerance."""
    return max(0, math.ceil(round(cents * 100, 6)) - 1)


def duplicates(docs: DataFrame, *, causal: bool = False, cents: float = 0.01) -> DataFrame:
    """id, duplicados: the sorted ids of other documents of one issuer, number and series and nearly one value.

    All of them, so n equal invoices give n lists of n - 1: for reports on few documents. shown_duplicates gives the first
    few and duplicated whether there are any, in a row a document. The lists come from an equi-join, values in buckets of
    the tolerance, and the exact test after it. causal: only smaller ids count. Documents without issuer or number have none.
    """
    reach = _reach(cents)
    own = _owned(docs).withColumn("_bucket", F.expr(f"_c div {reach + 1}L"))
    near = own.select(F.col("id").alias("_other"), *KEYS, F.col("_c").alias("_v"), F.explode(F.array_distinct(F.array(*[F.expr(f"(_c + {i}) div {reach + 1}L") for i in (-reach, 0, reach)]))).alias("_bucket"))
    pairs = own.join(near, [*KEYS, "_bucket"]).where((F.col("id") > F.col("_other") if causal else F.col("id") != F.col("_other")) & (F.abs(F.col("_c") - F.col("_v")) <= reach))
    return pairs.groupBy("id").agg(F.array_sort(F.collect_set("_other")).alias("duplicados"))


def shown_duplicates(docs: DataFrame, n: int = 3, *, cents: float = 0.01) -> DataFrame:
    """id, mostrados, mais: the n smallest of the ids that duplicates lists, and whether there are more.

    Documents of one value are one cell with its n + 1 smallest ids, which Spark limits before it shuffles; a frame over
    the values in order adds up the cells within the tolerance. So n equal invoices give n rows of n ids, not lists of all.
    """
    own = _owned(docs).distinct()
    first = Window.partitionBy(*KEYS, "_c").orderBy("id")
    least = own.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= n + 1).groupBy(*KEYS, "_c").agg(F.array_sort(F.collect_list("id")).alias("_ids"))
    cells = own.groupBy(*KEYS, "_c").agg(F.count("*").alias("_many")).join(least, [*KEYS, "_c"])
    if reach := _reach(cents):
        near = swept(cells, cells.select(*KEYS, "_c"), "_c", reach, KEYS, {"_many": F.sum("_many"), "_ids": F.collect_list("_ids")})
        cells = near.withColumn("_ids", F.slice(F.array_sort(F.flatten("_ids")), 1, n + 1))
    others = F.array_except("_ids", F.array("id"))
    return own.join(cells.where("_many > 1"), [*KEYS, "_c"]).select("id", F.slice(others, 1, n).alias("mostrados"), (F.col("_many") > n + 1).alias("mais"))


def duplicated(docs: DataFrame, *, cents: float = 0.01) -> DataFrame:
    """id of each document that duplicates would list others of, by counts alone."""
    own = _owned(docs).distinct()
    cells = own.groupBy(*KEYS, "_c").agg(F.count("*").alias("_many"))
    if reach := _reach(cents):
        cells = swept(cells, cells.select(*KEYS, "_c"), "_c", reach, KEYS, {"_many": F.sum("_many")})
    return own.join(cells.where("_many > 1"), [*KEYS, "_c"]).select("id")


def value_runs(pieces: DataFrame, *, cents: float = 0.01) -> DataFrame:
    """Runs of values, each less than cents above the one before: KEYS, _low, _high, classe (the least id), n.

    pieces: KEYS, _low, _high, _least, _n: values, or runs found before, which may overlap. A piece starts a run if it
    lies out of reach of all before it.
    """
    order = Window.partitionBy(*KEYS).orderBy("_low", "_high")
    highest = F.max("_high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.coalesce((F.col("_low") - highest > _reach(cents)).cast("int"), F.lit(1))
    runs = pieces.withColumn("_starts", starts).withColumn("_run", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*KEYS, "_run").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.min("_least").alias("classe"), F.sum("_n").alias("n")).drop("_run")


def values_of(docs: DataFrame) -> DataFrame:
    """KEYS, _low, _high, _least, _n: a row for equal values, so a hot group is small where it is put in order."""
    return _owned(docs).groupBy(*KEYS, "_c").agg(F.count("*").alias("_n"), F.min("id").alias("_least")).select(*KEYS, F.col("_c").alias("_low"), F.col("_c").alias("_high"), "_least", "_n")


def duplicate_classes(docs: DataFrame, *, cents: float = 0.01) -> DataFrame:
    """id, classe, n: the class of each document with issuer and number, and how many documents it has.

    A class is a run of one issuer's documents of one number and series in which each value is less than cents above the
    one before; classe is its smallest id. It says in a row a document what duplicates lists in pairs, so a group of
    many equal invoices costs no more than its rows.
    """
    return classes_of(docs, value_runs(values_of(docs), cents=cents))


def classes_of(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """id, classe, n of documents whose values lie in the runs: each value takes the last run that starts at or below it."""
    own = _owned(docs)
    starts = runs.select(*KEYS, F.col("_low").alias("_c"), F.struct("_high", "classe", "n").alias("_run"), F.lit(False).alias("_asked"))
    asks = own.select(*KEYS, "_c").distinct().withColumns({"_run": F.lit(None).cast(starts.schema["_run"].dataType), "_asked": F.lit(True)})
    order = Window.partitionBy(*KEYS).orderBy("_c", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    told = starts.unionByName(asks).withColumn("_run", F.last("_run", ignorenulls=True).over(order)).where("_asked and _c <= _run._high")
    return own.join(told, [*KEYS, "_c"]).select("id", "_run.classe", "_run.n")


def extended_runs(runs: DataFrame, new: DataFrame, *, cents: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """The runs that a batch of documents touches, as they are after it, and those of them that were there before.

    runs: value_runs of all documents so far; new: values_of those of the batch. A new value lies in a run, makes one longer, bridges
    two or starts one; runs out of reach of all of them stay as they are. So what is read is the batch and the touched
    groups' runs, and what is to be replaced is the second result by the first.
    """
    reach = _reach(cents)
    spans = value_runs(new, cents=cents)
    # Of the spans that begin within reach of a run's end the last goes furthest, as neither runs nor spans overlap.
    line = spans.select(*KEYS, F.col("_low").alias("_at"), F.col("_high").alias("_to")).unionByName(
        runs.join(spans.select(*KEYS).distinct(), KEYS, "left_semi").select(*KEYS, (F.col("_high") + reach).alias("_at"), F.struct("_low", "_high", "classe", "n").alias("_run")), allowMissingColumns=True
    )
    order = Window.partitionBy(*KEYS).orderBy("_at", F.col("_run").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    touched = line.withColumn("_to", F.max("_to").over(order)).where(F.col("_run").isNotNull() & (F.col("_to") >= F.col("_run._low") - reach)).select(*KEYS, "_run.*")
    before = touched.select(*KEYS, "_low", "_high", F.col("classe").alias("_least"), F.col("n").alias("_n"))
    return value_runs(before.unionByName(new), cents=cents), touched


def risk(docs: DataFrame, duplicate_ids: DataFrame, taxed: DataFrame, as_of: str) -> DataFrame:
    """id, risco, sinais. duplicate_ids: id; taxed: documento_id of documents with tax rows; as_of: today's date."""
    joined = docs.join(duplicate_ids.select("id", F.lit(True).alias("_dup")), "id", "left").join(taxed.select(F.col("documento_id").alias("id"), F.lit(True).alias("_tax")).distinct(), "id", "left")
    value = F.coalesce(F.col("valor_total").cast("double"), F.lit(0.0))
    tests = [
        ("duplicidade", F.coalesce("_dup", F.lit(False)), 0.5),
        ("campos_criticos", critical_hits(docs) < len(CRITICAL), 0.2),
        ("valor_nao_positivo", value <= 0, 0.2),
        ("data_futura", text.in_future(F.col("data_emissao"), F.to_date(F.lit(as_of))), 0.2),
        ("sem_impostos", (value > 1000) & F.col("_tax").isNull(), 0.2),
    ]
    score = sum((F.when(t, w).otherwise(0.0) for _, t, w in tests), F.lit(0.0))
    return joined.select("id", F.round(F.least(F.lit(1.0), score), 3).alias("risco"), F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t, _ in tests])).alias("sinais"))


def risk_gate(status: Column, score: Column, limit: float = RISK_REVIEW) -> Column:
    return F.when((score >= limit) & (status != "revisado"), "revisao_pendente").otherwise(status)


def metadata(docs: DataFrame, scores: DataFrame, risks: DataFrame, duplicate_ids: DataFrame) -> DataFrame:
    """id, meta_json with the results of the stages as one object."""
    joined = docs.select("id").join(scores, "id", "left").join(risks, "id", "left").join(duplicate_ids, "id", "left")
    body = F.struct(
        F.struct(F.struct(F.col("sanidade").alias("sanity_score")).alias("normalizador"), F.col("completude").alias("field_completeness")).alias("__meta__"),
        F.struct(F.col("risco").alias("score"), F.col("sinais").alias("signals"), F.coalesce("duplicados", F.array().cast("array<bigint>")).alias("duplicates")).alias("risk"),
    )
    return joined.select("id", F.to_json(body).alias("meta_json"))
