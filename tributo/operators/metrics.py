"""Operating metrics: events, windows of recent rows, and what they suggest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.schema import conform

FIGURES = ("coverage", "precision", "recall", "confidence", "latency_s")
DROP, COVERAGE_LEAST, SANITY_LEAST, MATCH_LEAST, OCR_LEAST, SLOWER = 0.10, 0.60, 0.80, 0.72, 0.70, 1.25


#: What the metric rows say of a kind of document, and the column that it is the mean of.
MEANS = {"media_valor_total": "valor_total", "media_icms": "total_icms", "media_ipi": "total_ipi", "media_pis": "total_pis", "media_cofins": "total_cofins"}


def kind_means(docs: DataFrame) -> DataFrame:
    """tipo, total_documentos, the means of its documents' values, and each tax's mean in percent of the total's."""
    money = lambda c: F.col(c).cast("decimal(18,2)")
    means = {name: F.round(F.sum(money(c)).cast("double") / F.count(money(c)), 6) for name, c in MEANS.items()}
    out = docs.groupBy("tipo").agg(F.count("*").alias("total_documentos"), *[v.alias(k) for k, v in means.items()])
    base = F.col("media_valor_total")
    shares = {f"taxa_{k.removeprefix('media_')}_media": F.when(base > 0, F.round(F.coalesce(k, F.lit(0.0)) / base * 100, 6)).otherwise(0.0) for k in MEANS if k != "media_valor_total"}
    return out.withColumns(shares)


def events(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One metric row a document: whether it went to review or failed, and what its kind looks like in history.

    docs: id, tipo, status, completude, tempo; history, docs itself where none is given: tipo and the columns of MEANS.
    """
    kinds = kind_means(docs if history is None else history)
    body = F.struct(*[c for c in kinds.columns if c != "tipo"])
    seen = docs.join(kinds.select(F.col("tipo").alias("_tipo"), body.alias("_k")), F.col("tipo").eqNullSafe(F.col("_tipo")), "left")
    meta = F.to_json(F.struct("_k.*", F.col("status").alias("status_evento")))
    return seen.select(
        "id", F.col("tipo").alias("tipo_documento"), F.coalesce("completude", F.lit(0.0)).alias("acuracia_media"), F.coalesce(F.col("status") == "revisao_pendente", F.lit(False)).cast("double").alias("taxa_revisao"),
        F.coalesce(F.col("status").isin("erro", "quarentena"), F.lit(False)).cast("double").alias("taxa_erro"), F.coalesce("tempo", F.lit(0.0)).alias("tempo_medio"), meta.alias("meta_json"),
    )


def agent_runs(docs: DataFrame, agent: str, *, extras: list[str] | None = None) -> DataFrame:
    """A row of metricas_agente for each document that an agent has gone through.

    Figures come from the columns of docs that bear their names, null where there is none; the columns in extras are
    kept as JSON.
    """
    more = F.to_json(F.struct(*extras)) if extras else F.lit("{}")
    rows = docs.withColumns({"doc_id": F.col("id"), "agente": F.lit(agent), "tipo_documento": F.col("tipo"), "extras": more})
    return conform(rows.withColumn("id", F.xxhash64("id", "agente")), "metricas_agente")


def event_rows(rows: DataFrame, event: Column, details: list[str], user: str = "sistema") -> DataFrame:
    """A row of logs for each row: something that happened (a retry, a failed step, an agent's run), details as JSON."""
    told = rows.select(event.alias("evento"), F.lit(user).alias("usuario"), F.to_json(F.struct(*details)).alias("detalhes"))
    return conform(told.withColumns({"id": F.xxhash64("evento", "detalhes"), "criado_em": F.current_timestamp()}), "logs")


def memory_rows(answered: DataFrame) -> DataFrame:
    """Rows of memoria for answered questions: pergunta, resposta_resumo and, if known, duracao_s."""
    now = F.current_timestamp()
    timed = answered if "duracao_s" in answered.columns else answered.withColumn("duracao_s", F.lit(0.0))
    return conform(timed.withColumns({"id": F.xxhash64("pergunta", "resposta_resumo", now), "criado_em": now}), "memoria")


def last_per_kind(metrics: DataFrame, n: int = 100, kind: str = "tipo_documento", order: str = "id") -> DataFrame:
    w = Window.partitionBy(kind).orderBy(F.desc(order))
    return metrics.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def recent_and_base(rows: DataFrame, keys: list[str], figures: tuple[str, ...] = FIGURES, *, recent: int = 100, base: int = 300, order: str = "id") -> DataFrame:
    """For each key the means of its newest rows and of the rows before them, as <figure>_recente and <figure>_base.

    The base is what is left of the newest ``base`` rows once as many as the recent ones are taken off, ten at least, the
    oldest of them; with too few rows it is all of them. Row limits are cut before the means, so a long history is only
    ranked, by a window that Spark limits early.
    """
    recent, base = max(10, recent), max(20, base)
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    ranked = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max(recent, base))
    size = F.count("*").over(Window.partitionBy(*keys))
    ranked = ranked.withColumn("_size", size)
    n_recent, n_base = F.least(F.col("_size"), F.lit(recent)), F.least(F.col("_size"), F.lit(base))
    kept = F.when(n_base > n_recent, F.greatest(F.lit(10), n_base - n_recent)).otherwise(n_base)
    in_recent = F.col("_n") <= recent
    in_base = (F.col("_n") <= n_base) & (F.col("_n") > n_base - kept)
    mean = lambda c, test: F.coalesce(F.round(F.avg(F.when(test, F.col(c).try_cast("double"))), 6), F.lit(0.0))
    return ranked.groupBy(*keys).agg(*[mean(c, in_recent).alias(f"{c}_recente") for c in figures], *[mean(c, in_base).alias(f"{c}_base") for c in figures])


def relative_drop(recent: Column, base: Column) -> Column:
    return F.when(base > 0, (base - recent) / base).otherwise(0.0)


def suggestions(windows: DataFrame, agent: str = "agente") -> DataFrame:
    """windows with sugestoes: actions that an agent's figures call for."""
    is_ = lambda *names: F.lower(agent).rlike("^(" + "|".join(names) + ")")
    r, b = (lambda c: F.col(f"{c}_recente")), (lambda c: F.col(f"{c}_base"))
    fell = lambda c: relative_drop(r(c), b(c)) >= DROP
    tests = [
        ("reforcar_ocr", is_("ocr") & fell("confidence")), ("otimizar_ocr", is_("ocr") & (r("latency_s") > b("latency_s") * SLOWER)),
        ("ativar_llm_nlp", is_("nlp") & (r("coverage") < COVERAGE_LEAST)), ("revisar_extrator_nlp", is_("nlp") & (fell("precision") | fell("recall"))),
        ("revisar_normalizador", is_("normalizador", "normalizer") & (r("confidence") < SANITY_LEAST)), ("reforcar_associacao", is_("associador") & (r("confidence") < MATCH_LEAST)),
        ("revisar_regras_validador", is_("validador") & fell("precision")),
    ]
    return windows.withColumn("sugestoes", F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests])))


def recommendations(snapshots: DataFrame) -> DataFrame:
    """snapshots (ocr, nlp, sanidade, match_score, erros_estruturais) with recomendacoes for the next run."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    tests = [
        ("reprocessar_ocr", zero("ocr") < OCR_LEAST), ("ativar_llm_nlp", zero("nlp") < COVERAGE_LEAST), ("revisar_normalizador", (zero("sanidade") != 0) & (zero("sanidade") < SANITY_LEAST)),
        ("reforcar_associacao", (zero("match_score") != 0) & (zero("match_score") < MATCH_LEAST)), ("reprocessar_documento", F.coalesce(F.col("erros_estruturais") > 0, F.lit(False))),
    ]
    return snapshots.withColumn("recomendacoes", F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests])))


def recipes(executions: DataFrame, keys: list[str], *, least: int = 3, success: float = 0.7) -> DataFrame:
    """For each key the recipe with the best rate of success, of those tried often enough and that mostly worked."""
    rate = executions.groupBy(*keys, "receita").agg(F.count("*").alias("amostras"), F.round(F.avg(F.col("sucesso").cast("double")), 6).alias("taxa"))
    best = rate.where((F.col("amostras") >= least) & (F.col("taxa") >= success)).groupBy(*keys).agg(F.max(F.struct("taxa", "amostras", "receita")).alias("m"))
    return best.select(*keys, "m.receita", "m.taxa", "m.amostras")


def entity_profiles(docs: DataFrame) -> DataFrame:
    """By issuer how many documents there are, their mean value, usual kind and last date."""
    kinds = docs.groupBy("emitente_nome", "tipo").agg(F.count("*").alias("n"), F.sum(F.col("valor_total").cast("decimal(18,2)")).alias("v"), F.max("data_emissao").alias("d"))
    usual = F.max_by("tipo", F.struct("n", "tipo"))
    return kinds.groupBy("emitente_nome").agg(F.sum("n").alias("documentos"), F.round(F.sum("v").cast("double") / F.sum("n"), 4).alias("valor_medio"), usual.alias("tipo_usual"), F.max("d").alias("ultima"))


def last_turns(memory: DataFrame, k: int, keys: list[str], order: str) -> DataFrame:
    """The last k rows of each key, oldest first, numbered from 1."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    oldest = Window.partitionBy(*keys).orderBy(order)
    return memory.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= k).withColumn("posicao", F.row_number().over(oldest)).drop("_n")
