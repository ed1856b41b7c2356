"""Files to canonical tables: routing, deduplication, quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from . import xml
from .schema import conform
from .sinks import content_path


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """nome_arquivo, caminho_arquivo, content, hash of every file below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("nome_arquivo"), F.col("path").alias("caminho_arquivo"), "content", F.sha2("content", 256).alias("hash"))


def extension(name: str = "nome_arquivo"):
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def route(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """XML files, and the others as quarantine rows typed by their extension."""
    ext = extension()
    other = files.where(ext != "xml").drop("content")
    return files.where(ext == "xml"), other.withColumns({"tipo": F.when(ext == "", "desconhecido").otherwise(ext), "status": F.lit("quarentena"), "motivo_rejeicao": F.lit("Formato não suportado; envie XML.")})


def ingest(files: DataFrame, existing: DataFrame | None = None, *, origin: str = "upload", day: str | None = None) -> dict[str, DataFrame]:
    """The rows of each table that new files give; a file known by its hash is left out.

    documentos, itens, impostos and documentos_detalhes hold what was read, extracoes, metricas, metricas_agente and logs a
    row a document on how reading it went. Ids are hashes of content and place, so reading the same file again gives the
    same rows.
    """
    # Dealt first: otherwise each task sorts its contents by hash before it hands them on, though hardly any are equal there.
    fresh = files.repartition("hash").dropDuplicates(["hash"])
    if existing is not None:
        fresh = fresh.join(existing.select("hash"), "hash", "left_anti")
    readable, other = route(fresh)
    parsed = xml.parse(readable)
    number = F.xxhash64("hash").alias("id")
    when = F.lit(day) if day else F.date_format(F.current_date(), "yyyy-MM-dd")
    place = F.when(F.col("tipo").isNotNull(), content_path(F.col("nome_arquivo"), F.col("hash"), F.replace(when, F.lit("-"), F.lit(""))))
    described = lambda found: xml.documents(found).unionByName(other, allowMissingColumns=True).withColumns({"id": F.xxhash64("hash"), "origem": F.lit(origin), "data_upload": when, "caminho_xml": place})
    # Documents hold no items; the telemetry is of the whole reading, with its time.
    brief = xml.parse(readable, items=False)
    docs, whole = described(brief), described(parsed)
    details = xml.details(brief, "hash").unionByName(docs.where("natureza_operacao is not null").select("hash", F.lit("natureza_operacao").alias("chave"), F.col("natureza_operacao").alias("valor"), F.lit("xml").alias("origem")))
    item_rows = xml.items(parsed, "hash")
    item_id = F.xxhash64("hash", "ordem")
    tax_rows = xml.taxes(item_rows, "hash").withColumns({"item_id": item_id, "id": F.xxhash64("hash", "ordem", "tipo_imposto", "cst", "valor")})
    telemetry = whole.select("id", F.lit("xml_parser").alias("agente"), F.coalesce("completude", F.lit(0.0)).alias("confianca_media"), F.lit("pt").alias("linguagem"), F.round("tempo", 3).alias("tempo_processamento"))
    seen = whole.select("id", "tipo", "status", "completude", "tempo", "versao_schema", *metrics.MEANS.values())
    told = F.concat(F.lit("doc_id="), "id", F.lit("|tipo="), "tipo", F.lit("|status="), "status")
    return {
        "documentos": conform(docs, "documentos"),
        "itens": conform(item_rows.withColumns({"documento_id": F.xxhash64("hash"), "id": item_id}), "itens"),
        "impostos": conform(tax_rows, "impostos"),
        "documentos_detalhes": conform(details.withColumns({"documento_id": F.xxhash64("hash"), "id": F.xxhash64("hash", "chave")}), "documentos_detalhes"),
        "extracoes": conform(telemetry.withColumn("documento_id", F.col("id")), "extracoes"),
        "metricas": conform(metrics.events(seen).withColumn("registrado_em", F.current_timestamp()), "metricas"),
        "metricas_agente": metrics.agent_runs(seen.withColumns({"coverage": F.col("completude"), "confidence": F.lit(1.0), "latency_s": F.col("tempo")}), "xml_parser", extras=["versao_schema"]),
        "logs": conform(docs.select("id", F.lit("ingestao_xml").alias("evento"), F.lit("sistema").alias("usuario"), told.alias("detalhes"), F.current_timestamp().alias("criado_em")), "logs"),
        "qualidade": docs.select(number, "completude", "cobertura"),
    }


def reprocess(files: DataFrame, existing: DataFrame, *, day: str | None = None) -> dict[str, DataFrame]:
    """The rows of ingest for the files that existing (hash) knows already, derived anew.

    Their ids are those of before, so that an upsert by id replaces the older rows. Unknown files are left out.
    """
    return ingest(files.join(existing.select("hash"), "hash", "left_semi"), origin="reprocessamento", day=day)
