"""Structured Streaming: files as they arrive, and metrics by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.ingest import ingest
from ..sources.ledger import Ledger

TABLES = ("documentos", "itens", "impostos", "documentos_detalhes", "extracoes", "metricas", "metricas_agente", "logs")
BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, path: str, *, delay: str = "1 day", pattern: str = "*") -> DataFrame:
    """New files below path; the same bytes within the delay count once."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", pattern).load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("nome_arquivo"), F.col("path").alias("caminho_arquivo"), "content", F.sha2("content", 256).alias("hash"), "modificationTime")
    return named.withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["hash"])


def run_ingest(spark: SparkSession, source: str, target: str, checkpoint: str, *, buckets: int = 64) -> StreamingQuery:
    """Ingests what has arrived and stops. A batch that is run again writes the same files of its own number again.

    Files that came before are told by the ledger of their hashes, beside the tables; documents are never read again.
    """
    ledger = Ledger(spark, f"{target}/hashes", buckets=buckets)

    def write(batch: DataFrame, epoch: int) -> None:
        fresh = ledger.fresh(batch.drop("modificationTime"), before=epoch).persist()
        try:
            for name, rows in ingest(fresh).items():
                if name in TABLES:
                    rows.write.mode("overwrite").parquet(f"{target}/{name}/_epoch={epoch}")
            ledger.add(fresh, epoch)
        finally:
            fresh.unpersist()

    return file_stream(spark, source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_metrics(events: DataFrame, *, time: str = "registrado_em", delay: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """By kind and window the number of events and their mean figures; late rows count within the delay."""
    return (
        events.withWatermark(time, delay)
        .groupBy(F.window(time, length), "tipo_documento")
        .agg(F.count("*").alias("eventos"), F.avg("acuracia_media").alias("acuracia"), F.avg("taxa_erro").alias("erro"))
        .select(F.col("window.start").alias("inicio"), "tipo_documento", "eventos", F.round("acuracia", 6).alias("acuracia"), F.round("erro", 6).alias("erro"))
    )
