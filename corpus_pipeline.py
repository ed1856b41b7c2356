"""A training-corpus pipeline over documents: each stage's result is written as Parquet and read again by the next.

Stages: reject toxic documents, keep one document of each group of near copies, drop documents that hold benchmark
passages, redact secrets, and draw the documents by the source mixture.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tributo.llm.common import prepared, read, shared_folder
from tributo.llm.decontaminate import drop_contaminated
from tributo.llm.mixing import mixture
from tributo.llm.near_dedup import keep_one
from tributo.llm.secrets import redact_documents
from tributo.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, read(prepared(spark), sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return keep_one(docs, k=5, threshold=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read(prepared(spark), sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return redact_documents(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixing", mixing),
]

#: Trained networks, signatures and byte-level redaction have no SQL form; the stages are tested against plain Python.
ORACLE_SQL: str | None = None


def _written(spark: SparkSession, docs: DataFrame, stage: str) -> tuple[DataFrame, str]:
    """docs as a table in the shared folder of the session, and its path."""
    path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}-{stage}"
    docs.write.parquet(path)
    return spark.read.parquet(path), path


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: doc_id, source, text, n_tokens, weight, draw, place of each time a document is drawn.

    A stage's table is deleted once the next one is written; the last one stays, as the result reads it.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = _written(spark, stage(spark, docs, sf_dir), name)
        if before:
            _delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
