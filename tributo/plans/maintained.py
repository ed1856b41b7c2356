"""Queries over what is kept up to date: streams, ledgers, runs and inverted files, written in the shared folder of the session."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import inverted
from ..session import shared_folder
from ..sources import canonical
from ..sources.ledger import Ledger
from ..streaming import windows
from ..streaming.duplicates import RunStore
from . import relational

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def _kept(like: str | None = None, sql: str | None = None) -> Callable[[Query], Query]:
    """The SQL of the query that says the same of all rows at once, or SQL of its own."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f, sql or relational.QUERIES[like][1]
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@_kept(like="cosine_topk")
def cosine_topk_cells(spark, sf_dir):
    """The six most alike vectors, from the cells of an inverted file that can hold them."""
    index = inverted.build(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), _folder(spark, "cells"), cells=32)
    return inverted.cosine_top(spark, index, relational.query_vector(), 6)


@_kept(like="recent_vs_base")
def recent_vs_base_stream(spark, sf_dir):
    """The windows of recent_vs_base after a stream of all events."""
    rows = canonical.metric_stream(spark, sf_dir).withColumn("confidence", F.col("acuracia_media"))
    out = _folder(spark, "stream")
    told = windows.recent_and_base_stream(rows, ["tipo_documento"], ("confidence",))
    windows.latest(told, f"{out}/answers", f"{out}/checkpoint")
    schema = "tipo_documento string, confidence_recente double, confidence_base double, _epoch int"
    answers = spark.read.schema(schema).parquet(f"{out}/answers")
    return windows.last_answers(answers, ["tipo_documento"]).select("tipo_documento", F.col("confidence_recente").alias("recente"), F.col("confidence_base").alias("base"))


@_kept(sql="SELECT min(doc_id) AS doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL GROUP BY 2")
def known_hashes_ledger(spark, sf_dir):
    """One document of each content, taken in by four batches in the order of their ids against a ledger of known hashes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.content_hash(F.col("text")).alias("hash"))
    least, most = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    # A batch's own copies: the smallest id stays.
    first = lambda rows: rows.groupBy("hash").agg(F.min("doc_id").alias("doc_id"))
    ledger, out, step = Ledger(spark, _folder(spark, "ledger"), buckets=16), _folder(spark, "taken"), ((most or 0) - (least or 0)) // 4 + 1
    for epoch in range(4):
        low = (least or 0) + epoch * step
        batch = first(docs.where(F.col("doc_id").between(low, low + step - 1)))
        ledger.fresh(batch, before=epoch).write.parquet(f"{out}/_epoch={epoch}")
        ledger.add(spark.read.schema("hash string, doc_id bigint").parquet(f"{out}/_epoch={epoch}"), epoch)
    return spark.read.schema("hash string, doc_id bigint").parquet(*[f"{out}/_epoch={e}" for e in range(4)]).select("doc_id", "hash")


@_kept(
    sql="""WITH g AS (SELECT o_custkey, o_orderkey AS id, o_orderkey % 3 AS n, CAST(floor(o_totalprice / 20000) AS BIGINT) AS b FROM orders
    ), w AS (SELECT *, CASE WHEN b - lag(b) OVER (PARTITION BY o_custkey, n ORDER BY b, id) <= 1 THEN 0 ELSE 1 END AS s FROM g
    ), r AS (SELECT *, sum(s) OVER (PARTITION BY o_custkey, n ORDER BY b, id ROWS UNBOUNDED PRECEDING) AS run FROM w)
    SELECT id, min(id) OVER (PARTITION BY o_custkey, n, run) AS classe, count(*) OVER (PARTITION BY o_custkey, n, run) AS n FROM r"""
)
def duplicates_maintained(spark, sf_dir):
    """duplicates_classes, from runs that three batches of orders by their date have brought up to date."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    docs = orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("emitente_cnpj"), F.lit(None).cast("string").alias("emitente_cpf"), (F.col("o_orderkey") % 3).alias("numero_nota"), F.lit("1").alias("serie"),
        (F.floor(F.col("o_totalprice") / 20000) * 0.01).alias("valor_total"), F.year("o_orderdate").alias("ano"),
    )
    store = RunStore(spark, _folder(spark, "runs"), cents=0.02, buckets=8)
    for epoch, years in enumerate(("ano < 1994", "ano between 1994 and 1996", "ano > 1996 or ano is null")):
        store.apply(docs.where(years), epoch)
    return store.classes(docs)
