"""Text blocks, chunks, and cosine retrieval over stored vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nested


def _lines(rows: DataFrame, key: str, order: list[Column | str], line: Column) -> DataFrame:
    """One text a key, a line a row, in a fixed order."""
    packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))).alias("_l"))
    return packed.select(F.col(key).alias("documento_id"), F.array_join(F.transform("_l", lambda s: s["_line"]), "\n").alias("texto"))


def text_blocks(details: DataFrame, items: DataFrame, taxes: DataFrame) -> DataFrame:
    """documento_id, source, texto: a document's details, items and taxes as text."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    bar = lambda cols: F.concat_ws(" | ", *[cell(c) for c in cols])
    a = _lines(details, "documento_id", ["id"], F.concat(cell("chave"), F.lit(": "), cell("valor"))).withColumn("source", F.lit("detalhes"))
    b = _lines(items, "documento_id", ["numero_item", "id"], bar(["numero_item", "descricao", "codigo_produto", "ncm", "cfop", "quantidade", "valor_unitario", "valor_total"])).withColumn("source", F.lit("itens"))
    owned = taxes.join(items.select(F.col("id").alias("item_id"), "documento_id"), "item_id")
    c = _lines(owned, "documento_id", ["item_id", "id"], bar(["id", "item_id", "tipo_imposto", "cst", "origem", "base_calculo", "aliquota", "valor"])).withColumn("source", F.lit("impostos"))
    return a.unionByName(b).unionByName(c)


def chunked(blocks: DataFrame, size: int = 800) -> DataFrame:
    return blocks.select("documento_id", "source", F.posexplode(nested.chunks(F.col("texto"), size)).alias("ordem", "chunk"))


def index(chunks: DataFrame, indexed: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """Chunks of documents without any stored ones, with their vectors; embed is the caller's column function."""
    fresh = chunks.join(indexed.select("documento_id").distinct(), "documento_id", "left_anti")
    return fresh.withColumn("embedding_json", F.to_json(embed(F.col("chunk"))))


def cosine_top(vectors: DataFrame, query: list[float], k: int = 5, *, column: str = "embedding", key: str = "vec_id", scope: DataFrame | None = None) -> DataFrame:
    """The k rows most alike to the query, only such as are alike at all, ties by key; at least one is asked for.

    The query is one small literal, and the top is kept in each task, so nothing is shuffled but k rows a task.
    """
    if scope is not None:
        vectors = vectors.join(scope, key, "left_semi")
    score = nested.cosine(F.col(column), F.array(*[F.lit(float(x)) for x in query]))
    return vectors.select(key, F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(max(1, k))
