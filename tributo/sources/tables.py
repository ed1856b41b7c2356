"""Scans and lookups over the canonical tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import TABLES


class Catalog:
    """Named DataFrames; only tables of the model can be scanned."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables

    def __getitem__(self, name: str) -> DataFrame:
        return self.scan(name)

    def scan(self, table: str, where: Column | str | None = None, order_by: list[Column | str] | None = None, limit: int | None = None) -> DataFrame:
        """Filter, order and limit are all optional; a limit that isn't positive is ignored."""
        if table not in TABLES or table not in self.tables:
            raise ValueError(f"unknown table: {table}")
        df = self.tables[table]
        if where is not None:
            df = df.where(where)
        if order_by:
            df = df.orderBy(*order_by)
        return df.limit(limit) if limit and limit > 0 else df

    def views(self, prefix: str = "") -> None:
        for name, df in self.tables.items():
            df.createOrReplaceTempView(f"{prefix}{name}")


def by_id(df: DataFrame, key: int) -> DataFrame:
    return df.where(F.col("id") == key)


def by_hash(df: DataFrame, content_hash: str) -> DataFrame:
    return df.where(F.col("hash") == content_hash)


def detail_map(details: DataFrame) -> DataFrame:
    """documento_id and a map of its details; of a key given twice the newest row counts."""
    newest = details.groupBy("documento_id", "chave").agg(F.max_by("valor", "id").alias("valor"))
    return newest.groupBy("documento_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chave", "valor")))).alias("detalhes"))


def detail(details: DataFrame, document: int, key: str) -> DataFrame:
    return details.where((F.col("documento_id") == document) & (F.col("chave") == key)).select("valor")


def details_with_prefix(details: DataFrame, prefix: str | None = None, document: int | None = None, *, literal: bool = False) -> DataFrame:
    """Rows whose key begins so, whatever its case; % and _ are wild unless literal."""
    if document is not None:
        details = details.where(F.col("documento_id") == document)
    if prefix:
        details = details.where(F.startswith("chave", F.lit(prefix)) if literal else F.col("chave").ilike(f"{prefix}%"))
    return details.orderBy("documento_id", "chave")


def config_value(config: DataFrame, key: str, user: str | None = None) -> DataFrame:
    """The setting of that user, or the common one for none."""
    return config.where((F.col("chave") == key) & F.col("usuario").eqNullSafe(F.lit(user))).select("valor")


def new_only(incoming: DataFrame, existing: DataFrame, key: str = "hash") -> DataFrame:
    """Incoming rows with a key that is new, one of each."""
    return incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def statistics(df: DataFrame) -> DataFrame:
    """coluna, linhas, nulos, minimo, maximo of each column that can be ordered, extremes as text; one pass over the table."""
    columns = [c for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]
    parts = lambda c: (F.lit(c).alias("coluna"), F.count("*").alias("linhas"), F.count_if(F.col(c).isNull()).alias("nulos"), F.min(c).cast("string").alias("minimo"), F.max(c).cast("string").alias("maximo"))
    row = df.agg(F.array(*[F.struct(*parts(c)) for c in columns]).alias("s")) if columns else df.select(F.lit(None).cast("array<struct<coluna:string,linhas:bigint,nulos:bigint,minimo:string,maximo:string>>").alias("s")).limit(0)
    return row.select(F.inline("s"))
