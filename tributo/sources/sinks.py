"""Writes: appends, latest-wins upserts, cascades, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .schema import PARENTS, conform


def append(df: DataFrame, table: str, path: str) -> None:
    """Appends to a Parquet table, in the table's columns and types."""
    conform(df, table).write.mode("append").parquet(path)


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], order: str = "criado_em", keep: tuple[str, ...] = ("origem",)) -> DataFrame:
    """current with incoming on top: the newest row of each key; a null in a kept column falls back to the row before.

    Keys match null-safe, as groups do.
    """
    both = current.withColumn("_late", F.lit(0)).unionByName(incoming.withColumn("_late", F.lit(1)), allowMissingColumns=True)
    rank = F.struct("_late", order)
    values = [c for c in both.columns if c not in (*keys, "_late")]
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), rank) if c in keep else rank).alias(c) for c in values]
    return both.groupBy(*keys).agg(*newest).select(current.columns)


def upsert_details(current: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(current, incoming, ["documento_id", "chave"])


def upsert_config(current: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(current.withColumn("usuario", F.coalesce("usuario", F.lit(""))), incoming.withColumn("usuario", F.coalesce("usuario", F.lit(""))), ["chave", "usuario"], order="id", keep=())


def insert_new_details(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """current and incoming; fails at run time on a (document, key) that is there already."""
    taken = incoming.join(current.select("documento_id", "chave", F.lit(True).alias("_taken")), ["documento_id", "chave"], "left")
    checked = taken.withColumn("valor", F.when(F.col("_taken"), F.raise_error(F.concat(F.lit("detail exists: "), "chave"))).otherwise(F.col("valor"))).drop("_taken")
    return current.unionByName(checked.select(current.columns))


def apply_overrides(docs: DataFrame, overrides: DataFrame) -> DataFrame:
    """docs with the newest value of each overridden (id, field); overrides: id, campo, valor, em (text values)."""
    fields = [c for c in docs.columns if c != "id"]
    wide = overrides.groupBy("id").agg(*[F.max_by(F.struct("valor"), F.when(F.col("campo") == c, F.col("em"))).alias(f"_{c}") for c in fields])
    kinds = dict(docs.dtypes)
    joined = docs.join(wide, "id", "left")
    return joined.select("id", *[F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.valor").try_cast(kinds[c])).otherwise(F.col(c)).alias(c) for c in fields])


def approve(ids: DataFrame, at: str) -> DataFrame:
    """Overrides that approve documents: status and motive."""
    both = F.array(F.struct(F.lit("status").alias("campo"), F.lit("revisado").alias("valor")), F.struct(F.lit("motivo_rejeicao").alias("campo"), F.lit(None).cast("string").alias("valor")))
    return ids.select("id", F.explode(both).alias("x")).select("id", "x.campo", "x.valor", F.lit(at).alias("em"))


def changed_cells(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """id, campo, antes, depois of each cell that differs, values as text."""
    columns = [c for c in before.columns if c != key and c in after.columns]
    pair = before.select(key, *[F.col(c).cast("string").alias(f"a_{c}") for c in columns]).join(after.select(key, *[F.col(c).cast("string").alias(f"b_{c}") for c in columns]), key)
    cells = F.array(*[F.struct(F.lit(c).alias("campo"), F.col(f"a_{c}").alias("antes"), F.col(f"b_{c}").alias("depois")) for c in columns])
    return pair.select(key, F.explode(F.filter(cells, lambda x: ~x["antes"].eqNullSafe(x["depois"]))).alias("x")).select(key, "x.*")


def cascade(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the documents whose id is in gone, and without what belongs to them."""
    out = dict(tables)
    lost = {"documentos": gone.select("id")}
    out["documentos"] = tables["documentos"].join(lost["documentos"], "id", "left_anti")
    for child, (column, parent) in PARENTS.items():
        if child in tables and parent in lost:
            ids = lost[parent].withColumnRenamed("id", column)
            if child in {p for _, p in PARENTS.values()}:
                lost[child] = tables[child].join(ids, column, "left_semi").select("id")
            out[child] = tables[child].join(ids, column, "left_anti")
    return out


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def package_bucket(document: Column, buckets: int) -> Column:
    """The folder of export_package in which a document's rows are."""
    return F.pmod(F.xxhash64(document), F.lit(buckets))


def export_package(docs: DataFrame, items: DataFrame, taxes: DataFrame, path: str, *, buckets: int = 256) -> None:
    """Documents, metadata and origins as JSON, items and taxes as CSV, each dealt into folders by package_bucket.

    The number of folders doesn't grow with that of documents. One document's package is what documento_id picks from
    its bucket; filter the inputs to export it alone.
    """
    own = lambda df: df.withColumn("pacote", package_bucket(F.col("documento_id"), buckets))
    named = own(docs.withColumn("documento_id", F.col("id")))
    owned = own(taxes.join(items.select(F.col("id").alias("item_id"), "documento_id"), "item_id"))
    parts = {
        "documento": named,
        "meta": named.select("pacote", "documento_id", F.coalesce("meta_json", F.lit("{}")).alias("meta_json")),
        "origem": named.where("caminho_arquivo is not null").select("pacote", "documento_id", "caminho_arquivo"),
    }
    for name, rows in parts.items():
        rows.write.mode("overwrite").partitionBy("pacote").json(f"{path}/{name}")
    for name, rows in (("itens", own(items)), ("impostos", owned)):
        rows.write.mode("overwrite").partitionBy("pacote").option("header", True).csv(f"{path}/{name}")


def compact(df: DataFrame, path: str, files: int) -> None:
    """The table in that many files, rows of a document together."""
    key = "documento_id" if "documento_id" in df.columns else "id"
    df.repartition(files, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def content_path(name, digest, day):
    """uploads/<day>/<first 16 of the hash>__<name>."""
    return F.concat_ws("/", F.lit("uploads"), day, F.concat(F.left(digest, F.lit(16)), F.lit("__"), name))


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
