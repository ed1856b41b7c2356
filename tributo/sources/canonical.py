"""The canonical tables as views over a star schema of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Catalog


# Columns of the driver tables. With them no job has to look at the files before a query starts.
_SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[table]).parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents, customers as issuers, a nation as the issuer's region."""
    orders, customer, nation = (_read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    issuer = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")
    return orders.join(issuer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("tipo"), F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("data_emissao"),
        F.col("c_name").alias("emitente_nome"), F.col("n_name").alias("emitente_uf"), F.lit(None).cast("string").alias("destinatario_uf"), F.col("o_totalprice").cast("decimal(18,2)").alias("valor_total"),
        F.lpad(F.col("o_custkey").cast("string"), 14, "0").alias("emitente_cnpj"), F.lit(None).cast("string").alias("emitente_cpf"), F.col("o_orderkey").cast("string").alias("numero_nota"), F.lit("1").alias("serie"),
    )


_LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as items; the id is a hash of the whole line, as line numbers repeat."""
    line, part = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "part")
    joined = line.join(part.select("p_partkey", "p_name", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.xxhash64(*_LINE).alias("id"), F.col("l_orderkey").alias("documento_id"), F.col("l_linenumber").alias("numero_item"), F.col("p_name").alias("descricao"), F.col("p_type").alias("ncm"), F.col("p_brand").alias("cfop"),
        F.col("l_quantity").cast("decimal(18,3)").alias("quantidade"), F.round(F.col("l_extendedprice") / F.col("l_quantity"), 4).alias("valor_unitario"), F.col("l_extendedprice").cast("decimal(18,2)").alias("valor_total"),
    )


def item_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, documento_id, valor_total of each item, for what needs no product: the lines alone, without a join."""
    line = _read(spark, sf_dir, "lineitem").select(*_LINE)
    return line.select(F.xxhash64(*_LINE).alias("id"), F.col("l_orderkey").alias("documento_id"), F.col("l_extendedprice").cast("decimal(18,2)").alias("valor_total"))


def taxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tax rows a line: its tax as ICMS, its discount as IPI, values to the cent."""
    line = _read(spark, sf_dir, "lineitem").select(*_LINE)
    rate = lambda c: F.col(c).cast("decimal(9,4)")
    base = F.col("l_extendedprice").cast("decimal(18,2)")
    kinds = F.array(*[F.struct(F.lit(k).alias("tipo_imposto"), rate(c).alias("aliquota"), F.round(base * rate(c), 2).cast("decimal(18,2)").alias("valor")) for k, c in (("ICMS", "l_tax"), ("IPI", "l_discount"))])
    return line.select(F.xxhash64(*_LINE).alias("item_id"), F.col("l_orderkey").alias("documento_id"), F.col("l_returnflag").alias("cst"), base.alias("base_calculo"), F.explode(kinds).alias("t")).select("item_id", "documento_id", "cst", "base_calculo", "t.*")


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events")
    return events.select(F.col("event_id").alias("id"), F.col("user_id").alias("documento_id"), F.explode(F.from_json("props", "map<string,string>")).alias("chave", "valor"), F.col("event_type").alias("origem"), F.col("ts").alias("criado_em"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric_rows(_read(spark, sf_dir, "events"))


def metric_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """metrics as a stream of the events' files, one a batch; the pattern lets the table be a file or a folder."""
    return _metric_rows(spark.readStream.schema(_SCHEMAS["events"]).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parque[t]"))


def _metric_rows(events: DataFrame) -> DataFrame:
    flag = lambda t: (F.col("event_type") == t).cast("double")
    return events.select(F.col("event_id").alias("id"), F.col("event_type").alias("tipo_documento"), F.col("value").alias("acuracia_media"), flag("view").alias("taxa_revisao"), flag("error").alias("taxa_erro"), (F.col("value") / 10).alias("tempo_medio"), F.col("ts").alias("registrado_em"))


class _Views(dict):
    """The views by name, each made when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(documentos=documents, itens=items, impostos=taxes, documentos_detalhes=details, metricas=metrics)
        self.made: dict[str, DataFrame] = {}
        self.of = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = super().__getitem__(name)(*self.of)
        return self.made[name]

    def items(self):
        return [(name, self[name]) for name in self]

    def values(self):
        return [self[name] for name in self]


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(_Views(spark, sf_dir))
