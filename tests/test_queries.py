"""Every registered query against its SQL, on the smallest tables; and what the entry module promises."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from datetime import timedelta
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tributo.plans import registry
from tributo.sources import canonical

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return float(v) if isinstance(v, Decimal) else v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = duck.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == _rows(columns, want.fetchall())


def test_band_links_of_all_documents(spark, sf_dir):
    """Every document is linked, to the least id within both bands."""
    docs = canonical.documents(spark, sf_dir).select("id", "valor_total", F.to_date(F.substring("data_emissao", 1, 10)).alias("dia")).collect()
    by_day = defaultdict(list)
    for r in docs:
        by_day[r.dia].append(r)
    near = lambda r: [x.id for d in (-1, 0, 1) for x in by_day[r.dia + timedelta(d)] if abs(x.valor_total - r.valor_total) <= 5]
    got = {r.id: r.alvo_id for r in registry.queries()["link_value_date_band"](spark, sf_dir).collect()}
    assert got == {r.id + 1: min(near(r)) for r in docs} and len(got) == len(docs)


def test_text_blocks_of_all_sources(spark, sf_dir):
    got = Counter()
    for r in registry.queries()["text_blocks_all"](spark, sf_dir).collect():
        got[r.source, r.documento_id] += len(r.texto.split("\n"))
    want = Counter()
    for source, rows in (("detalhes", canonical.details), ("itens", canonical.items), ("impostos", canonical.item_values)):
        want.update((source, r.documento_id) for r in rows(spark, sf_dir).select("documento_id").collect())
    assert got == want and {s for s, _ in got} == {"detalhes", "itens", "impostos"}


def test_entry(spark):
    assert len(entry.entry(spark).collect()) == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pages_that_parse_are_read_and_others_are_kept_as_invalid(spark, sf_dir):
    """What the strict parser of the standard library takes is read; what is no markup at all is registered as invalid."""
    from xml.etree import ElementTree

    pages = {str(r.page_id): r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r.nome_arquivo: r.status for r in registry.queries()["html_wellformed"](spark, sf_dir).collect()}
    assert got.keys() == pages.keys()

    def strict(text):
        try:
            ElementTree.fromstring(text)
        except (ElementTree.ParseError, TypeError):
            return False
        return True

    told = {(strict(pages[k]), s) for k, s in got.items()}
    assert all(not ok or s != "erro" for ok, s in told) and len({s for _, s in told}) >= 1


def test_validation_reads_each_child_table_once_a_purpose(spark, sf_dir):
    """Lines: their sums by document, their codes as items, the taxes and their owners, the classes; no more."""
    from tributo.plans import documents

    plan = documents.QUERIES["validate_codes_and_taxes"][0](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan" in line and "lineitem" in line for line in plan.splitlines()) <= 5


def test_rows_are_not_dealt_by_the_few_kinds_of_tax(spark, sf_dir):
    from tributo.plans import relational

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that Spark takes for large
    try:
        for name in ("ask_tax_outliers", "tax_iqr", "tax_zscore"):
            plan = relational.QUERIES[name][0](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in next(line for line in plan.splitlines() if "Join" in line)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
