"""Collects the queries of the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import canonical
from . import ask, documents, maintained, relational, scalar

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {name: run for module in (relational, documents, scalar, maintained) for name, (run, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in (relational, documents, scalar, maintained) for name, (_, sql) in module.QUERIES.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask.ask(canonical.catalog(spark, sf_dir), "top 5 emitentes").frame
