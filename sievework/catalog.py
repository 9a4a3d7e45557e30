"""All queries of the engine's own operators, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievework.plans import basic, payloads, shapes, state, whole, flows

Query = Callable[[SparkSession, str], DataFrame]


PARTS = (basic, payloads, shapes, state, whole, flows)


def queries() -> dict[str, Query]:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole.compact_all(spark, sf_dir)
