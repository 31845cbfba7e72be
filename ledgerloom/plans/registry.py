"""All queries of the core by name, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans import core_queries, ledger_queries

MODULES = (core_queries, ledger_queries)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.oracle_sql().items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return ledger_queries.insight_engine(spark, d)
