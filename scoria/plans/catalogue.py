"""All queries of the engine's own operators, module by module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scoria.plans import files, nested, records, texts

MODULES = (texts, records, nested, files)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.oracle_sql().items()}
