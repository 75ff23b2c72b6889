"""All queries of the text engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans import lines, pages, structure, text

ALL = {**text.QUERIES, **pages.QUERIES, **structure.QUERIES, **lines.QUERIES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.structure_report(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
