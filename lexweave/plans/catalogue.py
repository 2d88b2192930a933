"""All queries of the core by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexweave.plans import evaluation, extraction, graphs, parts, problems, retrieval


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**retrieval.QUERIES, **extraction.QUERIES, **graphs.QUERIES, **evaluation.QUERIES, **parts.QUERIES, **problems.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**retrieval.ORACLE, **extraction.ORACLE, **graphs.ORACLE, **evaluation.ORACLE, **parts.ORACLE, **problems.ORACLE}
