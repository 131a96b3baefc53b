"""The registered queries over the engine's own operators, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import diffs, flows, graph, paths, skills, texts

_PARTS = [paths, diffs, graph, texts, skills, flows]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.a3_cochange_pairs(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for part in _PARTS for name, run in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
