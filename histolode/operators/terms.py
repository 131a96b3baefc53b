"""Terms: normal forms, noise and the most frequent per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr, rules


def normal_terms(rows: DataFrame, term: str) -> DataFrame:
    """Lower-case terms of letters, digits and hyphens; short ones, numbers and noise words go."""
    normal = F.regexp_replace(F.lower(term), "[^a-z0-9-]+", "")
    return rows.withColumn(term, normal).where((F.length(term) >= 3) & ~F.col(term).rlike(r"^\d+$") & ~F.col(term).isin(rules.TERM_NOISE))


def top_terms(rows: DataFrame, keys: list[str], term: str, limit: int) -> DataFrame:
    """The most frequent terms per key with count and rank, ties by name."""
    counted = rows.groupBy(*keys, term).agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), term))).where(F.col("rank") <= limit)


def without_plurals(rows: DataFrame, keys: list[str], term: str, order: str) -> DataFrame:
    """Of terms with the same singular the first in order stays."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, expr.singular(F.col(term))).orderBy(order))).where("_r = 1").drop("_r")
