"""Path classification: areas, roles, extensions, directories, named patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr, rules


def file_extension(path: Column) -> Column:
    base = F.lower(expr.base_name(expr.normalize_path(path)))
    return F.when((base == ".env") | base.startswith(".env."), F.lit(".env")).otherwise(expr.ext_name(base))


def file_area(path: Column) -> Column:
    lower = F.lower(expr.normalize_path(path))
    return expr.first_match(lower, [(area, "|".join(patterns)) for area, patterns in rules.AREAS], "unknown")


def file_role(path: Column) -> Column:
    return expr.first_match(F.lower(expr.normalize_path(path)), rules.ROLES, "unknown")


def is_generated(path: Column) -> Column:
    return expr.any_match(F.lower(expr.normalize_path(path)), rules.GENERATED_PATTERNS)


def is_noisy(path: Column) -> Column:
    """Files that are no evidence of work: artifacts, fixtures, lock files."""
    return file_role(path).isin(rules.NOISY_ROLES) | expr.any_match(F.lower(path), rules.NOISY_EVIDENCE_PATTERNS)


def path_patterns(path: Column) -> Column:
    """Prefix globs of one to three parts, then the named patterns that match."""
    normal = expr.normalize_path(path)
    parts = expr.present(F.split(normal, "/"))
    depth = F.least(F.lit(3), F.size(parts))
    globs = F.when(depth > 0, F.transform(F.sequence(F.lit(1), depth), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/**")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(globs, expr.tags(F.lower(normal), [(p, [name]) for name, p in rules.NAMED_PATTERNS])))


def with_classes(files: DataFrame, path: str = "file_path") -> DataFrame:
    """Adds directory, extension, area, role, generated and noisy to a table of paths."""
    p = F.col(path)
    return files.select("*", expr.directory_of(p).alias("directory"), file_extension(p).alias("extension"), file_area(p).alias("area"), file_role(p).alias("role"), is_generated(p).alias("generated"), is_noisy(p).alias("noisy"))


def commit_areas(files: DataFrame, keys: list[str], order: str = "file_ord") -> DataFrame:
    """The area of each commit: the most frequent of its files' areas, first seen on ties, or mixed."""
    counted = files.select(*keys, order, file_area(F.col("file_path")).alias("area")).groupBy(*keys, "area").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    per = Window.partitionBy(*keys)
    best = F.row_number().over(per.orderBy(F.col("n").desc(), "first"))
    tops = counted.select("*", best.alias("rank"), F.sum("n").over(per).alias("total"), F.count("*").over(per).alias("areas")).where("rank = 1")
    mixed = (F.col("areas") > 1) & ((F.col("area") == "unknown") | (F.col("n") / F.col("total") < rules.MIXED_BELOW))
    return tops.select(*keys, F.when(mixed, F.lit("mixed")).otherwise(F.col("area")).alias("area"))


def repeated_path_patterns(files: DataFrame, repo: list[str], commit: str, min_count: int = 2) -> DataFrame:
    """Patterns seen in at least min_count commits of a repository, with their commits."""
    exploded = files.select(*repo, commit, F.explode(path_patterns(F.col("file_path"))).alias("pattern"))
    counted = exploded.groupBy(*repo, "pattern").agg(F.array_sort(F.collect_set(commit)).alias("commits"))
    return counted.withColumn("n", F.size("commits").cast("long")).where(F.col("n") >= min_count)
