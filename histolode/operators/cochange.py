"""Frequencies, co-change pairs and learned surfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr, rules
from ..functions.tables import Tables
from .classify import file_role, is_generated
from .signals import files_with


def file_frequency(files: DataFrame, repo: list[str], commit: str, keep: int | None = rules.FREQUENT_KEPT) -> DataFrame:
    """Distinct commits per file with its role, the most frequent of each repository."""
    counted = files.where("file_path != ''").groupBy(*repo, "file_path").agg(F.count_distinct(commit).alias("commit_count"))
    counted = counted.withColumn("role", file_role(F.col("file_path")))
    return _top(counted, repo, [F.col("commit_count").desc(), F.col("file_path")], keep)


def directory_frequency(files: DataFrame, repo: list[str], commit: str, keep: int | None = rules.FREQUENT_KEPT) -> DataFrame:
    counted = files.where("file_path != ''").groupBy(*repo, expr.directory_of(F.col("file_path")).alias("directory")).agg(F.count_distinct(commit).alias("commit_count"))
    return _top(counted, repo, [F.col("commit_count").desc(), F.col("directory")], keep)


def _top(rows: DataFrame, keys: list[str], order: list[Column], keep: int | None) -> DataFrame:
    if keep is None:
        return rows
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= keep)


def eligible(path: Column) -> Column:
    return ~is_generated(path) & file_role(path).isin(rules.CO_CHANGE_ROLES)


#: Files of one block of a commit; vaster commits are expanded by pairs of blocks, each a row of its own.
BLOCK_FILES = 512


def cochange_pairs(files: DataFrame, repo: list[str], commit: str, min_weight: int = rules.CO_CHANGE_MIN_WEIGHT, keep: int | None = rules.CO_CHANGE_KEPT, max_files_per_commit: int | None = None) -> DataFrame:
    """file_a < file_b changed together in at least min_weight commits: weight and shared commits.

    A pair is counted once a commit: files are made distinct per commit, gathered and
    expanded inside its row, so only partial counts of pairs are shuffled, never a
    self-join.  A commit of more than ``BLOCK_FILES`` files is cut into blocks, and each
    pair of blocks is dealt to a task.  max_files_per_commit is off by default; it skips
    vast commits.
    """
    lists = files.where(F.col("file_path") != "").where(eligible(F.col("file_path"))).groupBy(*repo, commit).agg(F.array_sort(F.collect_set(expr.normalize_path(F.col("file_path")))).alias("f"))
    lists = lists.where(F.size("f") >= 2)
    if max_files_per_commit is not None:
        lists = lists.where(F.size("f") <= max_files_per_commit)
    lists = Tables(files.sparkSession, "cochange").keep(lists, "lists")
    rest = lists.where(F.size("f") <= BLOCK_FILES).select(*repo, "f", F.posexplode("f").alias("i", "file_a"))
    pairs = rest.select(*repo, "file_a", F.explode(F.slice(F.col("f"), F.col("i") + 2, F.size("f"))).alias("file_b"))
    if not lists.where(F.size("f") > BLOCK_FILES).isEmpty():
        pairs = pairs.unionByName(_vast_pairs(lists.where(F.size("f") > BLOCK_FILES), repo, commit))
    weights = pairs.groupBy(*repo, "file_a", "file_b").agg(F.count("*").alias("weight")).where(F.col("weight") >= min_weight)
    return _top(weights, repo, [F.col("weight").desc(), F.col("file_a"), F.col("file_b")], keep)


def _vast_pairs(lists: DataFrame, repo: list[str], commit: str) -> DataFrame:
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("f") - 1) / BLOCK_FILES).cast("int")), lambda k: F.slice("f", k * BLOCK_FILES + 1, F.lit(BLOCK_FILES)))
    vast = lists.select(*repo, commit, blocks.alias("blocks")).select(*repo, commit, "blocks", F.posexplode("blocks").alias("x", "one"))
    dealt = vast.select(*repo, commit, "x", "one", F.posexplode(F.slice(F.col("blocks"), F.col("x") + 1, F.size("blocks"))).alias("y", "two"))
    one = dealt.repartition(*repo, commit, "x", "y").select(*repo, "two", F.explode("one").alias("file_a"))
    return one.select(*repo, "file_a", F.explode("two").alias("file_b")).where("file_a < file_b")


def surface_confidence(commits: Column, sources: Column, tests: Column, commands: Column, edges: Column) -> Column:
    score = F.lit(0.22) + F.least(commits, F.lit(8)) * F.lit(0.06) + F.least(sources, F.lit(6)) * F.lit(0.035) + F.when(tests > 0, 0.16).otherwise(0.0) + F.when(commands > 0, 0.12).otherwise(0.0) + F.least(edges, F.lit(5)) * F.lit(0.025)
    return expr.to_fixed2(F.least(F.lit(0.97), score))


def classified(files: DataFrame, repo: list[str], commit: str) -> DataFrame:
    """Distinct (repo, commit, file_path) with role and directory, which are found once for each path."""
    f = files.select(*repo, commit, expr.normalize_path(F.col("file_path")).alias("file_path")).where("file_path != ''").distinct()
    return files_with(f, {"role": file_role(F.col("file_path")), "directory": expr.directory_of(F.col("file_path"))})


def _in_surface() -> Column:
    """A surface is a directory other than the root that holds source or docs files."""
    return F.col("role").isin("source", "docs") & (F.col("directory") != "repo root")


def learn_surfaces(files: DataFrame, repo: list[str], commit: str, edges: DataFrame, commands: DataFrame | None = None, keep: int | None = rules.SURFACES_KEPT) -> DataFrame:
    """Surfaces with representative files, tests, configs, co-change evidence and confidence.

    edges: strongest co-change pairs; commands: repo, surface, n_commands (none: no validation commands).
    """
    f = classified(files, repo, commit)
    touched = f.where(_in_surface()).select(*repo, commit, F.col("directory").alias("surface")).distinct()
    commits = touched.groupBy(*repo, "surface").agg(F.count("*").alias("commit_count"))
    # a surface's sources are its own files; only tests, configs and docs of its commits are joined
    own = f.where(_in_surface()).groupBy(*repo, F.col("directory").alias("surface"), "file_path").agg(F.count("*").alias("n")).withColumn("kind", F.lit("source"))
    beside = touched.join(f.where(F.col("role").isin("test", "config", "docs")), [*repo, commit]).where((F.col("role") != "docs") | (F.col("directory") != F.col("surface")))
    kind = F.when(F.col("role") == "test", F.lit("test")).otherwise(F.lit("config"))
    others = beside.groupBy(*repo, "surface", kind.alias("kind"), "file_path").agg(F.count("*").alias("n"))
    counted = own.unionByName(others)
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(*repo, "surface", "kind").orderBy(F.col("n").desc(), "file_path")))
    tops = ranked.where("rank <= 8")

    def files_of(kind: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "file_path")))), lambda x: x["file_path"])

    lists = tops.groupBy(*repo, "surface").agg(files_of("source").alias("representative_files"), files_of("test").alias("test_files"), files_of("config").alias("config_or_docs_files"))
    ends = edges.select(*repo, "file_a", "file_b", F.explode(F.array("file_a", "file_b")).alias("file_path"))
    sources = ranked.where("kind = 'source'").select(*repo, "surface", "file_path")
    touching = sources.join(ends, [*repo, "file_path"]).select(*repo, "surface", "file_a", "file_b").distinct().groupBy(*repo, "surface").agg(F.least(F.count("*"), F.lit(8)).alias("edge_count"))
    joined = commits.join(lists, [*repo, "surface"]).join(touching, [*repo, "surface"], "left")
    joined = joined.join(commands, [*repo, "surface"], "left") if commands is not None else joined.withColumn("n_commands", F.lit(0))
    n = {c: F.size(c) for c in ("representative_files", "test_files")}
    confidence = surface_confidence(F.col("commit_count"), n["representative_files"], n["test_files"], F.coalesce("n_commands", F.lit(0)), F.coalesce("edge_count", F.lit(0)))
    scored = joined.withColumn("confidence", confidence).withColumn("edge_count", F.coalesce("edge_count", F.lit(0)))
    kept = scored.where((F.col("commit_count") >= rules.SURFACE_MIN_COMMITS) & (F.size("representative_files") > 0) & (F.col("confidence") >= rules.SURFACE_MIN_CONFIDENCE))
    return _top(kept, repo, [F.col("confidence").desc(), F.col("commit_count").desc(), F.col("surface")], keep).withColumn("surface_id", expr.slug(F.col("surface"), "repo-root"))


def surface_terms(files: DataFrame, messages: DataFrame, repo: list[str], commit: str) -> DataFrame:
    """Terms of a surface seen in at least max(2, 35 %) of its commits: six at most, by commits, then name.

    messages: repo, commit, message_terms (array).
    """
    members = classified(files, repo, commit).where(_in_surface()).withColumnRenamed("directory", "surface")
    words = F.concat(expr.path_terms(F.col("file_path")), expr.path_terms(F.col("surface")))
    from_paths = members.select(*repo, "surface", commit, F.explode(words).alias("term"))
    from_messages = members.select(*repo, "surface", commit).distinct().join(messages, [*repo, commit]).select(*repo, "surface", commit, F.explode("message_terms").alias("term"))
    term = F.regexp_replace(F.lower("term"), "[^a-z0-9-]+", "")
    terms = from_paths.unionByName(from_messages).withColumn("term", term).where((F.length("term") >= 3) & ~F.col("term").rlike(r"^\d+$") & ~F.col("term").isin(rules.TERM_NOISE))
    counted = terms.groupBy(*repo, "surface", "term").agg(F.count_distinct(commit).alias("n"))
    commits = members.groupBy(*repo, "surface").agg(F.count_distinct(commit).alias("commits"))
    kept = counted.join(commits, [*repo, "surface"]).where(F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("commits") * F.lit(0.35))))
    return _top(kept, [*repo, "surface"], [F.col("n").desc(), F.col("term")], 6)


def role_counts(files: DataFrame, keys: list[str]) -> DataFrame:
    """Files per role, zero-filled, one column a role."""
    roles = [F.count_if(file_role(F.col("file_path")) == r).alias(r.replace("-", "_")) for r in rules.ROLE_NAMES]
    return files.groupBy(*keys).agg(*roles)


def artifact_share(files: DataFrame, keys: list[str]) -> DataFrame:
    from .classify import is_noisy

    return files.groupBy(*keys).agg(F.avg(is_noisy(F.col("file_path")).cast("double")).alias("artifact_share"))
