"""Joins of files, directories, commits and clusters.

Prefix conditions become equality: a path is exploded into its ancestors, which are
few, and hash-joined, so no nested loop is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from .classify import is_noisy


def ancestors(path: Column, own: bool = True) -> Column:
    """The directories above a path, shortest first, and the path itself."""
    parts = F.split(path, "/")
    last = F.size(parts) if own else F.size(parts) - 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def commits_of_directories(files: DataFrame, directories: DataFrame, repo: list[str], commit: str, name: str = "surface") -> DataFrame:
    """Distinct (repo, commit, directory) where a file is the directory or lies under it."""
    above = files.select(*repo, commit, F.explode(ancestors(expr.normalize_path(F.col("file_path")))).alias(name)).distinct()
    return above.join(directories.select(*repo, name), [*repo, name], "left_semi")


def evidence_split(files: DataFrame, directories: DataFrame, repo: list[str], commit: str) -> DataFrame:
    """Per surface: commits with a direct file that is no noise, and the other commits of the repository."""
    useful = files.where(~is_noisy(F.col("file_path")))
    direct = commits_of_directories(useful, directories, repo, commit).groupBy(*repo, "surface").agg(F.count_distinct(commit).alias("direct_commits"))
    totals = files.groupBy(*repo).agg(F.count_distinct(commit).alias("total"))
    joined = directories.join(totals, repo).join(direct, [*repo, "surface"], "left")
    count = F.coalesce("direct_commits", F.lit(0))
    return joined.select(*repo, "surface", count.alias("direct_commits"), (F.col("total") - count).alias("rejected_commits"))


def overlaps(members: DataFrame, cluster: str, member: str, least: float) -> DataFrame:
    """Pairs of clusters whose member sets have a Jaccard similarity of at least ``least``.

    Members are the inverted index.  Clusters are cut to those that can reach the
    threshold by the prefix rule: in order of rarity, similar sets share one of their
    first n - ceil(least * n) + 1 members.
    """
    m = members.select(F.col(cluster).alias("c"), F.col(member).alias("m")).distinct()
    rare = m.groupBy("m").agg(F.count("*").alias("df"))
    sized = m.join(rare, "m").withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy("df", "m"))).withColumn("n", F.count("*").over(Window.partitionBy("c")))
    head = F.col("n") - F.ceil(F.col("n") * least) + 1
    heads = sized.where(F.col("r") <= head).select("c", "m", "n", (F.col("n") - head).alias("rest"))
    left, right = (heads.select(F.col("c").alias(x), "m", F.col("n").alias("n" + x), F.col("rest").alias("r" + x)) for x in "ab")
    # what a pair shares besides is behind the head that ends first, in the common order
    met = left.join(right, "m").where("a < b").groupBy("a", "b", "na", "nb", "ra", "rb").agg(F.count("*").alias("s"))
    most = F.least(F.col("s") + F.greatest("ra", "rb"), "na", "nb")
    pairs = met.where(most >= F.lit(least) * (F.col("na") + F.col("nb") - most) - 1e-9).select("a", "b", "na", "nb")
    shared = pairs.join(m.select(F.col("c").alias("a"), "m"), "a").join(m.select(F.col("c").alias("b"), "m"), ["b", "m"]).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    overlap = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    return shared.withColumn("overlap", overlap).where(F.col("overlap") >= least).select("a", "b", "shared", "overlap")


def commits_of_files(files: DataFrame, listed: DataFrame, repo: list[str], commit: str) -> DataFrame:
    """Distinct commits of each repository that change one of the listed files: repo, commit."""
    return files.join(listed.select(*repo, "file_path").distinct(), [*repo, "file_path"], "left_semi").select(*repo, commit).distinct()


def ranked_roots(files: DataFrame, roots: DataFrame, repo: list[str], keep: int) -> DataFrame:
    """The deepest root above each distinct file, counted; the roots with most files."""
    f = files.select(*repo, expr.normalize_path(F.col("file_path")).alias("p")).distinct()
    above = f.select(*repo, "p", F.explode(ancestors(F.col("p"), own=False)).alias("root")).join(roots, [*repo, "root"])
    nearest = above.groupBy(*repo, "p").agg(F.max_by("root", F.length("root")).alias("root"))
    counted = nearest.groupBy(*repo, "root").agg(F.count("*").alias("files"))
    rank = F.row_number().over(Window.partitionBy(*repo).orderBy(F.col("files").desc(), "root"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= keep)


def since(ordered: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    """Marks the rows that are newer than their key's head; all of them where there is none."""
    return ordered.join(heads, keys, "left").withColumn("newer", F.col("ordinal") < F.coalesce("head", F.lit(1_000_000_000)))


def partner_files(surfaces: DataFrame, edges: DataFrame, repo: list[str]) -> DataFrame:
    """(repo, surface, file_path): ends of the co-change edges that touch a surface's representative files.

    surfaces: repo, surface, representative_files; edges: repo, file_a, file_b.
    """
    own = surfaces.select(*repo, "surface", F.explode("representative_files").alias("file_path"))
    ends = edges.select(*repo, "file_a", "file_b", F.explode(F.array("file_a", "file_b")).alias("file_path"))
    touching = own.join(ends, [*repo, "file_path"]).select(*repo, "surface", "file_a", "file_b").distinct()
    return touching.select(*repo, "surface", F.explode(F.array("file_a", "file_b")).alias("file_path")).distinct()


def supporting_files(surfaces: DataFrame, files: DataFrame, repo: list[str]) -> DataFrame:
    """(repo, surface, file_path): changed files among a surface's tests or configs that are no noise."""
    listed = surfaces.select(*repo, "surface", F.explode(F.concat("test_files", "config_or_docs_files")).alias("file_path"))
    useful = files.where(~is_noisy(F.col("file_path"))).select(*repo, "file_path").distinct()
    return listed.join(useful, [*repo, "file_path"], "left_semi").select(*repo, "surface", "file_path").distinct()


def ranked_files(files: DataFrame, keys: list[str], keep: int = 8) -> DataFrame:
    """Files of a surface: direct ones first, then tests that support it, other support, the rest; by count, then name.

    files: keys, file_path, direct, supports, is_test, n.
    """
    kind = F.when(F.col("direct"), 0).when(F.col("supports") & F.col("is_test"), 1).when(F.col("supports"), 2).otherwise(9)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(kind, F.col("n").desc(), "file_path"))
    return files.withColumn("rank", rank).where(F.col("rank") <= keep)


def ordered_evidence(commits: DataFrame, keys: list[str], leading: str) -> DataFrame:
    """Evidence commits by the number of leading signals they show, a hundredth for each diff signal, then as they came.

    commits: keys, ordinal, signals (array), n_diff_signals, and the cluster's leading signals.
    """
    score = F.size(F.array_intersect("signals", F.col(leading))) + F.col("n_diff_signals") * F.lit(0.01)
    return commits.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(score.desc(), "ordinal")))
