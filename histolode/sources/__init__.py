"""Data sources over git repositories and source trees.

    spark.dataSource.register(GitLog)
    spark.read.format("git_log").option("path", "/repos/a").option("limit", "50").load()
"""

from .git import GitLog, RepositoryTarget, SourceTree, prepare_repository, register

__all__ = ["GitLog", "RepositoryTarget", "SourceTree", "prepare_repository", "register"]
