"""Python data sources ``git_log`` (commits with diffs) and ``source_tree`` (source files).

Both take ``path``: one or more repositories, separated by commas, which must be
reachable from the executors.  ``git_log`` cuts each history into ranges of commits,
one input partition each, so a long history is read by many tasks; the order of the
log is kept as ``ordinal`` (0: newest).
"""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import rules
from ..operators.sources import MAX_LENGTH

DEFAULT_LIMIT = 50
#: Directories that the walk does not enter, and extensions that it keeps (fixed values).
SKIPPED = {".git", ".histolode", "node_modules", "dist", "build", "coverage", "target", "out", ".next", ".nuxt", ".turbo", ".cache", "vendor"}
WALKED = {".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".java", ".kt", ".cs", ".go", ".rs", ".rb", ".php", ".swift", ".sql", ".vue"}
_REMOTE = re.compile(r"^git@[^:]+:.+$|^(https?|ssh|git|file)://.+", re.IGNORECASE)


def _git(args: list[str], cwd: str) -> str:
    """Standard output, or nothing when git fails."""
    done = subprocess.run(["git", *args], cwd=cwd, capture_output=True)
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else ""


@dataclass(frozen=True)
class RepositoryTarget:
    """Where a repository lies: its root, and whether it was cloned from an address."""

    given: str
    root: str
    remote: bool


def safe_name(url: str) -> str:
    text = re.sub(r"^[a-z]+://|^git@", "", url, flags=re.IGNORECASE)
    text = re.sub(r"\.git$", "", text, flags=re.IGNORECASE)
    host, *parts = [p for p in re.split(r"[/:]", text) if p]
    name = re.sub(r"[^a-z0-9]+", "-", "-".join([host, *parts[-2:]]).lower()).strip("-")[:80]
    return name or "remote-" + hashlib.sha1(url.encode()).hexdigest()[:8]


def prepare_repository(given: str | None = None, workspace: str | None = None) -> RepositoryTarget:
    """A local repository's root; an address is cloned once into the workspace and pulled later."""
    given = given or os.getcwd()
    remote = bool(_REMOTE.match(given))
    path = given
    if remote:
        path = os.path.join(workspace or os.path.join(os.getcwd(), ".histolode", "workspaces"), safe_name(given))
        command = ["pull", "--ff-only"] if os.path.isdir(path) else ["clone", given, path]
        os.makedirs(os.path.dirname(path), exist_ok=True)
        subprocess.run(["git", *command], cwd=path if command[0] == "pull" else os.getcwd(), check=True, capture_output=True)
    root = _git(["rev-parse", "--show-toplevel"], path).strip() if os.path.isdir(path) else ""
    if not root:
        raise ValueError(f"not a git repository: {path}")
    return RepositoryTarget(given, root, remote)


@dataclass
class CommitRange(InputPartition):
    root: str
    first: int
    hashes: list[tuple[str, str, str]]


class _LogReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.roots = [p.strip() for p in options["path"].split(",")]
        limit = int(options.get("limit", DEFAULT_LIMIT))
        self.limit, self.batch = limit if limit >= 1 else DEFAULT_LIMIT, int(options.get("batch", 200))

    def partitions(self) -> list[CommitRange]:
        ranges = []
        for root in self.roots:
            log = _git(["log", f"--max-count={self.limit}", "--date=iso-strict", "--pretty=format:%H%x1f%ad%x1f%s"], root)
            rows = [tuple(line.split("\x1f", 2)) for line in log.split("\n")]
            rows = [r for r in rows if len(r) == 3 and r[0] and r[1]]
            ranges += [CommitRange(root, at, rows[at : at + self.batch]) for at in range(0, len(rows), self.batch)]
        return ranges or [CommitRange("", 0, [])]

    def read(self, part: CommitRange) -> Iterator[tuple]:
        for k, (commit, date, message) in enumerate(part.hashes):
            diff = _git(["show", "--format=", "--unified=3", "--find-renames", commit], part.root)
            listing = "" if "diff --git " in diff else _git(["diff-tree", "--root", "--no-commit-id", "--name-only", "-r", commit], part.root)
            yield part.root, part.first + k, commit, date, message, diff, listing


class GitLog(DataSource):
    """Commits of git repositories, newest first, with their diffs."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "repo_id string, ordinal int, hash string, date string, message string, diff string, listing string"

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(self.options)


@dataclass
class Folder(InputPartition):
    root: str
    folder: str
    deep: bool


def _role(path: str) -> str:
    lower = path.lower()
    return next((name for name, pattern in rules.ROLES if re.search(pattern, lower)), "unknown")


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.roots = [p.strip() for p in options["path"].split(",")]
        self.limit = int(options.get("max_length", MAX_LENGTH))

    def partitions(self) -> list[Folder]:
        """One for the files of each root, one for each of its folders."""
        parts = []
        for root in self.roots:
            parts.append(Folder(root, "", False))
            parts += [Folder(root, d.name, True) for d in sorted(os.scandir(root), key=lambda e: e.name) if d.is_dir(follow_symlinks=False) and self._enters(d.name, d.name)]
        return parts

    @staticmethod
    def _enters(name: str, path: str) -> bool:
        return name.lower() not in SKIPPED and not any(re.search(p, path.lower()) for p in rules.GENERATED_PATTERNS)

    def read(self, part: Folder) -> Iterator[tuple]:
        for folder, names, files in os.walk(os.path.join(part.root, part.folder)):
            here = os.path.relpath(folder, part.root).replace(os.sep, "/")
            prefix = "" if here == "." else here + "/"
            names[:] = sorted(n for n in names if part.deep and self._enters(n, prefix + n))
            for name in sorted(files):
                path = prefix + name
                if Path(name).suffix.lower() in WALKED and _role(path) not in ("generated", "build-output", "fixture"):
                    try:
                        text = Path(part.root, path).read_text("utf-8", "replace")
                    except OSError:
                        continue
                    if len(text) <= self.limit:
                        yield part.root, path, text


class SourceTree(DataSource):
    """Source files below repositories, hidden ones included, artifacts left out."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "repo_id string, path string, text string"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


def register(spark: SparkSession) -> None:
    from ..functions.ship import ship

    ship(spark)
    spark.dataSource.register(GitLog)
    spark.dataSource.register(SourceTree)
