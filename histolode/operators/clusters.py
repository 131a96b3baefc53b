"""Commit clusters: an online fold over each repository's commits, newest first, and a merge of near-duplicates.

A commit joins the cluster it is most like; a cluster's leading signals change as it
grows, so order is part of the definition and the fold runs once per repository, with
counts as its only state.  Repositories run in parallel.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import rules
from ..functions.ship import ship

_PLACE = {s: i for i, s in enumerate(rules.SIGNAL_PRIORITY)}


class Cluster:
    def __init__(self) -> None:
        self.commits: list[str] = []
        self.signals, self.directories, self.surfaces = Counter(), Counter(), Counter()
        self._lead: list[str] | None = None

    def add(self, commit: dict, surfaces: Iterable[str]) -> None:
        self.commits.append(commit["hash"])
        self.signals.update(commit["shape"])
        self.directories.update(commit["directories"])
        self.surfaces.update(surfaces)
        self._lead = None

    def lead(self) -> list[str]:
        if self._lead is None:
            self._lead = [s for s, _ in sorted(self.signals.items(), key=lambda x: (-x[1], _PLACE.get(x[0], 998), x[0]))[:8]]
        return self._lead

    def top_surfaces(self, k: int) -> list[str]:
        return [s for s, _ in sorted(self.surfaces.items(), key=lambda x: (-x[1], x[0]))[:k]]

    def top_directories(self) -> set[str]:
        return {s for s, _ in sorted(self.directories.items(), key=lambda x: (-x[1], x[0]))[:3]}


def _overlap(a: Iterable[str], b: Iterable[str]) -> float:
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def fold(commits: list[dict]) -> list[Cluster]:
    """Clusters of commits (hash, shape, surfaces, directories) in the order given."""
    found: list[Cluster] = []
    members = {c["hash"]: c for c in commits}
    for commit in commits:
        if not commit["shape"] and not commit["surfaces"]:
            continue
        best, high = None, 0.0
        own = set(sorted(set(commit["directories"]))[:3])
        for cluster in found:
            score = _overlap(commit["shape"], cluster.lead())
            score += rules.CLUSTER_SURFACE_BONUS if any(s in cluster.surfaces for s in commit["surfaces"]) else 0.0
            score += rules.CLUSTER_DIRECTORY_BONUS if own & cluster.top_directories() else 0.0
            if score >= rules.CLUSTER_JOIN and (best is None or score > high):
                best, high = cluster, score
        if best is None:
            found.append(best := Cluster())
        best.add(commit, commit["surfaces"])
    merged: list[Cluster] = []
    for cluster in found:
        near = next((m for m in merged if _overlap(cluster.lead(), m.lead()) >= rules.CLUSTER_MERGE or _overlap(cluster.top_surfaces(4), m.top_surfaces(4)) >= rules.CLUSTER_MERGE), None)
        if near is None:
            merged.append(cluster)
            continue
        surfaces, known = cluster.top_surfaces(6), set(near.commits)
        for h in cluster.commits:
            if h not in known:
                near.add(members[h], surfaces)
    return merged


def cluster_commits(commits: DataFrame, repo: str, hash_type: str = "string") -> DataFrame:
    """(repo, hash, cluster, cluster_size) from (repo, ordinal, hash, shape, surfaces, directories); ordinal 0 is the newest."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["ordinal"])
        out = [(rows[0][repo], h, k, len(c.commits)) for k, c in enumerate(fold(rows)) for h in c.commits]
        names, kinds = [repo, "hash", "cluster", "cluster_size"], [table.schema.field(repo).type, table.schema.field("hash").type, pa.int64(), pa.int64()]
        columns = zip(*out, strict=True) if out else [()] * 4
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    ship(commits.sparkSession)
    kind = commits.schema[repo].dataType.simpleString()
    return commits.groupBy(repo).applyInArrow(run, f"{repo} {kind}, hash {hash_type}, cluster long, cluster_size long")
