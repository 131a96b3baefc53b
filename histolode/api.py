"""The engine over repositories: scan, learn, mine, evaluate, report.

    scan = api.scan(spark, ["/repos/a", "/repos/b"], limit=200)
    scan.pairs.show(); scan.surfaces.show(); scan.clusters.show(); scan.families.show()
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import expr
from .operators import classify, clusters, cochange, diff, families, fingerprints, joins, lifecycle, mining, render, signals
from .functions.tables import Tables
from .sources import git, projects, store


@dataclass
class Scan:
    """What a scan finds, each a table keyed by repo_id."""

    commits: DataFrame
    files: DataFrame
    diff_signals: DataFrame
    patterns: DataFrame
    file_frequency: DataFrame
    directory_frequency: DataFrame
    pairs: DataFrame
    surfaces: DataFrame
    fingerprints: DataFrame
    families: DataFrame
    clusters: DataFrame
    candidates: DataFrame


def scan(spark: SparkSession, repositories: list[str], limit: int = git.DEFAULT_LIMIT) -> Scan:
    """Reads histories and source trees and learns from them; stages are kept as tables in the shared folder."""
    git.register(spark)
    tables = Tables(spark, "scan")
    paths = ",".join(repositories)
    log = tables.keep(spark.read.format("git_log").option("path", paths).option("limit", limit).load(), "log")
    keys = ["repo_id", "hash"]
    in_diff = tables.keep(diff.with_features(diff.split_files(log, keys)), "diffs")
    listed = log.select(*keys, F.posexplode(expr.present(F.transform(F.split("listing", "\n"), lambda x: F.trim(x)))).alias("file_ord", "file_path"))
    files = in_diff.select(*keys, F.col("file_ord").cast("int").alias("file_ord"), "file_path", F.lit(True).alias("in_diff")).unionByName(listed.select(*keys, "file_ord", "file_path", F.lit(False).alias("in_diff")))
    files = tables.keep(files, "files")
    found = tables.keep(diff.diff_signals(in_diff, keys), "signals")
    summary = signals.commit_signals(files, found, log.select(*keys, "message"), keys)
    areas = classify.commit_areas(files, keys)
    commits = tables.keep(log.drop("diff", "listing").join(summary, keys).join(areas, keys, "left").withColumn("short_hash", F.substring("hash", 1, 7)), "commits")
    pairs = tables.keep(cochange.cochange_pairs(files, ["repo_id"], "hash"), "pairs")
    offered = spark.createDataFrame([(root, projects.validation_commands(root)) for root in repositories], "repo_id string, commands array<string>")
    touched = cochange.directory_frequency(files, ["repo_id"], "hash", keep=None).select("repo_id", F.col("directory").alias("surface"))
    counted = touched.join(offered, "repo_id").select("repo_id", "surface", F.size("commands").alias("n_commands"))
    surfaces = tables.keep(cochange.learn_surfaces(files, ["repo_id"], "hash", pairs, counted), "surfaces")
    sources = spark.read.format("source_tree").option("path", paths).load()
    prints = fingerprints.eligible(tables.keep(fingerprints.fingerprint(sources).drop("text"), "fingerprints"))
    best = tables.keep(families.best_earlier(prints, ["repo_id"]), "best")
    grouped = families.families(best, ["repo_id"])
    summaries = tables.keep(families.summarise(prints, grouped, best, ["repo_id"]), "families")
    clustered = tables.keep(_clusters(commits, files, surfaces), "clusters")
    mined = mining.mine(commits, files, in_diff, found, surfaces, mining.surface_words(files, commits), clustered, offered)
    mined = tables.keep(mining.without_repeats(tables.keep(mined, "mined")), "candidates")
    return Scan(
        commits, files, found, classify.repeated_path_patterns(files, ["repo_id"], "hash"), cochange.file_frequency(files, ["repo_id"], "hash"), cochange.directory_frequency(files, ["repo_id"], "hash"),
        pairs, surfaces, prints, summaries, clustered, mined,
    )


def _clusters(commits: DataFrame, files: DataFrame, surfaces: DataFrame) -> DataFrame:
    keys = ["repo_id", "hash"]
    touched = joins.commits_of_directories(files, surfaces, ["repo_id"], "hash").groupBy(*keys).agg(F.array_sort(F.collect_set("surface")).alias("surfaces"))
    directories = files.groupBy(*keys).agg(F.array_sort(F.collect_set(expr.directory_of(F.col("file_path")))).alias("directories"))
    none = F.array().cast("array<string>")
    rows = commits.join(touched, keys, "left").join(directories, keys, "left")
    return clusters.cluster_commits(rows.select("repo_id", "ordinal", "hash", signals.shape(F.col("generic_signals")).alias("shape"), F.coalesce("surfaces", none).alias("surfaces"), F.coalesce("directories", none).alias("directories")), "repo_id")


def explain(scanned: Scan, wanted: str) -> str:
    """Why the candidate of an id or name is what it is."""
    rows = scanned.candidates.where((F.col("id") == wanted) | (expr.slug(F.col("name")) == wanted)).limit(1).collect()
    known = [] if rows else [r["id"] for r in scanned.candidates.select("id").orderBy("id").toLocalIterator()]
    return render.explanation(rows[0].asDict(True) if rows else None, wanted, known)


def generate(scanned: Scan, root: str) -> dict[str, int]:
    """Writes the skill, draft and pattern documents of one scanned repository, its registry rows and guidance index."""
    own = scanned.candidates.where(F.col("repo_id") == root)
    head = scanned.commits.where((F.col("repo_id") == root) & (F.col("ordinal") == 0)).select("hash").first()
    documents = (r.asDict() for r in render.documents(own).toLocalIterator())
    return store.Store(root).generate(documents, (_registry_row(r.asDict(True), head[0] if head else "unknown") for r in own.toLocalIterator()), {"Commits analyzed": scanned.commits.where(F.col("repo_id") == root).count(), "Repeated path patterns": scanned.patterns.where(F.col("repo_id") == root).count(), "Generated at": store.now()})


def _registry_row(c: dict, head: str) -> dict:
    draft = c["promotion_level"] == "draft"
    return {
        "skill_id": c["id"], "name": c["name"], "task_description": c["description"], "generated_from_head": head, "evidence_commits": [{"hash": h, "line": x} for h, x in list(zip(c["evidence"], c["evidence_lines"], strict=True))[:20]],
        "generic_signals": c["signals"], "common_directories": c["directories"], "dominant_terms": c["terms"], "validation_commands": c["commands"], "pattern_confidence": c["pattern_confidence"], "naming_confidence": c["naming_confidence"],
        "workflow_quality": c["workflow_quality"], "promotion_level": c["promotion_level"], "status": "draft" if draft else "fresh", "managed_by": "engine", "human_approved": False, "drift_reasons": [], "surface": c["surface"],
    }


def evaluated(spark: SparkSession, scanned: Scan, root: str) -> dict[str, dict]:
    """By skill id: the status, drift reasons and command warnings that the commits since its head give."""
    rows = store.registry(spark, [root]).where("promotion_level != 'draft'")
    registry = rows.select("repo_id", "skill_id", "status", F.col("generated_from_head").alias("head"), F.col("generic_signals").alias("own_signals"), F.col("common_directories").alias("own_directories"), F.col("dominant_terms").alias("own_words"), "validation_commands")
    keys = ["repo_id", "hash"]
    directories = scanned.files.where(F.col("repo_id") == root).groupBy(*keys).agg(F.array_sort(F.collect_set(expr.directory_of(F.col("file_path")))).alias("directories"))
    none = F.array().cast("array<string>")
    commits = scanned.commits.join(directories, keys, "left").select("repo_id", "hash", "ordinal", F.col("generic_signals").alias("signals"), F.coalesce("directories", none).alias("directories"), F.col("message_terms").alias("words"))
    found = lifecycle.evaluate(registry.drop("validation_commands"), commits, "repo_id").collect()  # a row per skill of one repository
    offered, asked = projects.validation_commands(root), {r["skill_id"]: r["validation_commands"] or [] for r in registry.select("skill_id", "validation_commands").collect()}
    head = scanned.commits.where((F.col("repo_id") == root) & (F.col("ordinal") == 0)).select("hash").first()
    out = {}
    for r in found:
        gone = sorted(set(asked[r["skill_id"]]) ^ set(offered)) if asked[r["skill_id"]] else []
        status = "drifting" if gone and r["status"] in ("fresh", "stale") else r["status"]
        out[r["skill_id"]] = {"status": status, "drift_reasons": list(r["drift_reasons"]), "validation_warnings": [f"Validation commands changed: {', '.join(gone)}."] * bool(gone)}
        if r["supporting"] and head:
            out[r["skill_id"]]["generated_from_head"] = head[0]
    return out


def refresh(spark: SparkSession, scanned: Scan, root: str) -> str:
    """Evaluates the repository's skills, writes what has changed and returns the life-cycle report."""
    rows = store.Store(root).refresh(evaluated(spark, scanned, root))
    store.apply(root, existing_only=True)
    return render.lifecycle_report(_head(scanned, root), rows)


def validate(spark: SparkSession, scanned: Scan, root: str) -> str:
    """The same report without writing anything."""
    changes = evaluated(spark, scanned, root)
    return render.lifecycle_report(_head(scanned, root), [r | changes.get(r["skill_id"], {}) for r in store.Store(root).rows("skills")])


def _head(scanned: Scan, root: str) -> str:
    row = scanned.commits.where((F.col("repo_id") == root) & (F.col("ordinal") == 0)).select("hash").first()
    return row[0] if row else "unknown"


def cache(scanned: Scan, root: str) -> str:
    """Writes the stages of a scan as JSON lines, and the report, to the repository's cache folder."""
    stages = {f.name: getattr(scanned, f.name) for f in fields(scanned) if f.name in ("commits", "patterns", "pairs", "surfaces", "fingerprints", "families", "candidates")}
    return store.cache(stages, root, {"report.txt": report(scanned)})


def report(scanned: Scan) -> str:
    """A short text: counts by level, the repeated work in tokens, and the strongest patterns."""
    levels = {r[0]: (r[1], r[2]) for r in scanned.candidates.groupBy("promotion_level").agg(F.count("*"), F.sum(F.greatest(F.size("evidence") - 1, F.lit(0)))).collect()}
    repeated = sum(n or 0 for _, n in levels.values())
    tops = scanned.patterns.orderBy(F.col("n").desc(), "pattern").limit(8).collect()
    lines = [f"Commits analyzed: {scanned.commits.count()}"]
    lines += [f"{title}: {levels.get(level, (0, 0))[0]}" for level, title in (("agent_ready", "Agent-ready skills"), ("draft", "Draft skills"), ("pattern_candidate", "Pattern candidates"))]
    lines += [f"Pattern families: {scanned.families.count()}", f"Repeated occurrences: {repeated} (about {repeated * 1200} tokens)", "", "Top repeated patterns:"]
    return "\n".join(lines + [f"- {r['pattern']}: {r['n']} commits" for r in tops] or ["- None"])


def commands_of(root: str) -> list[str]:
    return projects.validation_commands(root)


__all__ = ["Scan", "cache", "commands_of", "explain", "generate", "refresh", "report", "scan", "validate"]
