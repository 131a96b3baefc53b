"""Candidates: areas, confidences, categories, promotion, validation commands and drafts."""

from __future__ import annotations

from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from ..functions.ship import ship
from .signals import area_of_signal

#: Areas in the order that breaks ties (fixed values).
AREA_ORDER = ["cli", "frontend", "backend", "db", "infra", "tests", "docs", "mixed", "unknown"]
#: Thresholds of the two promotion levels (fixed values).
AGENT_READY = {"commits": 2, "pattern": 0.85, "naming": 0.80, "surface": 0.65, "surface_share": 0.65, "artifacts": 0.25, "quality": 0.75, "files": 1}
DRAFT = {"commits": 3, "pattern": 0.70, "naming": 0.65, "surface": 0.45, "surface_share": 0.45, "artifacts": 0.40, "quality": 0.50, "files": 3}
STRONG_SURFACE = 0.65
#: Preferred test commands by language family, in order (fixed values).
FAMILY_TESTS: list[tuple[str, str]] = [
    ("rust", r"^cargo test$"),
    ("node", r"^npm test$"),
    ("python", r"^(pytest|python -m unittest)$"),
    ("go", r"^go test \./\.\.\.$"),
    ("dotnet", r"^dotnet test$"),
    ("jvm", r"^(mvn test|gradle test|\./gradlew test)$"),
]
COMMAND_FAMILIES: list[tuple[str, str]] = [
    ("rust", r"^cargo( |$)"),
    ("node", r"^(npm|pnpm|yarn)( |$)"),
    ("python", r"^(pytest|python( |$))"),
    ("go", r"^go test( |$)"),
    ("dotnet", r"^dotnet( |$)"),
    ("jvm", r"^(mvn|gradle|\./gradlew)( |$)"),
    ("make", r"^make( |$)"),
]
EXTENSION_FAMILIES: list[tuple[str, list[str]]] = [
    ("rust", [".rs"]),
    ("node", [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]),
    ("python", [".py"]),
    ("go", [".go"]),
    ("dotnet", [".cs"]),
    ("jvm", [".java", ".kt"]),
]

_TESTS3 = ["unit_test_changed", "integration_test_changed", "test_case_added"]
_TESTS4 = ["unit_test_changed", "integration_test_changed", "e2e_test_changed", "test_case_added"]
_UI = ["ui_changed", "component_changed", "page_or_screen_changed"]
#: Categories in order: signals that must all be there, lists of which one must be, category, fallback name, base confidence (fixed values).
CATEGORIES: list[tuple[list[str], list[list[str]], str, str, float]] = [
    (["api_route_changed", "service_layer_changed"], [_TESTS4], "Backend API Feature", "Add or Update Backend API Feature", 0.82),
    (["api_route_changed"], [], "Backend API Feature", "Add or Update Backend API Feature", 0.78),
    (["migration_changed", "model_or_entity_changed"], [_TESTS3], "Database-Backed Feature", "Add or Update Database-Backed Feature", 0.82),
    (["schema_changed", "query_changed"], [], "Database Schema and Query Pattern", "Update Database Schema and Queries", 0.80),
    (["queue_or_event_handler_changed", "+async"], [], "Async Job/Event Handler", "Add or Update Async Job/Event Handler", 0.78),
    (["component_changed"], [["frontend_test_changed", "unit_test_changed", "test_case_added"]], "UI Component Pattern", "Add or Update UI Component Feature", 0.80),
    (["cli_command_changed"], [_TESTS3], "CLI Feature", "Add or Update CLI Feature", 0.78),
    (["cli_command_changed"], [], "CLI Feature", "Add or Update CLI Feature", 0.72),
    (["ci_changed", "config_changed"], [], "Build or CI Configuration Pattern", "Update Build or CI Configuration", 0.78),
    (["backend_changed"], [_UI], "Full-Stack Feature Pattern", "Update Full-Stack Feature Pattern", 0.68),
    (["backend_changed", "db_changed"], [_TESTS3], "Backend and Database Feature", "Update Backend and Database Feature", 0.68),
    (["backend_changed"], [_TESTS3], "Backend Pattern", "Update Backend and Test Pattern", 0.62),
    (["db_changed"], [], "Database Change Pattern", "Update Database Change Pattern", 0.58),
    ([], [_UI], "Frontend Change Pattern", "Update Frontend Change Pattern", 0.58),
    ([], [["config_changed", "package_or_dependency_changed", "docker_changed", "terraform_or_infra_changed", "deployment_changed"]], "Configuration or Infrastructure Pattern", "Update Configuration or Infrastructure Pattern", 0.56),
    (["docs_changed"], [], "Documentation Pattern", "Update Documentation Pattern", 0.54),
]
ASYNC_WORDS = r"(?i)(queue|event|job|worker|task|consumer|subscriber|listener|scheduler|async)"


def signal_weight(signal: Column, area: Column) -> Column:
    return F.when(area.isin("tests", "docs"), 1.0).when(signal == "cli_command_changed", 2.5).when(signal.isin("package_or_dependency_changed", "package_script_changed"), 1.5).otherwise(2.0)


def _area_place(area: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, AREA_ORDER)), area)


def commit_primary_areas(signals: DataFrame, areas: DataFrame, keys: list[str]) -> DataFrame:
    """Each commit's primary area from (keys, signal) and its files' area (keys, area): weights, ties below 2 are mixed."""
    weighed = signals.withColumn("a", area_of_signal(F.col("signal"))).where("a != 'unknown'").select(*keys, "a", signal_weight(F.col("signal"), F.col("a")).alias("w"))
    likely = areas.withColumn("a", F.when(F.col("area") == "config", "infra").otherwise(F.col("area"))).where("a not in ('mixed', 'unknown')").select(*keys, "a", F.lit(0.35).alias("w"))
    scores = weighed.unionByName(likely).groupBy(*keys, "a").agg(F.sum("w").alias("score"))
    per = Window.partitionBy(*keys)
    ranked = scores.withColumn("r", F.row_number().over(per.orderBy(F.col("score").desc(), _area_place(F.col("a"))))).withColumn("top", F.max("score").over(per)).withColumn("tied", F.sum((F.col("score") == F.col("top")).cast("int")).over(per))
    return ranked.where("r = 1").select(*keys, F.when((F.col("tied") > 1) & (F.col("score") < 2), "mixed").otherwise(F.col("a")).alias("primary_area"), "score")


def pattern_confidence(commits: Column, top_signal: Column, top_directory: Column, total: Column) -> Column:
    """Of a cluster: its size, and the commits with its most frequent signal and directory."""
    share = lambda n: F.when(commits > 0, n / commits).otherwise(0.0)
    frequency = F.when(total > 0, F.least(commits / total, F.lit(1.0))).otherwise(0.0)
    score = F.lit(0.28) + F.least(commits, F.lit(8)) * F.lit(0.055) + share(top_signal) * F.lit(0.18) + share(top_directory) * F.lit(0.12) + frequency * F.lit(0.12)
    return F.when(commits > 0, expr.to_fixed2(F.least(F.lit(0.97), score))).otherwise(0.0)


def category(signals: Column, has_async: Column, has_terms: Column, strength: Column, has_phrase: Column) -> Column:
    """struct(category, fallback, confidence): the first category whose signals are there."""
    has = lambda s: has_async if s == "+async" else F.array_contains(signals, s)
    out = F.struct(F.when(has_terms, "Repeated Engineering Pattern").otherwise("Full-Stack Feature Pattern").alias("category"), F.when(has_terms, "Update Repeated Engineering Pattern").otherwise("Update Full-Stack Feature Pattern").alias("fallback"), F.when(has_terms, 0.52).otherwise(0.42).alias("confidence"))
    for every, some, name, fallback, base in reversed(CATEGORIES):
        condition = F.lit(True)
        for s in every:
            condition = condition & has(s)
        for names in some:
            condition = condition & F.arrays_overlap(signals, F.array(*map(F.lit, names)))
        confidence = expr.to_fixed2(F.least(F.lit(0.97), F.lit(base) + F.when(has_phrase, F.least(F.lit(0.14), strength * F.lit(0.16))).otherwise(0.0)))
        out = F.when(condition, F.struct(F.lit(name).alias("category"), F.lit(fallback).alias("fallback"), confidence.alias("confidence"))).otherwise(out)
    return out


def naming_confidence(raw: Column, commits: Column, aligned: Column, surface: Column, surface_terms: Column, artifacts: Column, uses_terms: Column) -> Column:
    """Raised on a strong surface, capped for few commits, many artifacts and unused domain terms. surface: its confidence or null."""
    strong = F.coalesce(surface >= STRONG_SURFACE, F.lit(False))
    floor = F.lit(0.56) + surface * F.lit(0.22) + F.least(F.lit(0.12), surface_terms * F.lit(0.04))
    c = F.when(strong, F.least(F.lit(0.96), F.greatest(raw + F.lit(0.08), floor))).otherwise(raw)
    c = F.when((commits <= 3) & ~aligned, F.least(c, F.lit(0.75))).otherwise(c)
    c = F.when((artifacts > AGENT_READY["artifacts"]) & ~strong, F.least(c, F.lit(0.7))).otherwise(c)
    return expr.to_fixed2(F.when(~uses_terms, F.least(c, F.lit(0.72))).otherwise(c))


def _percent(x: Column) -> Column:
    return F.floor(x * 100 + F.lit(0.5)).cast("string")


def failures(c: dict[str, Column], least: dict[str, float]) -> Column:
    """The reasons, in order, for which a candidate misses a level."""
    checks = [
        (c["commits"] < least["commits"], F.concat(F.lit("Only "), c["commits"].cast("string"), F.lit(" evidence commits were found."))),
        (c["pattern"] < least["pattern"], F.concat(F.lit("Pattern confidence "), _percent(c["pattern"]), F.lit("% is below threshold."))),
        (c["naming"] < least["naming"], F.concat(F.lit("Naming confidence "), _percent(c["naming"]), F.lit("% is below threshold."))),
        (c["surface"] < least["surface"], F.concat(F.lit("Learned surface confidence "), _percent(c["surface"]), F.lit("% is below threshold."))),
        (c["surface_share"] < least["surface_share"], F.concat(F.lit("Only "), _percent(c["surface_share"]), F.lit("% of evidence commits match one learned implementation surface."))),
        (c["artifacts"] > least["artifacts"], F.concat(F.lit("Generated artifact evidence share "), _percent(c["artifacts"]), F.lit("% is above threshold."))),
        ((c["quality"] < least["quality"]) | ~c["has_workflow"], F.concat(F.lit("Workflow quality "), _percent(c["quality"]), F.lit("% is below threshold."))),
        (c["files"] < least["files"], F.concat(F.lit("Only "), c["files"].cast("string"), F.lit(" representative source/test files were found."))),
        (c["junk_name"], F.lit("The proposed name contains noisy or over-broad terms.")),
        (~c["task_evidence"], F.lit("No source file matching the proposed task type was found.")),
        (~c["tested"], F.lit("No matching test or validation signal was found.")),
    ]
    return F.filter(F.array(*(F.when(cond, text) for cond, text in checks)), lambda x: x.isNotNull())


def promotion(c: dict[str, Column], has_surface: Column) -> Column:
    """struct(level, reasons).  A strong surface caps the artifact share at 0.2."""
    strong = has_surface & (c["surface"] >= STRONG_SURFACE) & (c["surface_share"] >= STRONG_SURFACE)
    capped = c | {"artifacts": F.when(strong, F.least(c["artifacts"], F.lit(0.2))).otherwise(c["artifacts"])}
    ready, draft = failures(capped, AGENT_READY), failures(capped, DRAFT)
    result = lambda level, reasons: F.struct(F.lit(level).alias("level"), reasons.alias("reasons"))
    return F.when(has_surface & (F.size(ready) == 0), result("agent_ready", F.array(F.lit("Promoted to agent-ready skill.")))).when(
        has_surface & (F.size(draft) == 0), result("draft", F.when(F.size(ready) > 0, ready).otherwise(F.array(F.lit("Needs human review before becoming trusted guidance."))))
    ).otherwise(result("pattern_candidate", draft))


def profile_quality(repeated: Column, sources: Column, tests: Column, commands: Column, steps: Column, fallback: Column, commits: Column, artifacts: Column) -> Column:
    """Workflow quality from counts of repeated, source and test actions, commands and core steps."""
    score = F.when(repeated >= 3, 0.25).when(repeated >= 2, 0.18).when(repeated >= 1, 0.1).otherwise(0.0)
    score = score + F.when(sources > 0, 0.2).otherwise(0.0) + F.when(tests > 0, 0.2).otherwise(0.0) + F.when(commands > 0, 0.15).otherwise(0.0)
    score = score + F.when((steps >= 3) & ~fallback, 0.15).when((steps > 0) & ~fallback, 0.08).otherwise(0.0) + F.when(commits >= 3, 0.05).otherwise(0.0)
    score = score - F.when(fallback, 0.2).otherwise(0.0) - F.when(artifacts > 0.35, 0.15).otherwise(0.0)
    return expr.to_fixed2(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def family_candidate(confidence: Column, files: Column, quality: Column) -> Column:
    """struct(level, pattern, naming) of a pattern family, null when it is too weak."""
    level = F.when((confidence >= 0.9) & (quality >= 0.75), "agent_ready").otherwise("draft")
    pattern = expr.to_fixed2(F.least(F.lit(0.98), confidence + F.when(files >= 4, 0.03).otherwise(0.0)))
    naming = expr.to_fixed2(F.least(F.lit(0.96), confidence + F.lit(0.04)))
    return F.when((files >= 3) & (confidence >= 0.68), F.struct(level.alias("level"), pattern.alias("pattern"), naming.alias("naming")))


def scope_commands(commands: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(key, command, primary): commands of the languages that a key's files are in, ranked.

    make targets count with any language; keys without a language keep all but python
    commands; if nothing fits, make targets are left.
    """
    families = [F.when(F.array_contains(F.collect_set("extension"), ext), F.lit(name)) for name, exts in EXTENSION_FAMILIES for ext in exts]
    known = files.groupBy(key).agg(F.array_distinct(F.filter(F.array(*families), lambda x: x.isNotNull())).alias("families"))
    family = expr.first_match(F.col("command"), COMMAND_FAMILIES, "unknown")
    c = commands.distinct().join(known, key, "left").withColumn("families", F.coalesce("families", F.array().cast("array<string>"))).withColumn("family", family)
    none = F.size("families") == 0
    fits = F.when(F.col("family") == "make", ~none).when(none, F.col("family") != "python").otherwise(F.array_contains("families", F.col("family")))
    c = c.withColumn("fits", fits).withColumn("any_fits", F.max(F.col("fits").cast("int")).over(Window.partitionBy(key)) == 1)
    c = c.where(F.col("fits") | (~F.col("any_fits") & (F.col("family") == "make")))
    is_test = F.col("command").rlike(r"(^|[^A-Za-z0-9_])test([^A-Za-z0-9_]|$)|pytest|unittest")
    preferred = F.lit(False)
    first = F.lit(None).cast("boolean")
    for name, pattern in reversed(FAMILY_TESTS):
        first = F.when(F.array_contains("families", name), F.col("command").rlike(pattern)).otherwise(first)
        preferred = preferred | (F.array_contains("families", name) & F.col("command").rlike(pattern))
    rank = F.when(preferred, 0).when(F.col("command") == "make test", 2).when(F.col("command") == "make build", 3).when(is_test, 4).when(F.col("command").rlike("build|typecheck|lint"), 5).otherwise(9)
    c = c.withColumn("order", rank).withColumn("is_primary", F.coalesce(first, is_test))
    per = Window.partitionBy(key)
    c = c.withColumn("place", F.row_number().over(per.orderBy("order", "command"))).withColumn("any_primary", F.max(F.col("is_primary").cast("int")).over(per) == 1)
    return c.select(key, "command", F.col("place").cast("long").alias("place"), F.when(F.col("any_primary"), F.col("is_primary")).otherwise(F.col("place") == 1).alias("primary"))


class _Widening:
    """Rows in order, found by what they share: an inverted index of files and commits that grows with its rows."""

    def __init__(self, rows: list[dict]) -> None:
        self.rows: list[dict] = []
        self.sizes = {name: array("q") for name in _OVERLAPS}
        self.places: dict[str, defaultdict] = {name: defaultdict(lambda: array("q")) for name in _OVERLAPS}
        for row in rows:
            self.add(row)

    def add(self, row: dict) -> None:
        k = len(self.rows)
        self.rows.append(row | {name: set() for name in _OVERLAPS})
        for name in _OVERLAPS:
            self.sizes[name].append(0)
        self.widen(k, row)

    def widen(self, k: int, other: dict) -> None:
        for name in _OVERLAPS:
            own = self.rows[k][name]
            for value in other[name] - own:
                self.places[name][value].append(k)
            own |= other[name]
            self.sizes[name][k] = len(own)

    def first(self, row: dict) -> int | None:
        """The place of the first row that overlaps enough in files or commits."""
        best = None
        for name, least in _OVERLAPS.items():
            places = [np.frombuffer(self.places[name][v], np.int64) for v in row[name] if v in self.places[name]]
            if not places:
                continue
            shared = np.bincount(np.concatenate(places))
            del places  # their arrays grow later
            at = np.flatnonzero(shared)
            union = np.array(self.sizes[name], np.int64)[at] + len(row[name]) - shared[at]
            enough = at[shared[at] / union >= least]
            if len(enough) and (best is None or enough[0] < best):
                best = int(enough[0])
        return best


#: Least overlap of files, or of commits, that merges a draft (fixed values).
_OVERLAPS = {"files": 0.5, "commits": 0.4}


def fold_drafts(rows: list[dict]) -> list[tuple[str, str, str | None]]:
    """(id, fate, into) of each candidate: kept, suppressed or merged; merging widens what overlaps later.

    rows: id, name, level, pattern, naming, files, commits (sets), strongest first.
    """
    rows = sorted(rows, key=lambda r: (-r["pattern"], -r["naming"], r["name"], r["id"]))
    own_name = lambda r: r["name"].strip().lower()
    ready, kept = _Widening([r for r in rows if r["level"] == "agent_ready"]), _Widening([])
    ready_names, kept_names = {own_name(r) for r in ready.rows}, {}
    fates = [(r["id"], "kept", None) for r in rows if r["level"] != "draft"]
    for draft in (r for r in rows if r["level"] == "draft"):
        name = own_name(draft)
        if name in ready_names:
            fates.append((draft["id"], "suppressed", None))
            continue
        of, at = ready, ready.first(draft)
        if at is None:
            of, at = kept, kept_names[name] if name in kept_names else kept.first(draft)
        if at is None:
            kept_names[name] = len(kept.rows)
            kept.add(draft)
            fates.append((draft["id"], "kept", None))
        else:
            of.widen(at, draft)
            fates.append((draft["id"], "merged", of.rows[at]["id"]))
    return fates


def dedupe_drafts(candidates: DataFrame, repo: str) -> DataFrame:
    """(repo, id, fate, into) per repository, whose candidates pass one task."""

    def run(table: pa.Table) -> pa.Table:
        rows = [r | {"files": set(r["files"]), "commits": set(r["commits"])} for r in table.to_pylist()]
        fates = fold_drafts(rows)
        a, b, c = zip(*fates, strict=True)
        return pa.table({repo: pa.array([rows[0][repo]] * len(fates), table.schema.field(repo).type), "id": pa.array(a, pa.string()), "fate": pa.array(b, pa.string()), "into": pa.array(c, pa.string())})

    ship(candidates.sparkSession)
    return candidates.groupBy(repo).applyInArrow(run, f"{repo} {candidates.schema[repo].dataType.simpleString()}, id string, fate string, into string")


def unique_ids(candidates: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Repeated ids get -2, -3, ... in the given order."""
    n = F.row_number().over(Window.partitionBy(*keys, "id").orderBy(*order))
    return candidates.withColumn("id", F.when(n > 1, F.concat_ws("-", "id", n.cast("string"))).otherwise(F.col("id")))
