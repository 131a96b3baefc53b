"""Signals of paths, diffs and commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr, rules
from .classify import is_generated


def _none() -> Column:
    return F.array().cast("array<string>")


def _gated(lower: Column, gate: str, table: list[tuple[str, list[str]]]) -> Column:
    return F.when(lower.rlike(gate), expr.tags(lower, table)).otherwise(_none())


def test_docs_signals(path: Column) -> Column:
    lower = F.lower(path)
    both = lower.rlike(rules.FRONTEND_TEST[0]) & lower.rlike(rules.FRONTEND_TEST[1])
    frontend = F.when(both, F.array(F.lit("frontend_test_changed"))).otherwise(_none())
    return F.array_distinct(F.concat(expr.tags(lower, rules.TEST_DOCS_SIGNALS), frontend, expr.tags(lower, rules.DOCS_SIGNALS)))


def detector_signals(path: Column, detector: str) -> Column:
    """Signals of one detector: typescript, python, jvm, dotnet, sql, infra or test_docs."""
    lower = F.lower(path)
    if detector == "test_docs":
        return test_docs_signals(path)
    gated = {"python": (rules.PYTHON_GATE, rules.PYTHON_SIGNALS), "jvm": (rules.JVM_GATE, rules.JVM_SIGNALS), "dotnet": (rules.DOTNET_GATE, rules.DOTNET_SIGNALS)}
    if detector in gated:
        return _gated(lower, *gated[detector])
    return expr.tags(lower, {"typescript": rules.TYPESCRIPT_SIGNALS, "sql": rules.SQL_SIGNALS, "infra": rules.INFRA_SIGNALS}[detector])


DETECTORS = ["typescript", "python", "jvm", "dotnet", "sql", "infra", "test_docs"]


def path_signals(path: Column) -> Column:
    """All detectors' signals in order; artifacts only count as tests or docs."""
    return F.when(is_generated(path), test_docs_signals(path)).otherwise(F.array_distinct(F.concat(*(detector_signals(path, d) for d in DETECTORS))))


def files_with(files: DataFrame, columns: dict[str, Column], path: str = "file_path") -> DataFrame:
    """Columns that depend on the path alone, evaluated once for each distinct path."""
    known = files.select(path).distinct().select(path, *(c.alias(n) for n, c in columns.items()))
    return files.join(known, path)


def framework_hints(path: Column) -> Column:
    return expr.tags(F.lower(path), rules.FRAMEWORK_HINTS)


def enriched(kind: Column, value: Column, path: Column) -> Column:
    """Further signals that one diff signal implies."""
    v, p = F.lower(value), F.lower(path)
    one = lambda condition, *names: F.when(condition, F.array(*map(F.lit, names))).otherwise(_none())
    test = F.when(p.rlike("(e2e|playwright|cypress)"), F.lit("e2e_test_changed")).when(p.rlike("integration"), F.lit("integration_test_changed")).otherwise(F.lit("unit_test_changed"))
    return F.array_distinct(F.concat(
        expr.tags(v, rules.VALUE_SIGNALS), one(v.rlike(rules.MODEL_VALUE) | p.rlike(rules.MODEL_PATH), "db_changed", "model_or_entity_changed"), one(kind.isin("api_route_changed", "controller_changed"), "backend_changed"),
        one(kind.isin("schema_changed", "index_changed", "query_changed"), "db_changed"), F.when(kind == "test_case_added", F.array(test)).otherwise(_none()),
    ))


def shape(signals: Column, limit: int = 8) -> Column:
    """A commit's leading signals: code-only ones only if there are no others, by priority, then name."""
    domain = F.filter(signals, lambda s: ~s.isin(rules.CODE_ONLY_SIGNALS))
    source = F.array_distinct(F.when(F.size(domain) > 0, domain).otherwise(signals))
    places = F.create_map(*(x for i, s in enumerate(rules.SIGNAL_PRIORITY) for x in (F.lit(s), F.lit(i))))
    ordered = F.array_sort(F.transform(source, lambda s: F.struct(F.coalesce(places[s], F.lit(999)).alias("p"), s.alias("s"))))
    return F.slice(F.transform(ordered, lambda x: x["s"]), 1, limit)


def broad_areas(signals: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform(signals, lambda s: expr.tags(s, rules.BROAD_AREAS)))))


def area_of_signal(signal: Column) -> Column:
    """One area per signal, for weighing a commit's primary area."""
    return expr.first_match(signal, [
        ("cli", r"^cli_command"), ("frontend", r"^(ui|component|page_or_screen|route_view|style|frontend)"),
        ("backend", r"^(backend|api_route|controller|service_layer|repository_or_dao|middleware|auth|validation|serialization|background_job|queue_or_event)"),
        ("db", r"^(db|migration|schema|model_or_entity|seed_data|query|index)"), ("infra", r"^(config|env|package|ci|docker|terraform_or_infra|deployment)"),
        ("tests", r"(test|fixture)"), ("docs", r"^(docs|readme|adr_or_design_doc|changelog)"),
    ], "unknown")


def top_values(rows: DataFrame, keys: list[str], value: str, limit: int) -> DataFrame:
    """The most frequent values per key as an ordered array, ties by name."""
    counted = rows.where(F.coalesce(F.col(value) != "", F.lit(False))).groupBy(*keys, value).agg(F.count("*").alias("n"))
    gathered = counted.groupBy(*keys).agg(F.collect_list(F.struct("n", F.col(value).alias("name"))).alias("counts"))
    return gathered.select(*keys, expr.ranked(F.col("counts"), limit).alias("top"))


def commit_signals(files: DataFrame, diff_signals: DataFrame, messages: DataFrame, keys: list[str]) -> DataFrame:
    """One row per commit: path_signals, diff_signals, generic_signals, framework_hints, filename_terms, message_terms.

    files: keys, file_ord, file_path, in_diff; diff_signals: keys, sig_ord, type, value, file_path; messages: keys, message.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("file_ord", "file_path"))), lambda x: x["file_path"])
    per_file = files.groupBy(*keys).agg(ordered.alias("paths"), F.transform(F.array_sort(F.collect_list(F.when(F.col("in_diff"), F.struct("file_ord", "file_path")))), lambda x: x["file_path"]).alias("diff_paths"))
    per_signal = diff_signals.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("sig_ord", "type", "value", "file_path"))).alias("raw"))
    joined = messages.join(per_file, keys, "left").join(per_signal, keys, "left")
    empty = _none()
    paths, diff_paths = F.coalesce("paths", empty), F.coalesce("diff_paths", empty)
    raw = F.coalesce("raw", F.array().cast("array<struct<sig_ord:bigint,type:string,value:string,file_path:string>>"))
    from_paths = expr.present(F.array_distinct(F.flatten(F.transform(paths, path_signals))))
    from_diff = expr.present(F.array_distinct(F.concat(F.transform(raw, lambda s: s["type"]), F.flatten(F.transform(raw, lambda s: enriched(s["type"], s["value"], s["file_path"]))), F.flatten(F.transform(diff_paths, path_signals)))))
    keep = lambda terms: F.filter(terms, lambda t: ~t.isin(rules.STOP_TERMS))
    name_terms = keep(F.flatten(F.transform(paths, lambda p: expr.tokenize(expr.without_last_extension(expr.base_name(p))))))

    def top(terms: Column) -> Column:
        distinct = F.array_distinct(terms)
        return expr.ranked(F.transform(distinct, lambda t: F.struct(F.size(F.filter(terms, lambda x: x == t)).alias("n"), t.alias("name"))), 8)

    return joined.select(
        *keys, from_paths.alias("path_signals"), from_diff.alias("diff_signals"), F.array_distinct(F.concat(from_paths, from_diff)).alias("generic_signals"),
        F.array_distinct(F.flatten(F.transform(paths, framework_hints))).alias("framework_hints"), top(name_terms).alias("filename_terms"), top(keep(expr.tokenize(F.col("message")))).alias("message_terms"),
    )
