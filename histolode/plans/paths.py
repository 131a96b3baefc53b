"""Queries over paths: classification and signals, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr, rules
from ..operators import classify, signals
from .bindings import COMMIT_FILE, PATHS, bind, plain, sql_directory, sql_first_match, sql_match, sql_normal, sql_tags, sql_text

QUERIES, ORACLES = {}, {}


def _text(tags: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(tags)), ",")


def _add(name: str, columns: dict[str, tuple[Callable[[], Column], str]]) -> None:
    """A projection over all paths: each column as a function that makes it and as SQL over file_path."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return bind(spark, sf_dir, PATHS).select("file_path", *(make().alias(n) for n, (make, _) in columns.items()))

    QUERIES[name] = run
    ORACLES[name] = f"select file_path, {', '.join(f'{sql} as {n}' for n, (_, sql) in columns.items())} from ({plain(PATHS)})"




def P() -> Column:
    return F.col("file_path")


N = sql_normal("file_path")
L, LN = "lower(file_path)", f"lower({N})"
BASE = f"lower(regexp_extract({N}, '([^/]*)$', 1))"

AREA = sql_first_match(LN, [(a, "|".join(p)) for a, p in rules.AREAS], "unknown")
ROLE = sql_first_match(LN, rules.ROLES, "unknown")
GENERATED = "(" + " or ".join(sql_match(LN, p) for p in rules.GENERATED_PATTERNS) + ")"
NOISY = f"({ROLE} in ({', '.join(repr(r) for r in rules.NOISY_ROLES)}) or " + " or ".join(sql_match(L, p) for p in rules.NOISY_EVIDENCE_PATTERNS) + ")"
EXTENSION = f"case when {BASE} = '.env' or starts_with({BASE}, '.env.') then '.env' else regexp_extract({BASE}, '^.*[^.]+?(\\.[^.]*)$', 1) end"


def sql_path_patterns() -> str:
    parts = f"list_filter(string_split({N}, '/'), lambda x: x <> '')"
    globs = f"list_transform(range(1, least(3, len({parts})) + 1), lambda n: array_to_string(({parts})[1:n], '/') || '/**')"
    return f"flatten([{globs}, {sql_tags(LN, [(p, [n]) for n, p in rules.NAMED_PATTERNS])}])"


def sql_detector(name: str) -> str:
    tables = {"typescript": rules.TYPESCRIPT_SIGNALS, "sql": rules.SQL_SIGNALS, "infra": rules.INFRA_SIGNALS}
    gated = {"python": (rules.PYTHON_GATE, rules.PYTHON_SIGNALS), "jvm": (rules.JVM_GATE, rules.JVM_SIGNALS), "dotnet": (rules.DOTNET_GATE, rules.DOTNET_SIGNALS)}
    if name in gated:
        gate, table = gated[name]
        return f"case when {sql_match(L, gate)} then {sql_tags(L, table)} else [] end"
    if name == "test_docs":
        both = " and ".join(sql_match(L, p) for p in rules.FRONTEND_TEST)
        return f"flatten([{sql_tags(L, rules.TEST_DOCS_SIGNALS)}, case when {both} then ['frontend_test_changed'] else [] end, {sql_tags(L, rules.DOCS_SIGNALS)}])"
    return sql_tags(L, tables[name])


PATH_SIGNALS = f"case when {GENERATED} then {sql_detector('test_docs')} else flatten([{', '.join(sql_detector(d) for d in signals.DETECTORS)}]) end"

_add("c2_file_extension", {"extension": (lambda: classify.file_extension(P()), EXTENSION)})
_add("c3_file_area", {"area": (lambda: classify.file_area(P()), AREA)})
_add("c5_path_patterns", {"patterns": (lambda: _text(classify.path_patterns(P())), sql_text(sql_path_patterns()))})
_add("c6_directory", {"normal": (lambda: expr.normalize_path(P()), N), "directory": (lambda: expr.directory_of(P()), sql_directory(N))})
_add("c7_file_role", {"role": (lambda: classify.file_role(P()), ROLE)})
_add("c8_generated", {"generated": (lambda: classify.is_generated(P()), GENERATED)})
_add("c9_noisy_evidence", {"noisy": (lambda: classify.is_noisy(P()), NOISY)})
for _k, _d in enumerate(signals.DETECTORS, 1):
    _add(f"g{_k}_{_d}_signals", {"signals": (lambda d=_d: _text(signals.detector_signals(P(), d)), sql_text(sql_detector(_d)))})
_add("g8_path_signals", {"signals": (lambda: _text(signals.path_signals(P())), sql_text(PATH_SIGNALS)), "hints": (lambda: _text(signals.framework_hints(P())), sql_text(sql_tags(L, rules.FRAMEWORK_HINTS)))})

_KINDS = {
    "ui": r"(^|/)(components?|pages?|screens?|views?|ui|web|frontend)(/|$)|\.(tsx|jsx|vue)$",
    "cli": r"(^|/)(commands?|cmd|cli)(/|$)",
    "api": r"(^|/)(controllers?|routes?|handlers?)(/|$)",
    "service": r"(^|/)(services?)(/|$)",
    "repository": r"(^|/)(repositories?|dao)(/|$)",
    "database": r"(^|/)(migrations?|schema|models?|entities?)(/|$)|\.(sql|prisma)$",
}
_add("c10_source_kinds", {k: (lambda p=p: F.lower(P()).rlike(p), sql_match(L, p)) for k, p in _KINDS.items()})


# -- per commit ---------------------------------------------------------------------

#: Files with their place inside the commit.
ORDERED = f"select *, row_number() over (partition by repo_id, commit_id order by file_path) as file_ord from ({COMMIT_FILE})"


def c4_commit_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.commit_areas(bind(spark, sf_dir, ORDERED), ["repo_id", "commit_id"])


QUERIES["c4_commit_area"] = c4_commit_area
ORACLES["c4_commit_area"] = f"""
with f as (select *, {AREA} as a from ({plain(ORDERED)})),
c as (select repo_id, commit_id, a, count(*) as n, min(file_ord) as first from f group by all),
r as (select *, row_number() over (partition by repo_id, commit_id order by n desc, first) as rank,
        sum(n) over (partition by repo_id, commit_id) as total, count(*) over (partition by repo_id, commit_id) as areas from c)
select repo_id, commit_id, case when areas > 1 and (a = 'unknown' or n / total < 0.6) then 'mixed' else a end as area from r where rank = 1
"""


def a1_repeated_path_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify.repeated_path_patterns(bind(spark, sf_dir, COMMIT_FILE), ["repo_id"], "commit_id")
    return found.select("repo_id", "pattern", "n", F.element_at("commits", 1).alias("first_commit"), F.element_at("commits", -1).alias("last_commit"))


QUERIES["a1_repeated_path_patterns"] = a1_repeated_path_patterns
ORACLES["a1_repeated_path_patterns"] = f"""
with f as (select distinct repo_id, commit_id, unnest({sql_path_patterns()}) as pattern from ({plain(COMMIT_FILE)}))
select repo_id, pattern, count(*) as n, min(commit_id) as first_commit, max(commit_id) as last_commit from f group by all having count(*) >= 2
"""


def c1_commit_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = classify.with_classes(bind(spark, sf_dir, COMMIT_FILE))
    gather = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))), ",").alias(c + "s")
    hashed = F.substring(F.sha2(F.col("commit_id").cast("string"), 256), 1, 7)
    return f.groupBy("repo_id", "commit_id").agg(gather("extension"), gather("directory"), F.count("*").alias("files"), F.count_if("noisy").alias("noisy_files")).withColumn("short_hash", hashed)


QUERIES["c1_commit_enrichment"] = c1_commit_enrichment
ORACLES["c1_commit_enrichment"] = f"""
with f as (select *, {EXTENSION} as e, {sql_directory(N)} as d, {NOISY} as z from ({plain(COMMIT_FILE)}))
select repo_id, commit_id, array_to_string(list_sort(list(distinct e) filter (where e <> '')), ',') as extensions,
  array_to_string(list_sort(list(distinct d) filter (where d <> '')), ',') as directorys, count(*) as files, count(*) filter (where z) as noisy_files,
  substr(sha256(commit_id::varchar), 1, 7) as short_hash
from f group by repo_id, commit_id
"""


def g10_commit_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = signals.files_with(bind(spark, sf_dir, COMMIT_FILE), {"s": signals.path_signals(P())})
    exploded = f.select("repo_id", "commit_id", F.explode("s").alias("signal"))
    return exploded.groupBy("repo_id", "commit_id").agg(F.array_join(F.array_sort(F.collect_set("signal")), ",").alias("signals"), F.count_distinct("signal").alias("n_signals"))


QUERIES["g10_commit_signals"] = g10_commit_signals
ORACLES["g10_commit_signals"] = f"""
with f as (select repo_id, commit_id, unnest({PATH_SIGNALS}) as signal from ({plain(COMMIT_FILE)}))
select repo_id, commit_id, array_to_string(list_sort(list(distinct signal)), ',') as signals, count(distinct signal) as n_signals from f group by all
"""

_PRIORITY = "case signal " + " ".join(f"when '{s}' then {i}" for i, s in enumerate(rules.SIGNAL_PRIORITY)) + " else 999 end"


def g11_shape_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = signals.files_with(bind(spark, sf_dir, COMMIT_FILE), {"of_path": signals.path_signals(P())})
    all_signals = f.groupBy("repo_id", "commit_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("of_path")))).alias("s"))
    return all_signals.select("repo_id", "commit_id", F.array_join(signals.shape(F.col("s")), ",").alias("shape"))


QUERIES["g11_shape_signals"] = g11_shape_signals
ORACLES["g11_shape_signals"] = f"""
with c as (select distinct repo_id, commit_id from ({plain(COMMIT_FILE)})),
f as (select distinct repo_id, commit_id, unnest({PATH_SIGNALS}) as signal from ({plain(COMMIT_FILE)})),
r as (select *, row_number() over (partition by repo_id, commit_id order by {_PRIORITY}, signal) as k from f),
s as (select repo_id, commit_id, string_agg(signal, ',' order by k) as shape from r where k <= 8 group by all)
select c.repo_id, c.commit_id, coalesce(shape, '') as shape from c left join s using (repo_id, commit_id)
"""


def g12_signal_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = bind(spark, sf_dir, PATHS)
    s = f.select(F.explode(signals.path_signals(P())).alias("signal")).groupBy("signal").agg(F.count("*").alias("n"))
    return s.select("signal", "n", F.array_join(signals.broad_areas(F.array("signal")), ",").alias("broad"))


QUERIES["g12_signal_areas"] = g12_signal_areas
ORACLES["g12_signal_areas"] = f"""
with f as (select unnest(list_distinct({PATH_SIGNALS})) as signal from ({plain(PATHS)})), s as (select signal, count(*) as n from f group by 1)
select signal, n, {sql_text(sql_tags('signal', rules.BROAD_AREAS))} as broad from s
"""

_DIFF = """
select event_id, event_type as kind, concat(event_type, case event_id % 6 when 0 then 'Controller' when 1 then 'Service' when 2 then 'DaoModel'
  when 3 then 'AuthFilter' when 4 then 'schemaJob' else 'EventDto' end) as value,
  case event_id % 4 when 0 then 'src/models/a.ts' when 1 then 'e2e/a.ts' when 2 then 'integration/b.ts' else 'lib/c.ts' end as path,
  case event_id % 5 when 0 then 'api_route_changed' when 1 then 'schema_changed' when 2 then 'test_case_added' when 3 then 'controller_changed' else 'class_added' end as type
from {events}
"""


def g9_enriched_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = bind(spark, sf_dir, _DIFF)
    return f.select("event_id", _text(signals.enriched(F.col("type"), F.col("value"), F.col("path"))).alias("signals"))


QUERIES["g9_enriched_signals"] = g9_enriched_signals
_MODEL = f"case when {sql_match('lower(value)', rules.MODEL_VALUE)} or {sql_match('path', rules.MODEL_PATH)} then ['db_changed', 'model_or_entity_changed'] else [] end"
ORACLES["g9_enriched_signals"] = f"""
select event_id, {sql_text("flatten([" + sql_tags("lower(value)", rules.VALUE_SIGNALS) + ", " + _MODEL + ''',
  case when type in ('api_route_changed', 'controller_changed') then ['backend_changed'] else [] end,
  case when type in ('schema_changed', 'index_changed', 'query_changed') then ['db_changed'] else [] end,
  case when type <> 'test_case_added' then [] when regexp_matches(path, '(e2e|playwright|cypress)') then ['e2e_test_changed']
    when regexp_matches(path, 'integration') then ['integration_test_changed'] else ['unit_test_changed'] end])''')} as signals
from ({plain(_DIFF)})
"""
