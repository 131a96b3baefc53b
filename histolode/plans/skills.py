"""Queries over clusters, candidates and the registry, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates, classify, clusters, lifecycle, signals
from .bindings import COMMIT_FILE, bind, literal, plain, sql_fixed2, sql_first_match, sql_jaccard, sql_match
from .paths import ORDERED, ORACLES as PATH_ORACLES, PATH_SIGNALS
from ..functions.tables import Tables

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


_AREA_RULES = [
    ("cli", r"^cli_command"), ("frontend", r"^(ui|component|page_or_screen|route_view|style|frontend)"),
    ("backend", r"^(backend|api_route|controller|service_layer|repository_or_dao|middleware|auth|validation|serialization|background_job|queue_or_event)"),
    ("db", r"^(db|migration|schema|model_or_entity|seed_data|query|index)"), ("infra", r"^(config|env|package|ci|docker|terraform_or_infra|deployment)"),
    ("tests", r"(test|fixture)"), ("docs", r"^(docs|readme|adr_or_design_doc|changelog)"),
]
_PLACE = "case a " + " ".join(f"when '{a}' then {i}" for i, a in enumerate(candidates.AREA_ORDER)) + " end"


@query("a7_primary_area", f"""
with s as (select distinct repo_id, commit_id, unnest({PATH_SIGNALS}) as signal from ({plain(COMMIT_FILE)})),
w as (select repo_id, commit_id, {sql_first_match('signal', _AREA_RULES, 'unknown')} as a, signal from s),
l as ({PATH_ORACLES['c4_commit_area']}),
u as (select repo_id, commit_id, a, case when a in ('tests', 'docs') then 1.0::double when signal = 'cli_command_changed' then 2.5::double when signal in ('package_or_dependency_changed', 'package_script_changed') then 1.5::double else 2.0::double end as w from w where a <> 'unknown'
  union all select repo_id, commit_id, case when area = 'config' then 'infra' else area end, 0.35::double from l where area not in ('mixed', 'unknown')),
c as (select repo_id, commit_id, a, sum(w) as score from u group by 1, 2, 3),
r as (select *, row_number() over (partition by repo_id, commit_id order by score desc, {_PLACE}) as r, max(score) over (partition by repo_id, commit_id) as top from c),
t as (select *, sum((score = top)::int) over (partition by repo_id, commit_id) as tied from r)
select repo_id, commit_id, case when tied > 1 and score < 2 then 'mixed' else a end as primary_area from t where r = 1""")
def a7_primary_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = bind(spark, sf_dir, ORDERED)
    s = files.select("repo_id", "commit_id", F.explode(signals.path_signals(F.col("file_path"))).alias("signal")).distinct()
    areas = classify.commit_areas(files, ["repo_id", "commit_id"])
    return candidates.commit_primary_areas(s, areas, ["repo_id", "commit_id"]).drop("score")


_NUMBERS = "select p_partkey as id, cast(p_size % 12 as int) as commits, p_size % 12 * 0.6 as x, cast(p_size % 7 as int) as a, cast(p_size % 5 as int) as b, p_retailprice / 2500.0 as u, (p_partkey % 101) / 100.0 as v, (p_partkey % 67) / 66.0 as w, p_partkey % 3 = 0 as f, p_partkey % 4 = 0 as g from {part}"
_NUMBERS = _NUMBERS.replace("p_size % 12 * 0.6 as x, ", "").replace("(p_partkey % 101) / 100.0", "cast(p_partkey % 101 as double) / 100").replace("(p_partkey % 67) / 66.0", "cast(p_partkey % 67 as double) / 66").replace("p_retailprice / 2500.0", "cast(p_partkey % 89 as double) / 89")
N = plain(_NUMBERS)
c = F.col


@query("p2_pattern_confidence", f"""select id, case when commits > 0 then {sql_fixed2('''least(0.97::double, 0.28::double + least(commits, 8) * 0.055::double + a::double / commits * 0.18::double / 1.0
  + b::double / commits * 0.12::double + least(commits::double / 40, 1.0::double) * 0.12::double)''').replace(' / 1.0', '')} else 0.0::double end as confidence from (select id, commits, least(a, commits) as a, least(b, commits) as b from ({N}))""")
def p2_pattern_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = bind(spark, sf_dir, _NUMBERS).withColumn("a", F.least("a", "commits")).withColumn("b", F.least("b", "commits"))
    return n.select("id", candidates.pattern_confidence(c("commits"), c("a"), c("b"), F.lit(40)).alias("confidence"))


def _sql_category() -> str:
    def condition(every: list[str], some: list[list[str]]) -> str:
        parts = ["has_async" if s == "+async" else f"list_contains(signals, '{s}')" for s in every] + [f"list_has_any(signals, [{', '.join(map(literal, names))}])" for names in some]
        return " and ".join(parts) or "true"

    names = " ".join(f"when {condition(e, s)} then {literal(n + '|' + f + '|')} || round({sql_fixed2(f'least(0.97::double, {b}::double + least(0.14::double, u * 0.16::double))')} * 100)::int" for e, s, n, f, b in candidates.CATEGORIES)
    return f"case {names} else 'Repeated Engineering Pattern|Update Repeated Engineering Pattern|52' end"


@query("p6_category", f"""
with s as (select repo_id, commit_id, list(distinct signal) as signals from (select repo_id, commit_id, unnest({PATH_SIGNALS}) as signal from ({plain(COMMIT_FILE)})) group by 1, 2)
select repo_id, commit_id, {_sql_category()} as category from (select *, commit_id % 2 = 0 as has_async, (commit_id % 90)::double / 90 as u from s)""")
def p6_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bind(spark, sf_dir, COMMIT_FILE).select("repo_id", "commit_id", F.explode(signals.path_signals(F.col("file_path"))).alias("signal")).groupBy("repo_id", "commit_id").agg(F.collect_set("signal").alias("signals"))
    found = candidates.category(c("signals"), c("commit_id") % 2 == 0, F.lit(True), (c("commit_id") % 90).cast("double") / 90, F.lit(True))
    s = s.withColumn("k", found)
    return s.select("repo_id", "commit_id", F.concat_ws("|", "k.category", "k.fallback", F.round(c("k.confidence") * 100).cast("int").cast("string")).alias("category"))


@query("p9_naming_confidence", f"""
with n as (select *, case when f then null else v end as surface from ({N})),
s as (select *, coalesce(surface >= 0.65, false) as strong from n),
a as (select *, case when strong then least(0.96::double, greatest(w + 0.08::double, 0.56::double + surface * 0.22::double + least(0.12::double, a * 0.04::double))) else w end as c from s),
b as (select *, case when commits <= 3 and not g then least(c, 0.75::double) else c end as d from a),
e as (select *, case when u - 0.3 > 0.25 and not strong then least(d, 0.7::double) else d end as e from b)
select id, {sql_fixed2("case when b = 1 then least(e, 0.72::double) else e end")} as confidence from e""")
def p9_naming_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = bind(spark, sf_dir, _NUMBERS).withColumn("surface", F.when(~c("f"), c("v")))
    return n.select("id", candidates.naming_confidence(c("w"), c("commits"), c("g"), c("surface"), c("a"), c("u") - F.lit(0.3), c("b") != 1).alias("confidence"))


def _sql_failures(t: dict[str, float]) -> str:
    pct = lambda x: f"floor({x} * 100 + 0.5)::int::varchar"
    checks = [
        (f"commits < {t['commits']}", "'Only ' || commits || ' evidence commits were found.'"), (f"u < {t['pattern']}", f"'Pattern confidence ' || {pct('u')} || '% is below threshold.'"),
        (f"v < {t['naming']}", f"'Naming confidence ' || {pct('v')} || '% is below threshold.'"), (f"w < {t['surface']}", f"'Learned surface confidence ' || {pct('w')} || '% is below threshold.'"),
        (f"w < {t['surface_share']}", f"'Only ' || {pct('w')} || '% of evidence commits match one learned implementation surface.'"), (f"art > {t['artifacts']}", f"'Generated artifact evidence share ' || {pct('art')} || '% is above threshold.'"),
        (f"v < {t['quality']}", f"'Workflow quality ' || {pct('v')} || '% is below threshold.'"), (f"a < {t['files']}", "'Only ' || a || ' representative source/test files were found.'"),
        ("b = 0", "'The proposed name contains noisy or over-broad terms.'"), ("b = 1", "'No source file matching the proposed task type was found.'"), ("b = 2", "'No matching test or validation signal was found.'"),
    ]
    return "array_to_string(list_filter([" + ", ".join(f"case when {x} then {y} end" for x, y in checks) + "], lambda x: x is not null), ' ')"


@query("p10_promotion", f"""
with n as (select *, case when not f and w >= 0.65 then least(1 - v, 0.2::double) else 1 - v end as art from ({N})),
r as (select *, {_sql_failures(candidates.AGENT_READY)} as ready, {_sql_failures(candidates.DRAFT)} as draft from n)
select id, case when not f and ready = '' then 'agent_ready' when not f and draft = '' then 'draft' else 'pattern_candidate' end as level,
  case when not f and ready = '' then 'Promoted to agent-ready skill.' when not f and draft = '' then case when ready <> '' then ready else 'Needs human review before becoming trusted guidance.' end else draft end as reasons from r""")
def p10_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = bind(spark, sf_dir, _NUMBERS)
    of = {"commits": c("commits"), "pattern": c("u"), "naming": c("v"), "surface": c("w"), "surface_share": c("w"), "artifacts": 1 - c("v"), "quality": c("v"), "files": c("a"), "has_workflow": F.lit(True), "junk_name": c("b") == 0, "task_evidence": c("b") != 1, "tested": c("b") != 2}
    found = n.withColumn("p", candidates.promotion(of, ~c("f")))
    return found.select("id", "p.level", F.array_join("p.reasons", " ").alias("reasons"))


@query("p11_workflow_quality", f"""
select id, {sql_fixed2('''greatest(0.0::double, least(1.0::double, case when a >= 3 then 0.25::double when a >= 2 then 0.18::double when a >= 1 then 0.1::double else 0.0::double end + case when b > 0 then 0.2::double else 0.0::double end
  + case when b > 1 then 0.2::double else 0.0::double end + case when b > 2 then 0.15::double else 0.0::double end + case when a >= 3 and not f then 0.15::double when a > 0 and not f then 0.08::double else 0.0::double end
  + case when commits >= 3 then 0.05::double else 0.0::double end - case when f then 0.2::double else 0.0::double end - case when v > 0.35 then 0.15::double else 0.0::double end))''')} as quality from ({N})""")
def p11_workflow_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = bind(spark, sf_dir, _NUMBERS)
    return n.select("id", candidates.profile_quality(c("a"), c("b"), c("b") - 1, c("b") - 2, c("a"), c("f"), c("commits"), c("v")).alias("quality"))


@query("p13_family_candidates", f"""
select id, case when u >= 0.9 and v >= 0.75 then 'agent_ready' else 'draft' end as level, {sql_fixed2("least(0.98::double, u + case when a >= 4 then 0.03::double else 0.0::double end)")} as pattern, {sql_fixed2("least(0.96::double, u + 0.04::double)")} as naming
from ({N}) where a >= 3 and u >= 0.68""")
def p13_family_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = bind(spark, sf_dir, _NUMBERS).withColumn("k", candidates.family_candidate(c("u"), c("a"), c("v"))).where("k is not null")
    return n.select("id", "k.*")


_COMMANDS = ["npm test", "npm run build", "cargo test", "pytest", "python -m unittest", "go test ./...", "mvn test", "make test", "make build", "dotnet test", "npm run lint", "./gradlew test"]
_KEYED = "select o_custkey % 300 as id, o_orderkey % 12 as k, case o_orderkey % 9 when 0 then '.rs' when 1 then '.ts' when 2 then '.py' when 3 then '.go' when 4 then '.java' when 5 then '.cs' else '.md' end as extension from {orders} group by 1, 2, 3"
_COMMAND = "(array(" + ", ".join(map(literal, _COMMANDS)) + "))"


@query("v1_scoped_commands", f"""
with k as ({plain(_KEYED)}), cmd as (select distinct id, [{', '.join(map(literal, _COMMANDS))}][k + 1] as command from k),
fam as (select id, list_distinct(flatten(list({'case extension ' + ' '.join(f"when '{e}' then ['{n}']" for n, es in candidates.EXTENSION_FAMILIES for e in es) + ' else [] end'}))) as families from k group by 1),
x as (select cmd.id, command, families, {sql_first_match('command', candidates.COMMAND_FAMILIES, 'unknown')} as family from cmd join fam using (id)),
y as (select *, case when family = 'make' then len(families) > 0 when len(families) = 0 then family <> 'python' else list_contains(families, family) end as fits from x),
z as (select *, max(fits::int) over (partition by id) as any_fits from y),
s as (select *, {sql_match('command', '(^|[^A-Za-z0-9_])test([^A-Za-z0-9_]|$)|pytest|unittest')} as is_test, ({' or '.join(f"(list_contains(families, '{n}') and {sql_match('command', p)})" for n, p in candidates.FAMILY_TESTS)}) as preferred from z where fits or (any_fits = 0 and family = 'make')),
r as (select *, case when preferred then 0 when command = 'make test' then 2 when command = 'make build' then 3 when is_test then 4 when regexp_matches(command, 'build|typecheck|lint') then 5 else 9 end as o,
  case {' '.join(f"when list_contains(families, '{n}') then {sql_match('command', p)}" for n, p in candidates.FAMILY_TESTS)} else is_test end as p from s),
t as (select *, row_number() over (partition by id order by o, command) as place, max(p::int) over (partition by id) as any_primary from r)
select id, command, place, case when any_primary = 1 then p else place = 1 end as primary from t""")
def v1_scoped_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = bind(spark, sf_dir, _KEYED)
    commands = k.select("id", F.element_at(F.array(*map(F.lit, _COMMANDS)), (c("k") + 1).cast("int")).alias("command")).distinct()
    return candidates.scope_commands(commands, k.select("id", "extension"), "id")


@query("u3_commit_clusters", None)
def u3_commit_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = bind(spark, sf_dir, COMMIT_FILE)
    per = f.groupBy("repo_id", "commit_id", "commit_ts").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(signals.path_signals(F.col("file_path")))))).alias("s"), F.array_sort(F.collect_set(F.regexp_replace("file_path", "/[^/]*$", ""))).alias("directories"))
    from pyspark.sql import Window

    ordered = per.select("repo_id", F.row_number().over(Window.partitionBy("repo_id").orderBy(c("commit_ts").desc(), c("commit_id").desc())).alias("ordinal"), c("commit_id").cast("string").alias("hash"), signals.shape(c("s")).alias("shape"), F.array().cast("array<string>").alias("surfaces"), "directories")
    return clusters.cluster_commits(ordered, "repo_id")


@query("u5_draft_dedupe", None)
def u5_draft_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bind(spark, sf_dir, """select concat('n', cast(c_nationkey as varchar(9))) as repo_id, concat('c', cast(c_custkey as varchar(9))) as id, concat('Skill ', cast(c_custkey % 40 as varchar(9))) as name,
      case c_custkey % 5 when 0 then 'agent_ready' when 4 then 'pattern_candidate' else 'draft' end as level, cast(c_custkey % 90 as double) / 100 as pattern, cast(c_custkey % 70 as double) / 100 as naming,
      collect_set(cast(o_orderkey % 50 as varchar(9))) as files, collect_set(cast(o_orderkey as varchar(9))) as commits from {customer} join {orders} on o_custkey = c_custkey group by 1, 2, 3, 4, 5, 6""")
    return candidates.dedupe_drafts(rows, "repo_id")


# -- registry: a skill per user, its first events as the skill's lists, later ones as new commits --------

_ORDERED = "select user_id, event_id, event_type, cast(value as bigint) % 5 as bucket, row_number() over (partition by user_id order by ts desc, event_id desc) as ordinal from {events}"
_SUPPORT = f"""with o as ({plain(_ORDERED)}),
own as (select user_id, coalesce(list(distinct event_type) filter (where ordinal > 20), []) as s, coalesce(list(distinct 'd' || bucket) filter (where ordinal > 20), []) as d from o group by 1),
new as (select user_id, ordinal, [event_type, 'x' || bucket] as s, ['d' || bucket] as d from o where ordinal <= 20)"""


def _skills(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # DuckDB's cast rounds halves to the even number, Spark's cuts the fraction off
    o = bind(spark, sf_dir, _ORDERED.replace("cast(value as bigint)", "cast(rint(value) as bigint)")).withColumn("d", F.concat(F.lit("d"), c("bucket").cast("string")))
    own = o.groupBy("user_id").agg(F.array_sort(F.collect_set(F.when(c("ordinal") > 20, c("event_type")))).alias("own_signals"), F.array_sort(F.collect_set(F.when(c("ordinal") > 20, c("d")))).alias("own_directories"))
    new = o.where("ordinal <= 20").select("user_id", "ordinal", F.array("event_type", F.concat(F.lit("x"), c("bucket").cast("string"))).alias("signals"), F.array("d").alias("directories"))
    return own, new


@query("l3_support", f"{_SUPPORT} select user_id, count(*) filter (where {sql_jaccard('n.s', 'w.s')} >= 0.35 or {sql_jaccard('n.d', 'w.d')} >= 0.25) as supporting, count(*) as new_commits from new n join own w using (user_id) group by 1")
def l3_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, new = _skills(spark, sf_dir)
    none = F.array().cast("array<string>")
    j = new.join(own, "user_id")
    return j.groupBy("user_id").agg(F.count_if(lifecycle.supports(c("signals"), c("directories"), none, c("own_signals"), c("own_directories"), none)).alias("supporting"), F.count("*").alias("new_commits"))


@query("l4_drift", None)
def l4_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A skill per repository and directory, from the commits up to the middle of the repository's time; all later ones are new."""
    f = bind(spark, sf_dir, COMMIT_FILE)
    per = f.groupBy("repo_id", "commit_id", "commit_ts").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(signals.path_signals(F.col("file_path")))))).alias("signals"), F.array_sort(F.collect_set(F.regexp_replace("file_path", "/[^/]*$", ""))).alias("directories"))
    day = F.unix_date(c("commit_ts").cast("date"))
    per = Tables(spark, "l4").keep(per.withColumn("day", day), "commits")
    heads = per.groupBy("repo_id").agg(((F.min("day") + F.max("day")) / 2).alias("head"))
    placed = per.join(heads, "repo_id")
    older = placed.where("day <= head").withColumn("skill_id", F.explode("directories"))
    own_signals, own_directories = (signals.top_values(older.withColumn("x", F.explode(values)), ["repo_id", "skill_id"], "x", 8).withColumnRenamed("top", own) for values, own in (("signals", "own_signals"), ("directories", "own_directories")))
    none = F.array().cast("array<string>")
    skills = own_directories.join(own_signals, ["repo_id", "skill_id"], "left").withColumn("own_signals", F.coalesce("own_signals", none)).withColumn("own_words", none)
    found = lifecycle.drift_since_head(skills, placed.where("day > head").withColumn("words", none), "repo_id")
    return found.select("repo_id", "skill_id", F.array_join("drift_reasons", " ").alias("reasons"))


_STATES = "select p_partkey as id, case p_size % 6 when 0 then 'fresh' when 1 then 'stale' when 2 then 'drifting' when 3 then 'deprecated' when 4 then 'rejected' else 'draft' end as status, cast(p_size % 14 as int) as new_commits, cast(p_partkey % 3 as int) as supporting, cast(p_partkey % 5 as int) - 3 as drift from {part}"


@query("l5_status", f"""
select id, case when status in ('deprecated', 'rejected') then status when drift > 0 then 'drifting' when supporting > 0 then 'fresh' when new_commits >= 10 then 'stale' when status in ('stale', 'drifting') then status else 'fresh' end as status from ({plain(_STATES)})""")
def l5_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(spark, sf_dir, _STATES).select("id", lifecycle.status(c("status"), c("new_commits"), c("supporting"), c("drift")).alias("status"))


_REGISTRY = "select c_custkey as skill_id, concat('Skill ', cast(c_custkey as varchar(9))) as name, case c_custkey % 4 when 0 then 'draft' when 1 then 'fresh' when 2 then 'stale' else 'deprecated' end as status, case c_custkey % 4 when 0 then 'draft' else 'agent_ready' end as promotion_level, c_custkey % 7 = 0 as human_approved, case when c_custkey % 11 = 0 then 'human' else 'engine' end as managed_by, 1 as version from {customer}"
_DOING = "select c_custkey as skill_id, case c_custkey % 8 when 0 then 'reject' when 4 then 'rename' when 1 then 'approve' else 'deprecate' end as action, '2026-01-01' as done_at, 'me' as done_by, concat('New ', cast(c_custkey as varchar(9))) as new_name from {customer} where c_custkey % 8 in (0, 1, 2, 4)"


@query("l6_transitions", f"""
select r.skill_id, case when action = 'rename' then new_name else name end as name, case action when 'approve' then 'fresh' when 'reject' then 'rejected' when 'deprecate' then 'deprecated' else status end as status,
  case when action = 'approve' then 'agent_ready' else promotion_level end as promotion_level, case when action = 'approve' then true when action = 'reject' then false else human_approved end as human_approved, managed_by, version + 1 as version, done_at as changed_at, done_by as changed_by
from ({plain(_REGISTRY)}) r join ({plain(_DOING)}) d using (skill_id)""")
def l6_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.transition(bind(spark, sf_dir, _REGISTRY), bind(spark, sf_dir, _DOING), ["skill_id"])


@query("l7_active", f"select skill_id, status from ({plain(_REGISTRY)}) where status not in ('deprecated', 'rejected', 'draft') and (human_approved or managed_by = 'human' or (status = 'fresh' and promotion_level = 'agent_ready'))")
def l7_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.active(bind(spark, sf_dir, _REGISTRY)).select("skill_id", "status")


_VERSIONS = "select o_custkey as skill_id, o_orderkey as version, o_orderstatus as status, o_totalprice as quality from {orders}"


@query("k2_current_versions", f"select skill_id, max(version) as version, arg_max(status, version) as status, arg_max(quality, version) as quality from ({plain(_VERSIONS)}) group by 1")
def k2_current_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.current(bind(spark, sf_dir, _VERSIONS), ["skill_id"])


@query("k3_generation", f"""
with r as ({plain(_REGISTRY)}), kept as (select skill_id from r where human_approved or managed_by = 'human')
select skill_id, case promotion_level when 'agent_ready' then 'skills' when 'draft' then 'draft-skills' else 'patterns' end as target from r where skill_id not in (select skill_id from kept)""")
def k3_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = bind(spark, sf_dir, _REGISTRY)
    return lifecycle.generate(r.select("skill_id", "promotion_level"), r, ["skill_id"]).select("skill_id", "target")


@query("l5_merged_evidence", """
with o as (select o_custkey as skill_id, o_orderkey % 40 as hash, o_orderkey as ordinal, case when o_orderkey % 3 = 0 then 0 else 1 end as old from orders),
f as (select *, row_number() over (partition by skill_id, hash order by old, ordinal) as r from o)
select skill_id, hash, ordinal, old, row_number() over (partition by skill_id order by old, ordinal, hash)::int as place from f where r = 1 qualify place <= 20""")
def l5_merged_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = bind(spark, sf_dir, "select o_custkey as skill_id, o_orderkey % 40 as hash, o_orderkey as ordinal, o_orderkey % 3 = 0 as fresh from {orders}")
    return lifecycle.merged_evidence(o.where("fresh").drop("fresh"), o.where("not fresh").drop("fresh"), ["skill_id"])


@query("o7_report", f"""
with r as ({plain(_REGISTRY)}), e as (select o_custkey as skill_id, count(*) as n from orders group by 1)
select promotion_level, status, count(*) as skills, sum(greatest(coalesce(n, 0) - 1, 0))::bigint as repeated, (sum(greatest(coalesce(n, 0) - 1, 0)) * 1200)::bigint as tokens from r left join e using (skill_id) group by 1, 2""")
def o7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = bind(spark, sf_dir, _REGISTRY)
    e = bind(spark, sf_dir, "select o_custkey as skill_id, count(*) as n from {orders} group by 1")
    repeated = F.greatest(F.coalesce("n", F.lit(0)) - 1, F.lit(0))
    return r.join(e, "skill_id", "left").groupBy("promotion_level", "status").agg(F.count("*").alias("skills"), F.sum(repeated).alias("repeated"), (F.sum(repeated) * 1200).alias("tokens"))
