"""Queries over surfaces in use, workflow actions and rendered text, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr, rules
from ..operators import cochange, joins, lifecycle, naming, render, signals, workflow
from .bindings import COMMIT_FILE, bind, commit_files, literal, plain, sql_directory, sql_fixed2, sql_match
from .graph import _PAIRS
from .paths import NOISY, PATH_SIGNALS, ROLE, N
from .texts import sql_tokens, sql_words

QUERIES, ORACLES = {}, {}
c = F.col


def query(name: str, sql: str | None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


FILES = plain(COMMIT_FILE)
_SURFACES = f"""select repo_id, {sql_directory(N)} as surface, list_sort(list(distinct file_path)) as files, list_sort(list_distinct(flatten(list({PATH_SIGNALS})))) as signals from ({FILES}) group by 1, 2"""


def _surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = bind(spark, sf_dir, COMMIT_FILE)
    f = signals.files_with(f.select("repo_id", "file_path").distinct(), {"s": signals.path_signals(c("file_path"))})
    return f.groupBy("repo_id", expr.directory_of(c("file_path")).alias("surface")).agg(F.array_sort(F.collect_set("file_path")).alias("files"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("signals"))


def _sql_kind() -> str:
    seen = lambda p: f"len(list_filter(list_concat([surface], files), lambda x: regexp_matches(lower(x), {literal(p)}))) > 0"
    some = lambda names: f"list_has_any(signals, [{', '.join(map(literal, names))}])"
    extra = {"api": some(["api_route_changed"]), "config": some(workflow.CONFIG_SIGNALS), "database": seen(r"\.sql$")}
    cases = " ".join(f"when {seen(p)}{' or ' + extra[k] if k in extra else ''} then '{k}'" for k, p in workflow.KIND_PATHS)
    return f"case {cases} when len(list_filter(files, lambda x: regexp_matches(lower(x), {literal(workflow.TEST_FILE)}))) = len(files) then 'tests' else 'source-workflow' end"


@query("p3_surface_kinds", f"select repo_id, surface, {_sql_kind()} as kind from ({_SURFACES})")
def p3_surface_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _surfaces(spark, sf_dir)
    return s.select("repo_id", "surface", workflow.surface_kind(F.concat(F.array("surface"), c("files")), c("signals")).alias("kind"))


def _sql_boost() -> str:
    some = lambda names: f"list_has_any(signals, [{', '.join(map(literal, names))}])"
    return f"case when kind = 'commands' then case when {some(['cli_command_changed'])} then 0.05::double else 0.04::double end when kind = 'ui' and {some(workflow.UI_SIGNALS)} then 0.04::double when kind = 'api' and {some(['api_route_changed'])} then 0.03::double when kind = 'database' and {some(workflow.DATABASE_SIGNALS)} then 0.03::double else 0.0::double end"


@query("j5_surface_match", f"""
with s as (select repo_id, surface, signals, len(files) as n, {_sql_kind()} as kind from ({_SURFACES}))
select repo_id, surface, {sql_fixed2(f"least(0.98::double, (n % 60)::double / 60 * 0.42::double + (n % 7)::double / 7 * 0.34::double + (n % 11)::double / 11 * 0.16::double + case when n % 2 = 0 then 0.05::double else 0.0::double end + case when n % 3 = 0 then 0.03::double else 0.0::double end + {_sql_boost()})")} as confidence from s""")
def j5_surface_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _surfaces(spark, sf_dir).withColumn("n", F.size("files")).withColumn("kind", workflow.surface_kind(F.concat(F.array("surface"), c("files")), c("signals")))
    share = lambda m: (c("n") % m).cast("double") / m
    return s.select("repo_id", "surface", workflow.match_confidence(share(60), share(7), share(11), c("n") % 2 == 0, c("n") % 3 == 0, workflow.alignment(c("kind"), c("signals"))).alias("confidence"))


_PARTS = sql_tokens("regexp_replace(part, '\\.[^.]+$', '')")


@query("a8_domain_terms", f"""
with f as (select repo_id, commit_id, unnest(string_split(file_path, '/')) as part, {NOISY} as noisy from ({FILES})),
t as (select repo_id, commit_id, unnest({_PARTS}) as term from f where not noisy),
s as (select repo_id, count(distinct commit_id) as commits from ({FILES}) group by 1),
n as (select repo_id, term, count(distinct commit_id) as n from t where not regexp_matches(term, '^\\d+$') and term not in {sql_words(rules.TERM_NOISE)} group by 1, 2),
r as (select n.*, row_number() over (partition by repo_id order by n desc, term)::int as rank from n join s using (repo_id) where n >= least(2, commits))
select repo_id, term, n, rank from r where rank <= 10""")
def a8_domain_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.domain_terms(bind(spark, sf_dir, COMMIT_FILE), ["repo_id"], "commit_id", rules.TERM_NOISE).select("repo_id", "term", "n", "rank")


@query("p4_surface_terms", f"""
with f as (select repo_id, commit_id, {N} as p, {ROLE} as role, {sql_directory(N)} as surface from ({FILES})),
m as (select * from f where role in ('source', 'docs') and surface <> 'repo root'),
t as (select repo_id, surface, commit_id, unnest(string_split(p, '/')) as part from m),
w as (select repo_id, surface, commit_id, unnest({_PARTS}) as term from t),
n as (select repo_id, surface, term, count(distinct commit_id) as n from w where not regexp_matches(term, '^\\d+$') and term not in {sql_words(rules.TERM_NOISE)} group by 1, 2, 3),
s as (select repo_id, surface, count(distinct commit_id) as commits from m group by 1, 2),
r as (select n.*, row_number() over (partition by repo_id, surface order by n desc, term)::int as rank from n join s using (repo_id, surface) where n >= greatest(2, ceil(commits * 0.35::double)))
select repo_id, surface, term, n, rank from r where rank <= 6""")
def p4_surface_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = bind(spark, sf_dir, COMMIT_FILE)
    messages = f.select("repo_id", "commit_id").distinct().withColumn("message_terms", F.array().cast("array<string>"))
    return cochange.surface_terms(f, messages, ["repo_id"], "commit_id").select("repo_id", "surface", "term", "n", "rank")


_LABELS = "list_filter([" + ", ".join(f"case when len(list_filter(signals, lambda x: regexp_matches(x, {literal(p)}))) > 0 then {literal('Backend/API') if n == 'Backend' else literal(n)} end" for n, p in workflow.AREA_LABELS) + "], lambda x: x is not null)"
_TESTED = "len(list_filter(signals, lambda x: regexp_matches(x, '(test|fixture)'))) > 0"


@query("p12_neutral_names", f"""
with s as (select repo_id, commit_id, list(distinct signal) as signals from (select repo_id, commit_id, unnest({PATH_SIGNALS}) as signal from ({FILES})) group by 1, 2),
a as (select *, ['docs', 'cli', 'backend', 'db', 'infra', 'frontend', 'tests', 'mixed'][(commit_id % 8 + 1)::int] as area, (commit_id % 10)::double / 10 as share, case when commit_id % 3 = 0 then 'Audit' end as hint from s),
l as (select *, {_LABELS} as labels, {_TESTED} as tested from a)
select repo_id, commit_id, case when area in ('mixed', 'unknown') or share < 0.6 or len(labels) > 2 then concat_ws(' ', 'Mixed', coalesce(nullif(array_to_string(labels[1:2], '/'), ''), 'Change'), hint, 'Changes')
  when area = 'docs' then 'Documentation Updates' when area = 'cli' then case when tested then 'CLI/Test Change Cluster' else 'CLI Change Cluster' end when area = 'backend' then 'Backend/API Change Cluster' when area = 'db' then 'Database Change Cluster'
  when area = 'infra' then case when list_contains(signals, 'fixture_changed') then 'Config/Fixture Change Cluster' else 'Config Change Cluster' end when area = 'frontend' then concat_ws(' ', case when tested then 'UI/Test' else 'UI' end, hint, 'Changes') else 'Test Change Cluster' end as name from l""")
def p12_neutral_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bind(spark, sf_dir, COMMIT_FILE).select("repo_id", "commit_id", F.explode(signals.path_signals(c("file_path"))).alias("signal")).groupBy("repo_id", "commit_id").agg(F.collect_set("signal").alias("signals"))
    area = F.element_at(F.array(*map(F.lit, ["docs", "cli", "backend", "db", "infra", "frontend", "tests", "mixed"])), (c("commit_id") % 8 + 1).cast("int"))
    return s.select("repo_id", "commit_id", workflow.neutral_name(c("signals"), area, (c("commit_id") % 10).cast("double") / 10, F.when(c("commit_id") % 3 == 0, "Audit"), F.lit(True)).alias("name"))


#: Changed files of commits with one diff signal each; surfaces are directories.
_MOVED = "case when file_path like 'ui/%' and commit_id % 3 = 0 then replace(file_path, '/components/', '/api/') when file_path like 'ui/%' and commit_id % 5 = 0 then replace(file_path, '.component.ts', '.scss') else file_path end"
_CHANGED = f"""
select repo_id, commit_id, {_MOVED} as file_path, case commit_id % 4 when 0 then 'Fix error output' when 1 then 'Validate input' else 'Work' end as message,
  case when file_path like 'src/commands/%' then 'commands' when file_path like 'ui/%' then 'ui' when file_path like 'server/%' then 'api' when file_path like 'migrations/%' then 'database' when file_path like 'config/%' then 'config'
    when file_path like 'docs/%' then 'docs' when file_path like 'tests/%' then 'tests' else 'source-workflow' end as kind,
  case commit_id % 6 when 0 then 'config_changed' when 1 then 'function_added' when 2 then 'api_route_changed' when 3 then 'schema_changed' when 4 then 'enum_added' else 'cli_command_changed' end as type,
  case when commit_id % 12 = 5 then '--flag' else 'go' end as value, commit_id % 7 = 0 and file_path like 'src/%' as options, commit_id % 13 <> 0 as changed, commit_id % 11 = 0 as supports, true as direct, -commit_id as ordinal
from ({COMMIT_FILE})"""
#: Written out by hand, not made of the operator's tables.
_DUCK_ACTIONS = """
changed as ({changed}),
g as (select *, {directory} as surface, case when file_path like 'tests/%' then 'test' when file_path like 'docs/%' then 'source' when supports or file_path like 'config/%' then 'supporting' else 'source' end as "group",
  file_path like 'src/%' or file_path like 'ui/%' or file_path like 'server/%' or file_path like 'migrations/%' as is_source from changed where file_path not like 'reports/%'),
shown as (
  select *, 'added_test_case' as action, 12 as usual from g where file_path like 'tests/%'
  union all select *, 'updated_docs', case when kind = 'docs' then 0 else 14 end from g where file_path like 'docs/%'
  union all select *, 'changed_config_key', 10 from g where type = 'config_changed'
  union all select *, 'added_route_or_handler', case when kind = 'api' then 0 else 6 end from g where type = 'api_route_changed'
  union all select *, 'changed_schema_or_model', case when kind in ('api', 'database') then 2 else 8 end from g where type = 'schema_changed'
  union all select *, 'changed_query_or_migration', case when kind = 'database' then 1 else 8 end from g where file_path like 'migrations/%'
  union all select *, 'changed_validation_logic', 3 from g where message = 'Validate input'
  union all select *, 'changed_error_handling', 7 from g where message = 'Fix error output'
  union all select *, 'changed_output_formatting', 8 from g where message = 'Fix error output'
  union all select *, 'added_function', 5 from g where type = 'function_added'
  union all select *, 'added_type_or_interface', 6 from g where type = 'enum_added'
  union all select *, 'added_cli_option', case when kind = 'commands' then 0 else 4 end from g where options or (type = 'cli_command_changed' and value = '--flag')
  union all select *, 'changed_cli_option', 1 from g where type = 'cli_command_changed' and value = 'go' and kind = 'commands'
  union all select *, 'updated_api_client', 1 from g where file_path like 'ui/src/api/%'
  union all select *, 'updated_component', 0 from g where file_path like 'ui/src/components/%' and file_path like '%.ts'
  union all select *, 'updated_style', 4 from g where file_path like '%.scss'
  union all select *, 'modified_function', 4 from g where changed and is_source and "group" = 'source' and file_path not like '%.scss'),
commits as (select repo_id, surface, count(distinct commit_id) as commits from (select *, {directory} as surface from changed) group by 1, 2),
n as (select repo_id, surface, kind, action, min(usual) as usual, count(distinct commit_id) as n, list_sort(list(distinct file_path))[1:5] as files, min((ordinal, file_path)) as seen from shown group by 1, 2, 3, 4),
m as (select repo_id, surface, action, "group" from shown group by 1, 2, 3, 4 qualify row_number() over (partition by repo_id, surface, action order by count(*) desc, case "group" when 'source' then 0 when 'test' then 1 else 2 end) = 1),
actions as (select repo_id, surface, kind, action, "group", n, files, row_number() over (partition by repo_id, surface order by usual, n desc, seen, action)::int as rank
  from n join commits using (repo_id, surface) join m using (repo_id, surface, action) where n >= least(2, greatest(1, ceil(commits * 0.35::double))))""".replace("{changed}", plain(_CHANGED)).replace("{directory}", sql_directory("file_path"))


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    commit_files(spark, sf_dir).createOrReplaceTempView("changed_commit_files")
    f = spark.sql(_CHANGED.replace(COMMIT_FILE, "table changed_commit_files")).withColumn("surface", expr.directory_of(c("file_path"))).withColumn("found", F.array(F.struct("type", "value")))
    return workflow.workflow_actions(f, ["repo_id", "surface"], "commit_id")


@query("w1_workflow_actions", f"""with {_DUCK_ACTIONS} select repo_id, surface, action, "group", n, array_to_string(files, '|') as files, rank from actions""")
def w1_workflow_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _actions(spark, sf_dir).select("repo_id", "surface", "action", "group", "n", F.array_join("files", "|").alias("files"), "rank")


@query("w2_workflow_steps", f"""
with {_DUCK_ACTIONS},
cored as (select *, case when kind = 'docs' then action = 'updated_docs' when kind = 'config' then action = 'changed_config_key' when "group" = 'supporting' then false
    when kind = 'commands' then action in ('added_cli_option', 'changed_cli_option', 'modified_function', 'added_function', 'changed_error_handling', 'changed_output_formatting', 'added_test_case')
    when kind = 'ui' then action in ('updated_component', 'updated_api_client', 'updated_style', 'modified_function', 'changed_error_handling', 'changed_output_formatting', 'added_test_case')
    when kind = 'api' then action in ('added_route_or_handler', 'changed_schema_or_model', 'updated_api_client', 'changed_validation_logic', 'changed_error_handling', 'modified_function', 'added_test_case')
    when kind = 'database' then action in ('changed_query_or_migration', 'changed_schema_or_model', 'added_test_case') else true end as core from actions),
told as (select *, case when core then action not in ('added_cli_option', 'changed_cli_option', 'added_route_or_handler', 'updated_component', 'updated_api_client', 'changed_schema_or_model', 'changed_query_or_migration', 'updated_style')
    or (kind = 'commands' and action in ('added_cli_option', 'changed_cli_option')) or (kind = 'ui' and action in ('updated_component', 'updated_api_client', 'updated_style'))
    or (kind = 'api' and action in ('added_route_or_handler', 'changed_schema_or_model', 'updated_api_client')) or (kind = 'database' and action in ('changed_query_or_migration', 'changed_schema_or_model'))
  else action in ('updated_docs', 'changed_config_key', 'updated_style') end as has_text from cored),
placed as (select *, row_number() over (partition by repo_id, surface, core order by rank)::int as place from told where has_text),
kept as (select repo_id, surface, case when core then 'core' else 'supporting' end as tier, place, action, n from placed where place <= 5),
checks as (select repo_id, surface, 'core' as tier, max(place) + 1 as place, 'validation' as action, 1 as n from kept where tier = 'core' and surface like '%s%' group by 1, 2)
select * from kept union all select * from checks""")
def w2_workflow_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _actions(spark, sf_dir)
    commands = found.select("repo_id", "surface").distinct().withColumn("commands", F.when(c("surface").contains("s"), F.array(F.lit("npm test"))).otherwise(F.array().cast("array<string>")))
    return workflow.workflow_steps(found, ["repo_id", "surface"], commands).select("repo_id", "surface", "tier", "place", "action", "n")


_TASKS = """
select p_partkey as id, element_at(array('frontend', 'cli', 'backend', 'db', 'infra', 'docs', 'tests', 'mixed', 'unknown'), cast(p_partkey % 9 as int) + 1) as area,
  case p_partkey % 4 when 0 then 'api_route_changed' when 1 then 'ci_changed' when 2 then 'background_job_changed' else 'unit_test_changed' end as signal,
  case p_size % 5 when 0 then 'audit' when 1 then 'ledger-entry' when 2 then 'report' when 3 then 'grid' else 'service' end as term,
  case p_partkey % 2 when 0 then 'Backend Pattern' else 'Command Surface' end as category,
  element_at(array('commands', 'ui', 'api', 'database', 'config', 'docs', 'tests', 'source-workflow'), cast(p_size % 8 as int) + 1) as kind, cast(p_partkey % 10 as double) / 10 as share, p_partkey % 7 < 4 as has_surface
from {part}"""
_DUCK_TASKS = plain(_TASKS).replace("element_at(array(", "list_extract(list_value(")


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bind(spark, sf_dir, _TASKS).withColumn("signals", F.array("signal")).withColumn("terms", F.array("term")).withColumn("files", F.array(F.lit("lib/x.go"), F.lit("cmd/x.go")))
    of = F.struct("kind", F.lit(0.9).alias("confidence"), c("share").alias("match_share"), F.array("term").alias("source_terms"), F.lit("src/billing/invoices").alias("directory"), F.lit("Invoices Surface").alias("display_name"), F.array(F.lit("src/billing/invoices/pay.go")).alias("representative_files"))
    t = t.withColumn("surface", F.when(c("has_surface"), of))
    return t.withColumn("name", naming.task_name(*(c(x) for x in ("area", "signals", "files", "terms", "category", "surface"))))


_NAMED = f"""
t as ({_DUCK_TASKS}),
d as (select *, case when term = 'service' then '' when term = 'report' then 'Reporting' when term = 'ledger-entry' then 'Ledger Entry' else upper(term[1]) || term[2:] end as feature,
  case when term = 'report' then 'Reporting' when term = 'ledger-entry' then 'Ledger Entry' else upper(term[1]) || term[2:] end as domain,
  has_surface and case when share >= 0.65 then true else area in ('tests', 'mixed', 'unknown') or category = 'Backend Pattern' or signal = 'unit_test_changed' end as of_surface from t),
named as (select *, case when of_surface then
    case kind when 'commands' then 'Update Commands' when 'ui' then case term when 'grid' then 'Update Grid UI' else 'Update ' || domain || ' UI' end when 'api' then 'Update ' || domain || ' API Behavior' when 'database' then 'Update ' || domain || ' Database Schema'
      when 'config' then 'Update ' || domain || ' Runtime Configuration' when 'docs' then 'Update ' || domain || ' Documentation' when 'tests' then 'Update ' || domain || ' Tests' else 'Update ' || domain || ' Billing Invoices Workflow' end
  when area = 'frontend' then case when feature = 'Reporting' then 'Update Reporting Dashboard UI' when feature = '' then 'Update UI Component' else 'Update ' || feature || ' UI' end
  when area = 'cli' then 'Add CLI Command'
  when area = 'backend' then case when signal = 'api_route_changed' then case when feature = '' then 'Update Backend API Behavior' else 'Update ' || feature || ' Backend API Behavior' end
    when signal = 'background_job_changed' then case when feature = '' then 'Add or Update Async Job or Event Handler' else 'Add or Update ' || feature || ' Async Job or Event Handler' end
    else case when feature = '' then 'Update Backend Behavior' else 'Update ' || feature || ' Backend Behavior' end end
  when area = 'db' then case when feature = '' then 'Add Database-Backed Feature' else 'Add or Update ' || feature || ' Database-Backed Feature' end
  when area = 'infra' then case when signal = 'ci_changed' then case when feature = '' then 'Update Build or CI Configuration' else 'Update ' || feature || ' Build or CI Configuration' end
    else case when feature = '' then 'Update Runtime Configuration' else 'Update ' || feature || ' Runtime Configuration' end end
  when area = 'docs' then case when feature = '' then 'Update Project Documentation' else 'Update ' || feature || ' Documentation' end
  when area = 'tests' then case when feature = '' then 'Update Tests' else 'Update ' || feature || ' Tests' end
  else case when feature = '' then 'Update Engineering Workflow' else 'Update ' || feature || ' Change Workflow' end end as name from d)"""


@query("p7_task_names", f"with {_NAMED} select id, name from named")
def p7_task_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tasks(spark, sf_dir).select("id", "name")


@query("p8_task_descriptions", f"""
with {_NAMED},
e as (select *, case when area not in ('mixed', 'unknown') then area when has_surface and share >= 0.65 and kind <> 'source-workflow'
    then case kind when 'commands' then 'cli' when 'ui' then 'frontend' when 'api' then 'backend' when 'database' then 'db' when 'config' then 'infra' else kind end
  when signal = 'api_route_changed' then 'backend' when signal = 'ci_changed' then 'infra' when signal = 'unit_test_changed' then 'tests' else area end as own from named),
f as (select *, case when own = 'cli' or feature = '' then '' else lower(feature) || ' ' end as f from e)
select id, case when has_surface and (of_surface or category = 'Command Surface') then 'Use this for changes to the learned Invoices Surface under src/billing/invoices, including examples like pay.'
  when name in ('Update Reporting Dashboard UI', 'Add or Update Reporting Workbench UI') then 'Use this for reporting dashboard/workbench UI changes involving UI components, UI API wiring, and UI tests.'
  when own = 'frontend' then 'Use this for ' || case when f = '' then 'UI component or screen' else f || 'UI' end || ' changes involving components, screens, API client wiring, or related UI tests.'
  when own = 'cli' then 'Use this for CLI command changes involving command registration, option parsing, handlers, and tests.'
  when own = 'backend' then 'Use this for ' || f || 'backend' || case when signal = 'api_route_changed' then ' API route, controller, service, handler, and test changes.' else ' service, handler, middleware, and test changes.' end
  when own = 'db' then 'Use this for ' || f || 'database-backed changes involving migrations, schema/model updates, queries, repositories, and tests.'
  when own = 'infra' then 'Use this for ' || case when f = '' then 'runtime, build, CI, or infrastructure configuration' else f || 'runtime or build configuration' end || ' changes with matching validation commands from the owning project.'
  when own = 'docs' then 'Use this for ' || case when f = '' then 'project documentation' else f || 'documentation' end || ' updates involving README, docs, changelog, or design-note files.'
  when own = 'tests' then 'Use this for ' || case when f = '' then 'test coverage' else f || 'tests' end || ' changes involving focused test cases, fixtures, and nearby source examples.'
  else 'Use this for repeated repository changes where the examples and evidence show a concrete source/test workflow.' end as description from f""")
def p8_task_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = naming.task_description(*(c(x) for x in ("name", "area", "signals", "files", "terms", "category", "surface")))
    return _tasks(spark, sf_dir).select("id", told.alias("description"))


_FILES_OF = "select o_custkey as id, cast(row_number() over (partition by o_custkey order by o_orderkey) as int) as place, o_orderkey as file, o_orderstatus = 'F' as is_test from {orders}"


@query("o2_examples", f"""
with f as ({plain(_FILES_OF)}), r as (select *, row_number() over (partition by id, is_test order by place) as r, sum(is_test::int) over (partition by id) as tests from f),
k as (select id, place, file, is_test, row_number() over (partition by id order by is_test, place)::int as rank from r where is_test or r <= case when tests > 0 then 4 else 5 end)
select * from k where rank <= 5""")
def o2_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.examples(bind(spark, sf_dir, _FILES_OF), ["id"])


_TEXTS = f"select page_id, case page_id % 3 when 0 then '' when 1 then concat('intro ', url, '  ') else concat('a ', '{render.START}', 'old', '{render.END}', ' z') end as text, url as section from {{pages}}"


@query("k4_managed_sections", f"""
select page_id, case when contains(text, '{render.START}') then concat('a ', '{render.START}', chr(10), section, chr(10), '{render.END}', ' z') when trim(text) = '' then concat('{render.START}', chr(10), section, chr(10), '{render.END}', chr(10))
  else concat(rtrim(text), chr(10), chr(10), '{render.START}', chr(10), section, chr(10), '{render.END}', chr(10)) end as text from ({plain(_TEXTS)})""")
def k4_managed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(spark, sf_dir, _TEXTS).select("page_id", render.managed_column(c("text"), c("section")).alias("text"))


@query("s14_archive", """
with a as (select o_orderkey as id, o_orderstatus as status, case o_orderstatus when 'F' then 'archive' else 'active' end as place from orders)
select place, status, count(*) as n from a where place = 'archive' or status = 'P' group by 1, 2""")
def s14_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bind(spark, sf_dir, "select o_orderkey as id, o_orderstatus as status from {orders}")
    archived = rows.where("status = 'F'").withColumn("place", F.lit("archive"))
    deprecated = rows.where("status = 'P'").withColumn("place", F.lit("active"))
    return archived.unionByName(deprecated).groupBy("place", "status").agg(F.count("*").alias("n"))


@query("a10_top_labels", f"""
with f as (select repo_id, {sql_directory(N)} as label from ({FILES})), n as (select repo_id, label, count(*) as n from f group by 1, 2), r as (select *, row_number() over (partition by repo_id order by n desc, label) as r from n)
select repo_id, string_agg(label, '|' order by r) as labels from r where r <= 8 group by 1""")
def a10_top_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = bind(spark, sf_dir, COMMIT_FILE).select("repo_id", expr.directory_of(c("file_path")).alias("label"))
    return signals.top_values(f, ["repo_id"], "label", 8).select("repo_id", F.array_join("top", "|").alias("labels"))




_REPS = f"""select repo_id, surface, file_path from (select *, row_number() over (partition by repo_id, surface order by n desc, file_path) as r
  from (select repo_id, {sql_directory(N)} as surface, {N} as file_path, count(*) as n from ({FILES}) group by 1, 2, 3)) where r <= 4"""


def _representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = bind(spark, sf_dir, COMMIT_FILE).groupBy("repo_id", expr.directory_of(c("file_path")).alias("surface"), "file_path").agg(F.count("*").alias("n"))
    tops = counted.withColumn("r", F.row_number().over(Window.partitionBy("repo_id", "surface").orderBy(c("n").desc(), "file_path"))).where("r <= 4")
    return tops.groupBy("repo_id", "surface").agg(F.array_sort(F.collect_list("file_path")).alias("representative_files"))


@query("j2_partner_files", f"""
with recursive {_PAIRS}, s as ({_REPS}),
t as (select distinct s.repo_id, surface, file_a, file_b from s join edges e on s.repo_id = e.repo_id and (s.file_path = file_a or s.file_path = file_b))
select distinct repo_id, surface, unnest([file_a, file_b]) as file_path from t""")
def j2_partner_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = cochange.cochange_pairs(bind(spark, sf_dir, COMMIT_FILE), ["repo_id"], "commit_id", keep=None)
    return joins.partner_files(_representatives(spark, sf_dir), edges, ["repo_id"])


@query("j3_supporting_files", f"""
with s as ({_REPS}) select distinct s.repo_id, s.surface, s.file_path from s semi join (select repo_id, file_path from ({FILES}) where not {NOISY}) f using (repo_id, file_path)""")
def j3_supporting_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _representatives(spark, sf_dir).select("repo_id", "surface", c("representative_files").alias("test_files"), F.array().cast("array<string>").alias("config_or_docs_files"))
    return joins.supporting_files(s, bind(spark, sf_dir, COMMIT_FILE), ["repo_id"])


_RANKED = f"select repo_id, file_path, commit_id % 3 = 0 as direct, commit_id % 2 = 0 as supports, commit_id % 5 = 0 as is_test, commit_id % 7 as n from ({COMMIT_FILE}) group by 1, 2, 3, 4, 5, 6"


@query("p5_common_files", f"""
with r as (select *, row_number() over (partition by repo_id order by case when direct then 0 when supports and is_test then 1 when supports then 2 else 9 end, n desc, file_path)::int as rank from ({plain(_RANKED)}))
select repo_id, file_path, n, rank from r where rank <= 8""")
def p5_common_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.ranked_files(bind(spark, sf_dir, _RANKED), ["repo_id"]).select("repo_id", "file_path", "n", "rank")


_EVIDENCE = "select o_custkey as cluster, cast(row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as int) as ordinal, o_orderkey as hash, o_orderpriority as signal, o_orderkey % 13 as n_diff_signals from {orders}"


@query("p14_ordered_evidence", f"""
select cluster, hash, row_number() over (partition by cluster order by (case when signal in ('1-URGENT', '2-HIGH') then 1 else 0 end) + n_diff_signals * 0.01::double desc, ordinal)::int as place from ({plain(_EVIDENCE)})""")
def p14_ordered_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bind(spark, sf_dir, _EVIDENCE).withColumn("signals", F.array("signal")).withColumn("lead", F.array(F.lit("1-URGENT"), F.lit("2-HIGH")))
    return joins.ordered_evidence(e, ["cluster"], "lead").select("cluster", "hash", "place")


@query("l1_registry_rows", f"""
with e as (select o_custkey as cluster, count(*) as commits, min(o_orderkey) as head from orders group by 1)
select cluster as skill_id, case when commits >= 12 then 'agent_ready' else 'draft' end as promotion_level, case when commits >= 12 then 'fresh' else 'draft' end as status, least(commits, 20) as evidence, head from e""")
def l1_registry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bind(spark, sf_dir, "select o_custkey as skill_id, count(*) as commits, min(o_orderkey) as head from {orders} group by 1").withColumn("promotion_level", F.when(c("commits") >= 12, "agent_ready").otherwise("draft"))
    return lifecycle.created(found).select("skill_id", "promotion_level", "status", F.least("commits", F.lit(20)).alias("evidence"), "head")
