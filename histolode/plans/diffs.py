"""Queries over unified diffs, built from orders, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff
from .bindings import bind, literal, plain

QUERIES, ORACLES = {}, {}

_K = "o_orderkey"


def _lines(*rows: str) -> str:
    return ", ".join(f"{r}, chr(10)" for r in rows)


#: One diff per order: a source file, a package.json, a config file and a migration, some added, renamed or deleted.
DIFFS = f"""
select {_K} as hash, concat({_lines(
    "'preamble that no file owns'",
    f"concat('diff --git a/src/commands/m', cast({_K} % 7 as varchar(9)), '.ts b/src/commands/m', cast({_K} % 7 as varchar(9)), '.ts')",
    f"case {_K} % 5 when 0 then 'new file mode 100644' when 1 then 'deleted file mode 100644' when 2 then 'rename from src/old name.ts' else 'index 1..2' end",
    f"case when {_K} % 5 = 2 then 'rename to src/commands/new.ts' else 'similarity' end",
    f"case when {_K} % 5 = 0 then '--- /dev/null' else concat('--- a/src/commands/m', cast({_K} % 7 as varchar(9)), '.ts') end",
    f"case when {_K} % 5 = 1 then '+++ /dev/null' when {_K} % 5 = 2 then '+++ b/src/commands/new.ts' else concat('+++ b/src/commands/m', cast({_K} % 7 as varchar(9)), '.ts') end",
    "'@@ -1,3 +1,9 @@'",
    f"concat('+export class Order', cast({_K} % 11 as varchar(9)), 'Controller {{{{')",
    f"concat('+export async function load', cast({_K} % 13 as varchar(9)), '(id: string) {{{{')",
    "'+export interface Shape { side: number }'",
    f"concat('+  enum Kind', cast({_K} % 3 as varchar(9)), ' {{{{ A, B }}}}')",
    f"case when {_K} % 2 = 0 then concat('+  it(\"loads ', o_orderpriority, '\", () => 1)') else '-  removed line' end",
    f"concat('+  .command(\"run', cast({_K} % 4 as varchar(9)), '\").option(\"-f, --force', cast({_K} % 4 as varchar(9)), '\", \"x\")')",
    "'+  case \"list\":'",
    f"concat('+router.get(\"/orders/', cast({_K} % 6 as varchar(9)), '\", handler)')",
    "'+@PostMapping(\"/make\")'",
    "' context line'",
    "'++ counted as added'",
    "'diff --git a/package.json b/package.json'",
    "'--- a/package.json'",
    "'+++ b/package.json'",
    "' {'",
    f"case when {_K} % 3 = 0 then '   \"scripts\": {{{{' else '   \"files\": {{{{' end",
    f"concat('+    \"build', cast({_K} % 5 as varchar(9)), '\": \"tsc\",')",
    "'     \"a\": \"b\",'",
    "'+    \"lint\": \"eslint\"'",
    "'diff --git a/config/app.yaml b/config/app.yaml'",
    "'--- a/config/app.yaml'",
    "'+++ b/config/app.yaml'",
    f"concat('+', o_orderstatus, '_level: ', cast({_K} % 9 as varchar(9)))",
    "'-old: 1'",
    "'diff --git a/db/migrations/1.sql b/db/migrations/1.sql'",
    "'+++ b/db/migrations/1.sql'",
    f"case {_K} % 3 when 0 then '+CREATE TABLE t (id int);' when 1 then '+create unique index i on t(id);' else '+select * from t; update t set a = 1' end",
)}, '') as diff
from {{orders}}
"""
DIFFS = DIFFS.replace("{{{{", "{").replace("}}}}", "}")

_FILES = f"""
lines as (select hash, unnest(string_split(diff, chr(10))) as line, generate_subscripts(string_split(diff, chr(10)), 1) as pos from ({plain(DIFFS)})),
numbered as (select *, sum((starts_with(line, 'diff --git '))::int) over (partition by hash order by pos rows unbounded preceding) as file_ord from lines),
marked as (select *, case when starts_with(line, '+++') or starts_with(line, '---') then null when starts_with(line, '+') then 'added' when starts_with(line, '-') then 'deleted'
    when starts_with(line, ' ') then 'context' end as kind,
  case when starts_with(line, 'rename to ') then trim(substr(line, 11)) when starts_with(line, '+++ ') and trim(substr(line, 5)) <> '/dev/null' then regexp_replace(regexp_replace(trim(substr(line, 5)), '^a/', ''), '^b/', '')
    when starts_with(line, 'diff --git ') then regexp_replace(regexp_replace(regexp_extract(line, '^diff --git (.+) (.+)$', 2), '^a/', ''), '^b/', '') end as new,
  case when starts_with(line, 'rename from ') then trim(substr(line, 13)) when starts_with(line, '--- ') and trim(substr(line, 5)) <> '/dev/null' then regexp_replace(regexp_replace(trim(substr(line, 5)), '^a/', ''), '^b/', '')
    when starts_with(line, 'diff --git ') then regexp_replace(regexp_replace(regexp_extract(line, '^diff --git (.+) (.+)$', 1), '^a/', ''), '^b/', '') end as old,
  case when starts_with(line, 'new file mode') then 'added' when starts_with(line, 'deleted file mode') then 'deleted' when starts_with(line, 'rename ') then 'renamed' end as status
  from numbered where file_ord > 0),
files as (select hash, file_ord::bigint as file_ord, arg_max(new, pos) filter (where new is not null) as file_path, arg_max(old, pos) filter (where old is not null) as old,
  coalesce(arg_max(status, pos) filter (where status is not null), 'modified') as status, count(*) filter (where kind = 'added') as added_lines, count(*) filter (where kind = 'deleted') as deleted_lines
  from marked group by hash, file_ord),
added as (select m.hash, m.file_ord, f.file_path, lower(f.file_path) as lp, substr(line, 2) as text from marked m join files f using (hash, file_ord) where kind = 'added')
"""


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.with_features(diff.split_files(bind(spark, sf_dir, DIFFS), ["hash"]))


def d1_diff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = diff.split_files(bind(spark, sf_dir, DIFFS), ["hash"])
    return files.select("hash", F.col("file_ord").cast("long").alias("file_ord"), "file_path", "old_path", "status", "added_lines", "deleted_lines")


QUERIES["d1_diff_files"] = d1_diff_files
ORACLES["d1_diff_files"] = f"with {_FILES} select hash, file_ord, file_path, case when old <> file_path then old end as old_path, status, added_lines, deleted_lines from files"


#: SQL of each list of values by column: hash, file_ord, v.
_LISTS: dict[str, str] = {}


def _add(name: str, column: str, values: str, gate: str) -> None:
    """A list per file as text; values: SQL for a list of a line's values, gate: which files count."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _features(spark, sf_dir).where(F.size(column) > 0).select("hash", F.col("file_ord").cast("long").alias("file_ord"), F.array_join(column, "|").alias("found"))

    QUERIES[name] = run
    _LISTS[column] = f"select distinct hash, file_ord, v from (select hash, file_ord, unnest({values}) as v from added where {gate}) where v <> ''"
    ORACLES[name] = f"""with {_FILES}, v as (select hash, file_ord, unnest({values}) as v from added where {gate})
select hash, file_ord::bigint as file_ord, string_agg(v, '|' order by v) as found from (select distinct * from v where v <> '') group by 1, 2"""


def _re(pattern: str) -> str:
    return pattern.replace(diff.B, r"\b").replace(diff.E, r"\b")


def _any(pattern: str, groups: list[int]) -> str:
    return "[coalesce(" + ", ".join(f"nullif(trim(regexp_extract(text, {literal(_re(pattern))}, {g})), '')" for g in groups) + ", '')]"


_CODE = f"regexp_matches(lp, {literal(diff.CODE_FILE)})"
_CLI = f"regexp_matches(lp, {literal(diff.CLI_FILE)})"
_add("d2_added_exports", "exports", f"[trim(concat(regexp_extract(text, {literal(_re(diff.EXPORT))}, 1), ' ', regexp_extract(text, {literal(_re(diff.EXPORT))}, 2)))]", _CODE)
_add("d2_added_functions", "functions", _any(diff.FUNCTION, [1, 2, 3]), _CODE)
_add("d2_added_classes", "classes", _any(diff.CLASS, [1, 2]), _CODE)
_add("d2_added_types", "types", _any(diff.TYPE, [1, 2]), _CODE)
_add("d2_added_enums", "enums", _any(diff.ENUM, [1, 2]), _CODE)
# RE2 has no back-references: the tests' texts use double quotes only
_add("d3_test_names", "tests", r"""regexp_extract_all(text, '\b(?:describe|it|test)(?:\.(?:only|skip|todo))?\s*\(\s*"([^"]+)"', 1)""", "true")
_add("d4_cli_commands", "cli_commands", r"""list_concat(regexp_extract_all(text, '\.(?:command|commandDir)\s*\(\s*"([^"\s)]+)"', 1), [regexp_extract(text, '^\s*case\s+"([a-z0-9][\w:-]*)"\s*:', 1)])""", _CLI)
_add("d4_cli_options", "cli_options", r"""regexp_extract_all(text, '\.(?:option|requiredOption)\s*\(\s*"([^"]*--[A-Za-z0-9][\w-]*)[^"]*"', 1)""", _CLI)
_add("d6_config_keys", "config_keys", _any(diff.CONFIG_KEY, [1]), f"regexp_matches(lp, {literal(diff.CONFIG_FILE)})")
_ROUTE = r"""list_concat(
  case when regexp_matches(text, '(?i)\brouter\s*\.\s*get\s*\(\s*"([^"]+)"') then ['GET ' || regexp_extract(text, '(?i)\brouter\s*\.\s*get\s*\(\s*"([^"]+)"', 1)]
       when regexp_matches(text, '@PostMapping') then ['POST ' || regexp_extract(text, '@PostMapping\s*\(\s*"([^"]+)"', 1)] else [] end,
  case when regexp_matches(text, '\b(?:function|class|const)\s+\w*(Controller|Handler|Route)\b') then ['handler ' || regexp_extract(text, '\b(?:function|class|const)\s+(\w*(?:Controller|Handler|Route))\b', 1)] else [] end)"""
_add("d7_routes", "routes", _ROUTE, f"not regexp_matches(lp, {literal(diff.TEST_FILE)})")
_add("d8_sql_signals", "sql_signals", "flatten([" + ", ".join(f"case when regexp_matches(text, {literal(_re(p))}) then ['{n}'] else [] end" for n, p in diff.SQL_KINDS) + "])", f"regexp_matches(lp, {literal(diff.SQL_FILE)})")


def d5_package_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).where(F.size("scripts") > 0).select("hash", F.array_join("scripts", "|").alias("scripts"))


QUERIES["d5_package_scripts"] = d5_package_scripts
ORACLES["d5_package_scripts"] = f"""with {_FILES},
kept as (select m.hash, m.kind, m.pos, substr(line, 2) as text from marked m join files f using (hash, file_ord) where kind is not null and regexp_extract(f.file_path, '([^/]*)$', 1) = 'package.json'),
near as (select *, max(regexp_matches(text, '"scripts"\\s*:')::int) over (partition by hash order by pos rows between 8 preceding and 1 following) as opens from kept),
v as (select distinct hash, regexp_extract(text, '^\\s*"([^"]+)":\\s*"[^"]*"', 1) as v from near where kind = 'added' and opens = 1)
select hash, string_agg(v, '|' order by v) as scripts from v where v <> '' group by hash"""


def d9_diff_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diff.diff_signals(_features(spark, sf_dir), ["hash"])
    return found.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("value").alias("values"), F.count_distinct("hash").alias("commits"))


QUERIES["d9_diff_signals"] = d9_diff_signals
_HANDLER = "lower(v) like '% handler' or lower(v) like 'handler %' or lower(v) like '%controller%'"
_SCRIPTS = """kept as (select m.hash, m.kind, m.pos, substr(line, 2) as text from marked m join files f using (hash, file_ord) where kind is not null and regexp_extract(f.file_path, '([^/]*)$', 1) = 'package.json'),
near as (select *, max(regexp_matches(text, '"scripts"\\s*:')::int) over (partition by hash order by pos rows between 8 preceding and 1 following) as opens from kept),
scripts as (select distinct hash, regexp_extract(text, '^\\s*"([^"]+)":\\s*"[^"]*"', 1) as v from near where kind = 'added' and opens = 1)"""
_PLAIN = {"exports": "exported_symbol_added", "functions": "function_added", "types": "interface_or_type_added", "enums": "enum_added", "tests": "test_case_added", "cli_commands": "cli_command_changed", "cli_options": "cli_command_changed", "config_keys": "config_changed"}
ORACLES["d9_diff_signals"] = f"""with {_FILES}, {_SCRIPTS},
found as (
  {' union all '.join(f"select '{t}' as type, v as value, hash from ({_LISTS[c]})" for c, t in _PLAIN.items())}
  union all select 'package_script_changed', v, hash from scripts where v <> ''
  union all select case when lower(v) like '%controller' then 'controller_changed' else 'class_added' end, v, hash from ({_LISTS['classes']})
  union all select case when {_HANDLER} then 'controller_changed' else 'api_route_changed' end, v, hash from ({_LISTS['routes']})
  union all select v, replace(v, '_', ' '), hash from ({_LISTS['sql_signals']}))
select type, count(*) as n, count(distinct value) as values, count(distinct hash) as commits from found group by 1"""


def s5_changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of a commit's diff in order, or the plain listing when the diff has no file."""
    source = bind(spark, sf_dir, f"select hash, case when hash % 10 = 0 then 'merge, no files' else diff end as diff, concat(' a', cast(hash % 3 as varchar(9)), '.ts ', chr(10), chr(10), 'b.ts') as listing from ({DIFFS})")
    files = diff.split_files(source, ["hash"]).groupBy("hash").agg(F.transform(F.array_sort(F.collect_list(F.struct("file_ord", "file_path"))), lambda x: x["file_path"]).alias("paths"))
    listed = F.filter(F.transform(F.split("listing", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return source.join(files, "hash", "left").select("hash", F.array_join(F.coalesce("paths", listed), "|").alias("paths"))


QUERIES["s5_changed_files"] = s5_changed_files
ORACLES["s5_changed_files"] = f"with {_FILES} select hash, case when hash % 10 = 0 then concat('a', hash % 3, '.ts|b.ts') else string_agg(file_path, '|' order by file_ord) end as paths from files group by hash"
