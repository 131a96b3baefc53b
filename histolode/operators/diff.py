"""Unified diffs: files, counts and the symbols, tests, commands, keys, routes and SQL they add.

Word borders are ASCII ones, spelled as look-arounds: Java's ``\\b`` is a Unicode
border and would not see ``class`` in ``éclass``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr

B, E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
NAME = r"[A-Za-z_$][\w$]*"
Q = "['\"`]"
#: What a line may add; the first group that matches names it (fixed values, borders as above).
EXPORT = rf"{B}export\s+(?:async\s+)?(?:abstract\s+)?(function|class|interface|type|enum)\s+({NAME})"
FUNCTION = rf"{B}(?:export\s+)?(?:async\s+)?function\s+({NAME}){E}|^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(|{B}(?:public|private|protected|internal|static|\s)+[\w<>,\[\]?]+\s+([A-Za-z_]\w*)\s*\("
CLASS = rf"{B}(?:export\s+)?(?:abstract\s+)?class\s+({NAME}){E}|^\s*class\s+([A-Za-z_]\w*){E}"
TYPE = rf"{B}(?:export\s+)?(?:interface|type)\s+({NAME}){E}|{B}(?:public\s+)?interface\s+([A-Za-z_]\w*){E}"
ENUM = rf"{B}(?:export\s+)?enum\s+({NAME}){E}|{B}(?:public\s+)?enum\s+([A-Za-z_]\w*){E}"
TEST = rf"{B}(?:describe|it|test)(?:\.(?:only|skip|todo))?\s*\(\s*({Q})([^'\"`]+)\1"
COMMAND = rf"\.(?:command|commandDir)\s*\(\s*({Q})([^'\"`\s)]+)\1|{B}command\s*:\s*({Q})([^'\"`]+)\3"
SWITCH_COMMAND = rf"^\s*case\s+{Q}([a-z0-9][\w:-]*){Q}\s*:"
OPTION = rf"\.(?:option|requiredOption)\s*\(\s*({Q})([^'\"`]*--[A-Za-z0-9][\w-]*)[^'\"`]*\1|(?:^|\s)(--[A-Za-z0-9][\w-]*){E}"
CONFIG_KEY = r"^\s*[\"']?([A-Za-z_][\w.-]*)[\"']?\s*[:=]"
SCRIPT_LINE, SCRIPTS = r'^\s*"([^"]+)":\s*"[^"]*"', r'"scripts"\s*:'
ROUTE = (
    rf"(?i){B}(?:app|router|server|fastify)\s*\.\s*(get|post|put|patch|delete|use|all)\s*\(\s*({Q})([^'\"`]+)\2|{B}(?:route|handler)\s*\(\s*({Q})([^'\"`]+)\4"
    rf"|{B}export\s+(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE){E}|@(app|router|api)\.(get|post|put|patch|delete|route)\s*\(\s*({Q})([^'\"`]+)\9"
    r"|@(GetMapping|PostMapping|PutMapping|PatchMapping|DeleteMapping|RequestMapping)\s*(?:\(\s*(?:value\s*=\s*)?[\"']([^\"']+)[\"'])?|@(HttpGet|HttpPost|HttpPut|HttpPatch|HttpDelete)\s*(?:\(\s*[\"']([^\"']+)[\"'])?"
)
HANDLER = rf"{B}(?:export\s+)?(?:async\s+)?(?:function|class|const)\s+([A-Za-z_$][\w$]*(?:Controller|Handler|Route)){E}"
SQL_KINDS: list[tuple[str, str]] = [
    ("schema_changed", rf"(?i){B}(create|alter|drop)\s+table{E}"),
    ("index_changed", rf"(?i){B}(create|drop)\s+(?:unique\s+)?index{E}"),
    ("query_changed", rf"(?i){B}(select|insert\s+into|update|delete\s+from){E}"),
]
#: Which files the extractors look at, on lower-cased paths (fixed values).
CODE_FILE = r"\.(tsx?|jsx?|py|java|kt|cs)$"
CLI_FILE = r"(^|/)(cli|commands?)(/|$)|(^|/)bin(/|$)|cli\.[jt]sx?$"
CONFIG_FILE = r"(^|/)\.env|environment|config|\.json$|\.ya?ml$|\.toml$|\.ini$"
SQL_FILE = r"\.(sql|prisma)$|(^|/)(migrations?|db|database|schema)(/|$)"
TEST_FILE = r"(\.spec\.|\.(test|tests)\.)|(^|/)__tests__(/|$)|(^|/)tests?(/|$)"
FIXTURE_FILE = r"(^|/)(fixtures?|testdata|test-data|__fixtures__)(/|$)"


def _stripped(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^a/", ""), "^b/", "")


def split_files(diffs: DataFrame, keys: list[str], diff: str = "diff") -> DataFrame:
    """One row per file of each diff: file_ord, file_path, old_path, status, counts, lines (pos, kind, text).

    Lines are numbered, a running count of file headers numbers the files, and one
    aggregation per file does the rest.
    """
    lines = diffs.select(*keys, F.posexplode(F.split(F.col(diff), "\n")).alias("pos", "line"))
    line, starts = F.col("line"), F.col("line").startswith
    numbered = lines.withColumn("file_ord", F.sum(starts("diff --git ").cast("int")).over(Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))).where("file_ord > 0")
    header = r"^diff --git (.+) (.+)$"
    quoted = lambda n: _stripped(F.regexp_replace(F.regexp_extract(line, header, n), '^"|"$', ""))
    kind = F.when(starts("+++") | starts("---"), None).when(starts("+"), "added").when(starts("-"), "deleted").when(starts(" "), "context")
    new = F.when(starts("rename to "), F.trim(F.substring(line, F.lit(11), F.length(line)))).when(starts("+++ ") & (F.trim(F.substring(line, F.lit(5), F.length(line))) != "/dev/null"), _stripped(F.trim(F.substring(line, F.lit(5), F.length(line))))).when(starts("diff --git "), F.when(line.rlike(header), quoted(2)).otherwise("unknown"))
    old = F.when(starts("rename from "), F.trim(F.substring(line, F.lit(13), F.length(line)))).when(starts("--- ") & (F.trim(F.substring(line, F.lit(5), F.length(line))) != "/dev/null"), _stripped(F.trim(F.substring(line, F.lit(5), F.length(line))))).when(starts("diff --git "), F.when(line.rlike(header), quoted(1)).otherwise("unknown"))
    status = F.when(starts("new file mode"), "added").when(starts("deleted file mode"), "deleted").when(starts("rename from ") | starts("rename to "), "renamed")
    marked = numbered.select(*keys, "file_ord", "pos", "line", kind.alias("kind"), new.alias("new"), old.alias("old"), status.alias("status"))
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("pos"))
    files = marked.groupBy(*keys, "file_ord").agg(
        F.max_by("new", at("new")).alias("file_path"), F.max_by("old", at("old")).alias("old"), F.coalesce(F.max_by("status", at("status")), F.lit("modified")).alias("status"),
        F.count_if(F.col("kind") == "added").alias("added_lines"), F.count_if(F.col("kind") == "deleted").alias("deleted_lines"),
        F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("pos", "kind", F.substring(line, F.lit(2), F.length(line)).alias("text"))))).alias("lines"),
    )
    return files.withColumn("old_path", F.when(F.col("old") != F.col("file_path"), F.col("old"))).drop("old")


def added_text(lines: Column) -> Column:
    return F.transform(F.filter(lines, lambda x: x["kind"] == "added"), lambda x: x["text"])


def _first(line: Column, pattern: str, groups: list[int]) -> Column:
    return F.coalesce(*(F.nullif(F.trim(F.regexp_extract(line, pattern, g)), F.lit("")) for g in groups))


def _one_each(lines: Column, pattern: str, groups: list[int]) -> Column:
    """At most one value a line, from the first match's first group that holds one."""
    return F.filter(F.transform(lines, lambda x: _first(x, pattern, groups)), lambda v: v.isNotNull())


def _all(lines: Column, pattern: str, groups: list[int]) -> Column:
    """All matches of every line, each by its first group that holds one."""
    def group(g: int) -> Column:
        return F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(pattern), F.lit(g))))

    per = [group(g) for g in groups]
    merged = per[0]
    for more in per[1:]:
        merged = F.zip_with(merged, more, lambda a, b: F.when(a != "", a).otherwise(b))
    return F.transform(merged, lambda x: F.trim(x))


def _when(condition: Column, values: Column) -> Column:
    return expr.distinct_sorted(F.when(condition, values).otherwise(F.array().cast("array<string>")))


def _method(annotation: Column) -> Column:
    lower = F.lower(annotation)
    return F.when(annotation == "", None).when(F.contains(lower, F.lit("post")), "POST").when(F.contains(lower, F.lit("put")), "PUT").when(F.contains(lower, F.lit("patch")), "PATCH").when(F.contains(lower, F.lit("delete")), "DELETE").when(F.contains(lower, F.lit("get")), "GET").otherwise("ROUTE")


def route_values(line: Column) -> Column:
    g = lambda n: F.regexp_extract(line, ROUTE, n)
    some = lambda *cols: F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))
    method = F.coalesce(F.nullif(F.upper(g(1)), F.lit("")), F.nullif(F.upper(g(8)), F.lit("")), _method(F.coalesce(some(g(11), g(13)), F.lit(""))), F.lit("HANDLER"))
    route = F.when(g(6) != "", F.concat(F.upper(g(6)), F.lit(" handler"))).when(line.rlike(ROUTE), F.concat(method, F.lit(" "), F.coalesce(some(g(3), g(5), g(10), g(12), g(14)), method)))
    handler = F.nullif(F.regexp_extract(line, HANDLER, 1), F.lit(""))
    return F.filter(F.array(route, F.concat(F.lit("handler "), handler)), lambda v: v.isNotNull())


def changed_scripts(lines: Column) -> Column:
    """Scripts added within eight lines after, or one before, a line that opens "scripts"."""
    near = lambda i: F.exists(F.slice(lines, F.greatest(i - 7, F.lit(1)), F.lit(9) + F.least(i - 8, F.lit(0)) + 1), lambda x: x["text"].rlike(SCRIPTS))
    value = F.transform(lines, lambda x, i: F.when((x["kind"] == "added") & near(i), F.nullif(F.regexp_extract(x["text"], SCRIPT_LINE, 1), F.lit(""))))
    return F.filter(value, lambda v: v.isNotNull())


def with_features(files: DataFrame) -> DataFrame:
    """Adds the eleven lists of a file's diff and its sql signals, each distinct and sorted."""
    lines, added = F.col("lines"), added_text(F.col("lines"))
    lower = F.lower(F.col("file_path"))
    code, cli = lower.rlike(CODE_FILE), lower.rlike(CLI_FILE)
    exports = F.filter(F.transform(added, lambda x: F.when(x.rlike(EXPORT), F.concat_ws(" ", F.regexp_extract(x, EXPORT, 1), F.regexp_extract(x, EXPORT, 2)))), lambda v: v.isNotNull())
    commands = F.concat(_all(added, COMMAND, [2, 4]), _one_each(added, SWITCH_COMMAND, [1]))
    sql = F.flatten(F.transform(added, lambda x: F.filter(F.array(*(F.when(x.rlike(p), F.lit(n)) for n, p in SQL_KINDS)), lambda v: v.isNotNull())))
    return files.select(
        "*",
        _when(code, exports).alias("exports"), _when(code, _one_each(added, FUNCTION, [1, 2, 3])).alias("functions"), _when(code, _one_each(added, CLASS, [1, 2])).alias("classes"),
        _when(code, _one_each(added, TYPE, [1, 2])).alias("types"), _when(code, _one_each(added, ENUM, [1, 2])).alias("enums"), _when(F.lit(True), _all(added, TEST, [2])).alias("tests"),
        _when(cli, commands).alias("cli_commands"), _when(cli, _all(added, OPTION, [2, 3])).alias("cli_options"), _when(expr.base_name(F.col("file_path")) == "package.json", changed_scripts(lines)).alias("scripts"),
        _when(lower.rlike(CONFIG_FILE), _one_each(added, CONFIG_KEY, [1])).alias("config_keys"), _when(~lower.rlike(TEST_FILE) & ~lower.rlike(FIXTURE_FILE), F.flatten(F.transform(added, route_values))).alias("routes"),
        _when(lower.rlike(SQL_FILE), sql).alias("sql_signals"),
    )


#: Signal types of the lists in the order in which signals are emitted; None: decided by the value.
SIGNAL_ORDER: list[tuple[str, str | None]] = [
    ("exports", "exported_symbol_added"),
    ("functions", "function_added"),
    ("classes", None),
    ("types", "interface_or_type_added"),
    ("enums", "enum_added"),
    ("tests", "test_case_added"),
    ("cli_commands", "cli_command_changed"),
    ("cli_options", "cli_command_changed"),
    ("scripts", "package_script_changed"),
    ("config_keys", "config_changed"),
    ("routes", None),
    ("sql_signals", None),
]


def diff_signals(files: DataFrame, keys: list[str]) -> DataFrame:
    """One row per signal: keys, file_ord, sig_ord, type, value, file_path."""
    def typed(name: str, kind: str | None) -> Column:
        def one(v: Column) -> Column:
            lower = F.lower(v)
            if name == "classes":
                t, value = F.when(lower.endswith("controller"), "controller_changed").otherwise("class_added"), v
            elif name == "routes":
                handler = lower.endswith(" handler") | lower.startswith("handler ") | F.contains(lower, F.lit("controller"))
                t, value = F.when(handler, "controller_changed").otherwise("api_route_changed"), v
            elif name == "sql_signals":
                t, value = v, F.regexp_replace(v, "_", " ")
            else:
                t, value = F.lit(kind), v
            return F.struct(t.alias("type"), value.alias("value"))

        return F.transform(F.col(name), one)

    every = F.concat(*(typed(n, k) for n, k in SIGNAL_ORDER))
    return files.select(*keys, "file_ord", "file_path", F.posexplode(every).alias("sig_ord", "s")).select(*keys, "file_ord", "sig_ord", "s.type", "s.value", "file_path")
