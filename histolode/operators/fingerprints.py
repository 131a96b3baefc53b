"""Source fingerprints: imports, symbols, routes, options, models, tags, technologies, roles and concepts of a text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr, rules
from .classify import file_role
from .diff import B, E
from .sources import readable

ID = r"[A-Za-z_]\w*"
#: What the lists are read from: (pattern, group), extension or None (fixed values, borders as ASCII look-arounds).
IMPORTS: list[tuple[str, int, str | None]] = [
    (rf"{B}import\s+(?:[^'\";]+?\s+from\s+)?[\"']([^\"']+)[\"']", 1, None),
    (rf"{B}require\([\"']([^\"']+)[\"']\)", 1, None),
    (rf"(?m)^\s*from\s+([\w.]+)\s+import{E}", 1, None),
    (rf"(?m)^\s*import\s+([\w.]+){E}", 1, None),
    (r"(?m)^\s*import\s+([\w.*]+);", 1, None),
    (r"(?m)^\s*use\s+([\w:]+)(?:;|::)", 1, ".rs"),
]
EXPORTED: list[tuple[str, int, str | None]] = [
    (rf"{B}export\s+(?:default\s+)?(?:abstract\s+)?(?:class|function|interface|type|enum|const|let|var)\s+({ID})", 1, None),
    (rf"{B}pub\s+(?:struct|enum|fn|trait)\s+({ID})", 1, ".rs"),
]
CLASSES: list[tuple[str, int, str | None]] = [(rf"{B}class\s+({ID})", 1, None), (rf"{B}struct\s+({ID})", 1, ".rs")]
TYPES: list[tuple[str, int, str | None]] = [(rf"{B}interface\s+({ID})", 1, None), (rf"{B}type\s+({ID})", 1, None), (rf"{B}trait\s+({ID})", 1, ".rs")]
FUNCTIONS: list[tuple[str, int, str | None]] = [
    (rf"{B}function\s+({ID})", 1, None),
    (rf"{B}(?:const|let|var)\s+({ID})\s*=\s*(?:async\s*)?\([^)]*\)\s*=>", 1, None),
    (rf"(?m)^\s*(?:async\s+)?({ID})\s*\([^)]*\)\s*(?::[^{{]+)?\{{", 1, None),
    (rf"(?m)^\s*def\s+({ID})\s*\(", 1, ".py"),
    (rf"{B}fn\s+({ID})\s*\(", 1, ".rs"),
]
NO_FUNCTIONS = ["if", "for", "while", "switch", "catch"]
TESTS: list[tuple[str, int, str | None]] = [(rf"{B}(?:describe|it|test)\s*\(\s*[\"'`]([^\"'`]+)[\"'`]", 1, None)]
ANNOTATIONS: list[tuple[str, int, str | None]] = [(rf"@({ID})", 1, None), (rf"#\[\s*({ID})", 1, None)]
DECORATORS: list[tuple[str, int, str | None]] = [(rf"@({ID})\s*(?:\(|\n)", 1, None)]
ROUTES: list[tuple[str, int, str | None]] = [
    (rf"(?i){B}(?:router|app|server)\.(?:get|post|put|patch|delete|use)\s*\(\s*[\"'`]([^\"'`]+)[\"'`]", 1, None),
    (r"@(?:app|router)\.(?:get|post|put|patch|delete)\s*\(\s*[\"']([^\"']+)[\"']", 1, None),
]
ANNOTATED_ROUTE = r"@(Get|Post|Put|Patch|Delete|RequestMapping)\s*\(\s*(?:value\s*=\s*)?[\"']([^\"']+)[\"']"
OPTIONS: list[tuple[str, int, str | None]] = [
    (r"\.option\s*\(\s*[\"'`]([^\"'`]+)[\"'`]", 1, None),
    (r"(?i)--[a-z][\w-]+", 0, None),
    (r"@Option\s*\(\s*(?:name\s*=\s*)?[\"']([^\"']+)[\"']", 1, None),
    (rf"#\[\s*(?:arg|clap){E}[^\]]*\]", 0, ".rs"),
    (rf"{B}Arg::new\s*\(\s*[\"']([^\"']+)[\"']", 1, ".rs"),
]
MODELS: list[tuple[str, int, str | None]] = [
    (rf"@(?:Entity|Table){E}", 0, None),
    (rf"{B}model\s+({ID})\s*\{{", 1, None),
    (rf"(?i){B}CREATE\s+TABLE\s+([A-Za-z_][\w.]*)", 1, None),
]
JVM_MODEL = rf"{B}(?:extends\s+JpaRepository|CrudRepository|Repository<)"
MIGRATION_TEXT = r"(?i)migration|migrations|schema"
MIGRATION, MIGRATION_CALL = rf"(?i){B}(CREATE|ALTER|DROP)\s+(TABLE|INDEX){E}", rf"{B}(createTable|alterTable|addColumn|dropColumn|createIndex){E}"
TAG_TEXT, TAG = r"(?i)@Component|template\s*:|<template", rf"(?i)<([a-z][\w-]*){E}"
TAG_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".vue"]

#: Technologies: text pattern, import pattern, frameworks, libraries, roles, concepts (fixed values).
TECHNOLOGIES: list[tuple[str | None, str | None, list[str], list[str], list[str], list[str]]] = [
    (rf"@Component{E}|templateUrl{E}|standalone\s*:|{B}inject\s*\(|{B}signal\s*\(", "@angular/", ["angular"], [], ["ui", "component"], []),
    (rf"{B}useState\s*\(|{B}useEffect\s*\(|from\s+[\"']react[\"']", "^react$", ["react"], [], ["ui", "component"], []),
    (rf"{B}defineComponent\s*\(|<template{E}", None, ["vue"], [], ["ui", "component"], []),
    (r"kendo-grid|GridDataResult|GridModule", "(?i)kendo", [], ["kendo-angular-grid"], ["ui", "grid"], ["grid", "columns"]),
    (r"ag-grid|AgGrid", "(?i)ag-grid", [], ["ag-grid"], ["ui", "grid"], ["grid", "columns"]),
    (r"mat-table|MatTable|MatTableModule", "(?i)material", [], ["material"], ["ui"], ["table"]),
    (rf"@RestController{E}|@Controller{E}", None, ["spring"], [], ["api", "controller"], ["rest", "controller"]),
    (rf"@Service{E}", None, ["spring"], [], ["service"], []),
    (rf"{B}Router\s*\(|{B}express\s*\(|from\s+[\"']express[\"']|require\([\"']express[\"']\)", None, ["express"], [], ["api", "route"], ["api", "route"]),
    (rf"{B}APIRouter\s*\(|from\s+fastapi\s+import", None, ["fastapi"], [], ["api", "route"], ["api", "route"]),
    (rf"(?i){B}prisma{E}", "(?i)prisma", [], ["prisma"], ["database"], ["model", "query"]),
    (rf"@Entity{E}|(?i:typeorm)", "(?i)typeorm", [], ["typeorm"], ["database"], ["entity", "model"]),
    (rf"@Entity{E}|JpaRepository|CrudRepository", None, [], ["jpa"], ["database", "repository"], ["entity", "repository"]),
]
RUST_TEXT, RUST_IMPORT = rf"(?i){B}clap{E}|{B}structopt{E}|{B}argh{E}|#\[\s*(?:arg|clap)", "^(clap|structopt|argh)$"
#: Concepts of words in the lower-cased text (fixed values).
WORD_CONCEPTS: list[tuple[str, list[str]]] = [
    (rf"{B}(export|download|csv|xlsx){E}", ["export"]),
    (rf"{B}(page|paging|paginate|pagination){E}", ["paging", "pagination"]),
    (rf"{B}(sort|sorting|sortable){E}", ["sorting"]),
    (rf"{B}(filter|filtering|search){E}", ["filter", "search"]),
]
#: Roles of lower-cased paths (fixed values).
PATH_ROLES: list[tuple[str, list[str]]] = [
    (r"(^|/)(components?|pages?|screens?|views?|ui|web|frontend)(/|$)|\.(tsx|jsx|vue)$", ["ui"]),
    (r"(^|/)(commands?|cmd|cli)(/|$)", ["cli"]),
    (r"(^|/)(controllers?|routes?|handlers?)(/|$)", ["api", "controller"]),
    (r"(^|/)(services?)(/|$)", ["service"]),
    (r"(^|/)(repositories?|dao)(/|$)", ["repository"]),
    (r"(^|/)(migrations?|schema|models?|entities?)(/|$)|\.(sql|prisma)$", ["database"]),
]


def _none() -> Column:
    return F.array().cast("array<string>")


def _list(*names: str) -> Column:
    return F.array(*map(F.lit, names)) if names else _none()


def read(text: Column, extension: Column, table: list[tuple[str, int, str | None]]) -> Column:
    """All groups of all patterns that apply to the extension, in order."""
    found = []
    for pattern, group, only in table:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        found.append(values if only is None else F.when(extension == only, values).otherwise(_none()))
    return F.concat(*found)


def concept(term: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for pair in rules.CONCEPT_SYNONYMS.items() for x in pair))
    return F.coalesce(pairs[term], F.lower(term))


def component_tags(text: Column, extension: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(TAG), F.lit(1)), lambda t: F.lower(t))
    kept = F.filter(found, lambda t: F.contains(t, F.lit("-")) | ~t.isin(rules.COMMON_TAGS))
    return expr.distinct_sorted(F.when(extension.isin(TAG_EXTENSIONS) | text.rlike(TAG_TEXT), kept).otherwise(_none()))


def libraries_of(imports: Column) -> Column:
    def one(x: Column) -> Column:
        parts = F.split(x, "/")
        return F.when(x.startswith("@"), F.when(F.size(parts) >= 2, F.concat_ws("/", parts[0], parts[1])).otherwise(x)).otherwise(F.split(x, "[/.]")[0])

    return expr.distinct_sorted(F.transform(imports, one))


def migration_operations(text: Column, extension: Column) -> Column:
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(MIGRATION), F.lit(1)), F.regexp_extract_all(text, F.lit(MIGRATION), F.lit(2)), lambda a, b: F.lower(F.concat_ws(" ", a, b)))
    return expr.distinct_sorted(F.when((extension == ".sql") | text.rlike(MIGRATION_TEXT), F.concat(pairs, F.regexp_extract_all(text, F.lit(MIGRATION_CALL), F.lit(1)))).otherwise(_none()))


def fingerprint(sources: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Adds the lists of a fingerprint to (path, text); unreadably long texts are left out."""
    rows = sources.where(readable(F.col(text)))
    t, ext = F.col(text), F.col("extension")
    sorted_read = lambda table: expr.distinct_sorted(F.transform(read(t, ext, table), lambda v: F.trim(v)))
    annotated = F.zip_with(F.regexp_extract_all(t, F.lit(ANNOTATED_ROUTE), F.lit(1)), F.regexp_extract_all(t, F.lit(ANNOTATED_ROUTE), F.lit(2)), lambda a, b: F.concat_ws(" ", a, b))
    routes = expr.distinct_sorted(F.concat(read(t, ext, ROUTES), annotated, F.when((ext == ".py") & t.rlike(r"APIRouter\s*\("), _list("APIRouter")).otherwise(_none())))
    jvm = F.when(ext.isin(".java", ".kt"), F.regexp_extract_all(t, F.lit(JVM_MODEL), F.lit(0))).otherwise(_none())
    first = rows.withColumn("extension", expr.ext_name(F.col(path))).select(
        "*", sorted_read(IMPORTS).alias("imports"), sorted_read(EXPORTED).alias("exported_symbols"), sorted_read(CLASSES).alias("class_names"), sorted_read(TYPES).alias("type_names"),
        expr.distinct_sorted(F.filter(read(t, ext, FUNCTIONS), lambda f: ~f.isin(NO_FUNCTIONS))).alias("function_names"), sorted_read(TESTS).alias("test_names"), sorted_read(ANNOTATIONS).alias("annotations"), sorted_read(DECORATORS).alias("decorators"),
        routes.alias("routes"), expr.distinct_sorted(read(t, ext, OPTIONS)).alias("cli_options"), expr.distinct_sorted(F.concat(read(t, ext, MODELS), jvm)).alias("schema_models"),
        migration_operations(t, ext).alias("migrations"), component_tags(t, ext).alias("component_tags"),
    )
    return _technologies(first.withColumn("own_libraries", libraries_of(F.col("imports"))), path, text)


def _technologies(rows: DataFrame, path: str, text: str) -> DataFrame:
    t, lower, p = F.col(text), F.lower(F.col(text)), F.lower(F.col(path))
    imported = F.concat("imports", "own_libraries")
    has = lambda pattern: F.exists(imported, lambda x: x.rlike(pattern))
    sets: dict[str, list[Column]] = {"frameworks": [], "libraries": [F.col("own_libraries")], "roles": [], "concepts": []}

    def add(condition: Column, frameworks: list[str], libraries: list[str], roles: list[str], concepts: list[str]) -> None:
        for name, values in zip(sets, (frameworks, libraries, roles, concepts), strict=True):
            if values:
                sets[name].append(F.when(condition, _list(*values)).otherwise(_none()))

    for k, (in_text, in_imports, *values) in enumerate(TECHNOLOGIES):
        conditions = ([t.rlike(in_text)] if in_text else []) + ([has(in_imports)] if in_imports else []) + ([F.col("extension") == ".tsx"] if k == 1 else [])
        add(reduce(lambda a, b: a | b, conditions), *values)
    rust = t.rlike(RUST_TEXT) | has(RUST_IMPORT)
    add(rust, ["rust"], [], ["cli"], ["command", "option"])
    sets["libraries"].append(F.when(rust, F.array(F.when(t.rlike("(?i)structopt"), "structopt").when(t.rlike("(?i)argh"), "argh").otherwise("clap"))).otherwise(_none()))
    some = lambda name: F.size(name) > 0
    add(some("routes"), [], [], ["api", "route"], [])
    add(some("cli_options") | p.rlike(PATH_ROLES[1][0]), [], [], ["cli"], [])
    add(some("schema_models") | some("migrations"), [], [], ["database"], [])
    add(some("component_tags"), [], [], ["ui", "component"], [])
    add(some("test_names") | (file_role(F.col(path)) == "test"), [], [], ["test"], [])
    sets["roles"].append(expr.tags(p, PATH_ROLES))
    sets["concepts"].append(expr.tags(lower, WORD_CONCEPTS))
    whole = F.concat_ws("\n", p, lower)
    sets["concepts"].append(F.filter(F.array(*(F.when(whole.rlike(f"{B}{c}{E}"), concept(F.lit(c))) for c in rules.CONCEPT_TERMS)), lambda v: v.isNotNull()))
    symbols = F.flatten(F.transform(F.concat("exported_symbols", "class_names", "type_names", "function_names"), lambda s: F.transform(expr.split_identifier(s), concept)))
    sets["concepts"].append(F.filter(symbols, lambda s: s.isin(rules.CONCEPT_TERMS)))
    masked = F.transform(F.col("routes"), lambda r: F.lower(F.regexp_replace(F.regexp_replace(r, "/:[^/]+", "/:param"), r"\{[^}]+\}", "{param}")))
    return rows.select(
        "*", *(expr.distinct_sorted(F.concat(*v)).alias(n) for n, v in sets.items()),
        expr.distinct_sorted(F.filter(symbols, lambda s: ~s.isin(rules.ENTITY_WORDS))).alias("symbol_patterns"), expr.distinct_sorted(masked).alias("route_patterns"),
        expr.distinct_sorted(F.flatten(F.transform(F.col("test_names"), lambda s: F.transform(expr.split_identifier(s), concept)))).alias("test_patterns"),
    ).drop("own_libraries")


def eligible(prints: DataFrame, path: str = "path") -> DataFrame:
    """Fingerprints that may found a family: no tests, two features at least."""
    features = sum((F.size(c) for c in ("frameworks", "libraries", "roles", "concepts", "component_tags", "routes", "cli_options", "schema_models")), F.lit(0))
    return prints.where((file_role(F.col(path)) != "test") & (features >= 2))
