"""Task names and descriptions of candidates, from their area, signals, files, terms and learned surface."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import expr
from .classify import is_noisy
from .workflow import TEST_FILE

#: Words that name no feature (fixed values).
NAMING_NOISE = [
    "add", "added", "adds", "update", "updated", "updates", "fix", "fixed", "fixes", "improve", "improved", "improves", "refactor", "refactored", "action", "actions", "all", "change", "changes", "support",
    "compatible", "compatibility", "aicompatible", "repo", "root", "workspace", "workspaces", "project", "projects", "app", "apps", "error", "errors", "the", "and", "for", "with", "from", "into", "use", "using",
    "without", "this", "that", "build", "built", "create", "creates", "created", "delete", "deleted", "remove", "removed", "save", "saved", "saves", "load", "loaded", "run", "runs", "running", "fetch", "fetched",
    "get", "set", "post", "put", "patch", "render", "rendered", "renders", "return", "returns", "should", "file", "files", "test", "tests", "unit", "integration", "e2e", "spec", "src", "index", "utils", "util",
    "helper", "helpers", "fixture", "fixtures", "generated", "snapshot", "snapshots", "baseline", "baselines", "replay", "coverage", "dist", "expected", "actual", "json", "component", "components", "service",
    "services", "controller", "controllers", "repository", "repositories", "route", "routes", "model", "models", "entity", "entities", "migration", "migrations", "schema", "persistence", "persist", "config",
    "configuration", "pattern", "feature", "backend", "frontend", "server", "client", "web", "ui", "lib", "core", "common", "shared", "public", "database", "docs", "readme", "function", "class", "interface", "type",
    "cli", "command", "commands", "option", "options", "flag", "flags", "page", "pages", "screen", "screens", "view", "views",
]
#: Words that a surface of a kind is made of anyway (fixed values).
KIND_WORDS: dict[str, list[str]] = {
    "ui": ["ui", "web", "frontend", "client", "api", "component", "components", "page", "pages", "screen", "screens", "view", "views"],
    "api": ["api", "route", "routes", "server", "handler", "handlers", "controller", "controllers"],
    "database": ["db", "database", "schema", "schemas", "migration", "migrations", "model", "models"],
    "config": ["config", "configs", "runtime", "build", "infra"],
    "docs": ["docs", "documentation"],
    "tests": ["test", "tests", "spec", "specs"],
}
#: Names by kind of surface: with its domain, without (fixed values).
SURFACE_NAMES: dict[str, tuple[str, str]] = {
    "ui": ("Update %s UI", "Update UI"),
    "api": ("Update %s API Behavior", "Update API Behavior"),
    "database": ("Update %s Database Schema", "Update Database Schema"),
    "config": ("Update %s Runtime Configuration", "Update Runtime Configuration"),
    "docs": ("Update %s Documentation", "Update Documentation"),
    "tests": ("Update %s Tests", "Update Tests"),
}
#: Names by area: with a feature, without (fixed values).
TASK_NAMES: dict[str, tuple[str, str]] = {
    "frontend": ("Update %s UI", "Update UI Component"),
    "cli": ("Add or Update %s CLI Workflow", "Add CLI Command"),
    "backend api": ("Update %s Backend API Behavior", "Update Backend API Behavior"),
    "backend async": ("Add or Update %s Async Job or Event Handler", "Add or Update Async Job or Event Handler"),
    "backend": ("Update %s Backend Behavior", "Update Backend Behavior"),
    "db": ("Add or Update %s Database-Backed Feature", "Add Database-Backed Feature"),
    "infra ci": ("Update %s Build or CI Configuration", "Update Build or CI Configuration"),
    "infra": ("Update %s Runtime Configuration", "Update Runtime Configuration"),
    "docs": ("Update %s Documentation", "Update Project Documentation"),
    "tests": ("Update %s Tests", "Update Tests"),
    "other": ("Update %s Change Workflow", "Update Engineering Workflow"),
}
#: Descriptions by area: subject with a feature, without, and the sentence around it (fixed values).
DESCRIPTIONS: dict[str, tuple[str, str, str]] = {
    "frontend": ("%s UI", "UI component or screen", "Use this for %s changes involving components, screens, API client wiring, or related UI tests."),
    "cli": ("%s CLI workflow", "CLI command", "Use this for %s changes involving command registration, option parsing, handlers, and tests."),
    "backend api": ("%s backend", "backend", "Use this for %s API route, controller, service, handler, and test changes."),
    "backend": ("%s backend", "backend", "Use this for %s service, handler, middleware, and test changes."),
    "db": ("%s database-backed", "database-backed", "Use this for %s changes involving migrations, schema/model updates, queries, repositories, and tests."),
    "infra": ("%s runtime or build configuration", "runtime, build, CI, or infrastructure configuration", "Use this for %s changes with matching validation commands from the owning project."),
    "docs": ("%s documentation", "project documentation", "Use this for %s updates involving README, docs, changelog, or design-note files."),
    "tests": ("%s tests", "test coverage", "Use this for %s changes involving focused test cases, fixtures, and nearby source examples."),
}
OTHER_DESCRIPTION = "Use this for repeated repository changes where the examples and evidence show a concrete source/test workflow."
REPORTING_NAMES = ("Update Reporting Dashboard UI", "Add or Update Reporting Workbench UI")
REPORTING_DESCRIPTION = "Use this for reporting dashboard/workbench UI changes involving UI components, UI API wiring, and UI tests."
#: Areas that signals show, in order, when a candidate's own is mixed (fixed values).
SIGNAL_AREAS: list[tuple[str, list[str]]] = [
    ("frontend", ["ui_changed", "component_changed", "page_or_screen_changed", "style_changed", "frontend_test_changed"]),
    ("cli", ["cli_command_changed"]),
    ("backend", ["api_route_changed", "controller_changed", "service_layer_changed"]),
    ("db", ["migration_changed", "schema_changed", "model_or_entity_changed", "query_changed"]),
    ("infra", ["ci_changed", "config_changed", "docker_changed", "terraform_or_infra_changed"]),
    ("docs", ["docs_changed", "readme_changed", "adr_or_design_doc_changed"]),
]
KIND_AREAS = {"commands": "cli", "ui": "frontend", "api": "backend", "database": "db", "config": "infra", "docs": "docs", "tests": "tests"}
UI_FILE = r"(?i)(^|/)(ui|frontend|client|web)/src/(components?|pages?|screens?|views?|routes?|api)|(^|/)src/(components?|pages?|screens?|views?)(/|$)"
CLI_FILE = r"(^|/)(src/)?cli(/|\.|$)|(^|/)(commands?|cmd)(/|$)"
CLI_EXTENSION = r"\.(tsx?|jsx?|py|go|rs|cs|java|kt)$"
BROAD_CATEGORY = r"Repeated Engineering|Full-Stack|Change Pattern|Frontend Change|Backend Pattern|Configuration or Infrastructure"
STRONG = 0.65


def term_title(term: Column) -> Column:
    shown = F.when(term == "report", F.lit("Reporting")).otherwise(term)
    return F.array_join(F.transform(expr.present(F.split(shown, "-")), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def _titles(terms: Column) -> Column:
    return F.array_join(F.transform(terms, term_title), " ")


def _some(signals: Column, names: list[str]) -> Column:
    return F.arrays_overlap(signals, F.array(*map(F.lit, names)))


def _filled(key: Column, table: dict[str, tuple[str, str]], value: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (with_value, without) in table.items():
        out = F.when(key == name, F.when(value == "", F.lit(without)).otherwise(F.format_string(with_value, value))).otherwise(out)
    return out


def cli_source(path: Column) -> Column:
    lower = F.lower(path)
    return ~is_noisy(path) & ~lower.rlike(TEST_FILE) & lower.rlike(CLI_FILE) & lower.rlike(CLI_EXTENSION)


def feature_noun(terms: Column, files: Column, signals: Column, area: Column) -> Column:
    """What a candidate is about, "" if nothing stands out."""
    lowered, text = F.transform(terms, lambda t: F.lower(t)), F.lower(F.array_join(files, " "))
    commands = F.lower(F.array_join(F.filter(files, cli_source), " "))
    has = lambda *words: F.arrays_overlap(lowered, F.array(*map(F.lit, words))) | text.rlike("|".join(words))
    first = lambda *pairs: F.coalesce(*(F.when(c, F.lit(v)) for c, v in pairs))
    normal = lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9-]+", "")
    telling = F.filter(terms, lambda t: (F.length(normal(t)) >= 3) & ~normal(t).rlike(r"^\d+$") & ~normal(t).isin([*NAMING_NOISE, "api"]))
    report, heuristic = has("report", "reporting", "reports"), has("heuristic", "heuristics")
    named = first(
        (report & (area != "frontend") & has("audit"), "Audit Reporting"), (report, "Reporting"), (has("evidence") & heuristic, "Evidence Heuristics"), (heuristic & has("runtime"), "Runtime Heuristics"), (heuristic, "Heuristics"),
        (has("repair"), "Repair"), (has("crawl") & has("graph"), "Crawl Graph"), (has("grid", "table", "columns"), "Grid"), ((area == "docs") & (has("readme") | _some(signals, ["readme_changed"])), "Project"),
    )
    of_commands = first((commands.contains("repair"), "Repair"), (commands.contains("audit"), "Audit"), (commands.contains("report"), "Reporting"), (F.lit(True), ""))
    return F.when(area == "cli", of_commands).otherwise(F.coalesce(named, _titles(F.slice(telling, 1, 2))))


def surface_domain(kind: Column, source_terms: Column) -> Column:
    """Up to two source terms that its kind does not say already; commands have none."""
    plain = F.filter(source_terms, lambda t: ~t.isin("source", "workflow"))
    out = plain
    for name, words in KIND_WORDS.items():
        out = F.when(kind == name, F.filter(plain, _outside(words))).otherwise(out)
    return F.when(kind == "commands", F.array().cast("array<string>")).otherwise(F.slice(out, 1, 2))


def _outside(words: list[str]):
    return lambda t: ~t.isin(words)


def surface_base(directory: Column) -> Column:
    """The last two telling words of a directory."""
    terms = F.transform(expr.path_terms(directory), lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9-]+", ""))
    kept = F.filter(terms, lambda t: (F.length(t) >= 3) & ~t.rlike(r"^\d+$") & ~t.isin("src", "lib", "app", "apps", "source"))
    once = F.filter(kept, lambda t, i: ~F.exists(F.slice(kept, F.lit(1), i), lambda u: (u == t) | (expr.singular(u) == expr.singular(t)) | (u == expr.singular(t))))
    last = F.slice(once, F.greatest(F.size(once) - 1, F.lit(1)), F.lit(2))
    return F.when(F.size(once) == 0, F.lit("Repository Workflow")).otherwise(_titles(last))


def surface_name(kind: Column, source_terms: Column, directory: Column, signals: Column) -> Column:
    terms = surface_domain(kind, source_terms)
    domain, base = _titles(terms), surface_base(directory)
    ui = F.when(_some(terms, ["grid", "table", "columns", "column"]), F.lit("Update Grid UI")).when(_some(terms, ["report", "reporting", "reports"]), F.lit("Update Reporting UI"))
    other = F.when((domain != "") & ~F.contains(F.lower(base), F.lower(domain)), F.format_string("Update %s %s Workflow", domain, base)).otherwise(F.format_string("Update %s Workflow", base))
    commands = F.when(_some(signals, ["cli_command_changed"]), F.lit("Add CLI Command")).otherwise(F.lit("Update Commands"))
    return F.when(kind == "commands", commands).when((kind == "ui") & ui.isNotNull(), ui).otherwise(F.coalesce(_filled(kind, SURFACE_NAMES, domain), other))


def _strong(surface: Column) -> Column:
    return F.coalesce((surface["match_share"] >= STRONG) & (surface["confidence"] >= STRONG), F.lit(False))


def prefers_surface(surface: Column, area: Column, category: Column, signals: Column) -> Column:
    """Whether the surface names the task better than area, terms and files do."""
    telling = (surface["kind"] != "source-workflow") | (F.size(surface["source_terms"]) > 0) | (surface["confidence"] >= 0.8)
    vague = area.isin("unknown", "mixed", "tests") | category.rlike(BROAD_CATEGORY) | ~F.exists(signals, lambda s: ~s.rlike("(test|fixture)"))
    return surface.isNotNull() & F.when(_strong(surface), telling).otherwise(vague)


def _has_api(signals: Column, category: Column) -> Column:
    return _some(signals, ["api_route_changed"]) | F.contains(category, F.lit("API"))


def _area_key(area: Column, signals: Column, category: Column) -> Column:
    backend = F.when(_has_api(signals, category), "backend api").when(_some(signals, ["queue_or_event_handler_changed", "background_job_changed"]), "backend async").otherwise("backend")
    infra = F.when(_some(signals, ["ci_changed"]), "infra ci").otherwise("infra")
    return F.when(area == "backend", backend).when(area == "infra", infra).when(area.isin("frontend", "cli", "db", "docs", "tests"), area).otherwise(F.lit("other"))


def task_name(area: Column, signals: Column, files: Column, terms: Column, category: Column, surface: Column) -> Column:
    """surface: struct(kind, confidence, match_share, source_terms, directory, display_name, representative_files) or null."""
    feature = feature_noun(terms, files, signals, area)
    workbench = F.exists(F.concat(files, terms), lambda v: F.contains(F.lower(v), F.lit("workbench")))
    reporting = F.when(workbench, F.lit(REPORTING_NAMES[1])).otherwise(F.lit(REPORTING_NAMES[0]))
    by_area = F.when((area == "frontend") & (feature == "Reporting"), reporting).otherwise(_filled(_area_key(area, signals, category), TASK_NAMES, feature))
    return F.when(prefers_surface(surface, area, category, signals), surface_name(surface["kind"], surface["source_terms"], surface["directory"], signals)).otherwise(by_area)


def effective_area(area: Column, signals: Column, files: Column, surface: Column) -> Column:
    """A mixed or unknown area narrowed by the surface's kind, the signals and the files."""
    kinds = F.create_map(*(F.lit(x) for pair in KIND_AREAS.items() for x in pair))
    by_signal = F.lit(None).cast("string")
    for name, names in reversed(SIGNAL_AREAS):
        shown = _some(signals, names)
        if name == "frontend":
            shown = shown | F.exists(files, lambda f: f.rlike(UI_FILE))
        by_signal = F.when(shown, F.lit(name)).otherwise(by_signal)
    tests = F.when(F.exists(signals, lambda s: s.rlike("(test|fixture)")), F.lit("tests"))
    return F.when(area.isin("mixed", "unknown"), F.coalesce(F.when(_strong(surface), kinds[surface["kind"]]), by_signal, tests, area)).otherwise(area)


def task_description(name: Column, area: Column, signals: Column, files: Column, terms: Column, category: Column, surface: Column) -> Column:
    examples = F.array_join(F.transform(F.slice(surface["representative_files"], 1, 2), lambda f: expr.without_last_extension(expr.base_name(f))), ", ")
    of_surface = F.concat(F.lit("Use this for changes to the learned "), surface["display_name"], F.lit(" under "), surface["directory"], F.when(examples != "", F.concat(F.lit(", including examples like "), examples)).otherwise(F.lit("")), F.lit("."))
    own = effective_area(area, signals, files, surface)
    feature = feature_noun(terms, files, signals, own)
    words = F.transform(expr.present(F.split(feature, " ")), lambda w: F.when(w.isin("UI", "API", "CLI", "CI"), w).otherwise(F.lower(w)))
    phrase = F.array_join(words, " ")
    key = F.when((own == "backend") & _has_api(signals, category), F.lit("backend api")).otherwise(own)
    out = F.lit(OTHER_DESCRIPTION)
    for k, (with_value, without, sentence) in DESCRIPTIONS.items():
        subject = F.when(phrase == "", F.lit(without)).otherwise(F.format_string(with_value, phrase))
        out = F.when(key == k, F.format_string(sentence, subject)).otherwise(out)
    by_area = F.when(name.isin(*REPORTING_NAMES), F.lit(REPORTING_DESCRIPTION)).otherwise(out)
    return F.when(surface.isNotNull() & (prefers_surface(surface, area, category, signals) | category.rlike(r"Surface\z")), of_surface).otherwise(by_area)
