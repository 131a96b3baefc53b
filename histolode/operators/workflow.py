"""Surfaces in use: their kind, how well a cluster matches them, domain terms, neutral names, workflow actions and steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from ..functions.tables import Tables
from .classify import file_role, is_noisy

#: Kinds of a surface by its lower-cased paths, in order (fixed values).
KIND_PATHS: list[tuple[str, str]] = [
    ("commands", r"(^|/)(cli|commands?|cmd)(/|$)"),
    ("ui", r"(^|/)(ui|web|frontend|client)(/|$)|(^|/)src/(components?|pages?|screens?|views?)(/|$)"),
    ("database", r"(^|/)(migrations?|schemas?|database|db|models?|entities?)(/|$)"),
    ("api", r"(^|/)(server|api|routes?|controllers?|handlers?)(/|$)"),
    ("config", r"(^|/)(config|configs|infra|deploy|deployment)(/|$)"),
    ("docs", r"(^|/)(docs?|documentation)(/|$)|\.(md|mdx|rst|adoc)$"),
]
TEST_FILE = r"(\.spec\.|\.(test|tests)\.|_(test|spec)\.)|(^|/)(__tests__|tests?|specs?|e2e|playwright|cypress)(/|$)"
UI_SIGNALS = ["ui_changed", "component_changed", "page_or_screen_changed", "frontend_test_changed"]
CONFIG_SIGNALS = ["config_changed", "ci_changed", "docker_changed", "terraform_or_infra_changed", "deployment_changed"]
DATABASE_SIGNALS = ["db_changed", "migration_changed", "schema_changed", "model_or_entity_changed"]
#: Actions that a file's path, role, diff signals and words show, in order (fixed values).
PATH_ACTIONS: list[tuple[str, str]] = [
    ("added_test_case", TEST_FILE),
    ("changed_schema_or_model", r"(^|/)(models?|entities?|schema)(/|\.|$)"),
    ("changed_query_or_migration", r"(^|/)(migrations?|queries?)(/|$)|\.(sql|prisma)$"),
    ("updated_style", r"\.(css|scss|sass|less)$"),
]
STYLE_FILE = PATH_ACTIONS[3][1]
CLIENT_FILE = r"(^|/)(api|client|clients|services)/|(^|/)(api|client|clients|services)\.(tsx?|jsx?)$|api[-_.]?client"
CONTRACT_FILE = r"(^|/)(clients?|sdk|contracts?)(/|$)|api[-_.]?client"
COMPONENT_FILE, COMPONENT_FOLDER = r"\.(tsx?|jsx?|vue|svelte|html)$", r"(^|/)(components?|pages?|screens?|views?)(/|$)"
ROLE_ACTIONS = {"docs": "updated_docs", "fixture": "updated_fixture"}
WORD_ACTIONS: list[tuple[str, str]] = [
    ("changed_validation_logic", r"(validat|schema|zod|yup)"),
    ("changed_error_handling", r"(error|errors|exception|failure|fail|panic|throw|catch)"),
    ("changed_output_formatting", r"(output|format|formatter|print|render|display|serialize|export)"),
]
SIGNAL_ACTIONS: list[tuple[str, list[str]]] = [
    ("changed_package_script", ["package_script_changed"]),
    ("changed_config_key", ["config_changed"]),
    ("added_route_or_handler", ["api_route_changed", "controller_changed"]),
    ("changed_schema_or_model", ["schema_changed", "model_or_entity_changed"]),
    ("changed_query_or_migration", ["query_changed", "migration_changed"]),
    ("changed_validation_logic", ["validation_changed"]),
    ("added_function", ["function_added"]),
    ("added_type_or_interface", ["class_added", "interface_or_type_added", "enum_added"]),
]
#: Places of actions: usual, and by kind (fixed values).
ACTION_PLACES: dict[str, tuple[int, dict[str, int]]] = {
    "added_cli_option": (4, {"commands": 0}), "changed_cli_option": (5, {"commands": 1}), "added_route_or_handler": (6, {"api": 0}), "updated_component": (6, {"ui": 0}), "updated_api_client": (7, {"ui": 1}),
    "changed_schema_or_model": (8, {"database": 2, "api": 2}), "changed_query_or_migration": (8, {"database": 1}), "changed_validation_logic": (3, {}), "modified_function": (4, {}), "added_function": (5, {}), "added_type_or_interface": (6, {}),
    "changed_error_handling": (7, {}), "changed_output_formatting": (8, {}), "updated_style": (9, {"ui": 4}), "changed_config_key": (10, {}), "changed_package_script": (11, {}), "added_test_case": (12, {}), "updated_fixture": (13, {}), "updated_docs": (14, {"docs": 0}),
}
ACTIONS = list(ACTION_PLACES)
GROUPS = ["source", "test", "supporting"]
#: Labels of signals in neutral names, in order (fixed values).
AREA_LABELS: list[tuple[str, str]] = [
    ("UI", r"^(ui|component|page_or_screen|route_view|style|frontend)"),
    ("Backend", r"^(backend|api_route|controller|service_layer|repository_or_dao|middleware|auth|validation|serialization|background_job|queue_or_event_handler)"),
    ("CLI", r"^cli_command"),
    ("Test", r"(test|fixture)"),
    ("Database", r"^(db|migration|schema|model_or_entity|seed_data|query|index)"),
    ("Config", r"^(config|env|package_or_dependency|package_script|ci|docker|terraform_or_infra|deployment)"),
    ("Docs", r"^(docs|readme|adr_or_design_doc|changelog)"),
]


def surface_kind(paths: Column, signals: Column) -> Column:
    """Of a surface's directory and files (array) and the signals of its commits."""
    lower = F.transform(paths, lambda p: F.lower(p))
    seen = lambda pattern: F.exists(lower, lambda p: p.rlike(pattern))
    some = lambda names: F.arrays_overlap(signals, F.array(*map(F.lit, names)))
    extra = {"api": some(["api_route_changed"]), "config": some(CONFIG_SIGNALS), "database": seen(r"\.sql$")}
    out = F.when(F.forall(F.slice(lower, F.lit(2), F.size(lower)), lambda p: p.rlike(TEST_FILE)), F.lit("tests")).otherwise(F.lit("source-workflow"))
    for kind, pattern in reversed(KIND_PATHS):
        out = F.when(seen(pattern) | extra.get(kind, F.lit(False)), F.lit(kind)).otherwise(out)
    return out


def alignment(kind: Column, signals: Column) -> Column:
    some = lambda names: F.arrays_overlap(signals, F.array(*map(F.lit, names)))
    commands = F.when(some(["cli_command_changed"]), 0.05).otherwise(0.04)
    return F.when(kind == "commands", commands).when((kind == "ui") & some(UI_SIGNALS), 0.04).when((kind == "api") & some(["api_route_changed"]), 0.03).when((kind == "database") & some(DATABASE_SIGNALS), 0.03).otherwise(0.0)


def match_confidence(surface: Column, share: Column, overlap: Column, has_tests: Column, has_commands: Column, boost: Column) -> Column:
    score = surface * F.lit(0.42) + share * F.lit(0.34) + overlap * F.lit(0.16) + F.when(has_tests, 0.05).otherwise(0.0) + F.when(has_commands, 0.03).otherwise(0.0) + boost
    return expr.to_fixed2(F.least(F.lit(0.98), score))


def domain_terms(files: DataFrame, keys: list[str], commit: str, noise: list[str]) -> DataFrame:
    """Per cluster (keys): its terms seen in two commits at least, ranked, from the names of useful files.

    files: keys, commit, file_path.
    """
    useful = files.where(~is_noisy(F.col("file_path"))).select(*keys, commit, F.explode(expr.path_terms(F.col("file_path"))).alias("term"))
    clean = useful.where(~F.col("term").rlike(r"^\d+$") & ~F.col("term").isin(noise))
    sizes = files.groupBy(*keys).agg(F.count_distinct(commit).alias("commits"))
    counted = clean.groupBy(*keys, "term").agg(F.count_distinct(commit).alias("n")).join(sizes, keys).where(F.col("n") >= F.least(F.lit(2), F.col("commits")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), "term"))
    return counted.withColumn("rank", rank).where("rank <= 10")


def neutral_name(signals: Column, area: Column, share: Column, hint: Column, api: Column) -> Column:
    """A name for review that claims no task."""
    labels = F.filter(F.array(*(F.when(F.exists(signals, _matching(p)), F.when(api & F.lit(n == "Backend"), "Backend/API").otherwise(n)) for n, p in AREA_LABELS)), lambda v: v.isNotNull())
    tested = F.exists(signals, _matching("(test|fixture)"))
    mixed = area.isin("mixed", "unknown") | (share < 0.6) | (F.size(labels) > 2)
    two = F.array_join(F.slice(labels, 1, 2), "/")
    spaced = lambda *parts: F.concat_ws(" ", *parts)
    named = F.when(area == "docs", "Documentation Updates").when(area == "cli", F.when(tested, "CLI/Test Change Cluster").otherwise("CLI Change Cluster")).when(area == "backend", F.when(api, "Backend/API Change Cluster").otherwise("Backend Change Cluster"))
    named = named.when(area == "db", "Database Change Cluster").when(area == "infra", F.when(F.array_contains(signals, "fixture_changed"), "Config/Fixture Change Cluster").otherwise("Config Change Cluster"))
    named = named.when(area == "frontend", spaced(F.when(tested, "UI/Test").otherwise("UI"), hint, F.lit("Changes"))).when(area == "tests", "Test Change Cluster").otherwise("Mixed Change Cluster")
    return F.when(mixed, spaced(F.lit("Mixed"), F.when(two == "", "Change").otherwise(two), hint, F.lit("Changes"))).otherwise(named)


def _matching(pattern: str):
    return lambda s: s.rlike(pattern)


def path_facts(path: Column) -> dict[str, Column]:
    """What a file's actions and group depend on by its path alone; ``shows`` has the bits of the actions it shows."""
    lower, role = F.lower(path), file_role(path)
    checks = [(lower.rlike(p), a) for a, p in [*PATH_ACTIONS, *WORD_ACTIONS]] + [(role == r, a) for r, a in ROLE_ACTIONS.items()]
    return {
        "role": role, "noisy": is_noisy(path), "test": lower.rlike(TEST_FILE), "style": lower.rlike(STYLE_FILE), "client": lower.rlike(CLIENT_FILE), "contract": lower.rlike(CONTRACT_FILE),
        "component": lower.rlike(COMPONENT_FILE) & lower.rlike(COMPONENT_FOLDER), "shows": _bits(checks),
    }


def action_group(fact: Column, kind: Column, direct: Column, supports: Column) -> Column:
    """source, test or supporting; direct, supports: whether the file belongs to the surface, or is one of its tests and configs."""
    documents = (kind == "docs") & direct & (fact["role"] == "docs")
    return F.when(fact["test"], "test").when(documents, "source").when(supports | fact["role"].isin("docs", "config", "fixture"), "supporting").otherwise("source")


def _bits(checks: list[tuple[Column, str]]) -> Column:
    """The actions whose checks hold as bits of a long, by their place in ACTIONS."""
    out = F.lit(0).cast("long")
    for check, action in checks:
        out = out.bitwiseOR(F.when(check, F.lit(1 << ACTIONS.index(action)).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def _shows(bits: Column, i: int) -> Column:
    return F.shiftright(bits, i).bitwiseAND(F.lit(1).cast("long"))


def _says(text: Column, pattern: str) -> Column:
    """Whether a pattern of words alone, (a|b|c), matches; looking for the words is several times faster."""
    out = F.lit(False)
    for word in pattern.strip("()").split("|"):
        out = out | text.contains(word)
    return out


def row_actions(message: Column, found: Column, options: Column) -> Column:
    """The bits of what a changed file shows beside its path: its diff's signals and its words.

    found: array of (type, value) signals of the file; options: its diff adds command
    options.  changed_cli_option counts only where the surface's kind is commands.
    """
    types, values = found["type"], found["value"]
    words = F.lower(F.concat_ws(" ", message, F.array_join(values, " ")))
    flags = lambda flag: F.array_contains(types, "cli_command_changed") & F.exists(found, lambda s: (s["type"] == "cli_command_changed") & (s["value"].startswith("--") == flag))
    checks = [(F.array_contains(types, t), a) for a, names in SIGNAL_ACTIONS for t in names] + [(_says(words, p), a) for a, p in WORD_ACTIONS]
    return _bits([*checks, (options | flags(True), "added_cli_option"), (flags(False), "changed_cli_option")])


def file_actions(fact: Column, row: Column, kind: Column, changed: Column, group: Column) -> Column:
    """The bits of what a changed file shows: by its path and role, its row's ``row_actions`` and its surface's kind.

    fact: its ``path_facts``; changed: its diff has lines, or there is none.
    """
    usual = F.lit(~(1 << ACTIONS.index("changed_cli_option")))
    checks = [
        (F.when(kind == "api", fact["contract"]).otherwise(fact["client"]), "updated_api_client"), ((kind == "ui") & fact["component"], "updated_component"),
        (changed & (fact["role"] == "source") & (group == "source") & ~fact["style"], "modified_function"),
    ]
    shown = F.when(kind == "commands", row).otherwise(row.bitwiseAND(usual)).bitwiseOR(fact["shows"]).bitwiseOR(_bits(checks))
    return F.when(fact["noisy"], F.lit(0).cast("long")).otherwise(shown)


def action_place(action: Column, kind: Column) -> Column:
    out = F.lit(99)
    for name, (usual, by_kind) in ACTION_PLACES.items():
        place = F.lit(usual)
        for k, p in by_kind.items():
            place = F.when(kind == k, F.lit(p)).otherwise(place)
        out = F.when(action == name, place).otherwise(out)
    return out


def workflow_actions(files: DataFrame, keys: list[str], commit: str) -> DataFrame:
    """Per surface (keys) the actions of enough commits: count, five files, modal group and rank.

    files: keys, commit, file_path, message, kind, found, options, changed, direct, supports
    as in ``row_actions``, ``file_actions`` and ``action_group``; ordinal orders the commits,
    newest first.  Actions are bits of a row, so that rows are counted without a copy for
    each action.  Rows are made once, and their paths are judged beside them: a table of the
    paths' facts is small as a rule, and then no row is sent anywhere to meet its path's.
    """
    scratch = Tables(files.sparkSession, "workflow_actions")
    marks = row_actions(F.col("message"), F.col("found"), F.col("options")).alias("marks")
    rows = scratch.keep(files.select(*keys, F.col(commit).alias("commit"), "kind", "file_path", "ordinal", "changed", "direct", "supports", marks), "rows")
    paths = rows.select("file_path").distinct()
    facts = scratch.keep(paths.select(F.col("file_path").alias("path"), F.struct(*(c.alias(n) for n, c in path_facts(F.col("file_path")).items())).alias("fact")), "facts")
    placed = rows.join(facts, F.col("file_path").eqNullSafe(F.col("path"))).withColumn("group", action_group(F.col("fact"), F.col("kind"), F.col("direct"), F.col("supports")))
    shown = placed.withColumn("bits", file_actions(*(F.col(c) for c in ("fact", "marks", "kind", "changed", "group"))))

    def by_action(df: DataFrame, by: list[str], value, name: str) -> DataFrame:
        """A row for each action that has a value."""
        return df.select(*by, F.posexplode(F.array(*map(value, range(len(ACTIONS)))))).where("col is not null").select(*by, F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("pos") + 1).alias("action"), F.col("col").alias(name))

    def positive(i: int) -> Column:
        return F.when(F.col(f"n{i}") > 0, F.col(f"n{i}"))

    # commits of a surface of one kind are counted as they are; only those of others meet again
    kinds = scratch.keep(rows.select(*keys, "kind").distinct().withColumn("number", F.monotonically_increasing_id()), "kinds")
    numbered = shown.where("commit is not null").alias("a").join(kinds.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "kind"]])
    each = numbered.groupBy("number", "commit").agg(F.bit_or("bits").alias("bits"))
    sums = scratch.keep(each.groupBy("number").agg(F.count("*").alias("commits"), *(F.sum(_shows(F.col("bits"), i)).alias(f"n{i}") for i in range(len(ACTIONS)))).join(kinds, "number"), "sums")
    several = sums.groupBy(*keys).agg(F.count("*").alias("kinds")).where("kinds > 1")
    again = rows.where("commit is not null").select(*keys, "commit").join(several, keys, "left_semi").distinct().groupBy(*keys).agg(F.count("*").alias("commits"))
    sizes = sums.groupBy(*keys).agg(F.count("*").alias("kinds"), F.sum("commits").alias("commits")).where("kinds = 1").drop("kinds").unionByName(again)
    enough = F.least(F.lit(2), F.greatest(F.lit(1), F.ceil(F.col("commits") * F.lit(0.35))))
    counts = by_action(sums, [*keys, "kind"], positive, "n").join(sizes, keys).where(F.col("n") >= enough)

    # per file and action its rows, and their first ordinal; none sorts before all others
    firsts = [F.min(F.when(_shows(F.col("bits"), i) == 1, F.col("ordinal"))).alias(f"o{i}") for i in range(len(ACTIONS))]
    unordered = F.bit_or(F.when(F.col("ordinal").isNull(), F.col("bits")).otherwise(F.lit(0).cast("long"))).alias("unordered")
    numbers = [F.sum(_shows(F.col("bits"), i)).alias(f"n{i}") for i in range(len(ACTIONS))]
    seen_rows = scratch.keep(shown.where("bits <> 0").groupBy(*keys, "kind", "file_path", "group").agg(unordered, *firsts, *numbers), "seen")
    place = F.array_position(F.array(*map(F.lit, GROUPS)), F.col("group"))
    grouped = by_action(seen_rows.groupBy(*keys, "group").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(len(ACTIONS)))), [*keys, "group"], positive, "g")
    modes = grouped.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "action").orderBy(F.col("g").desc(), place))).where("r = 1").select(*keys, "action", "group")
    first = lambda i: F.when(F.col(f"n{i}") > 0, F.struct(F.when(_shows(F.col("unordered"), i) == 0, F.col(f"o{i}")).alias("ordinal"), F.col("file_path")))
    met = by_action(seen_rows, [*keys, "kind"], first, "seen")
    seen = met.groupBy(*keys, "kind", "action").agg(F.slice(F.array_sort(F.collect_set("seen.file_path")), 1, 5).alias("files"), F.min("seen").alias("seen"))
    kept = counts.join(seen, [*keys, "kind", "action"]).join(modes, [*keys, "action"])
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(action_place(F.col("action"), F.col("kind")), F.col("n").desc(), "seen", "action"))
    actions = scratch.keep(kept.select(*keys, "kind", "action", "group", "n", "files", rank.alias("rank")), "actions")
    scratch.drop("rows", "facts", "kinds", "sums", "seen")
    return actions


#: Actions at the core of a workflow by kind; other kinds: all of group source or test (fixed values).
CORE_ACTIONS: dict[str, list[str]] = {
    "docs": ["updated_docs"],
    "config": ["changed_config_key", "changed_package_script"],
    "commands": ["added_cli_option", "changed_cli_option", "modified_function", "added_function", "changed_error_handling", "changed_output_formatting", "added_test_case"],
    "ui": ["updated_component", "updated_api_client", "updated_style", "modified_function", "changed_error_handling", "changed_output_formatting", "added_test_case"],
    "api": ["added_route_or_handler", "changed_schema_or_model", "updated_api_client", "changed_validation_logic", "changed_error_handling", "modified_function", "added_test_case"],
    "database": ["changed_query_or_migration", "changed_schema_or_model", "added_test_case"],
}
#: Texts of core steps: for any kind, then those that a kind has instead (fixed values).
STEP_TEXTS: dict[str, str] = {
    "added_function": "Add helper functions only where repeated examples introduce new behavior.",
    "modified_function": "Update source behavior in the learned surface.",
    "added_type_or_interface": "Update shared types or interfaces used by the surface.",
    "changed_validation_logic": "Update validation logic alongside the source behavior.",
    "changed_error_handling": "Update error handling paths for the changed behavior.",
    "changed_output_formatting": "Update output formatting where the surface renders or prints results.",
    "changed_config_key": "Update configuration keys that directly support this surface.",
    "changed_package_script": "Update package scripts only when the surface workflow requires it.",
    "updated_docs": "Update documentation that directly describes this surface.",
    "updated_fixture": "Update fixtures that directly support the changed behavior.",
    "added_test_case": "Add or update tests that cover the changed behavior.",
}
KIND_STEP_TEXTS: dict[str, dict[str, str]] = {
    "commands": {
        "added_cli_option": "Add or update command option parsing in the command module.",
        "changed_cli_option": "Update command dispatch, arguments, or option handling.",
        "modified_function": "Update command handler behavior in the learned command files.",
        "added_function": "Add command helper functions only when repeated examples do so.",
        "added_test_case": "Add or update command tests for the changed option or behavior.",
        "updated_fixture": "Update command fixtures only when output or behavior changes.",
        "changed_output_formatting": "Update command output formatting when examples change printed results.",
        "changed_error_handling": "Update command error handling for invalid input or failed execution.",
    },
    "ui": {
        "updated_component": "Update component, screen, or view behavior in the learned UI surface.",
        "updated_api_client": "Update API/client wiring used by the UI surface.",
        "updated_style": "Update styles that repeatedly co-change with this UI surface.",
        "added_test_case": "Add or update UI tests that cover the changed behavior.",
        "modified_function": "Update UI source behavior in the learned surface.",
        "changed_output_formatting": "Update display or rendering behavior when examples show formatting changes.",
        "changed_error_handling": "Update UI error states when examples show error handling changes.",
    },
    "api": {
        "added_route_or_handler": "Update route, controller, or handler behavior in the learned API surface.",
        "changed_schema_or_model": "Update schema or model code only when it co-changes with the API behavior.",
        "updated_api_client": "Update client contract or API client wiring when it co-changes.",
        "changed_validation_logic": "Update request validation alongside the API behavior.",
        "changed_error_handling": "Update API error handling for the changed route or handler.",
        "added_test_case": "Add or update API tests that cover the changed behavior.",
        "modified_function": "Update API source behavior in the learned surface.",
    },
    "database": {
        "changed_query_or_migration": "Update migrations or queries in the learned database surface.",
        "changed_schema_or_model": "Update schema, model, or entity code together.",
        "added_test_case": "Add or update tests that cover the database-backed behavior.",
    },
    "docs": {"updated_docs": "Update the documentation files in this learned docs surface."},
}
#: Texts of supporting steps; others have none (fixed values).
SUPPORTING_TEXTS: dict[str, str] = {
    "updated_docs": "Update documentation only if the user-facing behavior changes.",
    "changed_config_key": "Update configuration only if the source change requires it.",
    "changed_package_script": "Update package scripts only if validation or developer workflow changes.",
    "updated_fixture": "Update fixtures only when source behavior or output changes.",
    "updated_style": "Update styles only when the visible UI behavior changes.",
}
COMMAND_DOCS_TEXT = "Update docs/help text only if the command's user-facing behavior changes."
VALIDATION_TEXT = "Run the primary validation command(s)."


def _text_of(texts: dict[str, str], action: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in texts.items() for x in pair))[action]


def workflow_steps(actions: DataFrame, keys: list[str], commands: DataFrame | None = None) -> DataFrame:
    """Per surface its steps in order: five core ones at most and their validation, then five supporting ones.

    actions: from ``workflow_actions``; commands: keys, commands (array of primary ones).
    """
    kind, action = F.col("kind"), F.col("action")
    known = F.create_map(*(x for k, names in CORE_ACTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, names)))))[kind]
    core = F.when(kind.isin("docs", "config"), F.array_contains(known, action)).when(F.col("group") == "supporting", False).otherwise(F.coalesce(F.array_contains(known, action), F.lit(True)))
    own = F.coalesce(*(F.when(kind == k, _text_of(texts, action)) for k, texts in KIND_STEP_TEXTS.items()), _text_of(STEP_TEXTS, action))
    beside = F.when((action == "updated_docs") & (kind == "commands"), F.lit(COMMAND_DOCS_TEXT)).otherwise(_text_of(SUPPORTING_TEXTS, action))
    told = actions.withColumn("core", core).withColumn("text", F.when(F.col("core"), own).otherwise(beside)).where("text is not null")
    placed = told.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "core").orderBy("rank"))).where("place <= 5")
    tier = F.when(F.col("core"), "core").otherwise("supporting")
    steps = placed.select(*keys, tier.alias("tier"), "place", "action", "text", F.col("n").cast("long").alias("n"), F.slice("files", 1, 3).alias("files"))
    if commands is None:
        return steps
    last = steps.where("tier = 'core'").groupBy(*keys).agg(F.max("place").alias("last")).join(commands.where(F.size("commands") > 0), keys)
    check = last.select(*keys, F.lit("core").alias("tier"), (F.col("last") + 1).alias("place"), F.lit("validation").alias("action"), F.lit(VALIDATION_TEXT).alias("text"), F.size("commands").cast("long").alias("n"), F.col("commands").alias("files"))
    return steps.unionByName(check)
