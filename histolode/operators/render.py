"""Text output: skill and pattern documents, banners, the guidance index and managed sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workflow import TEST_FILE

#: Borders of the part of a file that the engine owns.
START, END = "<!-- histolode:start -->", "<!-- histolode:end -->"


def _bullets(values: Column) -> Column:
    lines = F.array_join(F.transform(values, lambda v: F.concat(F.lit("- "), v)), "\n")
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, lines).otherwise(F.lit("- None"))


def percent(x: Column) -> Column:
    return F.concat(F.floor(x * 100 + F.lit(0.5)).cast("string"), F.lit("%"))


def _section(title: str, body: Column) -> Column:
    return F.concat(F.lit(f"\n## {title}\n"), body, F.lit("\n"))


def _numbered(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v, i: F.concat((i + 1).cast("string"), F.lit(". "), v)), "\n")


#: Workflows of kinds of surface without steps of their own; the last is for all others.
FALLBACK_STEPS: dict[str, list[str]] = {
    "commands": ["Start from the closest command module above.", "Change its behavior, arguments or options there.", "Touch shared helpers only where the command needs it.", "Cover the command path by its tests.", "Run the validation commands."],
    "ui": ["Start from the closest component or screen above.", "Change the component, view or client wiring in this surface.", "Keep generated files, docs and configuration secondary.", "Cover the change by the UI tests.", "Run the validation commands."],
    "api": ["Start from the closest route, controller or handler above.", "Change the API behavior in this surface.", "Touch shared helpers only where the behavior needs it.", "Cover the change by the tests beside it.", "Run the validation commands."],
    "": ["Start from the nearest example above.", "Make the change where those files make it.", "Update or add tests when behavior changes.", "Update docs or configuration only when the change needs it.", "Run the validation commands."],
}


def _workflow() -> Column:
    fallback = _numbered(F.array(*map(F.lit, FALLBACK_STEPS[""])))
    for kind, steps in FALLBACK_STEPS.items():
        fallback = F.when(F.col("kind") == kind, _numbered(F.array(*map(F.lit, steps)))).otherwise(fallback)
    supporting = F.when(F.size("supporting_steps") > 0, _bullets(F.col("supporting_steps"))).otherwise(F.lit("- No repeated supporting updates."))
    told = F.concat(F.lit("### Core\n"), _numbered(F.col("core_steps")), F.lit("\n\n### Supporting\n"), supporting)
    return F.when(F.size("core_steps") > 0, told).otherwise(fallback)


def selected_examples(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, examples): example files of each candidate, those of its surface first."""
    pool = F.array_distinct(F.concat("representative_files", "test_files", "common_files"))
    rows = candidates.select(*keys, F.posexplode(pool).alias("place", "file_path"))
    source = F.lower("file_path").rlike(r"\.(tsx?|jsx?|py|java|kt|cs|go|rs|sql|prisma)$")
    placed = rows.withColumn("is_test", F.lower("file_path").rlike(TEST_FILE)).where(source | F.col("is_test"))
    chosen = examples(placed, keys).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "file_path"))), lambda x: x["file_path"]).alias("examples"))
    return candidates.join(chosen, keys, "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))


def documents(candidates: DataFrame) -> DataFrame:
    """(repo_id, id, path, text): one document per candidate, by level, without its banner."""
    folder = F.when(F.col("promotion_level") == "agent_ready", "skills").when(F.col("promotion_level") == "draft", "draft-skills").otherwise("patterns")
    pattern = F.col("promotion_level") == "pattern_candidate"
    evidence = _bullets(F.slice("evidence_lines", 1, 5))
    surface = F.concat_ws(
        "\n", F.concat(F.lit("- Surface: "), F.col("surface")), F.concat(F.lit("- Task kind: "), F.col("kind")), F.concat(F.lit("- Match confidence: "), percent(F.col("surface_match"))), F.concat(F.lit("- Commit match share: "), percent(F.col("surface_share"))),
        F.lit("- Representative source files:"), F.array_join(F.transform(F.slice("representative_files", 1, 5), lambda f: F.concat(F.lit("  - "), f)), "\n"),
    )
    head = F.concat(F.lit("Pattern confidence: "), percent(F.col("pattern_confidence")), F.lit("\nNaming confidence: "), percent(F.col("naming_confidence")), F.lit("\n"))
    when_to_use = F.regexp_replace(F.col("description"), "^Use this for", "Use this when working on")
    review = F.when(F.col("promotion_level") == "draft", F.lit("- Is the name right?\n- Are the examples relevant?\n- Approve, rename or reject it?")).otherwise(_bullets(F.slice(F.concat("promotion_reasons", "notes"), 1, 5)))
    commands = F.when(F.size("commands") > 0, _bullets(F.col("commands"))).otherwise(F.lit("- No confident validation command discovered."))
    skill = F.concat(
        F.lit("# "), F.col("name"), F.lit("\n\n"), head, _section("When to use", when_to_use), F.when(F.col("surface").isNotNull(), _section("Learned surface", surface)).otherwise(F.lit("")), _section("Relevant examples", _bullets(F.col("examples"))),
        _section("Workflow", _workflow()), _section("Validation", commands), _section("Evidence", evidence), _section("Human review", review),
    )
    found = F.concat(F.lit("- Signals: "), F.array_join(F.slice("signals", 1, 6), ", "), F.lit("\n- Directories: "), F.array_join(F.slice("directories", 1, 4), ", "))
    actions = F.lit("- Split it if the evidence holds several tasks.\n- Approve it only with a concrete workflow and checklist.\n- Ignore it if the evidence is generated or incidental churn.")
    unpromoted = F.concat(F.lit("# Pattern Candidate: "), F.col("name"), F.lit("\n\nThis is not a skill.\n"), _section("Why it was found", found), _section("Why it was not promoted", _bullets(F.col("promotion_reasons"))), _section("Evidence", evidence), _section("Suggested human review", actions))
    rows = candidates if "examples" in candidates.columns else selected_examples(candidates, ["repo_id", "id"])
    path = F.concat_ws("/", folder, "id", F.when(pattern, "PATTERN.md").otherwise("SKILL.md"))
    return rows.select("repo_id", "id", path.alias("path"), F.when(pattern, unpromoted).otherwise(skill).alias("text"))


#: Ends a document's banner.
BANNER_END = "---"
#: Warnings of a banner by status.
WARNINGS = {
    "draft": "This is a generated draft skill. A human must review it before it counts as guidance.",
    "stale": "Warning: this skill may no longer reflect the repository. Refresh or review it before use.",
    "drifting": "Warning: this skill may no longer reflect the repository. Refresh or review it before use.",
    "deprecated": "Warning: this skill is deprecated. Do not use it unless a reviewer approves it again.",
    "rejected": "Warning: this draft was rejected. Do not use it as guidance.",
}


def banner(row: dict) -> str:
    """The head of a skill document from its registry row."""
    approved = row.get("human_approved")
    lines = [f"Status: {'human-approved' if approved else row['status']}", f"Generated from HEAD: {row.get('generated_from_head', 'unknown')}", f"Last refreshed: {row.get('last_refreshed_at', '')}", f"Evidence commits: {len(row.get('evidence_commits') or [])}"]
    if approved:
        lines += [f"{label}: {row[field]}" for label, field in (("Approved at", "approved_at"), ("Approved by", "approved_by")) if row.get(field)] + ["Human approved: true"]
    draft = row["status"] == "draft" or row.get("promotion_level") == "draft"
    lines += [WARNINGS["draft"]] * draft
    if row["status"] in WARNINGS and row["status"] != "draft":
        lines.append(WARNINGS[row["status"]])
    return "\n".join([*lines, BANNER_END, ""])


def with_banner(text: str, row: dict) -> str:
    """The text with the banner of the row instead of the one it has."""
    head, rule, body = text.partition(f"\n{BANNER_END}\n")
    return banner(row) + (body if rule and head.startswith("Status: ") else text)


def _named(items: list[str], none: str = "- None") -> list[str]:
    return items or [none]


def guidance_index(rows: list[dict], patterns: list[tuple[str, str]], summary: dict[str, object]) -> str:
    """The guidance index: skills agents may rely on, drafts, skills to review, patterns (id, name)."""
    told = lambda r: r.get("task_description") or f"Use this for {r['name'][:1].lower()}{r['name'][1:].rstrip('.')} changes."
    live = [r for r in rows if r["status"] not in ("deprecated", "rejected")]
    relied = [r for r in live if r["status"] != "draft" and (r.get("human_approved") or (r["status"] == "fresh" and r.get("promotion_level") == "agent_ready"))]
    drafts = [r for r in live if (r["status"] == "draft" or r.get("promotion_level") == "draft") and not r.get("human_approved")]
    doubtful = [r for r in live if r["status"] in ("stale", "drifting") and not r.get("human_approved")]
    return "\n".join([
        "# Draft Repository Guidance", "", "Generated from local history. Review it before relying on it.", "",
        "## Repository guidance", "- Start from the nearest existing implementation.", "- Match work to skills by description, examples and evidence.", "- Run only validation commands that this repository has.", "",
        "## Approved / agent-ready skills", *_named([f"- {r['name']}: {told(r)} Use .histolode/skills/{r['skill_id']}/SKILL.md." for r in relied], "- No agent-ready skills yet."), "",
        "## Draft skills needing review", *_named([f"- {r['name']}: {told(r)} Review .histolode/draft-skills/{r['skill_id']}/SKILL.md before approving." for r in drafts]), "",
        "## Skills needing review", *_named([f"- {r['name']} ({r['status']}): review .histolode/skills/{r['skill_id']}/SKILL.md before using." for r in doubtful]), "",
        "## Pattern candidates", *_named([f"- {name}: review .histolode/patterns/{key}/PATTERN.md." for key, name in patterns]), "",
        "## Scan summary", *(f"- {label}: {value}" for label, value in summary.items()), "",
    ])


def lifecycle_report(head: str, rows: list[dict]) -> str:
    """Counts and lists of skills by status, command changes and what to review."""
    by = {s: [r for r in rows if r["status"] == s] for s in ("fresh", "stale", "drifting", "deprecated")}
    warned = [r for r in rows if r.get("validation_warnings")]
    line = lambda r: f"- {r['name']} ({r['skill_id']})" + (f": {'; '.join(r.get('drift_reasons') or r.get('validation_warnings') or [])}" if r.get("drift_reasons") or r.get("validation_warnings") else "")
    out = ["Skill Lifecycle Report", "", f"Current HEAD: {head}", *(f"{s.capitalize()} skills: {len(x)}" for s, x in by.items()), f"Validation command changes: {len(warned)}", ""]
    for title, listed in (*((f"{s.capitalize()} skills:", x) for s, x in by.items()), ("Validation command changes:", warned), ("Suggested human review:", [*by["stale"], *by["drifting"]])):
        out += [title, *_named([line(r) for r in listed]), ""]
    return "\n".join(out)


def review_dashboard(root: str, skills: list[dict], drafts: list[dict], patterns: list[tuple[str, str]], archived: list[dict]) -> str:
    """What waits for a reviewer."""
    ready = [r for r in skills if r["status"] not in ("deprecated", "rejected") and (r.get("human_approved") or r["status"] == "fresh" or r.get("promotion_level") == "agent_ready")]
    waiting = [r for r in drafts if r["status"] == "draft" or r.get("promotion_level") == "draft"]
    sure = lambda r: f"{max(r.get('pattern_confidence') or 0, r.get('naming_confidence') or 0):.0%}"
    return "\n".join([
        "Review Dashboard", "", f"Repository: {root}", "",
        f"Agent-ready skills: {len(ready)}", *_named([f"- {r['name']} ({r['skill_id']}): {r['status']}" for r in ready]), "",
        f"Draft skills needing review: {len(waiting)}", *_named([f"- {r['name']} ({r['skill_id']}): confidence {sure(r)}; surface {r.get('surface') or 'unknown'}; validation {', '.join(r.get('validation_commands') or []) or 'none'}" for r in waiting]), "",
        f"Pattern candidates: {len(patterns)}", *_named([f"- {name} ({key})" for key, name in patterns]), "",
        f"Archived/deprecated skills: {len(archived)}", *_named([f"- {r['name']} ({r['skill_id']}): {r['status']}" for r in archived]), "",
    ])


#: Reasons by broad area: signals that show it, if any does, if none does.
AREA_REASONS: list[tuple[set[str], str, str]] = [
    ({"backend_changed", "api_route_changed", "service_layer_changed"}, "Backend-related: backend, route, controller, service or handler signals.", "Not strongly backend-related."),
    ({"db_changed", "migration_changed", "schema_changed"}, "Database-related: migration, schema, model, query or index signals.", "Not strongly database-related."),
    ({"ui_changed", "component_changed", "page_or_screen_changed"}, "Frontend-related: component, page, style or frontend test signals.", "Not strongly frontend-related."),
    ({"config_changed", "ci_changed", "docker_changed", "terraform_or_infra_changed"}, "Config-related: configuration, dependency, CI or deployment signals.", "Not strongly config-related."),
]


def explanation(row: dict | None, wanted: str, known: list[str]) -> str:
    """Why a candidate was found, named and promoted as it was."""
    if row is None:
        return f"Skill not found: {wanted}\n\nAvailable skills: {', '.join(known) or 'none'}\n"
    shown = set(row["signals"])
    listed = lambda title, items: [f"{title}:", *_named([f"- {x}" for x in items]), ""]
    surface = ["None: no learned surface is strong enough."] if row["surface"] is None else [f"Directory: {row['surface']}", f"Task kind: {row['kind']}", f"Match confidence: {row['surface_match']:.0%}", f"Commit match share: {row['surface_share']:.0%}", f"Source files: {', '.join(row['representative_files'][:5]) or 'none'}", f"Tests: {', '.join(row['test_files'][:5]) or 'none'}"]
    return "\n".join([
        f"Explain: {row['name']}", "", f"Skill id: {row['id']}", f"Level: {row['promotion_level']}", f"Task description: {row['description']}", f"Primary area: {row['primary_area']} ({row['area_share']:.0%} of evidence commits)",
        f"Pattern confidence: {row['pattern_confidence']:.0%}", f"Naming confidence: {row['naming_confidence']:.0%}", f"Workflow quality: {row['workflow_quality']:.0%}", f"Artifact share: {row['artifact_share']:.0%}", "",
        *listed("Learned surface", surface), *listed("Signals", row["signals"]), *listed("Naming evidence", [f"Category: {row['category']}", f"Domain terms: {', '.join(row['terms']) or 'none'}", f"Repeated terms: {', '.join(row['repeated_terms']) or 'none'}"]),
        *listed("Category rationale", [yes if shown & names else no for names, yes, no in AREA_REASONS]), *listed("Possible false positives", row["notes"]), *listed("Promotion decision", row["promotion_reasons"]), *listed("Evidence commits", row["evidence_lines"]),
    ])


def examples(files: DataFrame, keys: list[str]) -> DataFrame:
    """Example files per key: four sources (five without tests), then tests up to five, by place."""
    by = Window.partitionBy(*keys, "is_test").orderBy("place")
    ranked = files.withColumn("r", F.row_number().over(by)).withColumn("tests", F.sum(F.col("is_test").cast("int")).over(Window.partitionBy(*keys)))
    sources = F.when(F.col("tests") > 0, 4).otherwise(5)
    kept = ranked.where((~F.col("is_test") & (F.col("r") <= sources)) | F.col("is_test"))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("is_test", "place"))
    return kept.withColumn("rank", order).where("rank <= 5").drop("r", "tests")


def managed_lines(approved: list[dict], drafts: list[dict], patterns: int) -> list[str]:
    """The lines of the managed section: protocol, approved skills, drafts, the number of patterns."""
    link = lambda folder: lambda r: f"- [{r['name']}](.histolode/{folder}/{r['skill_id']}/SKILL.md)" + (f" - {r['task_description']}" if r.get("task_description") else "")
    count = f"- {patterns} pattern candidate{'s' * (patterns != 1)} in [.histolode/patterns/](.histolode/patterns/). They are no agent-ready skills." if patterns else "- No pattern candidates found."
    return [
        "## Agent guidance", "", "Mined from this repository's history: repeated engineering patterns as reusable guidance.", "", "### Usage protocol", "Check the approved skills below before a task; follow a matching one and name it in the final response.", "",
        "### Approved skills", *_named([*map(link("skills"), approved)], "- No approved or agent-ready skills yet."), "", "### Draft skills, supporting context only", *_named([*map(link("draft-skills"), drafts)], "- None."), "",
        "### Pattern candidates", count, "", "### Safety note", "Prefer current code and tests where they conflict with a skill.",
    ]


def with_managed_section(text: str, lines: list[str]) -> str:
    """The text with the lines between the engine's borders; everything else stays."""
    section = "\n".join([START, *lines, END])
    if text.count(START) != text.count(END) or text.count(START) > 1 or (START in text and text.index(END) < text.index(START)):
        raise ValueError("the managed section's borders are damaged")
    if START in text:
        return text[: text.index(START)] + section + text[text.index(END) + len(END) :]
    return f"{text.rstrip()}\n\n{section}\n" if text.strip() else section + "\n"


def managed_column(text: Column, section: Column) -> Column:
    """The same as with_managed_section for a table of texts."""
    at, end = F.locate(START, text), F.locate(END, text)
    whole = F.concat(F.lit(START + "\n"), section, F.lit("\n" + END))
    damaged = ((at > 0) != (end > 0)) | ((at > 0) & (end < at))
    replaced = F.concat(F.substring(text, F.lit(1), at - 1), whole, F.substring(text, end + len(END), F.length(text)))
    appended = F.when(F.trim(text) == "", F.concat(whole, F.lit("\n"))).otherwise(F.concat(F.regexp_replace(text, r"\s+\z", ""), F.lit("\n\n"), whole, F.lit("\n")))
    return F.when(damaged, F.raise_error(F.lit("the managed section's borders are damaged"))).when(at > 0, replaced).otherwise(appended)
