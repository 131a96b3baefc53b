"""The registry on disk: skill documents, their rows with history, patterns and archives below a repository's .histolode folder."""

from __future__ import annotations

import getpass
import json
import os
import re
import shutil
from collections.abc import Iterable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import render

FOLDER = ".histolode"
#: Columns of a registry row that Spark reads; files may hold more.
ROW = (
    "skill_id string, name string, task_description string, created_at string, generated_from_head string, evidence_commits array<struct<hash: string, line: string>>, generic_signals array<string>, common_directories array<string>, "
    "dominant_terms array<string>, validation_commands array<string>, pattern_confidence double, naming_confidence double, workflow_quality double, promotion_level string, status string, last_refreshed_at string, managed_by string, human_approved boolean, drift_reasons array<string>, surface string"
)
ARCHIVES = ["skills", "deprecated-skills", "rejected-skills", "promoted-patterns"]


def now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def slug(name: str) -> str:
    return re.sub(r"^-+|-+$", "", re.sub(r"[^a-z0-9]+", "-", name.lower()))


def registry(spark: SparkSession, roots: Iterable[str], strict: bool = True) -> DataFrame:
    """Rows of all skills and drafts of many repositories; a damaged file fails, or is skipped if not strict."""
    files = [str(p) for root in roots for folder in ("skills", "draft-skills") for p in sorted(Path(root, FOLDER, folder).glob("*/metadata.json"))]
    if not files:
        return spark.createDataFrame([], f"repo_id string, {ROW}")
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    rows = spark.read.schema(ROW).option("multiLine", True).option("mode", mode).json(["file://" + f for f in files])
    return rows.select(F.regexp_extract(F.input_file_name(), rf"^file:/*(/.*)/{re.escape(FOLDER)}/", 1).alias("repo_id"), "*")


def cache(tables: dict[str, DataFrame], root: str, texts: dict[str, str]) -> str:
    """Writes tables as JSON lines and texts below the cache folder; nothing reads them back."""
    folder = Path(root, FOLDER, "cache")
    folder.mkdir(parents=True, exist_ok=True)
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"file://{folder / name}")
    for name, text in texts.items():
        (folder / name).write_text(text, "utf-8")
    return str(folder)


class Store:
    """One repository's registry."""

    def __init__(self, root: str) -> None:
        self.root, self.folder = root, Path(root, FOLDER)

    # -- reading --------------------------------------------------------------------

    def rows(self, folder: str, strict: bool = True) -> list[dict]:
        """Rows of skills or draft-skills by name."""
        found = []
        for path in sorted((self.folder / folder).glob("*/metadata.json")):
            try:
                found.append(json.loads(path.read_text("utf-8")))
            except ValueError:
                if strict:
                    raise
        return sorted(found, key=lambda r: (r["name"].lower(), r["name"]))

    def _folders(self, path: Path) -> list[Path]:
        return sorted(p for p in path.iterdir() if p.is_dir()) if path.is_dir() else []

    def patterns(self) -> list[tuple[str, str]]:
        """(id, name) of pattern candidates; the name is the first heading."""
        out = []
        for folder in self._folders(self.folder / "patterns"):
            file = folder / "PATTERN.md"
            title = re.search(r"(?m)^#\s+(?:Pattern Candidate:\s*)?(.+)$", file.read_text("utf-8") if file.exists() else "")
            out.append((folder.name, title[1].strip() if title else folder.name))
        return out

    def archived(self) -> list[dict]:
        """Archived rows, and skills still in place that are deprecated."""
        rows = []
        for name in ARCHIVES:
            for folder in self._folders(self.folder / "archive" / name):
                try:
                    rows.append(json.loads((folder / "metadata.json").read_text("utf-8")))
                except (OSError, ValueError):
                    continue
        return rows + [r for r in self.rows("skills", strict=False) if r["status"] == "deprecated"]

    def approved(self) -> list[dict]:
        return [r for r in self.rows("skills") if r["status"] not in ("deprecated", "rejected", "draft") and (r.get("human_approved") or (r["status"] == "fresh" and r.get("promotion_level") == "agent_ready"))]

    def drafts(self) -> list[dict]:
        return [r for r in self.rows("draft-skills") if r["status"] not in ("deprecated", "rejected") and not r.get("human_approved")]

    # -- writing --------------------------------------------------------------------

    def write(self, folder: Path, row: dict, keep_old: bool = True) -> None:
        """Writes a row, the one before it beside it, and its document's banner."""
        folder.mkdir(parents=True, exist_ok=True)
        file = folder / "metadata.json"
        if keep_old and file.exists():
            shutil.copy(file, folder / f"metadata.previous-{slug(row['last_refreshed_at'])}.json")
        file.write_text(json.dumps(row, indent=2), "utf-8")
        document = folder / "SKILL.md"
        if document.exists():
            document.write_text(render.with_banner(document.read_text("utf-8"), row), "utf-8")

    def _archive(self, folder: Path, place: str, name: str) -> Path:
        base = self.folder / "archive" / place
        target, n = base / name, 2
        while target.exists():
            target, n = base / f"{name}-{n}", n + 1
        base.mkdir(parents=True, exist_ok=True)
        folder.rename(target)
        if not any(folder.parent.iterdir()):
            folder.parent.rmdir()
        return target

    def index(self, summary: dict[str, object] | None = None) -> str:
        """Rewrites the guidance index from what the registry holds."""
        self.folder.mkdir(parents=True, exist_ok=True)
        text = render.guidance_index(self.rows("skills") + self.rows("draft-skills"), self.patterns(), summary or {"Generated at": now()})
        (self.folder / "AGENTS.md").write_text(text, "utf-8")
        return text

    def generate(self, documents: Iterable[dict], rows: Iterable[dict], summary: dict[str, object], at: str | None = None) -> dict[str, int]:
        """Writes the documents (id, path, text) and registry rows of a new scan.

        Old patterns and drafts go, skills are archived; those that a human approved or
        manages stay as they are, and no new skill takes their id.
        """
        at, archived = at or now(), 0
        for name in ("patterns", "draft-skills"):
            shutil.rmtree(self.folder / name, ignore_errors=True)
        preserved = set()
        for folder in self._folders(self.folder / "skills"):
            try:
                row = json.loads((folder / "metadata.json").read_text("utf-8"))
            except (OSError, ValueError):
                row = {}
            if row.get("human_approved") is True or row.get("managed_by") == "human":
                preserved.add(row.get("skill_id", folder.name))
            else:
                self._archive(folder, "skills", f"{folder.name}-{slug(at)}")
                archived += 1
        written = {"skills": 0, "draft-skills": 0, "patterns": 0}
        by_id = {r["skill_id"]: r | {"created_at": at, "last_refreshed_at": at} for r in rows}
        for d in documents:
            place = d["path"].split("/")[0]
            if place == "skills" and d["id"] in preserved:
                continue
            target = self.folder / d["path"]
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(d["text"], "utf-8")
            if place != "patterns":
                self.write(target.parent, by_id[d["id"]], keep_old=False)
            written[place] += 1
        self.index(summary)
        return written | {"archived": archived, "preserved": len(preserved)}

    def refresh(self, changes: dict[str, dict], at: str | None = None) -> list[dict]:
        """Skills with the changes of an evaluation, written with their history."""
        out = []
        for row in self.rows("skills"):
            row |= changes.get(row["skill_id"], {}) | {"last_refreshed_at": at or now()}
            self.write(self.folder / "skills" / row["skill_id"], row)
            out.append(row)
        self.index()
        return out

    # -- what a reviewer does ---------------------------------------------------------

    def _row(self, folder: str, key: str) -> dict:
        for row in self.rows(folder):
            if key in (row["skill_id"], slug(row["name"])):
                return row
        raise ValueError(f"{'Draft skill' if folder == 'draft-skills' else 'Skill'} not found: {key}")

    def approve(self, key: str, by: str | None = None, at: str | None = None) -> dict:
        """A skill, or a draft that becomes one; an existing skill of its id is an error."""
        drafts = {r["skill_id"] for r in self.rows("draft-skills") if key in (r["skill_id"], slug(r["name"]))}
        row = self._row("draft-skills" if drafts else "skills", key)
        target = self.folder / "skills" / row["skill_id"]
        if drafts:
            if target.exists():
                raise ValueError(f"A skill already has the id {row['skill_id']}")
            target.parent.mkdir(parents=True, exist_ok=True)
            (self.folder / "draft-skills" / row["skill_id"]).rename(target)
        at = at or now()
        return self._done(target, row | {"human_approved": True, "approved_at": at, "approved_by": by or getpass.getuser(), "status": "fresh", "promotion_level": "agent_ready", "last_refreshed_at": at})

    def reject(self, key: str, by: str | None = None, at: str | None = None) -> dict:
        row, at = self._row("draft-skills", key), at or now()
        target = self._archive(self.folder / "draft-skills" / row["skill_id"], "rejected-skills", row["skill_id"])
        return self._done(target, row | {"status": "rejected", "rejected_at": at, "rejected_by": by or getpass.getuser(), "human_approved": False, "last_refreshed_at": at})

    def deprecate(self, key: str, by: str | None = None, at: str | None = None) -> dict:
        row, at = self._row("skills", key), at or now()
        target = self._archive(self.folder / "skills" / row["skill_id"], "deprecated-skills", row["skill_id"])
        reasons = sorted({*(row.get("drift_reasons") or []), "Skill was manually deprecated."})
        return self._done(target, row | {"status": "deprecated", "deprecated_at": at, "deprecated_by": by or getpass.getuser(), "drift_reasons": reasons, "last_refreshed_at": at})

    def rename(self, key: str, name: str, by: str | None = None, at: str | None = None) -> dict:
        row, at = self._row("draft-skills", key), at or now()
        old, new = (self.folder / "draft-skills" / k for k in (row["skill_id"], slug(name)))
        if new != old:
            if new.exists():
                raise ValueError(f"A draft already has the id {slug(name)}")
            old.rename(new)
        document = new / "SKILL.md"
        if document.exists():
            document.write_text(re.sub(r"(?m)^# .*$", lambda _: f"# {name}", document.read_text("utf-8"), count=1), "utf-8")
        return self._done(new, row | {"skill_id": slug(name), "name": name, "proposed_name": name, "human_edited": True, "renamed_at": at, "renamed_by": by or getpass.getuser(), "last_refreshed_at": at})

    def promote(self, key: str, name: str, at: str | None = None) -> dict:
        """A pattern candidate becomes a draft under a name; the pattern is archived."""
        source, at = self.folder / "patterns" / key, at or now()
        if not (source / "PATTERN.md").exists():
            raise ValueError(f"Pattern candidate not found: {key}")
        base = slug(name) or "draft"
        taken = {r["skill_id"] for r in self.rows("draft-skills")}
        skill_id = next(i for n in range(1, len(taken) + 2) if (i := base if n == 1 else f"{base}-{n}") not in taken)
        evidence = (source / "PATTERN.md").read_text("utf-8")
        target = self.folder / "draft-skills" / skill_id
        target.mkdir(parents=True)
        (target / "SKILL.md").write_text(f"# {name}\n\n## Workflow\n- Write the concrete steps before approving.\n\n## Pattern evidence\n{evidence}", "utf-8")
        self._archive(source, "promoted-patterns", key)
        row = {"skill_id": skill_id, "name": name, "created_at": at, "generated_from_head": "unknown", "evidence_commits": [], "generic_signals": [], "common_directories": [], "dominant_terms": [], "validation_commands": [], "pattern_confidence": 0.0, "naming_confidence": 1.0, "workflow_quality": 0.0}
        return self._done(target, row | {"promotion_level": "draft", "status": "draft", "last_refreshed_at": at, "managed_by": "engine", "human_approved": False, "promoted_from_pattern": key, "human_named": True, "proposed_name": name, "drift_reasons": []})

    def _done(self, target: Path, row: dict) -> dict:
        self.write(target, row)
        self.index()
        return row

    def review(self) -> str:
        return render.review_dashboard(self.root, self.rows("skills"), self.rows("draft-skills"), self.patterns(), self.archived())


#: Entry files by target: path and what a new file starts with.
TARGETS: dict[str, tuple[str, str]] = {
    "codex": ("AGENTS.md", "# Agent Instructions\n\n"),
    "claude": ("CLAUDE.md", "# Claude Instructions\n\n"),
    "cursor": (".cursor/rules/histolode.mdc", "---\ndescription: Repository skills\nalwaysApply: true\n---\n\n"),
    "copilot": (".github/copilot-instructions.md", "# Copilot Instructions\n\n"),
}


def apply(root: str, target: str = "all", dry_run: bool = False, existing_only: bool = False) -> list[tuple[str, str]]:
    """(path, create | update | unchanged) of the entry files whose managed section is set."""
    store, out = Store(root), []
    lines = render.managed_lines(store.approved(), store.drafts(), len(store.patterns()))
    for name in TARGETS if target == "all" else [target]:
        path, prefix = Path(root, TARGETS[name][0]), TARGETS[name][1]
        if existing_only and not path.exists():
            continue
        old = path.read_text("utf-8") if path.exists() else None
        new = render.with_managed_section(old if old is not None else prefix, lines)
        out.append((os.path.relpath(path, root), "create" if old is None else "unchanged" if new == old else "update"))
        if new != old and not dry_run:
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(new, "utf-8")
    return out
