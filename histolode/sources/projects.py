"""Validation commands that a project folder offers, read on the driver: a handful of small files."""

from __future__ import annotations

import json
import re
from pathlib import Path

from ..operators.sources import PREFERRED_SCRIPTS, PREFERRED_TARGETS

#: Files that make a folder a project (fixed values).
MARKERS = ["package.json", "pyproject.toml", "pytest.ini", "tox.ini", "Makefile", "makefile", "go.mod", "Cargo.toml", "pom.xml", "build.gradle", "build.gradle.kts"]
_CI = re.compile(r"^\s*run:\s*(npm test|npm run [\w:-]+|pytest|go test \./\.\.\.|dotnet test|cargo test|mvn test|\./gradlew test|gradle test)\s*$")


def package_scripts(root: str) -> list[str]:
    try:
        scripts = json.loads(Path(root, "package.json").read_text("utf-8")).get("scripts") or {}
    except (OSError, ValueError, AttributeError):
        return []
    return sorted(k for k, v in scripts.items() if isinstance(v, str))


def _text(path: Path) -> str:
    try:
        return path.read_text("utf-8", "replace")
    except OSError:
        return ""


def is_project(root: str) -> bool:
    return any(Path(root, m).exists() for m in MARKERS) or any(Path(root).glob("*.sln")) or any(Path(root).glob("*.csproj"))


def validation_commands(root: str, repo: str | None = None) -> list[str]:
    """In order of rule families, each command once; with repo, npm commands carry the folder's prefix."""
    at, scripts, out = Path(root), package_scripts(root), []
    prefix = Path(root).relative_to(repo).as_posix() if repo and Path(root) != Path(repo) else ""
    npm = f"npm --prefix {prefix} " if prefix else "npm "
    out += [npm + (s if s == "test" else f"run {s}") for s in PREFERRED_SCRIPTS if s in scripts]
    makefile = next((at / n for n in ("Makefile", "makefile") if (at / n).exists()), None)
    if makefile:
        targets = {m[1] for line in _text(makefile).split("\n") if (m := re.match(r"([A-Za-z0-9_.:-]+):(?:\s|$)", line))}
        out += [f"make {t}" for t in PREFERRED_TARGETS if t in targets]
    out += ["mvn test"] * (at / "pom.xml").exists()
    if (at / "build.gradle").exists() or (at / "build.gradle.kts").exists():
        out.append("./gradlew test" if (at / "gradlew").exists() else "gradle test")
    tests = (at / "tests").exists()
    configured = any(re.search("pytest", _text(at / n), re.IGNORECASE) for n in ("pytest.ini", "tox.ini", "setup.cfg"))
    if configured or ((at / "pyproject.toml").exists() and tests):
        out.append("pytest")
    elif tests and any((at / "tests").rglob("*.py")):
        out.append("python -m unittest")
    out += ["go test ./..."] * (at / "go.mod").exists()
    out += ["dotnet test"] * (any(at.glob("*.sln")) or any(at.glob("*.csproj")))
    out += ["cargo test"] * (at / "Cargo.toml").exists()
    if repo is None:
        for flow in sorted([*at.glob(".github/workflows/*.yml"), *at.glob(".github/workflows/*.yaml")]):
            out += [m[1] for line in _text(flow).split("\n") if (m := _CI.match(line))]
    return list(dict.fromkeys(out))


def commands_for_files(repo: str, files: list[str]) -> list[str]:
    """Commands of the two projects that hold most of the files."""
    counts: dict[str, int] = {}
    for f in files:
        folder = Path(repo, f).parent
        while folder != Path(repo) and not (folder.is_dir() and is_project(str(folder))):
            folder = folder.parent
        if is_project(str(folder)):
            counts[str(folder)] = counts.get(str(folder), 0) + 1
    roots = sorted(counts, key=lambda r: (-counts[r], r))[:2]
    return list(dict.fromkeys(c for r in roots for c in validation_commands(r, repo)))
