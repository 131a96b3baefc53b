import json
import subprocess
from pathlib import Path

import pytest

from histolode import api, cli
from histolode.sources import store


def commit(root, k):
    for name, text in ((f"src/routes/r{k}-audit.ts", f"export class R{k}Controller {{}}\napp.get('/u{k}', f)\n"), (f"src/services/s{k}-audit.ts", f"export function s{k}() {{}}\n"), (f"tests/t{k}-audit.test.ts", f"it('works {k}', () => 1)\n")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    for args in (("add", "-A"), ("commit", "-q", "-m", f"Add audit route {k}")):
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.com", *args], cwd=root, check=True, capture_output=True)


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("store")
    subprocess.run(["git", "init", "-q"], cwd=root, check=True)
    (root / "package.json").write_text('{"scripts": {"test": "t"}}')
    for k in range(8):
        commit(root, k)
    return root


def test_scan_generate_refresh(spark, repository):
    root = str(repository)
    scanned = api.scan(spark, [root], 50)
    rows = {r["id"]: r for r in scanned.candidates.collect()}
    ready = [r for r in rows.values() if r["promotion_level"] == "agent_ready"]
    assert any(r["kind"] == "api" and r["name"] == "Update Audit API Behavior" and r["workflow_quality"] >= 0.75 for r in ready)
    counts = api.generate(scanned, root)
    assert counts["skills"] == len(ready) and counts["archived"] == 0
    skill = ready[0]["id"]
    text = (repository / ".histolode/skills" / skill / "SKILL.md").read_text()
    assert text.startswith("Status: fresh\n") and "## Workflow\n### Core\n1. " in text and "Run the primary validation command(s)." in text and "- npm test" in text and "## Evidence\n- `" in text
    found = store.registry(spark, [root]).collect()
    assert {r["skill_id"] for r in found} == {i for i, r in rows.items() if r["promotion_level"] != "pattern_candidate"} and {r["repo_id"] for r in found} == {root}
    assert skill in (repository / ".histolode/AGENTS.md").read_text()

    own = store.Store(root)
    assert own.approve(skill, "me")["human_approved"] and "Approved by: me" in (repository / ".histolode/skills" / skill / "SKILL.md").read_text()
    again = api.generate(scanned, root)
    assert again["preserved"] == 1 and again["archived"] == len(ready) - 1 and again["skills"] == len(ready) - 1
    assert own.rows("skills")[0]["human_approved"] or any(r["human_approved"] for r in own.rows("skills"))

    commit(repository, 9)
    (repository / "package.json").write_text('{"scripts": {"test": "t", "lint": "l"}}')
    later = api.scan(spark, [root], 50)
    report = api.validate(spark, later, root)
    assert "Validation command changes: " + str(len(ready)) in report and "Drifting skills: " + str(len(ready)) in report
    before = {r["skill_id"]: r["generated_from_head"] for r in own.rows("skills")}
    assert api.refresh(spark, later, root).startswith("Skill Lifecycle Report")
    after = {r["skill_id"]: r for r in own.rows("skills")}
    assert all(r["status"] == "drifting" and r["generated_from_head"] != before[k] for k, r in after.items())
    assert list((repository / ".histolode/skills" / skill).glob("metadata.previous-*.json"))
    folder = api.cache(later, root)
    assert Path(folder, "report.txt").read_text().startswith("Commits analyzed: 9") and spark.read.json(f"file://{folder}/candidates").count() == later.candidates.count()


ROW = {"status": "fresh", "promotion_level": "agent_ready", "last_refreshed_at": "2026-01-01", "human_approved": False, "managed_by": "engine", "evidence_commits": [], "pattern_confidence": 0.9, "naming_confidence": 0.8}


@pytest.fixture
def own(tmp_path):
    subprocess.run(["git", "init", "-q"], cwd=tmp_path, check=True)
    made = store.Store(str(tmp_path))
    documents = [{"id": i, "path": f"{f}/{i}/SKILL.md", "text": f"# {i}\n"} for i, f in (("a", "skills"), ("b", "skills"), ("c", "draft-skills"), ("d", "draft-skills"))] + [{"id": "p", "path": "patterns/p/PATTERN.md", "text": "# Pattern Candidate: Mixed Changes\n"}]
    rows = [ROW | {"skill_id": i, "name": f"Skill {i}"} for i in "ab"] + [ROW | {"skill_id": i, "name": f"Draft {i}", "status": "draft", "promotion_level": "draft"} for i in "cd"]
    made.generate(documents, rows, {"Commits analyzed": 3})
    return made


def test_human_actions(own):
    assert own.patterns() == [("p", "Mixed Changes")]
    assert own.approve("c")["status"] == "fresh" and {r["skill_id"] for r in own.rows("skills")} == {"a", "b", "c"}
    assert own.rename("draft-d", "A Better Name")["skill_id"] == "a-better-name"
    assert (own.folder / "draft-skills/a-better-name/SKILL.md").read_text().endswith("# A Better Name\n")
    assert own.reject("a-better-name")["status"] == "rejected" and not (own.folder / "draft-skills").exists()
    assert own.deprecate("b")["drift_reasons"] == ["Skill was manually deprecated."]
    assert own.promote("p", "New Draft")["skill_id"] == "new-draft" and own.patterns() == []
    assert sorted(r["status"] for r in own.archived()) == ["deprecated", "rejected"]
    with pytest.raises(ValueError):
        own.reject("nothing")
    board = own.review()
    assert "Agent-ready skills: 2" in board and "Draft skills needing review: 1" in board and "Archived/deprecated skills: 2" in board


def test_a_skill_is_not_overwritten(own):
    (own.folder / "skills/c").mkdir()
    with pytest.raises(ValueError):
        own.approve("c")


def test_damaged_rows(spark, own):
    (own.folder / "skills/a/metadata.json").write_text("{broken")
    with pytest.raises(ValueError):
        own.rows("skills")
    assert [r["skill_id"] for r in own.rows("skills", strict=False)] == ["b"]
    assert store.registry(spark, [own.root], strict=False).count() == 3
    with pytest.raises(Exception):
        store.registry(spark, [own.root]).collect()
    assert own.generate([], [], {})["archived"] == 2


def test_entry_files(own):
    assert dict(store.apply(own.root, dry_run=True)) == {"AGENTS.md": "create", "CLAUDE.md": "create", ".cursor/rules/histolode.mdc": "create", ".github/copilot-instructions.md": "create"}
    Path(own.root, "AGENTS.md").write_text("# Mine\n")
    assert store.apply(own.root, "codex") == [("AGENTS.md", "update")] and store.apply(own.root, "codex") == [("AGENTS.md", "unchanged")]
    text = Path(own.root, "AGENTS.md").read_text()
    assert text.startswith("# Mine\n") and "[Skill a](.histolode/skills/a/SKILL.md)" in text and "1 pattern candidate in" in text
    assert store.apply(own.root, existing_only=True) == [("AGENTS.md", "unchanged")]


def test_command_line_on_the_registry(own, capsys):
    assert cli.main(["approve", "c", "--repo", own.root]) == 0 and "Draft c (c): fresh" in capsys.readouterr().out
    assert cli.main(["deprecate", "zzz", "--repo", own.root]) == 1 and "Skill not found: zzz" in capsys.readouterr().err
    assert cli.main(["rename-draft", "d", own.root, "--name", "Other", "--json"]) == 0 and json.loads(capsys.readouterr().out)["skill_id"] == "other"
    assert cli.main(["promote-pattern", "p", own.root, "--name", "Own"]) == 0
    assert cli.main(["review", own.root]) == 0 and "Pattern candidates: 0" in capsys.readouterr().out
    assert cli.main(["apply", own.root, "--target", "claude", "--dry-run"]) == 0 and "create: CLAUDE.md" in capsys.readouterr().out
    assert cli.main(["help"]) == 0 and cli.main([]) == 0
