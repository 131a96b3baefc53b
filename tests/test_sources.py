import subprocess

import pytest

from histolode import api, cli
from histolode.plans import registry
from histolode.sources import git, projects
from histolode.streaming import refresh
from tests.compare import SF, rows_of


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")

    def run(*args):
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.com", *args], cwd=root, check=True, capture_output=True)

    run("init", "-q")
    for k in range(4):
        for name, text in ((f"src/api/user{k}.ts", f"export class User{k}Controller {{}}\napp.get('/u{k}', f)\n"), (f"tests/user{k}.test.ts", f"it('works {k}', () => 1)\n"), ("src/api/shared.ts", f"export const x = {k}\n")):
            (root / name).parent.mkdir(parents=True, exist_ok=True)
            (root / name).write_text(name and text)
        run("add", "-A")
        run("commit", "-q", "-m", f"Add user route {k}")
    (root / ".github").mkdir()
    (root / ".github" / "hook.ts").write_text("export const hidden = 1")
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.ts").write_text("no")
    (root / "package.json").write_text('{"scripts": {"test": "t", "lint": "l", "n": 1}}')
    (root / "Makefile").write_text("build: x\n\ttrue\n")
    (root / "Cargo.toml").write_text("[package]")
    return str(root)


def test_log_keeps_order_and_limit(spark, repository):
    git.register(spark)
    rows = spark.read.format("git_log").option("path", repository).option("limit", 3).option("batch", 2).load().orderBy("ordinal").collect()
    assert [(r["ordinal"], r["message"]) for r in rows] == [(0, "Add user route 3"), (1, "Add user route 2"), (2, "Add user route 1")]
    assert all("diff --git" in r["diff"] for r in rows)


def test_tree_reads_hidden_folders_and_skips_vendored_ones(spark, repository):
    git.register(spark)
    found = {r["path"] for r in spark.read.format("source_tree").option("path", repository).load().collect()}
    assert ".github/hook.ts" in found and "src/api/shared.ts" in found and not any("node_modules" in p for p in found)


def test_scan_end_to_end(spark, repository):
    scanned = api.scan(spark, [repository], 50)
    assert scanned.commits.count() == 4
    assert scanned.pairs.where("weight >= 2").count() == 0  # every commit has files of its own, and one shared
    assert [r["surface"] for r in scanned.surfaces.collect()] == ["src/api"]
    best = scanned.candidates.orderBy("newest").first()
    assert len(best["evidence"]) == 4 and best["surface"] == "src/api"
    assert best["kind"] == "api" and best["core_steps"] and "shared" in best["description"]
    told = api.explain(scanned, best["id"])
    assert told.startswith(f"Explain: {best['name']}") and told.count("Add user route") == 4 and "Task kind: api" in told
    assert api.explain(scanned, "none").startswith("Skill not found: none")
    assert "Commits analyzed: 4" in api.report(scanned)


def test_commands_of_a_project(repository):
    assert projects.validation_commands(repository) == ["npm test", "npm run lint", "make build", "cargo test"]
    assert projects.commands_for_files(repository, ["src/api/shared.ts"]) == ["npm test", "npm run lint", "make build", "cargo test"]


def test_targets(repository, tmp_path):
    assert git.prepare_repository(repository).root.endswith(repository.rsplit("/", 1)[1])
    with pytest.raises(ValueError):
        git.prepare_repository(str(tmp_path))
    assert git.safe_name("git@host.org:team/app.git") == "host-org-team-app"


def test_arguments_are_checked(capsys, tmp_path):
    assert cli.main(["scan", "--repo", str(tmp_path)]) == 1
    assert cli.main(["scan", "--limit", "0"]) == 1
    with pytest.raises(SystemExit):
        cli.main(["scan", "--unknown"])


def test_stream_of_files_keeps_weights(spark, tmp_path):
    schema = "repo_id string, hash string, file_path string"
    for batch in range(2):
        rows = [("r", f"{batch}{c}", f) for c in range(2) for f in ("src/a.rs", "src/b.rs")]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    refresh.refresh_pairs(stream, str(tmp_path / "deltas"), str(tmp_path / "ck")).awaitTermination()
    assert [tuple(r) for r in refresh.current_pairs(spark, str(tmp_path / "deltas")).collect()] == [("r", "src/a.rs", "src/b.rs", 4)]


def test_results_do_not_depend_on_partitions(spark):
    run = registry.queries()["u1_families"]
    before = rows_of(run(spark, SF))
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert rows_of(run(spark, SF)) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
