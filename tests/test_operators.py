import random
import re
import time
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from histolode.functions import expr, rules
from histolode.functions.tables import Tables
from histolode.operators import candidates, classify, clusters, cochange, diff, families, fingerprints, lifecycle, render, signals, workflow
from histolode.plans import skills as skills_plan
from histolode.plans.bindings import COMMIT_FILE, bind, commit_files
from tests.compare import SF


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_fixed2_follows_the_exact_binary_value(spark):
    values = [i / 1000 for i in range(1001)] + [0.285, 0.145, 0.555, 0.995, 1.0, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for row in df.select("x", expr.to_fixed2(F.col("x")).alias("y")).collect():
        assert row["y"] == float(Decimal(row["x"]).quantize(Decimal("0.01"), ROUND_HALF_UP))


@pytest.mark.parametrize("path, area", [("src/app/user/user.component.ts", "frontend"), ("src/app/user.component.spec.ts", "tests"), ("docs/a.md", "docs"), ("config/app.yaml", "config"), ("server/api/x.go", "backend"), ("lib/x.go", "unknown")])
def test_areas(spark, path, area):
    assert one(spark, classify.file_area(F.lit(path))) == area


@pytest.mark.parametrize("path, role", [("yarn.lock", "lockfile"), ("dist/a.js", "build-output"), ("reports/a.json", "generated"), ("a.snapshot.json", "fixture"), ("a/b_test.py", "test"), ("README", "docs"), ("Makefile", "config"), ("a/.ts", "unknown"), ("a/b.rs", "source")])
def test_roles(spark, path, role):
    assert one(spark, classify.file_role(F.lit(path))) == role


def test_four_frontend_files(spark):
    files = ["src/app/u/u.component.ts", "src/app/u/u.component.html", "src/app/u/u.service.ts", "src/app/u/u.component.spec.ts"]
    df = spark.createDataFrame([("c", i, f) for i, f in enumerate(files)], "hash string, file_ord int, file_path string")
    assert classify.commit_areas(df, ["hash"]).first()["area"] == "frontend"


def test_generated_docs_are_no_ui(spark):
    found = one(spark, signals.path_signals(F.lit("docs/progress/index.html")))
    assert "docs_changed" in found and "ui_changed" not in found


def test_borders_are_ascii(spark):
    text = "+éclass Été\ndiff"
    rows = spark.createDataFrame([("h", "diff --git a/x.ts b/x.ts\n+++ b/x.ts\n" + text)], "hash string, diff string")
    assert diff.with_features(diff.split_files(rows, ["hash"])).first()["classes"] == []


def test_diff_of_five_files(spark):
    text = """diff --git a/cli/run.ts b/cli/run.ts
--- a/cli/run.ts
+++ b/cli/run.ts
+program.command('go').option("-x, --xray", "d")
+export function go() {}
diff --git a/a.test.ts b/a.test.ts
new file mode 100644
+++ b/a.test.ts
+describe(`outer`, () => { it('in"ner', f) })
diff --git "a/o.txt" "b/n.txt"
rename from o.txt
rename to n.txt
diff --git a/gone.py b/gone.py
deleted file mode 100644
--- a/gone.py
+++ /dev/null
-def f():
diff --git a/q.sql b/q.sql
+++ b/q.sql
+SELECT 1"""
    files = diff.with_features(diff.split_files(spark.createDataFrame([("h", text)], "hash string, diff string"), ["hash"])).orderBy("file_ord").collect()
    assert [(f["file_path"], f["old_path"], f["status"], f["added_lines"], f["deleted_lines"]) for f in files] == [
        ("cli/run.ts", None, "modified", 2, 0), ("a.test.ts", None, "added", 1, 0), ("n.txt", "o.txt", "renamed", 0, 0), ("gone.py", None, "deleted", 0, 1), ("q.sql", None, "modified", 1, 0),
    ]
    assert files[0]["cli_commands"] == ["go"] and files[0]["cli_options"] == ["-x, --xray"] and files[0]["functions"] == ["go"]
    assert files[1]["tests"] == ["outer"] and files[4]["sql_signals"] == ["query_changed"]


def test_css_has_no_functions(spark):
    rows = spark.createDataFrame([("h", "diff --git a/a.css b/a.css\n+++ b/a.css\n+ transform: scale(1);\n+.a { color: var(--x); }")], "hash string, diff string")
    assert diff.with_features(diff.split_files(rows, ["hash"])).first()["functions"] == []


def test_empty_diffs(spark):
    rows = spark.createDataFrame([("a", ""), ("b", "no header\n+x")], "hash string, diff string")
    assert diff.split_files(rows, ["hash"]).count() == 0


def test_artifacts_are_in_no_pair(spark):
    rows = [(c, f) for c in ("1", "2", "3") for f in ("src/a.rs", "src/b.rs", "reports/out.json", "dist/x.js")]
    pairs = cochange.cochange_pairs(spark.createDataFrame([("r", *r) for r in rows], "repo string, hash string, file_path string"), ["repo"], "hash").collect()
    assert [(p["file_a"], p["file_b"], p["weight"]) for p in pairs] == [("src/a.rs", "src/b.rs", 3)]


def test_surface_of_command_commits(spark):
    rows = [("r", str(c), f) for c in range(4) for f in (f"src/commands/c{c}.rs", "src/commands/mod.rs", "Cargo.toml")]
    files = spark.createDataFrame(rows, "repo string, hash string, file_path string")
    found = cochange.learn_surfaces(files, ["repo"], "hash", cochange.cochange_pairs(files, ["repo"], "hash")).collect()
    assert [(s["surface"], s["commit_count"]) for s in found] == [("src/commands", 4)]


@pytest.mark.parametrize("block", [512, 3])
def test_pairs_of_vast_commits(spark, monkeypatch, block):
    monkeypatch.setattr(cochange, "BLOCK_FILES", block)
    rows = [("r", str(c), f"src/f{i}.ts") for c, n in enumerate((2, 7, 11, 11)) for i in range(n)]
    found = cochange.cochange_pairs(spark.createDataFrame(rows, "repo string, hash string, file_path string"), ["repo"], "hash", keep=None).collect()
    names = {c: {f for _, h, f in rows if h == str(c)} for c in range(4)}
    weights = {(a, b): sum(a in v and b in v for v in names.values()) for a in names[3] for b in names[3] if a < b}
    assert {(r["file_a"], r["file_b"]): r["weight"] for r in found} == {p: w for p, w in weights.items() if w >= 2}


TABLE = 'import React from "react"\nexport function UserTable() { return <AppTable pageSize={1}/> } // table sort filter'


def test_fingerprint_of_a_table(spark):
    f = fingerprints.fingerprint(spark.createDataFrame([("src/ui/UserTable.tsx", TABLE)], "path string, text string")).first()
    assert f["frameworks"] == ["react"] and "react" in f["libraries"] and "ui" in f["roles"] and {"table", "sorting", "filter"} <= set(f["concepts"])


def test_three_tables_are_a_family_and_one_file_is_none(spark):
    rows = [("r", f"src/ui/T{i}.tsx", TABLE.replace("UserTable", f"User{i}Table")) for i in range(3)] + [("r", "api/x.py", "from fastapi import APIRouter\nr = APIRouter()")]
    kept = Tables(spark, "test").keep(fingerprints.fingerprint(spark.createDataFrame(rows, "repo_id string, path string, text string")), "prints")
    prints = fingerprints.eligible(kept)
    best = families.best_earlier(prints, ["repo_id"])
    found = families.summarise(prints, families.families(best, ["repo_id"]), best, ["repo_id"]).collect()
    assert [len(f["files"]) for f in found] == [3] and found[0]["confidence"] >= 0.85


def _greedy(n, score):
    owner = {}
    for later in range(n):
        best, at = 0.0, None
        for root in dict.fromkeys(owner.values()):
            for earlier in [e for e, r in owner.items() if r == root]:
                if score(earlier, later) > best:
                    best, at = score(earlier, later), root
        owner[later] = at if at is not None and best >= 0.5 else later
    return owner


@pytest.mark.parametrize("seed", range(4))
def test_families_equal_the_greedy_loop_with_ties(spark, seed):
    rng = random.Random(seed)
    table = {(a, b): rng.choice([0.3, 0.5, 0.5, 0.7, 0.9]) for b in range(14) for a in range(b)}
    rows = [("r", f"f{a:02d}", f"f{b:02d}", s) for (a, b), s in table.items() if s >= 0.5 and rng.random() < 0.6]
    kept = {(int(a[1:]), int(b[1:])): s for _, a, b, s in rows}
    expected = _greedy(14, lambda a, b: kept.get((a, b), 0.0))
    best = [r for r in rows if r[3] == max(s for _, _, later, s in rows if later == r[2])]
    found = {int(r["path"][1:]): int(r["root"][1:]) for r in families.families(spark.createDataFrame(best, "repo string, earlier string, later string, score double"), ["repo"]).collect()}
    assert found == {p: r for p, r in expected.items() if p != r or r in [x for y, x in expected.items() if y != x]}


def test_a_long_chain_of_files_is_one_family(spark):
    rows = [("r", f"f{i:04d}", f"f{i + 1:04d}", 0.9) for i in range(1000)]
    found = families.families(spark.createDataFrame(rows, "repo string, earlier string, later string, score double"), ["repo"]).collect()
    assert len(found) == 1001 and {r["root"] for r in found} == {"f0000"}


@pytest.mark.parametrize("seed", range(2))
def test_families_over_classes_equal_the_greedy_loop(spark, seed):
    rng = random.Random(seed)
    pick = lambda *options: rng.choice(options)
    rows = [("r", f"f{i:03d}", [pick("a", "b")], pick([], ["l1"], ["l1", "l2"]), [pick("x", "y")], ["grid", pick("c1", "c2", "c3")], pick([], ["t1"], ["t2"])) for i in range(70)]
    prints = spark.createDataFrame(rows, "repo_id string, path string, frameworks array<string>, libraries array<string>, roles array<string>, concepts array<string>, component_tags array<string>")
    prints = prints.select("*", *(F.array().cast("array<string>").alias(n) for n in families.LISTS if n not in prints.columns))
    weights = {name: w for _, name, w in rules.SIMILARITY_WEIGHTS}
    lists = {r[1]: dict(zip(("frameworks", "libraries", "roles", "concepts", "component_tags"), map(set, r[2:]), strict=True)) for r in rows}

    def score(a, b):
        x, y = lists[a], lists[b]
        return round(sum(weights[n] * len(x[n] & y[n]) / len(x[n] | y[n]) for n in x if x[n] | y[n]) + 1e-9, 2)

    names = sorted(lists)
    pairs = {(r["earlier"], r["later"]): r["score"] for r in families.similar_pairs(prints, ["repo_id"]).collect()}
    assert pairs == {(a, b): score(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if score(a, b) >= 0.5}
    expected = {names[k]: names[v] for k, v in _greedy(len(names), lambda a, b: pairs.get((names[a], names[b]), 0.0)).items()}
    found = {r["path"]: r["root"] for r in families.families(families.best_earlier(prints, ["repo_id"]), ["repo_id"]).collect()}
    assert found == {p: r for p, r in expected.items() if p != r or r in [x for y, x in expected.items() if y != x]}


def test_files_of_few_classes_meet_their_classes_not_all_neighbours(spark):
    """A file is placed by its path among its class's neighbours: its rows do not grow with the classes like it."""
    rows = [(f"r{i % 2}", f"f{i:04d}", ["fw"], [f"l{i % 40}"], ["role"], ["grid"], ["t"]) for i in range(800)]
    prints = spark.createDataFrame(rows, "repo_id string, path string, frameworks array<string>, libraries array<string>, roles array<string>, concepts array<string>, component_tags array<string>")
    prints = prints.select("*", *(F.array().cast("array<string>").alias(n) for n in families.LISTS if n not in prints.columns))
    best = families.best_earlier(prints, ["repo_id"]).collect()
    hung = [r for r in best if r["via"] is not None]
    assert len(hung) == 760 and {r["via"] for r in hung} == {f"f{i:04d}" for i in range(40)}
    assert all(r["score"] == 0.84 and int(r["later"][1:]) - int(r["earlier"][1:]) == 40 for r in hung)
    found = families.families(families.best_earlier(prints, ["repo_id"]), ["repo_id"]).collect()
    assert len(found) == 800 and {(r["repo_id"], r["root"]) for r in found} == {("r0", "f0000"), ("r1", "f0001")}


def test_a_path_with_two_lists_joins_by_the_better(spark):
    lists = lambda x: (["fw"], [x], ["role"], ["grid"], ["t"])
    rows = [("r", "a", *lists("x")), ("r", "b", ["other"], ["z"], ["p"], ["q"], ["s"]), ("r", "c", *lists("x")), ("r", "c", *lists("y")), ("r", "d", *lists("y"))]
    prints = spark.createDataFrame(rows, "repo_id string, path string, frameworks array<string>, libraries array<string>, roles array<string>, concepts array<string>, component_tags array<string>")
    prints = prints.select("*", *(F.array().cast("array<string>").alias(n) for n in families.LISTS if n not in prints.columns))
    best = families.best_earlier(prints, ["repo_id"])
    assert sorted((r["later"], r["earlier"], r["score"]) for r in best.collect()) == [("c", "a", 0.84), ("d", "c", 0.84)]
    assert sorted((r["path"], r["root"]) for r in families.families(best, ["repo_id"]).collect()) == [("a", "a"), ("c", "a"), ("d", "a")]


def _fold_by_pairs(rows):
    """The fates as every pair compared would give them."""
    j = lambda x, y: len(x & y) / len(x | y) if x | y else 0.0
    near = lambda a, b: j(a["files"], b["files"]) >= 0.5 or j(a["commits"], b["commits"]) >= 0.4
    rows = sorted((dict(r) for r in rows), key=lambda r: (-r["pattern"], -r["naming"], r["name"], r["id"]))
    ready, kept, fates = [r for r in rows if r["level"] == "agent_ready"], [], [(r["id"], "kept", None) for r in rows if r["level"] != "draft"]
    for d in (r for r in rows if r["level"] == "draft"):
        if any(r["name"] == d["name"] for r in ready):
            fates.append((d["id"], "suppressed", None))
            continue
        into = next((r for r in ready if near(r, d)), None) or next((r for r in kept if r["name"] == d["name"]), None) or next((r for r in kept if near(r, d)), None)
        fates.append((d["id"], "kept", None) if into is None else (d["id"], "merged", into["id"]))
        if into is None:
            kept.append(d)
        else:
            into["files"], into["commits"] = into["files"] | d["files"], into["commits"] | d["commits"]
    return fates


def _drafts(rng, n, names, files):
    some = lambda: {str(rng.randrange(files)) for _ in range(rng.randrange(6))}
    level = lambda: rng.choice(["agent_ready", "draft", "draft", "pattern_candidate"])
    return [{"id": f"c{i}", "name": f"n{rng.randrange(names)}", "level": level(), "pattern": rng.randrange(90) / 100, "naming": rng.randrange(70) / 100, "files": some(), "commits": some()} for i in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_drafts_found_by_what_they_share_have_the_fates_of_all_pairs(seed):
    rng = random.Random(seed)
    rows = _drafts(rng, 300, 400, (8, 30, 200)[seed % 3])
    assert candidates.fold_drafts(rows) == _fold_by_pairs(rows)


def test_many_drafts_are_not_compared_in_pairs():
    rows = _drafts(random.Random(1), 20_000, 10**9, 10**6)
    began = time.process_time()
    candidates.fold_drafts(rows)
    assert time.process_time() - began < 10  # all pairs are some 50 million


def _commit(h, *shape, surfaces=(), directories=("a",)):
    return {"hash": h, "shape": list(shape), "surfaces": list(surfaces), "directories": list(directories)}


def test_clusters_fold_in_order():
    found = clusters.fold([_commit("1", "x", "y"), _commit("2", "x", "y"), _commit("3", "z", directories=("b",)), _commit("4"), _commit("5", "z", "w", directories=("b",))])
    assert [c.commits for c in found] == [["1", "2"], ["3", "5"]]


def test_near_duplicate_clusters_merge():
    rows = [_commit("1", "a", "b", "c"), _commit("2", "q"), _commit("3", "a", "b", "c", directories=("z",))]
    assert sorted(h for c in clusters.fold(rows) for h in c.commits) == ["1", "2", "3"]


def test_drafts_merge_and_are_suppressed():
    row = lambda i, name, level, p, files: {"id": i, "name": name, "level": level, "pattern": p, "naming": 0.5, "files": set(files), "commits": {i}}
    fates = candidates.fold_drafts([row("a", "X", "agent_ready", 0.9, "ab"), row("b", "x", "draft", 0.8, "zz"), row("c", "Y", "draft", 0.7, "ab"), row("d", "Z", "draft", 0.6, "mn"), row("e", "W", "draft", 0.5, "mno"), row("f", "Q", "pattern_candidate", 0.4, "m")])
    assert {i: (f, t) for i, f, t in fates} == {"a": ("kept", None), "b": ("suppressed", None), "c": ("merged", "a"), "d": ("kept", None), "e": ("merged", "d"), "f": ("kept", None)}


def test_repeated_ids_get_numbers(spark):
    df = spark.createDataFrame([("r", "a", 1), ("r", "a", 2), ("r", "b", 3)], "repo string, id string, n int")
    assert sorted(r["id"] for r in candidates.unique_ids(df, ["repo"], [F.col("n")]).collect()) == ["a", "a-2", "b"]


def _life(spark, commits):
    registry = spark.createDataFrame([("r", "s", "h0", "fresh", ["api_route_changed", "unit_test_changed"], ["src/api", "tests"], ["user"])], "repo_id string, skill_id string, head string, status string, own_signals array<string>, own_directories array<string>, own_words array<string>")
    rows = [("r", i, h, s, d, w) for i, (h, s, d, w) in enumerate(commits)]
    table = spark.createDataFrame(rows, "repo_id string, ordinal int, hash string, signals array<string>, directories array<string>, words array<string>")
    return lifecycle.evaluate(registry, table, "repo_id").first()


HEAD = ("h0", ["api_route_changed"], ["src/api"], ["user"])


def test_supporting_commit_keeps_fresh(spark):
    found = _life(spark, [("h1", ["api_route_changed", "unit_test_changed"], ["src/api"], ["user"]), HEAD])
    assert (found["status"], found["new_commits"], found["supporting"]) == ("fresh", 1, 1)


def test_other_directories_drift(spark):
    new = ("x", ["backend_changed", "auth_changed"], ["lib/x"], ["zzz"])
    assert _life(spark, [("h2", *new[1:]), ("h1", *new[1:]), HEAD])["status"] == "drifting"


def test_unrelated_commits_turn_stale(spark):
    assert _life(spark, [*((f"n{i}", ["docs_changed"], ["docs"], ["guide"]) for i in range(10)), HEAD])["status"] == "stale"


def test_drift_since_head_equals_drift_of_all_pairs(spark):
    rng = random.Random(3)
    some = lambda values: sorted(rng.sample(values, rng.randint(0, 4)))
    names, places, words = ["ui_changed", "db_changed", "docs_changed", "unit_test_changed", "auth_changed", "other"], ["src", "tests", "e2e/a", "docs", "lib", "lib/tests", "x"], ["user", "page", "cart", "item"]
    lists = "{0}signals array<string>, {0}directories array<string>, {0}words array<string>"
    skills = spark.createDataFrame([(f"r{i % 3}", f"s{i}", some(names), some(places), some(words)) for i in range(60)], "repo_id string, skill_id string, " + lists.format("own_"))
    commits = spark.createDataFrame([(f"r{min(2, i % 12)}", i, some(names), some(places), some(words)) for i in range(60)], "repo_id string, ordinal int, " + lists.format(""))
    expected = lifecycle.drift(skills.join(commits, "repo_id"), ["repo_id", "skill_id"]).collect()
    found = lifecycle.drift_since_head(skills, commits, "repo_id").collect()
    assert sorted(found) == sorted(expected) and len({tuple(r["drift_reasons"]) for r in found}) > 3


def test_l4_takes_every_commit(spark):
    files = bind(spark, SF, COMMIT_FILE).select("repo_id", "commit_id", "commit_ts", "file_path", signals.path_signals(F.col("file_path")).alias("s"))
    commits = {}
    for r in files.collect():
        s, d = commits.setdefault((r["repo_id"], r["commit_ts"], r["commit_id"]), (set(), set()))
        s.update(r["s"]), d.add(r["file_path"].rpartition("/")[0])
    days = {repo: [at.toordinal() for other, at, _ in commits if other == repo] for repo, _, _ in commits}
    head = {repo: (min(x) + max(x)) / 2 for repo, x in days.items()}
    older, newer = ([(k, *v) for k, v in commits.items() if (k[1].toordinal() > head[k[0]]) == late] for late in (False, True))
    assert len(older) + len(newer) == len(commits) and newer
    skills = {(k[0], x) for k, _, d in older for x in d}

    def top(values):
        counts = Counter(v for x in values for v in x)
        return sorted(counts, key=lambda v: (-counts[v], v))[:8]

    mine = lambda repo, x: [(s, d) for k, s, d in older if k[0] == repo and x in d]
    rows = [(repo, x, top(s for s, _ in mine(repo, x)), top(d for _, d in mine(repo, x)), []) for repo, x in sorted(skills) if repo in ("r1", "r2")]
    own = spark.createDataFrame(rows, "repo_id string, skill_id string, own_signals array<string>, own_directories array<string>, own_words array<string>")
    new = spark.createDataFrame([(k[0], k[2], sorted(s), sorted(d), []) for k, s, d in newer], "repo_id string, ordinal long, signals array<string>, directories array<string>, words array<string>")
    expected = {(r[0], r[1]): " ".join(r[2]) for r in lifecycle.drift(own.join(new, "repo_id"), ["repo_id", "skill_id"]).collect()}
    found = {(r[0], r[1]): r[2] for r in skills_plan.l4_drift(spark, SF).collect() if r[0] in ("r1", "r2")}
    assert found == expected and found


def test_transition_of_a_skill_that_is_no_draft_fails(spark):
    registry = spark.createDataFrame([(1, "S", "fresh", "agent_ready", False, "engine", 1)], "skill_id int, name string, status string, promotion_level string, human_approved boolean, managed_by string, version int")
    action = spark.createDataFrame([(1, "reject", "t", "me", None)], "skill_id int, action string, done_at string, done_by string, new_name string")
    with pytest.raises(Exception, match="Not a draft"):
        lifecycle.transition(registry, action, ["skill_id"]).collect()


def test_every_approved_skill_and_draft_is_listed():
    rows = [{"skill_id": f"s{i}", "name": f"Skill {i}", "task_description": "Do it."} for i in range(300)]
    lines = render.managed_lines(rows, rows[:2], 1)
    assert sum(x.startswith("- [Skill") for x in lines) == 302 and "- 1 pattern candidate in [.histolode/patterns/](.histolode/patterns/). They are no agent-ready skills." in lines
    assert "- None." in render.managed_lines([], [], 0) and "- No pattern candidates found." in render.managed_lines([], [], 0)


def test_managed_section(spark):
    once = render.with_managed_section("intro", ["- a"])
    assert render.with_managed_section(once, ["- a"]) == once and "intro" in once
    assert "- b" in (twice := render.with_managed_section(once, ["- b"])) and "- a" not in twice
    with pytest.raises(ValueError):
        render.with_managed_section(render.END + render.START, [])
    assert one(spark, render.managed_column(F.lit("intro"), F.lit("- a"))) == once
    assert one(spark, render.managed_column(F.lit(once), F.lit("- b"))) == twice


def test_examples_prefer_sources(spark):
    df = spark.createDataFrame([("k", i, i >= 6) for i in range(9)], "k string, place int, is_test boolean")
    assert [r["place"] for r in render.examples(df, ["k"]).orderBy("rank").collect()] == [0, 1, 2, 3, 6]


def test_banners_are_replaced():
    row = {"status": "stale", "last_refreshed_at": "d1", "evidence_commits": [1], "generated_from_head": "h"}
    first = render.with_banner("# T\n\n---\nrule", row)
    assert first.startswith("Status: stale\nGenerated from HEAD: h\nLast refreshed: d1\nEvidence commits: 1\nWarning") and first.endswith("---\n# T\n\n---\nrule")
    second = render.with_banner(first, row | {"status": "fresh", "human_approved": True, "approved_by": "me"})
    assert second.startswith("Status: human-approved\n") and second.count("Status:") == 1 and "Approved by: me\nHuman approved: true\n---\n# T" in second

def test_workflow_actions_judge_each_path_once(spark):
    # judging the long paths on every row took minutes
    paths = [f"src/{'part/' * 800}f{i}.ts" for i in range(5)]
    path = F.element_at(F.array(*map(F.lit, paths)), (F.col("id") % 5 + 1).cast("int"))
    rows = spark.range(40000).select(F.lit("r").alias("repo"), (F.col("id") % 20000).alias("hash"), path.alias("file_path"), F.when(F.col("id") == 3, "Fix error").otherwise("Work").alias("message"), F.lit("source-workflow").alias("kind"), F.array(F.struct(F.lit("config_changed").alias("type"), F.lit("x").alias("value"))).alias("found"),
        F.lit(False).alias("options"), F.lit(True).alias("changed"), F.lit(True).alias("direct"), (F.col("id") % 5 == 0).alias("supports"), F.when(F.col("id") != 7, -F.col("id")).alias("ordinal"))
    begin = time.time()
    found = {r["action"]: r for r in workflow.workflow_actions(rows, ["repo"], "hash").collect()}
    assert time.time() - begin < 30
    assert {a: (r["n"], r["group"], r["files"], r["rank"]) for a, r in found.items()} == {"modified_function": (16000, "source", paths[1:], 1), "changed_config_key": (20000, "source", paths, 2)}


def test_workflow_actions_make_their_rows_once(spark):
    # rows were made a second time to find their paths
    made = spark.sparkContext.accumulator(0)

    def counted(n):
        made.add(1)
        return f"src/f{n % 3}.ts"

    row = {"message": F.lit("Work"), "kind": F.lit("commands"), "options": F.lit(False), "changed": F.lit(True), "direct": F.lit(True), "supports": F.lit(False), "ordinal": -F.col("id")}
    found = F.array(F.struct(F.lit("cli_command_changed").alias("type"), F.when(F.col("id") % 2 == 0, "--Serialize").otherwise("go").alias("value")))
    rows = spark.range(40).select(F.lit("r").alias("repo"), F.col("id").alias("hash"), F.udf(counted)(F.col("id")).alias("file_path"), found.alias("found"), *(v.alias(k) for k, v in row.items()))
    actions = {r["action"]: r["n"] for r in workflow.workflow_actions(rows, ["repo"], "hash").collect()}
    assert made.value == 40
    assert actions == {"added_cli_option": 20, "changed_cli_option": 20, "modified_function": 40, "changed_output_formatting": 20}


def test_commit_files_are_those_of_the_sql(spark, tmp_path):
    # parts with one path and key twice, without name or key; orders twice, without customer
    spark.sql("select * from values (1L, 'a b', 'X', 1), (2L, 'a b', 'X', 9), (2L, 'c', 'X', 2), (3L, cast(null as string), 'Y', 3), (cast(null as bigint), 'd', 'Y', 4) as (p_partkey, p_name, p_type, p_size)").write.parquet(f"{tmp_path}/part.parquet")
    spark.sql("select * from values (1L, 41L, date'2020-01-01'), (1L, 1L, date'2020-01-01'), (1L, 1L, date'2020-01-02'), (2L, cast(null as bigint), date'2020-01-01') as (o_orderkey, o_custkey, o_orderdate)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(24).selectExpr("cast(1 + id % 3 as bigint) as l_orderkey", "if(id % 4 = 0, null, id % 4) as l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    for folder in (SF, str(tmp_path)):
        names = ["repo_id", "commit_id", "commit_ts", "file_path"]
        expected, found = (Counter(df.select(*names).collect()) for df in (bind(spark, folder, COMMIT_FILE), commit_files(spark, folder)))
        assert found == expected and found


def test_directories_of_odd_paths(spark):
    paths = ["a/b.ts", "a\\\\b\\c.ts", ".//./x", "./x", "/", "/a", "é/ü/ö.ts", "a/b\n", "a/\nb/c\nd", "", "a//", "..", "./", "x"]
    rows = spark.createDataFrame([(p,) for p in [*paths, None]], "p string").select("p", expr.normalize_path(F.col("p")).alias("n"), expr.directory_of(F.col("p")).alias("d")).collect()
    normal = [re.sub(r"^\./+", "", p.replace("\\", "/")) for p in paths]
    assert [(r["n"], r["d"]) for r in rows] == [*((n, re.sub(r"/[^/]*\Z", "", n) if "/" in n else "repo root") for n in normal), (None, "repo root")]


def test_workflow_actions_of_two_kinds_and_rows_without_commit_or_path(spark):
    def row(commit, path, kind, message, supports, ordinal):
        return ("r", commit, path, message, kind, [("function_added", "f")], False, True, True, supports, ordinal)

    rows = [row("a", "x/a.ts", "ui", "Work", False, 2), row("a", "x/b.ts", "api", "Work", True, 2), row("b", "x/b.ts", "ui", "Throw", True, 1), row("b", None, "ui", "Throw", True, None), row(None, "x/c.ts", "ui", "Throw", False, 3)]
    schema = "repo string, hash string, file_path string, message string, kind string, found array<struct<type:string,value:string>>, options boolean, changed boolean, direct boolean, supports boolean, ordinal int"
    found = workflow.workflow_actions(spark.createDataFrame(rows, schema), ["repo"], "hash").collect()
    # of two commits one is enough; an action's group is its most frequent one, source at a tie
    assert {(r["kind"], r["action"]): (r["n"], r["group"], r["files"]) for r in found} == {
        ("ui", "added_function"): (2, "supporting", ["x/a.ts", "x/b.ts", "x/c.ts"]), ("api", "added_function"): (1, "supporting", ["x/b.ts"]),
        ("ui", "modified_function"): (1, "source", ["x/a.ts", "x/c.ts"]), ("ui", "changed_error_handling"): (1, "supporting", ["x/b.ts", "x/c.ts"]),
    }
