"""The engine from a shell, on a local Spark session: histolode COMMAND [ID] [REPOSITORY] [options]."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import api
from .sources import git, store

#: Commands that scan the history, that act on one skill, that also name it, and that only read the registry.
SCANS = {"scan": "list what history shows", "mine": "list candidates", "generate": "write skills, drafts and patterns", "report": "print a report", "analyze": "scan, generate, cache and report", "refresh": "update the registry", "validate-skills": "check the registry", "explain": "tell why a candidate was found"}
ACTIONS = {"approve": "approve a skill or draft", "deprecate": "archive a skill", "reject": "archive a draft"}
NAMED = {"promote-pattern": "make a draft of a pattern", "rename-draft": "name a draft"}
OTHERS = {"apply": "set the managed section of entry files", "review": "show what waits for review"}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="histolode", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    for name, text in (SCANS | ACTIONS | NAMED | OTHERS).items():
        p = commands.add_parser(name, help=text)
        if name in ACTIONS or name in NAMED or name == "explain":
            p.add_argument("id")
        p.add_argument("repository", nargs="?")
        p.add_argument("--repo")
        p.add_argument("--json", action="store_true")
        if name in SCANS:
            p.add_argument("-n", "--limit", type=int, default=git.DEFAULT_LIMIT)
        if name in NAMED:
            p.add_argument("--name", required=True)
        if name == "apply":
            p.add_argument("--target", choices=[*store.TARGETS, "all"], default="all")
            p.add_argument("--dry-run", action="store_true")
    commands.add_parser("help", help="print this")
    return out


def _act(args: argparse.Namespace, root: str) -> str:
    own = store.Store(root)
    if args.command in NAMED:
        row = own.promote(args.id, args.name) if args.command == "promote-pattern" else own.rename(args.id, args.name)
    elif args.command in ACTIONS:
        row = getattr(own, args.command)(args.id)
    elif args.command == "review":
        return json.dumps({"skills": own.rows("skills"), "drafts": own.rows("draft-skills"), "patterns": own.patterns(), "archived": own.archived()}) if args.json else own.review()
    else:
        changes = store.apply(root, args.target, args.dry_run)
        return json.dumps([{"path": p, "action": a} for p, a in changes]) if args.json else "\n".join(f"{a}: {p}" for p, a in changes)
    return json.dumps(row) if args.json else f"{row['name']} ({row['skill_id']}): {row['status']}"


def _scan(args: argparse.Namespace, root: str) -> str:
    spark = SparkSession.builder.master("local[*]").appName("histolode").getOrCreate()
    scanned = api.scan(spark, [root], args.limit)
    if args.command == "explain":
        return api.explain(scanned, args.id)
    if args.command in ("refresh", "validate-skills"):
        return (api.refresh if args.command == "refresh" else api.validate)(spark, scanned, root)
    if args.command in ("generate", "analyze"):
        counts = api.generate(scanned, root)
        if args.command == "analyze":
            api.cache(scanned, root)
        text = json.dumps(counts) if args.json else "\n".join(f"{k}: {n}" for k, n in counts.items())
        return text if args.command == "generate" or args.json else f"{text}\n\n{api.report(scanned)}"
    if args.command == "report":
        return api.report(scanned)
    rows = (r.asDict(True) for r in (scanned.candidates.orderBy("newest") if args.command == "mine" else scanned.surfaces.orderBy("rank")).toLocalIterator())
    if args.json:
        return json.dumps([*rows])
    line = (lambda r: f"{r['promotion_level']}: {r['name']} ({r['id']})") if args.command == "mine" else (lambda r: f"{r['surface']}: {r['commit_count']} commits, {r['confidence']:.0%}")
    return "\n".join(map(line, rows)) or "nothing found"


def main(argv: list[str] | None = None) -> int:
    given = sys.argv[1:] if argv is None else argv
    if not given or given[0] == "help":
        parser().print_help()
        return 0
    args = parser().parse_args(given)
    if getattr(args, "limit", 1) < 1:
        print("--limit must be at least 1", file=sys.stderr)
        return 1
    try:
        root = git.prepare_repository(args.repo or args.repository or ".").root
        print(_scan(args, root) if args.command in SCANS else _act(args, root))
    except (ValueError, OSError) as wrong:
        print(wrong, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
