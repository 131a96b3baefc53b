"""Repository addresses and validation commands as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import expr

#: Scripts worth running, in order (fixed values).
PREFERRED_SCRIPTS = ["test", "build", "typecheck", "lint", "e2e", "ui:test"]
PREFERRED_TARGETS = ["test", "build", "typecheck", "lint", "e2e"]
#: Commands that a workflow line may hold as a whole (fixed values).
CI_COMMAND = r"^\s*run:\s*(npm test|npm run [\w:-]+|pytest|go test \./\.\.\.|dotnet test|cargo test|mvn test|\./gradlew test|gradle test)\s*\z"
SCP = r"^git@([^:]+):(.+)\z"


#: Longest text that is read as a source file, in characters (fixed value).
MAX_LENGTH = 512_000


def readable(text: Column) -> Column:
    return F.length(text) <= MAX_LENGTH


def package_scripts(raw: Column) -> Column:
    """The names of a package file's scripts that are texts, sorted; none if it cannot be parsed."""
    scripts = F.try_variant_get(F.try_parse_json(raw), "$.scripts", "map<string,variant>")
    texts = F.map_filter(scripts, lambda _, v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.array_sort(F.map_keys(texts)), F.array().cast("array<string>"))


def remote_parts(url: Column) -> list[Column]:
    """host, owner, name and safe_name of a repository address."""
    scp, full = url.rlike(SCP), url.contains("://")
    host = F.when(scp, F.regexp_extract(url, SCP, 1)).when(full, F.regexp_extract(url, r"^[a-z]+://([^/:]+)", 1)).otherwise(F.lit("remote"))
    path = F.when(scp, F.regexp_extract(url, SCP, 2)).when(full, F.regexp_extract(url, r"^[a-z]+://[^/]+(/[^?#]*)?", 1)).otherwise(url)
    parts = expr.present(F.split(F.regexp_replace(F.regexp_replace(path, "^/+", ""), r"\.git\z", ""), "/"))
    owner = F.when(F.size(parts) >= 2, F.element_at(parts, -2))
    name = F.when(F.size(parts) >= 1, F.element_at(parts, -1)).otherwise(F.lit("repository"))
    joined = F.regexp_replace(F.concat_ws("-", host, owner, name), r"(?i)\.git\z", "")
    safe = F.substring(expr.slug(joined), 1, 80)
    return [host.alias("host"), owner.alias("owner"), name.alias("name"), F.when(safe == "", F.concat(F.lit("remote-"), F.substring(F.sha1(url), 1, 8))).otherwise(safe).alias("safe_name")]


def web_url(remote: Column) -> Column:
    scp = F.concat(F.lit("https://"), F.regexp_extract(remote, SCP, 1), F.lit("/"), F.regexp_replace(F.regexp_extract(remote, SCP, 2), r"\.git\z", ""))
    return F.when(remote.rlike(SCP), scp).when(remote.startswith("https://") | remote.startswith("http://"), F.regexp_replace(remote, r"\.git\z", ""))


def npm_commands(scripts: Column, prefix: Column) -> Column:
    """The preferred scripts that exist as commands; prefix: the project's folder, empty for the root."""
    npm = F.when(prefix == "", F.lit("npm ")).otherwise(F.concat(F.lit("npm --prefix "), prefix, F.lit(" ")))
    known = F.filter(F.array(*map(F.lit, PREFERRED_SCRIPTS)), lambda s: F.array_contains(scripts, s))
    return F.transform(known, lambda s: F.concat(npm, F.when(s == "test", s).otherwise(F.concat(F.lit("run "), s))))


def make_commands(makefile: Column) -> Column:
    targets = F.transform(F.split(makefile, "\n"), lambda x: F.regexp_extract(x, r"^([A-Za-z0-9_.:-]+):(?:\s|\z)", 1))
    return F.transform(F.filter(F.array(*map(F.lit, PREFERRED_TARGETS)), lambda t: F.array_contains(targets, t)), lambda t: F.concat(F.lit("make "), t))


def ci_commands(workflow: Column) -> Column:
    return expr.present(F.array_distinct(F.transform(F.split(workflow, "\n"), lambda x: F.regexp_extract(x, CI_COMMAND, 1))))
