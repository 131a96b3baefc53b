"""How the engine's inputs are laid over the relational tables; the same SQL text serves Spark and DuckDB."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import Tables

_PART_PATH = """concat(case p_size % 8 when 0 then 'tests/' when 1 then 'docs/' when 2 then 'config/' when 3 then 'src/commands/'
           when 4 then 'ui/src/components/' when 5 then 'server/api/' when 6 then 'migrations/' else 'reports/' end,
         lower(p_type), '/', replace(p_name, ' ', '_'),
         case p_size % 8 when 0 then '.test.ts' when 1 then '.md' when 2 then '.yaml' when 3 then '.rs'
           when 4 then '.component.ts' when 5 then '.ts' when 6 then '.sql' else '.report.json' end)"""
#: One row per changed file: parts of an order as files of a commit.
COMMIT_FILE = """
select concat('r', cast(o_custkey % 40 as varchar(9))) as repo_id, l_orderkey as commit_id, o_orderdate as commit_ts,
  {_PART_PATH} as file_path
from {lineitem} join {part} on l_partkey = p_partkey join {orders} on l_orderkey = o_orderkey
group by 1, 2, 3, 4
""".replace("{_PART_PATH}", _PART_PATH)

#: Hand-picked paths that reach what the tables do not.
SAMPLE_PATHS = [
    "src/app/user/user.component.ts", "src/app/user/user.component.spec.ts", "src/app/user/user.service.ts", "src/app/grid/kendo-grid.component.html",
    "server/routes/users.ts", "server/controllers/user.controller.ts", "api/views/models.py", "app/services/billing_service.py", "tests/test_api.py",
    "src/main/java/com/x/UserController.java", "src/main/java/com/x/UserRepository.kt", "Api/Controllers/OrdersController.cs", "Api/Api.csproj",
    "db/migrate/001_init.sql", "prisma/schema.prisma", "db/seeds/seed.sql", ".github/workflows/ci.yml", "Dockerfile", "infra/main.tf", "k8s/deployment.yaml",
    "package.json", "package-lock.json", "yarn.lock", "docs/adr/0001-record.md", "README.md", "CHANGELOG.md", "e2e/login.e2e.ts", "playwright.config.ts",
    "dist/bundle.js", "coverage/lcov.info", "src/__tests__/a.test.tsx", "data.expected.json", "state/repo_learning_state.json", "logs/run.log",
    ".env.local", "config/.env", "environment/prod.ts", "src/commands/add.rs", "bin/tool", "web/client/tests/a.spec.ts", "x.snapshot.json", "Makefile",
    "contracts/pact/a.json", "src/widgets/Table.tsx", "styles/site.scss", "pages/index.vue", "notes.adoc", "a/b/c/d/e.go", "LICENSE", "src\\\\win\\\\path.cs", "./src/dot.py",
]


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SAMPLES = "(values " + ", ".join(f"({literal(p)})" for p in SAMPLE_PATHS) + ") as s(file_path)"

#: Every path once, with a commit and a place of its own.
PATHS = f"select distinct file_path from ({COMMIT_FILE}) union select file_path from {SAMPLES}"

_NAMES = re.compile(r"\{(lineitem|part|orders|customer|supplier|nation|region|events|documents|embeddings|pages|benchmark|labels|conversations)\}")


def bind(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs SQL whose {table} names are read from sf_dir, through views named after the folder."""
    suffix = f"{zlib.crc32(sf_dir.encode()):08x}"
    for name in set(_NAMES.findall(sql)):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"{name}_{suffix}")
    return spark.sql(_NAMES.sub(rf"\1_{suffix}", sql).replace("\\", "\\\\"))


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``COMMIT_FILE``: a part's path is made once, and rows are told apart by the numbers of their paths."""
    paths = bind(spark, sf_dir, f"select p_partkey, {_PART_PATH} as path from {{part}}")
    known = Tables(spark, "commit_files").keep(paths.select(F.col("path").alias("file_path")).distinct().withColumn("number", F.monotonically_increasing_id()), "paths")
    parts = paths.join(known, F.col("path").eqNullSafe(F.col("file_path"))).select("p_partkey", "number")
    commits = bind(spark, sf_dir, "select o_orderkey, o_custkey % 40 as repo, o_orderdate as commit_ts from {orders}")
    lines = bind(spark, sf_dir, "select l_orderkey as commit_id, l_partkey from {lineitem}")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(commits, F.col("commit_id") == F.col("o_orderkey"))
    found = joined.select("repo", "commit_id", "commit_ts", "number").distinct().join(known, "number")
    return found.select(F.concat(F.lit("r"), F.col("repo").cast("string")).alias("repo_id"), "commit_id", "commit_ts", "file_path")


def plain(sql: str) -> str:
    """The same SQL for DuckDB, where the tables are views."""
    return _NAMES.sub(r"\1", sql)


# -- pieces of DuckDB SQL -----------------------------------------------------------


def sql_match(value: str, pattern: str) -> str:
    return f"regexp_matches({value}, {literal(pattern)})"


def sql_first_match(value: str, rules: list[tuple[str, str]], otherwise: str) -> str:
    return "case " + " ".join(f"when {sql_match(value, p)} then {literal(n)}" for n, p in rules) + f" else {literal(otherwise)} end"


def sql_tags(value: str, rules: list[tuple[str, list[str]]]) -> str:
    """A list with the tags of all rules that match, repeats included."""
    lists = [f"case when {sql_match(value, p)} then [{', '.join(map(literal, t))}] else [] end" for p, t in rules]
    return "flatten([" + ", ".join(lists) + "])"


def sql_text(tags: str) -> str:
    """Sorted distinct members of a list as text."""
    return f"array_to_string(list_sort(list_distinct({tags})), ',')"


def sql_fixed2(x: str) -> str:
    return f"(((({x}) * 1152921504606846976.0::double)::hugeint * 100 + 576460752303423488) // 1152921504606846976)::double / 100.0"


def sql_jaccard(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b}))::double / greatest(len(list_distinct(list_concat({a}, {b}))), 1))"


def sql_directory(path: str) -> str:
    return f"case when contains({path}, '/') then regexp_replace({path}, '/[^/]*$', '') else 'repo root' end"


def sql_normal(path: str) -> str:
    return f"regexp_replace(replace({path}, chr(92), '/'), '^\\./+', '')"
