"""Queries over commits and files: frequencies, co-change, surfaces, joins and overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr, rules
from ..operators import classify, cochange, joins
from .bindings import COMMIT_FILE, bind, plain, sql_directory, sql_fixed2, sql_jaccard
from .paths import GENERATED, NOISY, ROLE, N

QUERIES, ORACLES = {}, {}
FILES = plain(COMMIT_FILE)


def query(name: str, sql: str | None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


@query("a2_file_frequency", f"""
with c as (select repo_id, file_path, count(distinct commit_id) as commit_count from ({FILES}) group by 1, 2),
r as (select *, {ROLE} as role, row_number() over (partition by repo_id order by commit_count desc, file_path) as rank from c)
select repo_id, file_path, commit_count, role, rank::int as rank from r where rank <= 50""")
def a2_file_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cochange.file_frequency(bind(spark, sf_dir, COMMIT_FILE), ["repo_id"], "commit_id")


@query("a2_directory_frequency", f"""
with c as (select repo_id, {sql_directory(N)} as directory, count(distinct commit_id) as commit_count from ({FILES}) group by 1, 2),
r as (select *, row_number() over (partition by repo_id order by commit_count desc, directory) as rank from c)
select repo_id, directory, commit_count, rank::int as rank from r where rank <= 50""")
def a2_directory_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cochange.directory_frequency(bind(spark, sf_dir, COMMIT_FILE), ["repo_id"], "commit_id")


_ELIGIBLE = f"select distinct repo_id, commit_id, {N} as file_path from ({FILES}) where not {GENERATED} and {ROLE} in ('source', 'test', 'config', 'docs')"
_PAIRS = f"""e as ({_ELIGIBLE}),
p as (select a.repo_id, a.file_path as file_a, b.file_path as file_b, count(*) as weight from e a join e b on a.repo_id = b.repo_id and a.commit_id = b.commit_id and a.file_path < b.file_path group by 1, 2, 3 having count(*) >= 2),
edges as (select *, row_number() over (partition by repo_id order by weight desc, file_a, file_b)::int as rank from p)"""


@query("a3_cochange_pairs", f"with {_PAIRS} select repo_id, file_a, file_b, weight, rank from edges where rank <= 50")
def a3_cochange_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cochange.cochange_pairs(bind(spark, sf_dir, COMMIT_FILE), ["repo_id"], "commit_id")


#: The pairs over all orders, without repositories: the largest self-join.
_ALL = f"select 'all' as repo_id, commit_id, file_path from ({COMMIT_FILE})"


@query("a3_cochange_all", f"""
with e as (select distinct commit_id, {N} as file_path from ({FILES}) where not {GENERATED} and {ROLE} in ('source', 'test', 'config', 'docs'))
select a.file_path as file_a, b.file_path as file_b, count(*) as weight from e a join e b on a.commit_id = b.commit_id and a.file_path < b.file_path group by 1, 2 having count(*) >= 2""")
def a3_cochange_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cochange.cochange_pairs(bind(spark, sf_dir, _ALL), ["repo_id"], "commit_id", keep=None).select("file_a", "file_b", "weight")


_SURFACES = f"""{_PAIRS},
f as (select distinct repo_id, commit_id, {N} as file_path from ({FILES})),
r as (select *, {ROLE} as role, {sql_directory(N)} as directory from f),
touched as (select distinct repo_id, commit_id, directory as surface from r where role in ('source', 'docs') and directory <> 'repo root'),
m as (select t.surface, r.* from touched t join r using (repo_id, commit_id)),
commits as (select repo_id, surface, count(distinct commit_id) as commit_count from m group by 1, 2),
k as (select *, case when role in ('source', 'docs') and directory = surface then 'source' when role = 'test' then 'test' when role in ('config', 'docs') then 'config' end as kind from m),
n as (select repo_id, surface, kind, file_path, count(*) as n, row_number() over (partition by repo_id, surface, kind order by count(*) desc, file_path) as rank from k where kind is not null group by 1, 2, 3, 4),
lists as (select repo_id, surface, count(*) filter (where kind = 'source' and rank <= 8) as sources, count(*) filter (where kind = 'test' and rank <= 8) as tests,
  string_agg(file_path, '|' order by rank) filter (where kind = 'source' and rank <= 8) as representative_files from n group by 1, 2),
ends as (select repo_id, file_a, file_b, unnest([file_a, file_b]) as file_path from edges where rank <= 50),
touching as (select repo_id, surface, least(count(*), 8) as edge_count from (select distinct n.repo_id, surface, file_a, file_b from n join ends using (repo_id, file_path) where kind = 'source') group by 1, 2),
s as (select c.repo_id, c.surface, commit_count, representative_files, sources, tests, coalesce(edge_count, 0) as edge_count,
  {sql_fixed2("least(0.97::double, 0.22::double + least(commit_count, 8) * 0.06::double + least(sources, 6) * 0.035::double + case when tests > 0 then 0.16::double else 0.0::double end + 0.0::double + least(coalesce(edge_count, 0), 5) * 0.025::double)")} as confidence
  from commits c join lists using (repo_id, surface) left join touching using (repo_id, surface)),
ranked as (select *, row_number() over (partition by repo_id order by confidence desc, commit_count desc, surface)::int as rank from s where commit_count >= 2 and sources > 0 and confidence >= 0.35)"""


@query("a4_learned_surfaces", f"with {_SURFACES} select repo_id, surface, commit_count, representative_files, tests, edge_count, confidence, rank from ranked where rank <= 25")
def a4_learned_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = bind(spark, sf_dir, COMMIT_FILE)
    edges = cochange.cochange_pairs(f, ["repo_id"], "commit_id")
    found = cochange.learn_surfaces(f, ["repo_id"], "commit_id", edges)
    return found.select("repo_id", "surface", "commit_count", F.array_join("representative_files", "|").alias("representative_files"), F.size("test_files").cast("long").alias("tests"), F.col("edge_count").cast("long").alias("edge_count"), "confidence", "rank")


_UNITS = "select p_partkey as id, p_size % 12 as commits, p_size % 9 as sources, p_size % 3 as tests, p_size % 2 as commands, p_size % 7 as edges from {part}"


@query("a5_surface_confidence", f"""select id, {sql_fixed2('''least(0.97::double, 0.22::double + least(commits, 8) * 0.06::double + least(sources, 6) * 0.035::double
  + case when tests > 0 then 0.16::double else 0.0::double end + case when commands > 0 then 0.12::double else 0.0::double end + least(edges, 5) * 0.025::double)''')} as confidence from ({plain(_UNITS)})""")
def a5_surface_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return bind(spark, sf_dir, _UNITS).select("id", cochange.surface_confidence(c("commits"), c("sources"), c("tests"), c("commands"), c("edges")).alias("confidence"))


@query("a6_role_counts", f"select repo_id, {', '.join(f'''count(*) filter (where role = '{r}') as {r.replace('-', '_')}''' for r in rules.ROLE_NAMES)} from (select *, {ROLE} as role from ({FILES})) group by 1")
def a6_role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cochange.role_counts(bind(spark, sf_dir, COMMIT_FILE), ["repo_id"])


@query("a9_artifact_share", f"select repo_id, commit_id, count(*) filter (where {NOISY}) * 1.0::double / count(*) as artifact_share from ({FILES}) group by 1, 2")
def a9_artifact_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cochange.artifact_share(bind(spark, sf_dir, COMMIT_FILE), ["repo_id", "commit_id"])


_TOP_SURFACES = f"select repo_id, directory as surface from (select repo_id, {sql_directory(N)} as directory, row_number() over (partition by repo_id order by count(*) desc, {sql_directory(N)}) as r from ({FILES}) group by 1, 2) where r <= 6"


@query("j1_commit_surfaces", f"""
with s as ({_TOP_SURFACES}), f as (select distinct repo_id, commit_id, {N} as p from ({FILES}))
select repo_id, commit_id, string_agg(distinct surface, ',' order by surface) as surfaces from f join s using (repo_id) where p = surface or starts_with(p, surface || '/') group by 1, 2""")
def j1_commit_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = bind(spark, sf_dir, COMMIT_FILE)
    tops = cochange.directory_frequency(f.withColumn("commit_id", F.struct("commit_id", "file_path")), ["repo_id"], "commit_id", 6).select("repo_id", F.col("directory").alias("surface"))
    found = joins.commits_of_directories(f, tops, ["repo_id"], "commit_id")
    return found.groupBy("repo_id", "commit_id").agg(F.array_join(F.array_sort(F.collect_set("surface")), ",").alias("surfaces"))


@query("j4_evidence_split", f"""
with s as ({_TOP_SURFACES}), f as (select repo_id, commit_id, {N} as p, {NOISY} as noisy from ({FILES}))
select repo_id, surface, count(*) filter (where direct) as direct_commits, count(*) filter (where not direct) as rejected_commits from (
  select f.repo_id, surface, commit_id, bool_or((p = surface or starts_with(p, surface || '/')) and not noisy) as direct from f join s using (repo_id) group by 1, 2, 3) group by 1, 2""")
def j4_evidence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = bind(spark, sf_dir, COMMIT_FILE)
    tops = cochange.directory_frequency(f.withColumn("commit_id", F.struct("commit_id", "file_path")), ["repo_id"], "commit_id", 6).select("repo_id", F.col("directory").alias("surface"))
    return joins.evidence_split(f, tops, ["repo_id"], "commit_id")


@query("j6_family_commits", f"""
with fam as (select repo_id, file_path from (select repo_id, file_path, row_number() over (partition by repo_id order by count(distinct commit_id) desc, file_path) as r from ({FILES}) group by 1, 2) where r <= 5)
select repo_id, count(distinct commit_id) as commits from ({FILES}) f semi join fam using (repo_id, file_path) group by 1""")
def j6_family_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = bind(spark, sf_dir, COMMIT_FILE)
    family = cochange.file_frequency(f, ["repo_id"], "commit_id", 5).select("repo_id", "file_path")
    return joins.commits_of_files(f, family, ["repo_id"], "commit_id").groupBy("repo_id").agg(F.count("*").alias("commits"))


_CLUSTERS = "select o_custkey as cluster, l_partkey as member from {orders} join {lineitem} on o_orderkey = l_orderkey group by 1, 2"


@query("j7_cluster_overlap", f"""
with c as ({plain(_CLUSTERS)}), s as (select cluster, count(*) as n from c group by 1),
p as (select a.cluster as a, b.cluster as b, count(*) as shared from c a join c b on a.member = b.member and a.cluster < b.cluster group by 1, 2)
select a, b, shared, shared::double / (x.n + y.n - shared) as overlap from p join s x on x.cluster = a join s y on y.cluster = b where shared::double / (x.n + y.n - shared) >= 0.05""")
def j7_cluster_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.overlaps(bind(spark, sf_dir, _CLUSTERS), "cluster", "member", 0.05)


_SETS = "select o_custkey as id, collect_set(o_orderpriority) as a, collect_set(o_orderstatus) as b, collect_set(case when o_orderkey % 2 = 0 then o_orderpriority end) as c from {orders} group by 1"


@query("t7_jaccard", f"""
with s as (select o_custkey as id, list(distinct o_orderpriority) as a, coalesce(list(distinct o_orderpriority) filter (where o_orderkey % 2 = 0), []) as c from orders group by 1)
select id, {sql_jaccard('a', 'c')} as overlap, {sql_fixed2(sql_jaccard('a', 'c'))} as rounded from s""")
def t7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    overlap = expr.jaccard(F.col("a"), F.col("c"))
    return bind(spark, sf_dir, _SETS).select("id", overlap.alias("overlap"), expr.to_fixed2(overlap).alias("rounded"))


_MARKERS = f"""select repo_id, {sql_directory(N)} as root from ({FILES}) group by 1, 2 having count(*) % 3 = 0"""


@query("s12_nearest_roots", f"""
with m as ({_MARKERS}), f as (select distinct repo_id, {N} as p from ({FILES})),
near as (select f.repo_id, f.p, arg_max(root, length(root)) as root from f join m on f.repo_id = m.repo_id and starts_with(p, root || '/') group by 1, 2)
select repo_id, root, count(*) as files, row_number() over (partition by repo_id order by count(*) desc, root)::int as rank from near group by 1, 2 qualify rank <= 2""")
def s12_nearest_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = bind(spark, sf_dir, COMMIT_FILE)
    roots = f.groupBy("repo_id", expr.directory_of(F.col("file_path")).alias("root")).agg(F.count("*").alias("n")).where("n % 3 = 0").select("repo_id", "root")
    return joins.ranked_roots(f, roots, ["repo_id"], 2)


_EVENTS_ORDER = "select user_id, event_id, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) as ordinal from {events}"


@query("l2_commits_since", f"""
with o as ({plain(_EVENTS_ORDER)}), h as (select user_id, min(ordinal) as head from o where event_id % 7 = 0 group by 1)
select user_id, count(*) filter (where ordinal < coalesce(head, 1000000000)) as newer, count(*) as total from o left join h using (user_id) group by 1""")
def l2_commits_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = bind(spark, sf_dir, _EVENTS_ORDER)
    heads = ordered.where("event_id % 7 = 0").groupBy("user_id").agg(F.min("ordinal").alias("head"))
    marked = joins.since(ordered, heads, ["user_id"])
    return marked.groupBy("user_id").agg(F.count_if("newer").alias("newer"), F.count("*").alias("total"))
