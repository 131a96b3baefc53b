"""Queries over texts: tokens, terms, URLs, source features, similarity and families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr, rules
from ..functions.tables import Tables
from ..operators import families, fingerprints, sources, terms
from .bindings import PATHS, bind, literal, plain, sql_fixed2, sql_match, sql_tags

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def sql_tokens(value: str, least: int = 3) -> str:
    return f"list_filter(string_split_regex(lower(regexp_replace({value}, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda t: length(t) >= {least})"


def sql_words(words: list[str]) -> str:
    return "(" + ", ".join(map(literal, words)) + ")"


@query("t1_tokenise", f"""
with t as (select doc_id, unnest({sql_tokens('text')}) as term from documents)
select doc_id, count(*) as tokens, count(distinct term) as distinct_terms, count(*) filter (where term not in {sql_words(rules.STOP_TERMS)}) as kept from t group by 1""")
def t1_tokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bind(spark, sf_dir, "select doc_id, text from {documents}").select("doc_id", F.explode(expr.tokenize(F.col("text"))).alias("term"))
    return t.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.count_distinct("term").alias("distinct_terms"), F.count_if(~F.col("term").isin(rules.STOP_TERMS)).alias("kept"))


_PART_TERMS = sql_tokens("regexp_replace(part, '\\.[^.]+$', '')")


@query("t2_path_terms", f"""
with p as (select file_path, unnest(string_split(file_path, '/')) as part from ({plain(PATHS)}))
select file_path, coalesce(array_to_string(list_sort(list_distinct(flatten(list({_PART_TERMS})))), ','), '') as terms from p group by 1""")
def t2_path_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(spark, sf_dir, PATHS).select("file_path", F.array_join(expr.distinct_sorted(expr.path_terms(F.col("file_path"))), ",").alias("terms"))


@query("t3_normal_terms", f"""
with t as (select role, unnest({sql_tokens('text')}) as raw from conversations), n as (select role, regexp_replace(lower(raw), '[^a-z0-9-]+', '', 'g') as term from t)
select role, term, count(*) as n from n where length(term) >= 3 and not regexp_matches(term, '^\\d+$') and term not in {sql_words(rules.TERM_NOISE)} group by 1, 2""")
def t3_normal_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bind(spark, sf_dir, "select role, text from {conversations}").select("role", F.explode(expr.tokenize(F.col("text"))).alias("term"))
    return terms.normal_terms(t, "term").groupBy("role", "term").agg(F.count("*").alias("n"))


@query("t4_singular", """
select word, case when word like '%ies' and length(word) > 4 then word[:-4] || 'y' when word like '%s' and word not like '%ss' and length(word) > 3 then word[:-2] else word end as singular
from (select distinct unnest(string_split_regex(lower(text), '[^a-z]+')) as word from conversations) where word <> ''""")
def t4_singular(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = bind(spark, sf_dir, "select text from {conversations}").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("word != ''").distinct()
    return words.select("word", expr.singular(F.col("word")).alias("singular"))


@query("t5_top_terms", f"""
with t as (select source, unnest({sql_tokens('text')}) as term from documents), c as (select source, term, count(*) as n from t group by 1, 2),
r as (select *, row_number() over (partition by source order by n desc, term)::int as rank from c) select source, term, n, rank from r where rank <= 8""")
def t5_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bind(spark, sf_dir, "select source, text from {documents}").select("source", F.explode(expr.tokenize(F.col("text"))).alias("term"))
    return terms.top_terms(t, ["source"], "term", 8)


@query("t6_distinct_words", """
with t as (select doc_id, unnest(string_split(text, ' ')) as w from documents) select doc_id, count(distinct w) as n, min(w) as first, max(w) as last from t where w <> '' group by 1""")
def t6_distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bind(spark, sf_dir, "select doc_id, text from {documents}").select("doc_id", expr.distinct_sorted(F.split("text", " ")).alias("w")).where(F.size("w") > 0)
    return d.select("doc_id", F.size("w").cast("long").alias("n"), F.array_min("w").alias("first"), F.array_max("w").alias("last"))


@query("t8_slugs", """
select page_id, coalesce(nullif(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'repo-root') as slug from pages""")
def t8_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(spark, sf_dir, "select page_id, url from {pages}").select("page_id", expr.slug(F.col("url"), "repo-root").alias("slug"))


@query("t9_stable_hash", """
select o_custkey as id, substr(sha256(concat('{"statuses":[', string_agg(distinct '"' || o_orderstatus || '"', ',' order by '"' || o_orderstatus || '"'), '],"orders":', count(*), '}')), 1, 16) as hash from orders group by 1""")
def t9_stable_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = bind(spark, sf_dir, "select o_custkey as id, array_sort(collect_set(o_orderstatus)) as statuses, count(*) as orders from {orders} group by 1")
    return g.select("id", expr.stable_hash(F.struct("statuses", "orders")).alias("hash"))


_URLS = "select page_id as id, url from {pages} union all select o_orderkey as id, case o_orderkey % 4 when 0 then concat('git@host', cast(o_custkey % 5 as varchar(9)), '.org:team/app', cast(o_orderkey % 9 as varchar(9)), '.git') when 1 then 'https://h.example/deep/own/Repo.git' when 2 then 'ssh://x.example/solo' else '' end as url from {orders}"


@query("s2_remote_parts", f"""
with u as (select id, url, case when regexp_matches(url, '^git@[^:]+:.+$') then regexp_extract(url, '^git@([^:]+):(.+)$', 1) when url like '%://%' then regexp_extract(url, '^[a-z]+://([^/:]+)', 1) else 'remote' end as host,
  case when regexp_matches(url, '^git@[^:]+:.+$') then regexp_extract(url, '^git@([^:]+):(.+)$', 2) when url like '%://%' then regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)?', 1) else url end as path from ({plain(_URLS)})),
p as (select *, list_filter(string_split(regexp_replace(regexp_replace(path, '^/+', ''), '\\.git$', ''), '/'), lambda x: x <> '') as parts from u),
n as (select id, host, case when len(parts) >= 2 then parts[-2] end as owner, coalesce(parts[-1], 'repository') as name, url from p)
select id, host, owner, name, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(regexp_replace(concat_ws('-', host, owner, name), '\\.git$', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), ''), 'remote-' || substr(sha1(url), 1, 8)) as safe_name from n""")
def s2_remote_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(spark, sf_dir, _URLS).select("id", *sources.remote_parts(F.col("url")))


@query("s6_web_urls", f"""
select id, case when starts_with(url, 'git@') then 'https://' || regexp_extract(url, '^git@([^:]+):', 1) || '/' || regexp_replace(regexp_extract(url, '^git@[^:]+:(.+)$', 1), '\\.git$', '')
  when starts_with(url, 'http') then regexp_replace(url, '\\.git$', '') end as web_url from ({plain(_URLS)})""")
def s6_web_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(spark, sf_dir, _URLS).select("id", sources.web_url(F.col("url")).alias("web_url"))


@query("s8_read_sources", "select page_id, length(html) as length from pages where length(html) <= 512000")
def s8_read_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(spark, sf_dir, "select page_id, html from {pages}").where(sources.readable(F.col("html"))).select("page_id", F.length("html").cast("long").alias("length"))


_PACKAGES = "select event_id, case event_id % 5 when 0 then '{{broken' when 1 then '{{\"name\": \"x\"}}' else concat('{{\"scripts\": {{\"z\": ', cast(event_id % 3 as varchar(9)), ', \"', event_type, '\": \"go\", \"build\": \"tsc\"}}, \"props\": ', props, '}}') end as raw from {events}".replace("{{", "{").replace("}}", "}")


@query("s9_package_scripts", f"""
with r as (select event_id, case when json_valid(raw) then json_extract(raw, '$.scripts') end as scripts from ({plain(_PACKAGES)}))
select event_id, coalesce(array_to_string(list_sort(list_filter(json_keys(scripts), lambda k: json_type(scripts, '$.' || k) = 'VARCHAR')), ','), '') as names from r""")
def s9_package_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(spark, sf_dir, _PACKAGES).select("event_id", F.array_join(sources.package_scripts(F.col("raw")), ",").alias("names"))


_PROJECT = "select o_orderkey as id, concat('x: 1', chr(10), '    run: ', case o_orderkey % 5 when 0 then 'npm test' when 1 then 'npm run lint' when 2 then 'pytest' when 3 then 'rm -rf /' else 'cargo test' end, chr(10), '- run: pytest') as ci from {orders}"


@query("s11_ci_commands", f"""
with l as (select id, unnest(string_split(ci, chr(10))) as line from ({plain(_PROJECT)}))
select id, regexp_extract(line, '^\\s*run:\\s*(npm test|npm run [\\w:-]+|pytest|go test \\./\\.\\.\\.|dotnet test|cargo test|mvn test|\\./gradlew test|gradle test)\\s*$', 1) as command from l where command <> ''""")
def s11_ci_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = bind(spark, sf_dir, _PROJECT)
    return lines.select("id", F.explode(sources.ci_commands(F.col("ci"))).alias("command"))


@query("s10_preferred_commands", """
with s as (select o_custkey as id, list(distinct case o_orderkey % 7 when 0 then 'test' when 1 then 'build' when 2 then 'lint' when 3 then 'typecheck' when 4 then 'e2e' when 5 then 'ui:test' else 'start' end) as scripts from orders group by 1)
select id, array_to_string(list_transform(list_filter(['test', 'build', 'typecheck', 'lint', 'e2e', 'ui:test'], lambda x: list_contains(scripts, x)), lambda x: case when x = 'test' then 'npm test' else 'npm run ' || x end), '|') as commands from s""")
def s10_preferred_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bind(spark, sf_dir, "select o_custkey as id, collect_set(case o_orderkey % 7 when 0 then 'test' when 1 then 'build' when 2 then 'lint' when 3 then 'typecheck' when 4 then 'e2e' when 5 then 'ui:test' else 'start' end) as scripts from {orders} group by 1")
    return s.select("id", F.array_join(sources.npm_commands(F.col("scripts"), F.lit("")), "|").alias("commands"))


# -- source features on web pages ------------------------------------------------------

_COMMON = "(" + ", ".join(literal(t) for t in rules.COMMON_TAGS) + ")"


@query("f6_component_tags", f"""
with t as (select page_id, html, list_transform(regexp_extract_all(html, '(?i)<([a-z][\\w-]*)\\b', 1), lambda x: lower(x)) as tags from pages)
select page_id, array_to_string(list_sort(list_distinct(list_filter(tags, lambda t: contains(t, '-') or t not in {_COMMON}))), ',') as tags from t""")
def f6_component_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(spark, sf_dir, "select page_id, html from {pages}").select("page_id", F.array_join(fingerprints.component_tags(F.col("html"), F.lit(".vue")), ",").alias("tags"))


def _ascii(pattern: str) -> str:
    return pattern.replace(fingerprints.B, r"\b").replace(fingerprints.E, r"\b")


@query("f8_word_concepts", f"""
select page_id, array_to_string(list_sort(list_distinct(flatten([{sql_tags('lower(html)', [(_ascii(p), c) for p, c in fingerprints.WORD_CONCEPTS])}, {sql_tags('lower(html)', [(chr(92) + 'b' + c + chr(92) + 'b', [rules.CONCEPT_SYNONYMS.get(c, c)]) for c in rules.CONCEPT_TERMS])}]))), ',') as concepts from pages""")
def f8_word_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = bind(spark, sf_dir, "select page_id, html from {pages}")
    whole = F.lower("html")
    found = F.filter(F.array(*(F.when(whole.rlike(f"{fingerprints.B}{c}{fingerprints.E}"), fingerprints.concept(F.lit(c))) for c in rules.CONCEPT_TERMS)), lambda v: v.isNotNull())
    return p.select("page_id", F.array_join(expr.distinct_sorted(F.concat(expr.tags(whole, fingerprints.WORD_CONCEPTS), found)), ",").alias("concepts"))


#: Source texts in several languages, from parts.
_SOURCES = """
select p_partkey as id, concat(case p_size % 4 when 0 then 'src/ui/a' when 1 then 'src/commands/b' when 2 then 'api/controllers/c' else 'db/migrations/d' end, cast(p_partkey as varchar(9)), case p_size % 4 when 0 then '.tsx' when 1 then '.rs' when 2 then '.java' else '.sql' end) as path,
  case p_size % 4 when 0 then concat('import React from "react"', chr(10), 'import { Grid', cast(p_size as varchar(9)), ' } from "@acme/grid-kit/core"', chr(10), 'export function List', cast(p_size % 5 as varchar(9)), '() { return <kendo-grid><my-cell/></kendo-grid> }')
    when 1 then concat('use clap::Parser;', chr(10), 'pub struct Args', cast(p_size % 6 as varchar(9)), ' {}', chr(10), '#[arg(long)]', chr(10), 'fn run_', cast(p_size % 3 as varchar(9)), '(x: i32) {', chr(10), '--verbose', cast(p_size % 2 as varchar(9)))
    when 2 then concat('@RestController', chr(10), 'public class Part', cast(p_size % 7 as varchar(9)), 'Controller {', chr(10), '@RequestMapping("/parts/', cast(p_size % 3 as varchar(9)), '")', chr(10), 'void get(String id) {')
    else concat('CREATE TABLE part_', cast(p_size % 5 as varchar(9)), ' (id int);', chr(10), 'create index i on part(id);', chr(10), 'select sort from page') end as text
from {part}
"""


def _pulled(table: list[tuple[str, int, str | None]], extension: str) -> str:
    lists = [f"regexp_extract_all(text, {literal(_ascii(p))}, {g})" for p, g, only in table if only is None]
    lists += [f"case when {extension} = '{only}' then regexp_extract_all(text, {literal(_ascii(p))}, {g}) else [] end" for p, g, only in table if only is not None]
    return "array_to_string(list_sort(list_distinct(list_filter(list_transform(flatten([" + ", ".join(lists) + "]), lambda x: trim(x)), lambda x: x <> ''))), '|')"


_EXT = "regexp_extract(path, '(\\.[^.]*)$', 1)"


def _features(name: str, column: str, table: list[tuple[str, int, str | None]]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = bind(spark, sf_dir, _SOURCES).withColumn("extension", expr.ext_name(F.col("path")))
        return t.select("id", F.array_join(expr.distinct_sorted(F.transform(fingerprints.read(F.col("text"), F.col("extension"), table), lambda v: F.trim(v))), "|").alias(column))

    QUERIES[name] = run
    ORACLES[name] = f"select id, {_pulled(table, _EXT)} as {column} from ({plain(_SOURCES)})"


_features("f2_imports", "imports", fingerprints.IMPORTS)
_features("f3_exported_symbols", "symbols", fingerprints.EXPORTED)
_features("f3_class_names", "names", fingerprints.CLASSES)
_features("f3_type_names", "names", fingerprints.TYPES)
_features("f4_annotations", "annotations", fingerprints.ANNOTATIONS)
_features("f4_decorators", "decorators", fingerprints.DECORATORS)
_features("f5_cli_options", "options", fingerprints.OPTIONS)
_features("f5_models", "models", fingerprints.MODELS)


#: What each kind of text holds, written out by hand.
_KIND_LISTS = {
    "frameworks": ("'react'", "'rust'", "'spring'", "''"), "libraries": ("'@acme/grid-kit,React,kendo-angular-grid,react'", "'clap,clap::Parser'", "''", "''"), "roles": ("'component,grid,ui'", "'cli'", "'api,controller,route'", "'database'"),
    "concepts": ("'columns,export,grid'", "'command,option'", "'api,controller,rest'", "'page,pagination,paging,sorting,table'"), "component_tags": ("'kendo-grid,my-cell'", "''", "''", "''"), "routes": ("''", "''", "'RequestMapping /parts/' || p_size % 3", "''"),
    "cli_options": ("''", "'#[arg(long)],--verbose1'", "''", "''"), "schema_models": ("''", "''", "''", "'part_' || p_size % 5"), "migrations": ("''", "''", "''", "'create index,create table'"),
    "symbol_patterns": ("'list' || p_size % 5", "(p_size % 3) || ',args' || (p_size % 6) || ',run'", "'controller,part' || p_size % 7", "''"),
}


@query("f1_fingerprints", "select id, path, " + ", ".join(f"case p_size % 4 when 0 then {a} when 1 then {b} when 2 then {c} else {d} end as {n}" for n, (a, b, c, d) in _KIND_LISTS.items()) + f" from ({plain(_SOURCES)}) join part on p_partkey = id")
def f1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = fingerprints.fingerprint(bind(spark, sf_dir, _SOURCES))
    join = lambda c: F.array_join(c, ",").alias(c)
    return prints.select("id", "path", *(join(c) for c in ("frameworks", "libraries", "roles", "concepts", "component_tags", "routes", "cli_options", "schema_models", "migrations", "symbol_patterns")))


@query("f9_feature_views", f"""select id, case p_size % 4 when 0 then 'list' || p_size % 5 when 1 then (p_size % 3) || ',args' || (p_size % 6) || ',run' when 2 then 'controller,part' || p_size % 7 else '' end as symbols,
  case when p_size % 4 = 2 then 'requestmapping /parts/' || p_size % 3 else '' end as routes from ({plain(_SOURCES)}) join part on p_partkey = id""")
def f9_feature_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = fingerprints.fingerprint(bind(spark, sf_dir, _SOURCES))
    return prints.select("id", F.array_join("symbol_patterns", ",").alias("symbols"), F.array_join("route_patterns", ",").alias("routes"))


#: The same texts, tests among them, and texts that show nothing.
_MIXED = f"{_SOURCES} union all select -id, concat('tests/t', cast(id as varchar(9)), '.test.tsx'), text from ({_SOURCES}) union all select -1000000 - id, concat('lib/x', cast(id as varchar(9)), '.go'), 'x' from ({_SOURCES})"


@query("f11_eligible_sources", f"select id, path from ({plain(_SOURCES)})")
def f11_eligible_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = Tables(spark, "f11").keep(fingerprints.fingerprint(bind(spark, sf_dir, _MIXED)), "prints")
    return fingerprints.eligible(kept).select("id", "path")


@query("f7_frameworks", f"""
select id, case when {_EXT} = '.tsx' then 'react' when {sql_match('text', '(?i)#\\[\\s*(?:arg|clap)')} then 'rust' when {sql_match('text', '@RestController')} then 'spring' else '' end as frameworks from ({plain(_SOURCES)})""")
def f7_frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(bind(spark, sf_dir, _SOURCES)).select("id", F.array_join("frameworks", ",").alias("frameworks"))


#: Feature lists from customers, for similarity and families.
_PRINTS = """
select concat('n', cast(c_nationkey as varchar(9))) as repo_id, concat('src/', lower(c_mktsegment), '/f', cast(c_custkey as varchar(9)), '.ts') as path,
  array(concat('fw', cast(c_custkey % 3 as varchar(9)))) as frameworks, array(concat('lib', cast(c_custkey % 5 as varchar(9))), concat('lib', cast(c_custkey % 7 as varchar(9)))) as libraries,
  array(lower(c_mktsegment)) as roles, array(concat('c', cast(c_custkey % 4 as varchar(9))), 'grid') as concepts, array(concat('tag-', cast(c_custkey % 6 as varchar(9)))) as component_tags
from {customer}
"""


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    p = bind(spark, sf_dir, _PRINTS).withColumn("libraries", F.array_distinct("libraries"))
    return p.select("*", *(none.alias(n) for n in families.LISTS if n not in p.columns))


_DUCK_PRINTS = plain(_PRINTS).replace("array(", "list_value(").replace("list_value(concat('lib', cast(c_custkey % 5 as varchar(9))), concat('lib', cast(c_custkey % 7 as varchar(9))))", "list_distinct(list_value(concat('lib', cast(c_custkey % 5 as varchar(9))), concat('lib', cast(c_custkey % 7 as varchar(9)))))")
_SCORE = " + ".join(f"len(list_intersect(a.{n}, b.{n}))::double / len(list_distinct(list_concat(a.{n}, b.{n}))) * {w}::double" for _, n, w in rules.SIMILARITY_WEIGHTS if n in ("frameworks", "libraries", "component_tags", "roles", "concepts"))
_SIMILAR = f"""p as ({_DUCK_PRINTS}),
s as (select a.repo_id, a.path as earlier, b.path as later, {sql_fixed2(f'least(1.0::double, 0.0::double + {_SCORE})')} as score from p a join p b on a.repo_id = b.repo_id and a.path < b.path),
pairs as (select * from s where score >= 0.5)"""


@query("f10_similar_sources", f"with {_SIMILAR} select repo_id, earlier, later, score from pairs")
def f10_similar_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.similar_pairs(_prints(spark, sf_dir), ["repo_id"])


@query("u1_families", f"""
with recursive {_SIMILAR},
best as (select repo_id, later, earlier from pairs qualify score = max(score) over (partition by repo_id, later)),
reach(repo_id, path, root) as (select repo_id, later, earlier from best union select r.repo_id, r.path, b.earlier from reach r join best b on b.repo_id = r.repo_id and b.later = r.root),
ends as (select repo_id, path, min(root) as root from reach r where not exists (select 1 from best b where b.repo_id = r.repo_id and b.later = r.root) group by 1, 2)
select repo_id, path, root from ends union select distinct repo_id, root, root from ends""")
def u1_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = Tables(spark, "u1").keep(families.best_earlier(_prints(spark, sf_dir), ["repo_id"]), "best")
    return families.families(best, ["repo_id"])


def _shared(name: str, limit: int) -> str:
    """SQL for the values of a list that most members share, two at least if any are, as text and as their number."""
    return f"""{name}_n as (select repo_id, root, v, count(*) as n from (select repo_id, root, unnest({name}) as v from members) group by 1, 2, 3),
{name}_k as (select *, row_number() over (partition by repo_id, root order by n desc, v) as r from (select *, max(n) over (partition by repo_id, root) >= 2 as two from {name}_n) where not two or n >= 2),
{name}_s as (select repo_id, root, string_agg(v, ',' order by r) as {name}, count(*) as {name}_size from {name}_k where r <= {limit} group by 1, 2)"""


@query("u2_family_summaries", f"""
with recursive {_SIMILAR},
best as (select repo_id, later, earlier, score from pairs qualify score = max(score) over (partition by repo_id, later)),
reach(repo_id, path, root) as (select repo_id, later, earlier from best union select r.repo_id, r.path, b.earlier from reach r join best b on b.repo_id = r.repo_id and b.later = r.root),
ends as (select repo_id, path, min(root) as root from reach r where not exists (select 1 from best b where b.repo_id = r.repo_id and b.later = r.root) group by 1, 2),
clusters as (select repo_id, path, root from ends union select distinct repo_id, root, root from ends),
members as (select c.root, p.* from clusters c join p using (repo_id, path)),
average as (select repo_id, root, avg(score) as average from (select distinct b.repo_id, c.root, b.later, b.score from best b join clusters c on c.repo_id = b.repo_id and c.path = b.later where c.path <> c.root) group by 1, 2),
{_shared('frameworks', 4)}, {_shared('libraries', 5)}, {_shared('concepts', 8)}, {_shared('roles', 6)},
sized as (select repo_id, root, count(distinct path) as files from members group by 1, 2),
scored as (select *, least(0.98::double, average + 0.08::double + 0.08::double + case when concepts_size >= 2 then 0.08::double else 0.0::double end + 0.05::double + case when files >= 3 then 0.06::double else 0.0::double end) as c
  from sized join average using (repo_id, root) join frameworks_s using (repo_id, root) join libraries_s using (repo_id, root) join concepts_s using (repo_id, root) join roles_s using (repo_id, root)),
kept as (select *, {sql_fixed2('c')} as confidence from scored)
select repo_id, root, files, frameworks, libraries, concepts, confidence, rank from (
  select *, row_number() over (partition by repo_id order by confidence desc, files desc, root)::int as rank from kept where confidence >= {rules.FAMILY_MIN_CONFIDENCE} and files >= 2) where rank <= {rules.FAMILIES_KEPT}""")
def u2_family_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = _prints(spark, sf_dir)
    best = Tables(spark, "u2").keep(families.best_earlier(prints, ["repo_id"]), "best")
    found = families.summarise(prints, families.families(best, ["repo_id"]), best, ["repo_id"])
    return found.select("repo_id", "root", F.size("files").cast("long").alias("files"), F.array_join("frameworks", ",").alias("frameworks"), F.array_join("libraries", ",").alias("libraries"), F.array_join("concepts", ",").alias("concepts"), "confidence", "rank")
