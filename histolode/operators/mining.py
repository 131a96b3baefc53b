"""Candidates from commit clusters: evidence, areas, surface, workflow, names, confidences and promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from . import candidates, classify, cochange, joins, naming, signals, terms, workflow

KEYS = ["repo_id", "cluster"]
COMMIT = ["repo_id", "hash"]


def _none() -> Column:
    return F.array().cast("array<string>")


def _list(column: str) -> Column:
    return F.coalesce(column, _none())


def _leading(rows: DataFrame, value: str, limit: int = 8) -> DataFrame:
    """Per cluster its values by the number of commits that show them, and the highest number."""
    counted = rows.groupBy(*KEYS, value).agg(F.count_distinct("hash").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v")))), lambda x: x["v"])
    return counted.groupBy(*KEYS).agg(F.max("n").alias(f"top_{value}"), F.slice(ordered, 1, limit).alias(f"{value}_list"))


def _areas(members: DataFrame, commits: DataFrame, files: DataFrame) -> DataFrame:
    """Per cluster the area of most of its commits, and their share."""
    shown = commits.select(*COMMIT, F.explode("generic_signals").alias("signal"))
    own = candidates.commit_primary_areas(shown, classify.commit_areas(files, COMMIT), COMMIT)
    counted = members.select(*KEYS, "hash", "commits").join(own, COMMIT).groupBy(*KEYS, "commits", "primary_area").agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*map(F.lit, candidates.AREA_ORDER)), F.col("primary_area"))
    first = counted.withColumn("r", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("n").desc(), place))).where("r = 1")
    return first.select(*KEYS, "primary_area", F.round(F.col("n") / F.col("commits"), 2).alias("area_share"))


def _terms(file_rows: DataFrame, members: DataFrame) -> DataFrame:
    """Per cluster three domain terms at most, those named besides, and their strength."""
    ranked = workflow.domain_terms(file_rows, KEYS, "hash", naming.NAMING_NOISE)
    once = terms.without_plurals(ranked, KEYS, "term", "rank")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"])
    sizes = members.select(*KEYS, "commits").distinct()
    found = once.groupBy(*KEYS).agg(F.max("n").alias("most"), ordered.alias("repeated_terms")).join(sizes, KEYS)
    selected = F.slice("repeated_terms", 1, 3)
    return found.select(*KEYS, "repeated_terms", selected.alias("terms"), F.least(F.lit(1.0), F.col("most") / F.col("commits") + F.size(selected) * F.lit(0.08)).alias("strength"))


def _matches(file_rows: DataFrame, sized: DataFrame, surfaces: DataFrame, commands: DataFrame) -> DataFrame:
    """Per cluster its best surface: shares, kind, confidence and files."""
    useful = file_rows.where(~F.col("noisy")).select(*KEYS, "hash", "file_path").distinct()
    above = useful.select(*KEYS, "hash", "file_path", F.explode(joins.ancestors(F.col("file_path"))).alias("surface"))
    direct = above.join(surfaces.select("repo_id", "surface"), ["repo_id", "surface"], "left_semi")
    listed = surfaces.select("repo_id", "surface", F.explode(F.concat("representative_files", "test_files", "config_or_docs_files")).alias("file_path")).distinct()
    touched = direct.select(*KEYS, "surface", "file_path").unionByName(useful.join(listed, ["repo_id", "file_path"]).select(*KEYS, "surface", "file_path")).distinct()
    hits = direct.groupBy(*KEYS, "surface").agg(F.count_distinct("hash").alias("hits"))
    overlap = touched.groupBy(*KEYS, "surface").agg(F.count("*").alias("overlap"))
    totals = useful.groupBy(*KEYS).agg(F.count_distinct("file_path").alias("useful"))
    match = hits.join(overlap, [*KEYS, "surface"]).join(totals, KEYS).join(sized.select(*KEYS, "commits", F.col("signal_list").alias("signals")), KEYS)
    match = match.join(surfaces.withColumnRenamed("confidence", "surface_confidence").drop("rank", "commit_count"), ["repo_id", "surface"]).join(commands, "repo_id", "left")
    kind = workflow.surface_kind(F.concat(F.array("surface"), "representative_files"), _list("signals"))
    share = F.col("hits") / F.col("commits")
    match = match.withColumn("kind", kind).withColumn("share", share).where("share >= 0.4")
    score = workflow.match_confidence(F.col("surface_confidence"), F.col("share"), F.col("overlap") / F.col("useful"), F.size("test_files") > 0, F.size(_list("commands")) > 0, workflow.alignment(F.col("kind"), _list("signals")))
    best = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("match").desc(), F.length("surface").desc(), "surface"))
    kept = ("surface", "kind", "match", "share", "representative_files", "test_files", "config_or_docs_files")
    return match.withColumn("match", score).withColumn("r", best).where("r = 1").select(*KEYS, *kept)


def _steps(file_rows: DataFrame, matches: DataFrame, diffs: DataFrame, found: DataFrame, commands: DataFrame) -> DataFrame:
    """Per cluster with a surface: counts of its actions, and the texts of its steps."""
    by_file = found.groupBy(*COMMIT, "file_path").agg(F.array_sort(F.collect_list(F.struct("type", "value"))).alias("found"))
    shown = diffs.select(*COMMIT, "file_path", (F.size("cli_options") > 0).alias("options"), (F.col("added_lines") + F.col("deleted_lines") > 0).alias("changed")).dropDuplicates([*COMMIT, "file_path"])
    rows = file_rows.join(matches, KEYS).join(by_file, [*COMMIT, "file_path"], "left").join(shown, [*COMMIT, "file_path"], "left")
    direct = (F.col("file_path") == F.col("surface")) | F.col("file_path").startswith(F.concat("surface", F.lit("/"))) | F.array_contains("representative_files", F.col("file_path"))
    supports = F.array_contains(F.concat("test_files", "config_or_docs_files"), F.col("file_path"))
    rows = rows.withColumn("direct", direct).withColumn("supports", supports).where((F.col("direct") | F.col("supports")) & ~F.col("noisy"))
    none = F.array().cast("array<struct<type:string,value:string>>")
    rows = rows.withColumn("found", F.coalesce("found", none)).withColumn("options", F.coalesce("options", F.lit(False))).withColumn("changed", F.coalesce("changed", F.lit(True)))
    actions = workflow.workflow_actions(rows, KEYS, "hash")
    primary = matches.select(*KEYS).join(commands, "repo_id", "left").select(*KEYS, F.slice(_list("commands"), 1, 1).alias("commands"))
    steps = workflow.workflow_steps(actions, KEYS, primary)
    hint = F.concat(F.lit(" (Observed in "), F.col("n").cast("string"), F.when(F.col("n") == 1, " commit").otherwise(" commits"), F.when(F.size("files") > 0, F.concat(F.lit("; common files: "), F.array_join(F.slice("files", 1, 2), ", "))).otherwise(F.lit("")), F.lit(")."))
    text = F.when(F.col("action") == "validation", F.col("text")).otherwise(F.concat(F.col("text"), hint))
    ordered = lambda tier: F.transform(F.array_sort(F.collect_list(F.when(F.col("tier") == tier, F.struct("place", text.alias("text"))))), lambda x: x["text"])
    told = steps.groupBy(*KEYS).agg(ordered("core").alias("core_steps"), ordered("supporting").alias("supporting_steps"))
    counts = actions.groupBy(*KEYS).agg(F.count_if(F.col("n") >= 2).alias("repeated"), F.count_if(F.col("group") == "source").alias("source_actions"), F.count_if(F.col("group") == "test").alias("test_actions"))
    return counts.join(told, KEYS, "left")


def _evidence(members: DataFrame, found: DataFrame) -> DataFrame:
    """Per cluster its commits, those that show most leading signals first."""
    counted = found.groupBy(*COMMIT).agg(F.count("*").alias("n_diff_signals"))
    rows = members.join(counted, COMMIT, "left").withColumn("n_diff_signals", F.coalesce("n_diff_signals", F.lit(0))).withColumn("signals", F.col("generic_signals"))
    placed = joins.ordered_evidence(rows, KEYS, "signal_list")
    of = F.struct("place", "hash", "short_hash", "message")
    return placed.groupBy(*KEYS).agg(F.array_sort(F.collect_list(of)).alias("e")).select(*KEYS, F.col("e.hash").alias("evidence"), F.transform("e", lambda x: F.concat(F.lit("`"), x["short_hash"], F.lit("`: "), x["message"])).alias("evidence_lines"))


def mine(commits: DataFrame, files: DataFrame, diffs: DataFrame, found: DataFrame, surfaces: DataFrame, surface_terms: DataFrame, clustered: DataFrame, commands: DataFrame) -> DataFrame:
    """One row per cluster of two commits or more, by repository.

    commits: with signals and terms; files: repo_id, hash, file_ord, file_path; diffs:
    features per file; found: diff signals; surface_terms: repo_id, surface, term, rank;
    clustered: repo_id, hash, cluster, cluster_size; commands: repo_id, commands (array).
    """
    joined = clustered.where("cluster_size >= 2").join(commits, COMMIT)
    members = joined.withColumn("commits", F.count("*").over(Window.partitionBy(*KEYS)))
    totals = commits.groupBy("repo_id").agg(F.count("*").alias("total"))
    known = signals.files_with(files, {"directory": expr.directory_of(F.col("file_path")), "noisy": classify.is_noisy(F.col("file_path")), "role": classify.file_role(F.col("file_path"))})
    file_rows = members.select(*KEYS, "hash", "ordinal", "message").join(known.select(*COMMIT, "file_path", "directory", "noisy", "role").distinct(), COMMIT)
    shapes = members.select(*KEYS, "hash", F.explode(signals.shape(F.col("generic_signals"))).alias("signal"))
    asynchronous = F.max((F.col("message").rlike(candidates.ASYNC_WORDS) | F.col("file_path").rlike(candidates.ASYNC_WORDS)).cast("int")) == 1
    sized = members.groupBy(*KEYS, "commits").agg(F.min("ordinal").alias("newest")).join(totals, "repo_id").join(_leading(shapes, "signal"), KEYS, "left").join(_leading(file_rows, "directory", 6), KEYS, "left")
    artifacts = file_rows.groupBy(*KEYS).agg(
        F.avg(F.col("noisy").cast("double")).alias("artifacts"), F.count_distinct(F.when(F.col("role").isin("source", "test"), F.col("file_path"))).alias("files"),
        F.max((F.col("role") == "test").cast("int")).alias("tests"), F.max((F.col("role") == "source").cast("int")).alias("sources"), asynchronous.alias("asynchronous"),
    )
    common = _leading(file_rows.where(~F.col("noisy")), "file_path").drop("top_file_path")
    matches = _matches(file_rows, sized, surfaces, commands)
    own_terms = surface_terms.where(~F.col("term").isin(naming.NAMING_NOISE)).groupBy("repo_id", "surface").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("source_terms"))
    c = sized
    for more in (artifacts, common, _areas(members, commits, files), _terms(file_rows, members), matches, _steps(file_rows, matches, diffs, found, commands), _evidence(members.join(sized.select(*KEYS, "signal_list"), KEYS), found)):
        c = c.join(more, KEYS, "left")
    c = c.join(own_terms, ["repo_id", "surface"], "left").join(commands, "repo_id", "left")
    shown, files_of, area = _list("signal_list"), _list("file_path_list"), F.coalesce("primary_area", F.lit("unknown"))
    zero = lambda n: F.coalesce(n, F.lit(0.0))
    c = c.withColumn("terms", _list("terms")).withColumn("commands", _list("commands")).withColumn("artifacts", zero("artifacts")).withColumn("area", area).withColumn("signals", shown).withColumn("common_files", files_of)
    c = c.withColumn("k", candidates.category(F.col("signals"), F.coalesce("asynchronous", F.lit(False)), F.size("terms") > 0, zero("strength"), F.size("terms") > 0))
    display = F.concat(expr.title(F.regexp_replace(expr.base_name(F.col("surface")), "[_.]", " ")), F.lit(" Surface"))
    surface = F.struct("kind", F.col("match").alias("confidence"), F.col("share").alias("match_share"), _list("source_terms").alias("source_terms"), F.col("surface").alias("directory"), display.alias("display_name"), "representative_files")
    c = c.withColumn("of_surface", F.when(F.col("surface").isNotNull(), surface))
    told = [F.col(x) for x in ("area", "signals", "common_files", "terms", "k.category", "of_surface")]
    c = c.withColumn("task", naming.task_name(*told))
    c = c.withColumn("description", naming.task_description(F.col("task"), *told))
    tested = F.coalesce(F.col("tests") > 0, F.lit(False)) | (F.size("commands") > 0)
    sourced = F.coalesce(F.col("sources") > 0, F.lit(False))
    uses_terms = (F.size("terms") == 0) | F.exists("terms", lambda t: F.contains(F.lower("task"), F.lower(t)))
    pattern = candidates.pattern_confidence(F.col("commits"), F.coalesce("top_signal", F.lit(0)), F.coalesce("top_directory", F.lit(0)), F.col("total"))
    named = candidates.naming_confidence(F.col("k.confidence"), F.col("commits"), F.coalesce(F.col("tests") > 0, F.lit(False)) & sourced, F.col("match"), F.size(_list("source_terms")), F.col("artifacts"), uses_terms)
    count = lambda n: F.coalesce(n, F.lit(0))
    quality = candidates.profile_quality(count("repeated"), count("source_actions"), count("test_actions"), F.size("commands"), F.size(_list("core_steps")), F.size(_list("core_steps")) == 0, F.col("commits"), F.col("artifacts"))
    c = c.withColumn("pattern_confidence", pattern).withColumn("naming_confidence", named).withColumn("workflow_quality", quality)
    junk = F.lower("task").rlike(r"(^|[^a-z0-9_])(aicompatible|compatible|all|run|runs|running|action|actions|pattern)([^a-z0-9_]|\z)")
    of = {
        "commits": F.col("commits"), "pattern": F.col("pattern_confidence"), "naming": F.col("naming_confidence"), "surface": zero("match"), "surface_share": zero("share"), "artifacts": F.col("artifacts"), "quality": F.col("workflow_quality"),
        "files": count("files"), "has_workflow": F.size(_list("core_steps")) > 0, "junk_name": junk, "task_evidence": sourced | (F.col("area") == "docs"), "tested": tested,
    }
    c = c.withColumn("p", candidates.promotion(of, F.col("surface").isNotNull()))
    hint = F.when(F.size("terms") > 0, naming.term_title(F.element_at("terms", 1)))
    neutral = workflow.neutral_name(F.col("signals"), F.col("area"), zero("area_share"), hint, F.arrays_overlap("signals", F.array(F.lit("api_route_changed"))))
    name = F.when(F.col("p.level") == "pattern_candidate", neutral).otherwise(F.col("task"))
    notes = F.filter(F.array(
        F.when(F.col("naming_confidence") < 0.7, F.lit("Naming confidence is modest because the dominant signals are broad.")),
        F.when(F.forall("signals", lambda s: s.rlike("test")), F.lit("This may be a test-maintenance pattern rather than a feature workflow.")),
    ), lambda x: x.isNotNull())
    out = c.select(
        *KEYS, name.alias("name"), "description", F.col("p.level").alias("promotion_level"), F.col("p.reasons").alias("promotion_reasons"), notes.alias("notes"), "pattern_confidence", "naming_confidence", "workflow_quality",
        F.col("artifacts").alias("artifact_share"), F.col("area").alias("primary_area"), zero("area_share").alias("area_share"), F.col("k.category").alias("category"), "surface", "kind", F.col("match").alias("surface_match"), F.col("share").alias("surface_share"),
        _list("representative_files").alias("representative_files"), _list("test_files").alias("test_files"), "signals", _list("directory_list").alias("directories"), "common_files", "terms", _list("repeated_terms").alias("repeated_terms"),
        "commands", _list("core_steps").alias("core_steps"), _list("supporting_steps").alias("supporting_steps"), "evidence", "evidence_lines", "newest",
    )
    return candidates.unique_ids(out.withColumn("id", expr.slug(F.col("name"), "candidate")), ["repo_id"], [F.col("pattern_confidence").desc(), F.col("cluster")])


def without_repeats(mined: DataFrame) -> DataFrame:
    """The candidates that are left when drafts that repeat others have gone; kept ones keep their evidence."""
    rows = mined.select("repo_id", "id", "name", F.col("promotion_level").alias("level"), F.col("pattern_confidence").alias("pattern"), F.col("naming_confidence").alias("naming"), F.col("common_files").alias("files"), F.col("evidence").alias("commits"))
    fates = candidates.dedupe_drafts(rows, "repo_id").where("fate = 'kept'").select("repo_id", "id")
    return mined.join(fates, ["repo_id", "id"], "left_semi")


def surface_words(files: DataFrame, commits: DataFrame) -> DataFrame:
    """repo_id, surface, term, rank: the terms that a surface's own files and commits repeat."""
    return cochange.surface_terms(files, commits.select("repo_id", "hash", F.col("message_terms")), ["repo_id"], "hash").select("repo_id", "surface", "term", "rank")
