"""The registry's life cycle: versions, support, drift, status and human transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr, rules
from .signals import broad_areas

TEST_DIRECTORY = r"(?i)(^|/)(tests?|e2e|playwright|cypress)(/|$)"
#: Drift reasons in order (fixed values).
REASONS = [
    "New commits match the same broad area but use different dominant signals.",
    "Common files or directories shifted significantly.",
    "Dominant naming terms changed strongly.",
    "Tests moved to a different framework or folder.",
]
#: Status and level that an action leads to (fixed values).
ACTIONS = {"approve": ("fresh", "agent_ready"), "reject": ("rejected", None), "deprecate": ("deprecated", None), "rename": (None, None)}


def supports(signals: Column, directories: Column, words: Column, own_signals: Column, own_directories: Column, own_words: Column) -> Column:
    return (expr.jaccard(signals, own_signals) >= rules.SUPPORT_SIGNALS) | (expr.jaccard(directories, own_directories) >= rules.SUPPORT_DIRECTORIES) | (expr.jaccard(words, own_words) >= rules.SUPPORT_TERMS)


def new_commits(registry: DataFrame, commits: DataFrame, repo: str) -> DataFrame:
    """Skills with the commits newer than the head they were made from; all of them if it is unknown.

    registry: repo, skill_id, head and the skill's lists; commits: repo, ordinal, hash and theirs.
    """
    heads = commits.select(repo, F.col("hash").alias("head"), F.col("ordinal").alias("head_ordinal"))
    placed = registry.join(heads, [repo, "head"], "left")
    return placed.join(commits, repo).where(F.col("ordinal") < F.coalesce("head_ordinal", F.lit(2_147_483_647)))


def drift(new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, drift_reasons) from new commits that share a broad area with their skill, if there are two.

    new: keys, ordinal, signals, directories, words, own_signals, own_directories, own_words (arrays).
    """
    broad = new.where(F.arrays_overlap(broad_areas(F.col("signals")), broad_areas(F.col("own_signals"))))
    tested = F.exists("signals", lambda s: F.contains(s, F.lit("test")))

    def counts(values: Column) -> Column:
        flat = F.flatten(F.collect_list(values))
        return F.transform(F.array_distinct(flat), lambda v: F.struct(F.size(F.filter(flat, lambda x: x == v)).alias("n"), v.alias("name")))

    tests = F.when(tested, F.filter("directories", lambda d: d.rlike(TEST_DIRECTORY))).otherwise(F.array().cast("array<string>"))
    g = broad.groupBy(*keys).agg(
        F.count("*").alias("matches"), expr.ranked(counts(F.col("signals")), 8).alias("s"), expr.ranked(counts(F.col("directories")), 6).alias("d"), expr.ranked(counts(F.col("words")), 8).alias("w"), expr.ranked(counts(tests), 6).alias("t"),
        *(F.first(c).alias(c) for c in ("own_signals", "own_directories", "own_words")),
    )
    return _drifted(g, keys)


def _drifted(counted: DataFrame, keys: list[str]) -> DataFrame:
    """The reasons from the skills' own lists and the most frequent values s, d, w, t of their matches."""
    own_tests = F.filter("own_directories", lambda d: d.rlike(TEST_DIRECTORY))
    some = lambda c: F.size(c) > 0
    checks = [
        some("s") & (expr.jaccard(F.col("s"), F.col("own_signals")) < rules.DRIFT_SIGNALS), some("d") & (expr.jaccard(F.col("d"), F.col("own_directories")) < rules.DRIFT_OTHERS),
        some("own_words") & some("w") & (expr.jaccard(F.col("w"), F.col("own_words")) < rules.DRIFT_OTHERS), some(own_tests) & some("t") & (expr.jaccard(own_tests, F.col("t")) < rules.DRIFT_OTHERS),
    ]
    reasons = F.filter(F.array(*(F.when(c, F.lit(r)) for c, r in zip(checks, REASONS, strict=True))), lambda x: x.isNotNull())
    return counted.where(F.col("matches") >= rules.DRIFT_MIN_COMMITS).select(*keys, reasons.alias("drift_reasons"))


def drift_since_head(skills: DataFrame, commits: DataFrame, repo: str) -> DataFrame:
    """The same as drift for every skill with every commit of its repository, without making the pairs.

    skills: repo, skill_id and the skill's lists; commits: repo, signals, directories, words, all
    newer than the repository's head.  Which commits match depends on the skill's broad areas
    alone, so values are counted by the commits' areas, then summed by the skills'.
    """
    none = F.array().cast("array<string>")
    tests = F.when(F.exists("signals", lambda s: F.contains(s, F.lit("test"))), F.filter("directories", lambda d: d.rlike(TEST_DIRECTORY))).otherwise(none)
    kinds = {"m": F.array(F.lit("")), "s": F.col("signals"), "d": F.col("directories"), "w": F.col("words"), "t": tests}
    named = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), x.alias("name"))
    values = F.flatten(F.array(*(F.transform(v, named(k)) for k, v in kinds.items())))
    by_commits = commits.select(repo, broad_areas(F.col("signals")).alias("areas"), F.explode(values).alias("v")).groupBy(repo, "areas", "v.kind", "v.name").agg(F.count("*").alias("n"))
    own = skills.withColumn("own_areas", broad_areas(F.col("own_signals")))
    summed = own.select(repo, "own_areas").distinct().join(by_commits, repo).where(F.arrays_overlap("areas", "own_areas")).groupBy(repo, "own_areas", "kind", "name").agg(F.sum("n").alias("n"))
    limits = {"s": 8, "d": 6, "w": 8, "t": 6}
    place = F.row_number().over(Window.partitionBy(repo, "own_areas", "kind").orderBy(F.col("n").desc(), "name"))
    tops = summed.withColumn("r", place).where(F.col("r") <= max(limits.values()))
    top = {k: expr.ranked(F.collect_list(F.when(F.col("kind") == k, F.struct("n", "name"))), limit).alias(k) for k, limit in limits.items()}
    g = tops.groupBy(repo, "own_areas").agg(F.max(F.when(F.col("kind") == "m", F.col("n"))).alias("matches"), *top.values())
    return _drifted(own.join(g, [repo, "own_areas"]), [repo, "skill_id"])


def status(current: Column, n_new: Column, n_support: Column, n_drift: Column, stale_after: int = rules.STALE_COMMITS) -> Column:
    return F.when(current.isin("deprecated", "rejected"), current).when(n_drift > 0, "drifting").when(n_support > 0, "fresh").when(n_new >= stale_after, "stale").when(current.isin("stale", "drifting"), current).otherwise("fresh")


def evaluate(registry: DataFrame, commits: DataFrame, repo: str) -> DataFrame:
    """Each skill's new status with its counts and drift reasons."""
    keys = [repo, "skill_id"]
    new = new_commits(registry, commits, repo)
    support = supports(F.col("signals"), F.col("directories"), F.col("words"), F.col("own_signals"), F.col("own_directories"), F.col("own_words"))
    counted = new.groupBy(*keys).agg(F.count("*").alias("new_commits"), F.count_if(support).alias("supporting"))
    joined = registry.join(counted, keys, "left").join(drift(new, keys), keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    reasons = F.coalesce("drift_reasons", F.array().cast("array<string>"))
    return joined.select(*keys, status(F.col("status"), zero("new_commits"), zero("supporting"), F.size(reasons)).alias("status"), zero("new_commits").alias("new_commits"), zero("supporting").alias("supporting"), reasons.alias("drift_reasons"))


def current(versions: DataFrame, keys: list[str]) -> DataFrame:
    """The latest version of every registry row."""
    rest = [c for c in versions.columns if c not in keys]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("v")).select(*keys, "v.*")


def transition(registry: DataFrame, actions: DataFrame, keys: list[str]) -> DataFrame:
    """New versions of the rows that actions (keys, action, done_at, done_by, new_name) change.

    Only drafts can be rejected or renamed; an approval of a draft whose id is already
    a skill is an error, as is a rename to an existing id.
    """
    joined = registry.join(actions, keys)
    draft = F.col("promotion_level") == "draft"
    bad = F.col("action").isin("reject", "rename") & ~draft
    names = F.create_map(*(x for a, (s, _) in ACTIONS.items() if s for x in (F.lit(a), F.lit(s))))
    kept = F.when(bad, F.raise_error(F.concat(F.lit("Not a draft: "), F.col("skill_id")))).otherwise(F.coalesce(names[F.col("action")], F.col("status")))
    level = F.when(F.col("action") == "approve", "agent_ready").otherwise(F.col("promotion_level"))
    approved = F.when(F.col("action") == "approve", True).when(F.col("action") == "reject", False).otherwise(F.col("human_approved"))
    name = F.when(F.col("action") == "rename", F.col("new_name")).otherwise(F.col("name"))
    changed = {"status": kept, "promotion_level": level, "human_approved": approved, "name": name, "version": F.col("version") + 1}
    return joined.select(*(changed.get(c, F.col(c)).alias(c) for c in registry.columns), F.col("done_at").alias("changed_at"), F.col("done_by").alias("changed_by"))


def active(registry: DataFrame) -> DataFrame:
    """Rows that agents may rely on: not withdrawn, and human-made or fresh and agent-ready."""
    human = F.col("human_approved") | (F.col("managed_by") == "human")
    return registry.where(~F.col("status").isin("deprecated", "rejected", "draft") & (human | ((F.col("status") == "fresh") & (F.col("promotion_level") == "agent_ready"))))


def preserved(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("human_approved") | (F.col("managed_by") == "human"))


def generate(candidates: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates routed by level, without those that a human keeps."""
    target = F.when(F.col("promotion_level") == "agent_ready", "skills").when(F.col("promotion_level") == "draft", "draft-skills").otherwise("patterns")
    return candidates.join(preserved(registry).select(*keys), keys, "left_anti").withColumn("target", target)


def merged_evidence(incoming: DataFrame, existing: DataFrame, keys: list[str], keep: int = 20) -> DataFrame:
    """The newest evidence first, each commit once, at most ``keep`` per skill."""
    both = incoming.withColumn("old", F.lit(0)).unionByName(existing.withColumn("old", F.lit(1)))
    once = both.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "hash").orderBy("old", "ordinal"))).where("_r = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("old", "ordinal", "hash"))).where(F.col("place") <= keep).drop("_r")


def created(candidates: DataFrame) -> DataFrame:
    """First registry rows of candidates: drafts wait for review, the others start fresh."""
    draft = F.col("promotion_level") == "draft"
    return candidates.select("*", F.when(draft, "draft").otherwise("fresh").alias("status"), F.lit("engine").alias("managed_by"), F.lit(False).alias("human_approved"), F.lit(1).alias("version"))
