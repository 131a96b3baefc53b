"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Sources share a budget by weight, none above ``max_repeats`` times its size (the
level of this water-filling is the largest over a sorted scan of the sources).
Documents of a source are shuffled by a keyed hash; a document's virtual finish
time is its source's cumulative tokens, repeats included, divided by the source's
target.  Taking all finish times in global order until the budget is spent gives
each source its share.  Cumulative sums run in two levels, over hash buckets and
inside them, so a source with a third of all rows is spread over many tasks; the
global cut is found from sums over bands of finish time and one band's rows.  The
windows over bands hold one row for each ``BUCKET_ROWS`` copies.

Cases: null text has size 0; documents of size 0 are never taken; null is a source
of its own, last; repeated rows are documents of their own; equal shuffle keys (equal
ids) queue by id, size, text hash and row, and equal finish times, which only different
sources have, by source; very long texts are counted whole and taken whole or not at
all; an empty table gives no rows; extra columns are ignored by ``mix_schedule`` and
carried by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, Scratch, free_prefix

#: Rows that one bucket or band should hold; their number follows the table's size.
BUCKET_ROWS = 4096


def words(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_repeats: int) -> DataFrame:
    """source_key, source_size, target: one row per source.  A bounded scan: sources, not documents."""
    sums = sizes.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    caps = sums.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(max_repeats))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    levels = caps.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(everything) - before) / rest)
    level = F.max("level").over(everything)
    return levels.select("source_key", "source_size", F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target"))


def mix_schedule(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2, seed: str = "mix", row: str | None = None) -> DataFrame:
    """doc_id, row, size, source_size, target, finish (of the first copy), copies, taken: one row per document.

    ``row`` names a long column of docs that comes along, null without one.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    own = F.lit(None).cast("long") if row is None else F.col(row)
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    shuffle = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sizes = scratch.keep(docs.select("doc_id", "source", key.alias("source_key"), words().alias("size"), shuffle.alias("shuffle"), F.xxhash64("text").alias("text_key"), own.alias("row")), "sizes")
    n, total = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    digits = next(d for d in range(1, 8) if 16**d * BUCKET_ROWS >= n or d == 7)
    sizes = sizes.withColumn("bucket", F.substring("shuffle", 1, digits))
    targets = source_targets(sizes, weights, min(share, max_repeats), max_repeats)
    by_bucket = sizes.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_bucket.join(targets, "source_key").select("source_key", "bucket", "source_size", "target", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source_key", "bucket").orderBy("shuffle", "doc_id", "size", "text_key", "row").rowsBetween(Window.unboundedPreceding, 0)
    rows = sizes.join(starts, ["source_key", "bucket"]).withColumn("done", F.col("start") + F.sum("size").over(inside))
    rows = scratch.keep(rows.select("doc_id", "row", "source_key", "size", "source_size", "target", "done"), "queued")
    scratch.drop("sizes")

    # Finish times differ within a source, so (finish, source) orders all copies.
    def finish(copy: Column) -> Column:
        return (F.col("done") + copy * F.col("source_size")) / F.col("target")

    open_rows = rows.where("size > 0 and target > 0")
    copies = open_rows.withColumn("copy", F.explode(F.array(*map(F.lit, range(max_repeats))))).withColumn("finish", finish(F.col("copy")))
    bands, budget = max(16, max_repeats * n // BUCKET_ROWS), min(share, max_repeats) * total
    band = F.floor(F.col("finish") * bands)
    sums = copies.groupBy(band.alias("band")).agg(F.sum("size").alias("words"))
    running = F.sum("words").over(Window.orderBy("band").rowsBetween(Window.unboundedPreceding, 0))
    cut = sums.select("band", "words", running.alias("upto")).where(F.col("upto") > F.lit(budget)).orderBy("band").limit(1).first()
    last = None
    if cut is not None:
        order = F.struct("finish", "source_key")
        upto = F.lit(cut["upto"] - cut["words"]) + F.sum("size").over(Window.orderBy("order").rowsBetween(Window.unboundedPreceding, 0))
        within = copies.where(band == cut["band"]).withColumn("order", order)
        last = within.select("order", upto.alias("upto")).where(F.col("upto") <= F.lit(budget)).agg(F.max("order").alias("last")).first()["last"]
    n_copies: Column = F.lit(0)
    for copy in range(max_repeats):
        at = finish(F.lit(copy))
        taken = F.lit(True)
        if cut is not None:
            in_band = F.floor(at * bands)
            taken = in_band < F.lit(cut["band"])
            if last is not None:
                taken = taken | ((in_band == F.lit(cut["band"])) & (F.struct(at, F.col("source_key")) <= F.struct(F.lit(last[0]), F.lit(last[1]))))
        n_copies = n_copies + F.when((F.col("size") > 0) & (F.col("target") > 0) & taken, 1).otherwise(0)
    out = rows.withColumn("copies", n_copies)
    first = F.when(F.col("target") > 0, finish(F.lit(0)))
    return out.select("doc_id", "row", "size", "source_size", "target", first.alias("finish"), "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents as often as the mix takes them, globally sorted by virtual finish time; columns stay as they are.

    Rows are numbered in a table of the shared folder, so equal rows keep copies of their own.
    """
    p = free_prefix(docs)
    row = p + "row"
    numbered = Scratch(docs.sparkSession, "mix").keep(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    wanted = ("row", "finish", "copies", "source_size", "target")
    schedule = mix_schedule(numbered, row=row, **options).where("copies > 0").select(*(F.col(c).alias(p + c) for c in wanted))
    repeated = numbered.join(schedule, row).withColumn(p + "copy", F.explode(F.sequence(F.lit(0), F.col(p + "copies") - 1)))
    at = F.col(p + "finish") + F.col(p + "copy") * F.col(p + "source_size") / F.col(p + "target")
    return repeated.orderBy(at, "doc_id").select(docs.columns)
