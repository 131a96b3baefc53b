"""Incremental refresh: a stream of changed files keeps co-change weights up to date.

Each micro-batch counts its own pairs and is written as a delta, one folder per batch
id, so a replayed batch overwrites its own delta and weights stay exact.  A commit's
files must arrive in one batch, as they do from a log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cochange


def refresh_pairs(files: DataFrame, folder: str, checkpoint: str, repo: str = "repo_id", commit: str = "hash") -> StreamingQuery:
    """Starts the stream (repo, commit, file_path) → deltas of pair weights below folder; ends when the input is read."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        pairs = cochange.cochange_pairs(rows, [repo], commit, min_weight=1, keep=None)
        pairs.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_pairs(spark: SparkSession, folder: str, repo: str = "repo_id", min_weight: int = 2) -> DataFrame:
    """Weights over all deltas."""
    deltas = spark.read.parquet(folder)
    return deltas.groupBy(repo, "file_a", "file_b").agg(F.sum("weight").alias("weight")).where(F.col("weight") >= min_weight)
