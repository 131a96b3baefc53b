"""Connected components of an undirected edge table.

1. Local contraction: each task hangs the vertices of its edges on the smallest vertex
   that they reach there.  The number of tasks follows the number of edges, so an edge
   table of up to ``TASK_EDGES`` rows is settled by one task.
2. Otherwise alternating star contractions go on: large-star hangs every larger
   neighbour of a vertex on its smallest neighbour, small-star every smaller one; the
   edge table shrinks to stars around component minima in a logarithmic number of
   rounds (Kiveris et al., 2014).  Each round is a groupBy-min and a join on the vertex,
   both of which combine or split hot vertices, and its table is written to the shared
   folder.

Cases: loops and repeated edges change nothing; null ends are skipped; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mapped

#: Edges that one task contracts: some 20 MB of arrays.
TASK_EDGES = 1 << 18


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both(edges)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct vertices of the edges, and the smallest vertex that each of them reaches."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(ids))
    while len(x):
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        np.minimum.at(label, high, low)
        while not np.array_equal(further := label[label], label):
            label = further
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    return ids, ids[label]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [[], []]
    for batch in batches:
        for end, name in zip(ends, "ab", strict=True):
            end.append(batch.column(name).to_numpy(zero_copy_only=False))
    if ends[0]:
        ids, least = least_reached(*map(np.concatenate, ends))
        hung = ids != least
        yield pa.RecordBatch.from_arrays([pa.array(ids[hung]), pa.array(least[hung])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of long ids: (id, component) for every vertex but the smallest of each component."""
    scratch = Scratch(edges.sparkSession, "components")
    edges = edges.where("a != b").select("a", "b")
    tasks = max(1, -(-edges.count() // TASK_EDGES))
    now = scratch.keep(mapped(edges.coalesce(tasks), _contracted, "a long, b long"), "e0")
    before, k = None, 0
    while tasks > 1:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, k = state, k + 1
        after = scratch.keep(_small_star(_large_star(now).where("a != b").distinct()).where("a != b").distinct(), f"e{k}")
        scratch.drop(f"e{k - 1}")
        now = after
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
