"""MinHash near-duplicates, verified by odd sketches and then on full shingle sets.

1. One pass over the texts: 5-word shingle sets, ``SAMPLES`` MinHash samples of each,
   band keys of the first ones, and the odd sketch: every sample flips one bit of a
   parity bitmap.  The XOR of two sketches has a set bit for each sample they do not
   share (up to collisions), so its population count estimates high similarities.
2. Documents with equal sets are one class, represented by its smallest id.
3. Buckets of equal band keys are range-partitioned and streamed in order of
   (key, class), so a vast bucket spans many tasks.  Each member is paired with the
   first of its bucket in its task, and those firsts with the first of all, so a bucket
   of m members gives m - 1 pairs.  Pairs pass the sketch estimate, then the exact test
   on full sets; components of the links are labelled.
4. Buckets whose members are still in several components are searched whole, in blocks
   bounded by rows and bytes: each member against those of other components that pass
   the length filter and the sketch estimate, exactly, and in large buckets only between
   neighbouring size classes.  Blocks keep track of what they have joined, so no link
   between components is lost and few pairs inside one are tested.
5. These last links join the labels of step 3.

With 20 bands of 3 samples a pair at similarity 0.75 shares no bucket with
probability 1.7e-5; at 0.8 it is 6e-7.  The sketch discards estimates below
``threshold - MARGIN`` (over four deviations).

Cases: null, empty and blank texts have no shingles and link with nothing; texts of
one to four words are one shingle; ids must be unique, repeated rows get equal
answers and rows without id are never linked; ties do not arise, since classes are
ordered by id; a very long text is a step of its own and its sample pass runs in
pieces; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, grouped, mapped, mix, partitions, rows_batch, steps, texts_of
from .components import components

SAMPLES, BANDS, ROWS, SKETCH_BITS, MARGIN = 128, 20, 3, 1024, 0.2
#: Rows and bytes of shingle sets of one block of a bucket.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
_M = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words; forgets all when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes, hashes: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(width, len(h))):
        total = total * _M + h[k : k + n]
    if len(h) < width:
        total += np.uint64(len(h))
    return np.unique(mix(total))


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    keys = mix(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64))
    return (keys[:SAMPLES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (keys[SAMPLES:] >> np.uint64(32)).astype(np.uint32)


def samples(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    values, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(values), 1024):
        np.minimum(least, (np.bitwise_xor.outer(values[k : k + 1024], b) * a).min(axis=0), out=least)
    return least


def odd_sketch(least: np.ndarray) -> np.ndarray:
    bits = mix(least.astype(np.uint64) * np.uint64(len(least)) + np.arange(len(least), dtype=np.uint64)) % np.uint64(SKETCH_BITS)
    return np.packbits(np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS).astype(np.uint8) & 1)


def estimates(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Similarities of sketch rows: -n/(2) ln(1 - 2d/n) samples differ, each once on either side."""
    apart = np.bitwise_count(one.view(np.uint64) ^ others.view(np.uint64)).sum(axis=-1)
    flips = -SKETCH_BITS / 2 * np.log(np.maximum(1e-9, 1 - 2 * apart / SKETCH_BITS))
    return 1 - flips / (2 * SAMPLES)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])


def signatures(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (a, b) = WordHashes(), _permutations()
        weights = mix(np.arange(7, 7 + BANDS * ROWS, dtype=np.uint64)).reshape(BANDS, ROWS)
        for step in steps(batches, "text"):
            n, keys, bands, sketches = [], [], [], []
            for text in texts_of(step.column("text")):
                found = shingle_set(text, hashes, width)
                n.append(len(found))
                if not len(found):
                    keys.append(None), bands.append(None), sketches.append(None)
                    continue
                least = samples(found, a, b)
                keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                banded = mix((mix(least[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS) + weights)).sum(axis=1, dtype=np.uint64))
                bands.append(banded.view(np.int64))
                sketches.append(odd_sketch(least).tobytes())
            yield rows_batch({"doc_id": step.column("doc_id"), "n_shingles": n, "set_key": keys, "bands": bands, "sketch": sketches}, _SIGNED)

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch binary")


def _stars(buckets: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, bucket): each member b of a bucket but its first, with an earlier one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs with the first of the task's run; rows without b name the firsts of the runs that may go on next door."""
        key, first, edge = None, None, True

        def named(keys: list, heads: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(heads, pa.int64()), pa.nulls(len(heads), pa.int64()), pa.array(keys, pa.int64())], ["a", "b", "bucket"])

        for batch in batches:
            keys, reps = (batch.column(c).to_numpy() for c in ("bucket", "rep"))
            if not len(keys):
                continue
            new = np.r_[key is None or keys[0] != key, keys[1:] != keys[:-1]]
            starts = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))
            heads = np.where(starts < 0, first if first is not None else 0, reps[starts])
            if edge and key is not None and new[0]:  # the task's first run has ended
                yield named([key], [first])
                edge = False
            elif edge and new[1:].any():
                yield named([keys[0]], [heads[0]])
                edge = False
            key, first = keys[-1], heads[-1]
            yield pa.RecordBatch.from_arrays([pa.array(heads[~new]), pa.array(reps[~new]), pa.array(keys[~new])], ["a", "b", "bucket"])
        if key is not None:
            yield named([key], [first])

    order = ["bucket", "rep"]
    streamed = scratch.keep(mapped(buckets.repartitionByRange(partitions(buckets.sparkSession), *order).sortWithinPartitions(*order), run, "a long, b long, bucket long"), "streamed")
    heads = streamed.where("b is null").select("bucket", F.col("a").alias("b"))  # at most two rows a task
    least = heads.groupBy("bucket").agg(F.min("b").alias("a"))
    return streamed.where("b is not null").unionByName(heads.join(least, "bucket").where("a < b").select("a", "b", "bucket").distinct())


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for step in steps(batches, "text"):
            sets = [shingle_set(t, hashes, width).tobytes() for t in texts_of(step.column("text"))]
            yield pa.RecordBatch.from_arrays([step.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    return mapped(docs, run, "doc_id long, shingles binary")


def exact_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], ["a", "b"])

    left, right = (sets.select(F.col("doc_id").alias(v), F.col("shingles").alias(f"s{v}")) for v in "ab")
    return mapped(pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb"), run, "a long, b long")


def _similar(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Pairs whose sketches estimate at least ``least``."""
    left, right = (sketches.select(F.col("rep").alias(v), F.col("sketch").alias(f"k{v}")) for v in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("ka", "kb"))
                mask = pa.array(estimates(one, two) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], ["a", "b"])

    return mapped(pairs.join(right, "b").join(left, "a").select("a", "b", "ka", "kb"), run, "a long, b long")


def _tasks(members: DataFrame) -> DataFrame:
    """Members dealt to the pairs (i, j) of blocks of their group: ``task`` names bucket, group and pair.

    A bucket of one block is a group of its own.  In a larger one, sizes fall into classes
    of the length filter's ratio; a pair within the length filter has equal or neighbouring classes,
    so group c holds classes c and c + 1, the latter not against each other.
    """
    grouped_ = members.withColumn("upper", F.explode(F.when(F.col("blocks") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    group = F.when(F.col("blocks") > 1, F.col("size_class") - F.col("upper")).otherwise(F.lit(0))
    mine = grouped_.withColumn("mine", F.expr("cast(pmod(xxhash64(rep), blocks) as int)")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("mine", "other"), F.greatest("mine", "other")
    return mine.withColumn("i", i).withColumn("j", j).withColumn("task", F.concat_ws(":", "bucket", group, i, j))


class _Labels:
    """Components that a task joins further as it finds links."""

    def __init__(self, components: np.ndarray) -> None:
        self.place = np.unique(components, return_inverse=True)[1]
        self.root = np.arange(len(components))

    def of(self, rows: np.ndarray) -> np.ndarray:
        return self.root[self.place[rows]]

    def join(self, x: int, y: int) -> bool:
        low, high = sorted((self.root[self.place[x]], self.root[self.place[y]]))
        self.root[self.root == high] = low
        return low != high


def _exhaustive(members: DataFrame, percent: int, least: float) -> DataFrame:
    """Links across components inside buckets; a pair that shares several buckets is tested in the first of its bands alone."""

    def run(table: pa.Table) -> pa.Table:
        reps, mine, sizes = (table.column(c).to_numpy() for c in ("rep", "mine", "n_shingles"))
        upper = table.column("upper").to_numpy().astype(bool)
        bands = np.array(table.column("bands").to_pylist(), np.int64)
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(reps), -1)
        sets = table.column("shingles")
        i, j, bucket = (table.column(c)[0].as_py() for c in ("i", "j", "bucket"))
        labels, found = _Labels(table.column("component").to_numpy()), []
        for r in np.flatnonzero(mine == i):
            others = np.flatnonzero((mine == j) & ~(upper & upper[r]) & (100 * np.minimum(sizes, sizes[r]) >= percent * np.maximum(sizes, sizes[r])))
            others = others[(labels.of(others) != labels.of(np.array([r]))) & ((others > r) | (i != j))]
            if len(others):
                same = bands[others] == bands[r]
                others = others[bands[r][same.argmax(axis=1)] == bucket]
            if len(others):
                likely = estimates(sketch[r], sketch[others])
                others = others[np.argsort(-likely, kind="stable")[: int((likely >= least).sum())]]
            own = np.frombuffer(sets[int(r)].as_py(), np.uint64) if len(others) else None
            while len(others):
                some, others = others[:64], others[64:]
                theirs = [np.frombuffer(sets[int(o)].as_py(), np.uint64) for o in some]
                flat = np.concatenate(theirs)
                hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                both = np.add.reduceat(hit, np.cumsum(sizes[some]) - sizes[some], dtype=np.int64)
                for o in some[100 * both >= percent * (sizes[some] + sizes[r] - both)]:
                    if labels.join(r, o):
                        found.append((reps[r], reps[o]))
                others = others[labels.of(others) != labels.of(np.array([r]))]
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    tasks = _tasks(members).select("task", "bucket", "i", "j", "mine", "upper", "rep", "component", "n_shingles", "bands", "sketch", "shingles")
    return grouped(tasks, ["task"], run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near_dup")
    signed = scratch.keep(signatures(docs, width), "signed")
    classes = signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "sketch")).alias("r"))
    classes = scratch.keep(classes.select("set_key", F.col("r.doc_id").alias("rep"), "r.n_shingles", "r.bands", "r.sketch"), "classes")
    least = percent / 100 - MARGIN
    stars = _stars(classes.select("rep", F.explode("bands").alias("bucket")), scratch)
    involved = stars.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").join(involved, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = scratch.keep(shingle_sets(texts, width), "sets")
    similar = _similar(stars.select("a", "b").distinct(), classes.select("rep", "sketch"), least)
    labels = components(scratch.keep(exact_links(similar, sets, percent), "links"))

    inside = stars.select("bucket", F.explode(F.array("a", "b")).alias("rep")).distinct()
    shared = inside.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sized = shared.join(classes.select("rep", "n_shingles"), "rep")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") * 8 / BLOCK_BYTES)).cast("int")
    split = sized.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), blocks.alias("blocks")).where("lo != hi").select("bucket", "blocks")
    split = scratch.keep(split, "split")
    second = None
    if not split.isEmpty():
        size_class = F.floor(F.log(F.col("n_shingles").cast("double")) / (math.log(100 / percent) + 1e-6)).cast("int")
        members = shared.join(split, "bucket").join(classes.drop("set_key"), "rep").withColumn("size_class", size_class).join(sets.withColumnRenamed("doc_id", "rep"), "rep")
        rest = scratch.keep(_exhaustive(members, percent, least), "rest")
        for end in "ab":
            rest = rest.join(labels.select(F.col("id").alias(end), F.col("component").alias("c" + end)), end, "left").withColumn("c" + end, F.coalesce("c" + end, end))
        second = components(scratch.keep(rest.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "joined"))
    scratch.drop("streamed", "sets", "links", "split")

    named = classes.select("set_key", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("class_component"))
    if second is not None:
        named = named.join(second.select(F.col("id").alias("class_component"), F.col("component").alias("joined")), "class_component", "left").select("set_key", F.coalesce("joined", "class_component").alias("class_component"))
    rows = signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
