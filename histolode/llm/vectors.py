"""Operators on embedding tables: exact metric range join and permutation index search.

Both use cosine in double precision on the original components.  Vectors that are
null, empty, zero, hold null or non-finite components, or have another length than
the pivots take part in nothing.

Cases: ids should be unique; repeated rows are vectors of their own, so each links with
the other and counts its links, and a search ranks each by its id; rows without id link
with nothing and are not found; ties of nearness go to the smaller id and equal
distances to the pivot listed first; an empty table gives no rows; a vector of any
length is one row; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, grouped, mapped
from .components import components, least_reached


def usable(column: str = "embedding") -> Column:
    c = F.col(column)
    good = F.forall(c, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.coalesce(c.isNotNull() & good & F.exists(c, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the given length as doubles, and which rows those are."""
    rows = column.to_pylist()
    fits = np.array([len(r) == size for r in rows], bool)
    return np.array([r for r, ok in zip(rows, fits, strict=True) if ok], float).reshape(-1, size), fits


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row; sums in the order of the components, so equal vectors give equal values."""
    x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


def sample_of(vectors: DataFrame, n: int) -> np.ndarray:
    """Unit vectors of at most n distinct rows of (id, embedding), those of the smallest id hashes; only they reach the driver."""
    rows = [tuple(r[0]) for r in vectors.select("embedding").orderBy(F.xxhash64("id"), "id").limit(n).collect()]
    rows = list(dict.fromkeys(r for r in rows if len(r) == len(rows[0])))
    return _unit(np.array(rows, float)) if rows else np.zeros((0, 0))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * x @ y.T))


# -- range join -----------------------------------------------------------------

#: Least rows of one block of a cell; vectors of the sample that pivots are chosen from; fewest pivots.
BLOCK, SAMPLE, LEAST_PIVOTS = 4096, 4096, 8
#: Bytes of the single-precision vectors of a block; values of one array of distances or cosines.
BLOCK_BYTES, STEP = 16 << 20, 1 << 18


def block_rows(n: int, size: int) -> int:
    """Rows of one block: a tenth of all vectors, so that few copies are made, as far as a task's memory goes."""
    return max(BLOCK, min(n // 10, BLOCK_BYTES // (4 * size)))


def dense_first(sample: np.ndarray, radius: float) -> np.ndarray:
    """The sample reordered: centres of its dense regions, each taken with all it covers, then the rest as it comes."""
    near = _distances(sample, sample) <= 2 * radius
    counts, open_, order = near.sum(axis=1), np.ones(len(sample), bool), []
    while len(sample) and counts.max() > 1:
        best = int(counts.argmax())
        order.append(best)
        covered = np.flatnonzero(near[best] & open_)
        open_[covered] = False
        counts = counts - near[:, covered].sum(axis=1)
    return sample[[*order, *(i for i in range(len(sample)) if i not in set(order))]]


def _reach(d: np.ndarray, pivots: np.ndarray, radii: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cells by distances to pivots, and the lower cells that may hold a neighbour.

    A neighbour y of x in cell j has d(y, j) <= d(y, i) and d(y, j) <= the cell's radius;
    by the triangle inequality d(x, j) - d(x, i) <= 2r, d(x, j) <= radius of j + r, and x
    is within r of the plane between i and j.
    """
    home = d.argmin(axis=1)
    own = d[np.arange(len(d)), home][:, None]
    gap = _distances(pivots, pivots)[home]
    plane = np.where(gap > 1e-6, (d * d - own * own) / (2 * np.maximum(gap, 1e-6)), 0)
    return home, (d - own <= 2 * radius + 1e-7) & (d <= radii + radius + 1e-7) & (plane <= radius + 1e-7) & (np.arange(len(pivots)) < home[:, None])


def pivot_count(sample: np.ndarray, n: int, radius: float, block: int | None = None) -> tuple[int, float]:
    """How many of the first sample vectors to take as pivots for n vectors, and the copies of a vector to expect.

    The cheapest by what the sample says: pairs in cells, rows moved, distances to pivots.
    Any number gives the same links.
    """
    best, block = (math.inf, 1, 0.0), block or BLOCK
    p, scale = min(LEAST_PIVOTS, len(sample)), n / max(1, len(sample))
    while 0 < p <= len(sample) and p <= max(LEAST_PIVOTS, 4 * math.sqrt(n)):
        d = _distances(sample, sample[:p])
        home = d.argmin(axis=1)
        radii = np.zeros(p)
        np.maximum.at(radii, home, d[np.arange(len(d)), home])
        guests = _reach(d, sample[:p], radii, radius)[1].sum(axis=0) * scale
        homes = np.bincount(home, minlength=p) * scale
        moved = (homes * (np.ceil(homes / block) + np.ceil(guests / block)) + guests * np.ceil(homes / block)).sum()
        pairs = (homes * (homes / 2 + guests)).sum()
        best = min(best, (pairs * 3e-9 + moved * 1e-5 + n * p * 1e-8, p, float(guests.sum() / max(1, n))))
        p *= 2
    return best[1:]


def _row_steps(batches: Iterator[pa.RecordBatch], n_pivots: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a step's distances to all pivots, and the copies they may call for, stay bounded."""
    rows = max(1, STEP // n_pivots)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _homes(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """cell, far: the distance of each task's farthest vector of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radii = np.full(len(pivots), -1.0)
        for batch in _row_steps(batches, len(pivots)):
            x, _ = _matrix(batch.column("embedding"), pivots.shape[1])
            if len(x):
                d = _distances(_unit(x), pivots)
                home = d.argmin(axis=1)
                np.maximum.at(radii, home, d[np.arange(len(d)), home])
        cells = np.flatnonzero(radii >= 0)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(cells, pa.int32()), "far": pa.array(radii[cells])})

    return mapped(vectors.select("embedding"), run, "cell int, far double")


def _bytes_of(rows: np.ndarray) -> pa.Array:
    """The bytes of each row of a matrix, without an object per row."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _cells(vectors: DataFrame, pivots: np.ndarray, radii: np.ndarray, radius: float) -> DataFrame:
    """Each vector in its nearest pivot's cell, and as a guest in lower cells that its ball may reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _row_steps(batches, len(pivots)):
            x, fits = _matrix(batch.column("embedding"), pivots.shape[1])
            if not len(x):
                continue
            home, reach = _reach(_distances(_unit(x), pivots), pivots, radii, radius)
            row, cell = np.nonzero(reach)
            row, cell = np.r_[np.arange(len(x)), row], np.r_[home, cell]
            guest = np.arange(len(row)) >= len(x)
            ids, copies = (batch.column(c).to_numpy()[fits][row] for c in ("id", "copies"))
            short = x.astype(np.float32)
            raw = short if (short == x).all() else x
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cell, pa.int32()), "guest": pa.array(guest), "id": ids, "copies": copies, "vector": _bytes_of(raw[row])})

    return mapped(vectors, run, "cell int, guest boolean, id long, copies long, vector binary")


def _joined(threshold: float, size: int):
    """Links between two blocks of a cell: counts per vector, and a star of links' ends around the least of each component.

    Single precision finds the candidates, by a threshold lower by its largest error;
    those it is not sure of are judged in double precision, some at a time.
    """
    slack = 2e-7 * (size + 4)

    def run(table: pa.Table) -> pa.Table:
        ids, copies, side = (table.column(c).to_numpy(zero_copy_only=False) for c in ("id", "copies", "side"))
        vectors = table.column("vector").to_pylist()
        single = all(len(v) == 4 * size for v in vectors)
        raw = np.array([np.frombuffer(v, np.float32 if len(v) == 4 * size else float) for v in vectors], np.float32 if single else float)
        del vectors
        left, right = np.flatnonzero((side == 0) | (side == 2)), np.flatnonzero((side == 1) | (side == 2))
        unit = np.empty(raw.shape, np.float32)
        for at in range(0, len(raw), 4096):
            unit[at : at + 4096] = _unit(raw[at : at + 4096].astype(float))
        other_side = unit[right]
        links, ends = np.zeros(len(ids)), (np.zeros(0, np.int64),) * 2
        step = max(1, 8 * STEP // max(1, len(right)))
        for at in range(0, len(left), step):
            rows = left[at : at + step]
            cos = unit[rows] @ other_side.T
            i, j = np.nonzero(cos >= threshold - slack)
            if not len(i):
                continue
            near, a, b = cos[i, j] >= threshold + slack, rows[i], right[j]
            unsure = np.flatnonzero(~near)
            for k in range(0, len(unsure), 4096):
                u = unsure[k : k + 4096]
                near[u] = _cosines(raw[a[u]].astype(float), raw[b[u]].astype(float)) >= threshold
            near &= a != b
            a, b = a[near], b[near]
            links += np.bincount(a, copies[b], len(ids))
            apart = side[a] != 2  # inside one block either order is met
            links += np.bincount(b[apart], copies[a[apart]], len(ids))
            found, least = least_reached(np.r_[ends[0], ids[a]], np.r_[ends[1], ids[b]])
            hung = found != least
            ends = found[hung], least[hung]
        linked = np.flatnonzero(links)
        a, b = ends
        return pa.table({
            "id": pa.array(np.r_[ids[linked], a], pa.int64()), "links": pa.array(np.r_[links[linked].astype(np.int64), np.zeros(len(a), np.int64)], pa.int64()),
            "other": pa.array(np.r_[np.zeros(len(linked), np.int64), b], pa.int64(), mask=np.arange(len(linked) + len(a)) < len(linked)),
        })

    return run


def range_join(vectors: DataFrame, id_column: str, threshold: float = 0.95) -> DataFrame:
    """vec id, n_links, component_id, kept: one row per row of vectors.

    Links are pairs of cosine >= threshold.  Equal vectors are joined once, as one
    vector with a number of copies.  Pivots come from a sample of at most ``SAMPLE``
    vectors; cells of any size are joined in blocks, whose bytes are bounded, as are the
    distances to pivots that a task holds.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "range_join")
    all_rows = vectors.select(F.col(id_column).cast("long").alias("id"), "embedding")
    good = all_rows.where(F.col("id").isNotNull() & usable())
    classes = scratch.keep(good.groupBy("embedding").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "classes")
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    sample = dense_first(sample_of(classes, SAMPLE), radius)
    out = ["id", "n_links", "component_id", "kept"]
    if not len(sample):
        return all_rows.select(F.col("id").alias(id_column), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    n = classes.count()
    block = block_rows(n, sample.shape[1])
    pivots = sample[: pivot_count(sample, n, radius, block)[0]]
    radii = np.full(len(pivots), -1.0)
    for row in _homes(classes, pivots).groupBy("cell").agg(F.max("far")).collect():  # a row per pivot
        radii[row[0]] = row[1]
    cells = _cells(classes, pivots, radii, radius)
    counts = cells.groupBy("cell").agg(F.count_if(~F.col("guest")).alias("homes"), F.count_if("guest").alias("guests"))
    blocks = counts.select("cell", *(F.greatest(F.lit(1), F.ceil(F.col(c) / block)).cast("int").alias(c) for c in ("homes", "guests")))
    placed = cells.join(F.broadcast(scratch.keep(blocks, "blocks")), "cell")  # one row per pivot, at most SAMPLE
    own = F.expr("cast(pmod(xxhash64(id), if(guest, guests, homes)) as int)")
    home_tasks = F.expr("""concat(
        transform(sequence(0, homes - 1), b -> struct(false as with_guests, least(own, b) as a, greatest(own, b) as b, if(b = own, 2, if(own < b, 0, 1)) as side)),
        transform(sequence(0, guests - 1), b -> struct(true as with_guests, own as a, b as b, 0 as side)))""")
    guest_tasks = F.expr("transform(sequence(0, homes - 1), a -> struct(true as with_guests, a as a, own as b, 1 as side))")
    tasks = placed.withColumn("own", own).withColumn("task", F.explode(F.when(F.col("guest"), guest_tasks).otherwise(home_tasks)))
    found = scratch.keep(grouped(tasks.select("cell", "task.*", "id", "copies", "vector"), ["cell", "with_guests", "a", "b"], _joined(threshold, pivots.shape[1]), "id long, links long, other long"), "found")
    scratch.drop("blocks")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    labels = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = classes.join(links, "id", "left").join(labels, "id", "left").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    rows = all_rows.withColumn("key", F.when(F.col("id").isNotNull() & usable(), F.col("embedding")))
    joined = rows.join(named.withColumnRenamed("embedding", "key"), "key", "left")
    result = joined.select("id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return result.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).select(*out).withColumnRenamed("id", id_column)


# -- permutation index ----------------------------------------------------------

#: Rows of one block of an inverted file, and of one group of queries.
INDEX_ROWS, QUERY_ROWS = 8192, 2048
#: Queries that the search is tuned on, and the recall that it must reach there.
TUNING_QUERIES, TARGET = 128, 0.95


def _posted(vectors: DataFrame, pivots: np.ndarray, files: int, columns: dict[str, str], sizes: np.ndarray | None = None, least: int = 0) -> DataFrame:
    """Each vector with the pivots of its ``files`` nearest inverted files, one row a file; more if those hold under ``least`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, fits = _matrix(batch.column("embedding"), pivots.shape[1])
            if len(x):
                near = np.argsort(-(_unit(x) @ pivots.T), axis=1, kind="stable")
                taken = np.broadcast_to(np.arange(len(pivots)) < files, near.shape)
                if sizes is not None:
                    taken = taken | (np.cumsum(sizes[near], axis=1) - sizes[near] < least)
                row, place = np.nonzero(taken)
                rows = pa.array(np.flatnonzero(fits)[row])
                yield pa.RecordBatch.from_arrays([pa.array(near[row, place].astype(np.int32)), *(batch.column(c).take(rows) for c in columns)], ["pivot", *columns])

    schema = ", ".join(["pivot int", *(f"{c} {t}" for c, t in columns.items())])
    return mapped(vectors.select(*columns), run, schema)


def _searched(pivots: np.ndarray, prefix: int, k: int, share: float):
    """One inverted file, or a block of one: footrule ranks of its rows for each query, and an exact rerank."""

    def run(table: pa.Table) -> pa.Table:
        raw, fits = _matrix(table.column("embedding"), pivots.shape[1])
        ids, copies = table.column("id").to_numpy()[fits], [c for c, ok in zip(table.column("copies").to_pylist(), fits, strict=True) if ok]
        is_query = np.array([c is None for c in copies], bool)
        rows, asked = np.flatnonzero(~is_query), np.flatnonzero(is_query)
        out: tuple[list, list, list] = ([], [], [])
        if len(rows) and len(asked):
            unit = _unit(raw)
            base, base_ids = unit[rows], ids[rows]
            order = np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :prefix]
            # the place of each pivot in each row's list; absent ones stand behind the last
            places = np.full((len(pivots), len(rows)), prefix, np.int16)
            places[order[rows].T, np.arange(len(rows))] = np.arange(prefix, dtype=np.int16)[:, None]
            behind, own = prefix - places, np.arange(prefix, dtype=np.int16)[:, None]
            n = min(len(rows), max(k + 1, math.ceil(share * len(rows))))
            for q in asked:
                near = order[q]
                # Spearman's footrule, but for a constant: pivots of the query's list, less what the row's list would add
                footrule = (np.abs(places[near] - own) - behind[near]).sum(axis=0, dtype=np.int32)
                best = np.flatnonzero(footrule <= np.partition(footrule, n - 1)[n - 1])  # with all that tie at the n-th rank
                if len(best) > k + 1:  # one of them may be the query alone
                    rough = base[best] @ unit[q]
                    best = best[rough >= np.partition(rough, len(best) - k - 1)[len(best) - k - 1] - 1e-9]
                exact = _cosines(raw[rows[best]], np.broadcast_to(raw[q], (len(best), raw.shape[1])))
                top = np.lexsort((base_ids[best], -exact))[: k + 1]
                found = sorted((-exact[i], copy) for i in top for copy in copies[rows[best[i]]] if copy != ids[q])[:k]
                out[0].extend([ids[q]] * len(found)), out[1].extend(copy for _, copy in found), out[2].extend(-x for x, _ in found)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _exact(classes: DataFrame, ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, k: int) -> DataFrame:
    """query_id, vec_id, score, file: the true neighbours of a bounded set of queries, with the place of their file in the query's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = np.argsort(np.argsort(-(_unit(queries) @ pivots.T), axis=1, kind="stable"), axis=1)
        for batch in batches:
            x, fits = _matrix(batch.column("embedding"), queries.shape[1])
            copies = [c for c, ok in zip(batch.column("copies").to_pylist(), fits, strict=True) if ok]
            out: tuple[list, list, list, list] = ([], [], [], [])
            cos = _unit(x) @ _unit(queries).T if len(x) else np.zeros((0, len(ids)))
            home = (_unit(x) @ pivots.T).argmax(axis=1) if len(x) else []
            for q in range(len(ids) if len(x) else 0):
                for i in np.argsort(-cos[:, q], kind="stable")[: k + 1]:
                    for copy in copies[i]:
                        if copy != ids[q]:
                            out[0].append(ids[q]), out[1].append(copy), out[2].append(cos[i, q]), out[3].append(files[q, home[i]])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.int64())], ["query_id", "vec_id", "score", "file"])

    found = mapped(classes.select("embedding", "copies"), run, "query_id long, vec_id long, score double, file long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_vectors(vectors: DataFrame, id_column: str, is_query: Column, k: int = 5, n_pivots: int | None = None, prefix: int = 128, share: float = 0.1) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query among all other rows.

    Every distinct vector is posted once, in the inverted file of its nearest pivot and
    with its k + 1 smallest ids.  A query goes to the files of its nearest pivots only,
    where vectors are ranked by the footrule distance of their ``prefix`` nearest pivots
    and the best ``share``, and all that tie with its last, are reranked by cosine; a
    query's best over its files are its result.

    How many files a query reads, and the share, are tuned on ``TUNING_QUERIES`` queries
    whose true neighbours are found first: the fewest files that hold ``TARGET`` of them,
    and the share doubled until the search finds that many.  Pivots are a sample of
    2 sqrt(n) vectors, 64 at least, unless ``n_pivots`` says otherwise.
    """
    scratch = Scratch(vectors.sparkSession, "permutation_index")
    good = vectors.where(F.col(id_column).isNotNull() & usable()).select(F.col(id_column).cast("long").alias("id"), "embedding", is_query.alias("asks"))
    good = scratch.keep(good, "vectors")
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("id"))  # Spark cuts each task's rows to k + 1 a vector before it moves them
    smallest = good.select("id", "embedding", place.alias("place")).where(F.col("place") <= k + 1)
    classes = smallest.groupBy("embedding").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("copies"))
    classes = scratch.keep(classes.select(F.col("copies")[0].alias("id"), "copies", "embedding"), "classes")
    n = classes.count()
    pivots = sample_of(classes, n_pivots or max(64, math.ceil(2 * math.sqrt(n))))
    asked = good.where("asks").select("id", "embedding")
    tuning = [r for r in asked.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(TUNING_QUERIES).collect() if len(r["embedding"]) == pivots.shape[1]]
    if not len(pivots) or not tuning:
        return _best(asked.limit(0).select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")), k)
    prefix, kind = min(prefix, len(pivots)), good.schema["embedding"].dataType.simpleString()
    index = scratch.keep(_posted(classes, pivots, 1, {"id": "long", "copies": "array<long>", "embedding": kind}), "index")
    sizes = scratch.keep(index.groupBy("pivot").agg(F.count("*").alias("n_rows")), "sizes")
    held = np.zeros(len(pivots), np.int64)
    for row in sizes.collect():  # a row per pivot
        held[row[0]] = row[1]
    rows_of_block = max(256, min(INDEX_ROWS, (16 << 20) // len(pivots)))

    def search(queries: DataFrame, files: int, share: float) -> DataFrame:
        sent = _posted(queries, pivots, files, {"id": "long", "embedding": kind}, held, 2 * k + 1)
        load = sent.groupBy("pivot").agg(F.count("*").alias("n_queries")).join(sizes, "pivot")
        tasks = load.select("pivot", F.ceil(F.col("n_rows") / rows_of_block).cast("int").alias("blocks"), F.ceil(F.col("n_queries") / QUERY_ROWS).cast("int").alias("groups"))
        tasks = F.broadcast(tasks)  # a row per pivot
        own, every = (lambda m: F.expr(f"cast(pmod(xxhash64(id), {m}) as int)")), (lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1)))
        rows = index.join(tasks, "pivot").select("pivot", own("blocks").alias("block"), every("groups").alias("group"), "id", "embedding", "copies")
        asks = sent.join(tasks, "pivot").select("pivot", every("blocks").alias("block"), own("groups").alias("group"), "id", "embedding", F.lit(None).cast("array<long>").alias("copies"))
        both = rows.unionByName(asks).withColumn("task", F.concat_ws(":", "pivot", "block", "group")).drop("pivot", "block", "group")
        return _best(grouped(both, ["task"], _searched(pivots, prefix, k, share), "query_id long, vec_id long, score double"), k)

    sample = asked.sparkSession.createDataFrame(tuning, asked.schema)
    truth = _exact(classes, np.array([r["id"] for r in tuning]), np.array([r["embedding"] for r in tuning], float), pivots, k).collect()  # k rows a tuning query
    worst: dict[int, float] = {}
    for r in truth:
        worst[r["query_id"]] = min(r["score"], worst.get(r["query_id"], 2.0))
    files = 1 + int(np.quantile([r["file"] for r in truth], (1 + TARGET) / 2, method="higher")) if truth else 1
    while share < 1 and truth:
        found = search(sample, files, share).collect()
        if sum(r["score"] >= worst[r["query_id"]] - 1e-9 for r in found) >= TARGET * len(truth):
            break
        share = min(1.0, 2 * share)
    return search(asked, files, share)
