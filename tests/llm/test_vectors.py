import numpy as np
import pytest
from pyspark.sql import functions as F

from histolode.llm import components, vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("x")).withColumn("copies", F.lit("y"))


def made(n=400, d=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[n // 2 : n // 2 + 60] = x[0] + rng.normal(size=(60, d)) * np.linspace(0.02, 0.25, 60)[:, None]
    x[-20:] = x[1]
    return x.astype(np.float32)


def brute(x, t=0.95):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= t
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in x:
        label = np.array([min(label[i], label[near[i]].min(initial=label[i])) for i in range(len(x))])
    return near.sum(axis=1), label


@pytest.mark.parametrize("block, least", [(4096, 8), (17, 64)])
def test_range_join_equals_brute_force(spark, monkeypatch, block, least):
    monkeypatch.setattr(vectors, "LEAST_PIVOTS", least)
    monkeypatch.setattr(vectors, "BLOCK", block)
    x = made()
    links, label = brute(x)
    found = sorted(vectors.range_join(table(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)]), "vec_id").collect())
    assert [tuple(r) for r in found] == [(i, links[i], label[i], label[i] == i) for i in range(len(x))]


BAD = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] + [1.0] * 15, 1), (904, [float("inf")] * 16, 1), (905, [1.0], 1), (906, [], 1), (None, [1.0] * 16, 1)]


def test_odd_vectors_link_with_nothing(spark):
    rows = [(i, v.tolist(), 1) for i, v in enumerate(made(200))] + BAD
    found = {r["vec_id"]: r for r in vectors.range_join(table(spark, rows), "vec_id").collect()}
    assert len(found) == len(rows) and all(found[i]["n_links"] == 0 and found[i]["kept"] for i in range(900, 907))
    asked = vectors.nearest_vectors(table(spark, rows), "vec_id", F.col("vec_id") % 10 == 0).collect()
    assert not {r["vec_id"] for r in asked} & set(range(900, 907)) and not {r["query_id"] for r in asked} & set(range(900, 907))


def test_empty_tables(spark):
    assert vectors.range_join(table(spark, []), "vec_id").count() == 0
    assert vectors.range_join(table(spark, BAD[:2]), "vec_id").count() == 2
    assert vectors.nearest_vectors(table(spark, []), "vec_id", F.lit(True)).count() == 0


def test_search_recall_order_and_ties(spark):
    x = made(1500, 32, 2)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    found = vectors.nearest_vectors(table(spark, rows), "vec_id", F.col("vec_id") % 20 == 0).collect()
    y = x.astype(float)
    hits = total = 0
    for q in range(0, 1500, 20):
        own = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        cos = (y @ y[q]) / (np.linalg.norm(y, axis=1) * np.linalg.norm(y[q]))
        cos[q] = -9
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        assert np.allclose([r["score"] for r in own], cos[[r["vec_id"] for r in own]], atol=1e-12)
        hits += sum(r["score"] >= np.sort(cos)[-5] - 1e-12 for r in own)
        total += 5
    assert hits / total >= 0.9
    copies = [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == 1480]
    assert copies == [1, 1481, 1482, 1483, 1484]  # equal vectors: smaller ids first


@pytest.mark.parametrize("scaled", [False, True])
def test_search_finds_the_smallest_ids_of_a_large_group(spark, scaled):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    group = rng.permutation(3000)[:1000]
    x[group] = x[group[0]] * (2.0 ** rng.integers(-9, 9, 1000)[:, None] if scaled else 1)
    group = sorted(map(int, group))
    rows = table(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)])
    asks = F.col("vec_id").isin(group[0], group[2], group[-1])
    for dealt in (rows, rows.repartition(7, "label", "vec_id")):
        found = sorted(vectors.nearest_vectors(dealt, "vec_id", asks).collect())
        assert [(r["query_id"], r["vec_id"]) for r in found] == [(q, i) for q in (group[0], group[2], group[-1]) for i in [g for g in group if g != q][:5]]


def test_copies_take_no_places_of_others(spark):
    x = np.random.default_rng(6).normal(size=(3000, 16))
    x[::3] = x[0]
    near = x[0] + 0.05 * x[1]
    x[1], x[2], x[4], x[5], x[7], x[8] = near, near + 0.2 * x[2], near + 0.2 * x[4], near + 0.2 * x[5], near + 0.2 * x[7], near + 0.2 * x[8]
    found = vectors.nearest_vectors(table(spark, [(i, v.tolist(), 1) for i, v in enumerate(x.astype(np.float32))]), "vec_id", F.col("vec_id") == 2).collect()
    y = x.astype(np.float32).astype(float)
    cos = y @ y[2] / np.linalg.norm(y, axis=1) / np.linalg.norm(y[2])
    cos[2] = -9
    assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"])] == np.lexsort((np.arange(3000), -cos.round(12)))[:5].tolist()


def clustered(n=4000, d=32, centres=100, spread=0.02, seed=8):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    return c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, d)) * np.sqrt(centres / 100)


def test_many_pivots_and_copies_take_bounded_memory(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    unit = made(12_000, 16).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    runs = []
    monkeypatch.setattr(vectors, "mapped", lambda df, run, schema: runs.append(run))

    class Frame:
        def select(self, *names):
            return self

    pivots = unit[:1024]
    vectors._homes(Frame(), pivots), vectors._cells(Frame(), pivots, np.full(len(pivots), 2.0), 0.3)
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(10_000)), "copies": pa.array([1] * 10_000), "embedding": pa.array(unit[:10_000].tolist())})
    rows = 0
    for run in runs:
        tracemalloc.start()
        rows = sum(b.num_rows for b in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 64 << 20  # all rows against all pivots were over 250 MB
    assert rows > 10_000


def test_links_at_the_threshold_are_judged_in_double_precision(spark):
    t = 0.95
    angles = np.arccos(np.clip(t + np.array([-1e-6, -1e-9, 1e-9, 1e-6]), -1, 1))
    x = [[1.0, 0.0], *([float(np.cos(a)) * 3, float(np.sin(a)) * 3] for a in angles)]
    double = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.n_links for r in vectors.range_join(double, "vec_id").collect()} == {0: 2, 1: 3, 2: 3, 3: 4, 4: 4}


def test_pivots_of_dense_regions_spare_copies():
    x = clustered()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    radius = np.sqrt(0.1)
    sample = vectors.dense_first(unit[:1000], radius)
    n_pivots, copies = vectors.pivot_count(sample, 1_000_000, radius)
    assert n_pivots >= 64 and copies < 1  # full replication to lower cells would be over 30
    d = vectors._distances(unit, sample[:n_pivots])
    assert np.bincount(d.argmin(axis=1)).max() < 400


def test_clustered_vectors_are_searched_in_few_files(spark, monkeypatch):
    x, seen = clustered().astype(np.float32), []
    posted = vectors._posted
    monkeypatch.setattr(vectors, "_posted", lambda df, pivots, files, columns, *more: seen.append((len(pivots), files)) or posted(df, pivots, files, columns, *more))
    found = vectors.nearest_vectors(table(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)]), "vec_id", F.col("vec_id") % 50 == 0).collect()
    pivots, files = seen[-1]
    assert files <= pivots / 4
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    best = {}
    for q in range(0, len(x), 50):
        cos = y @ y[q]
        cos[q] = -9
        best[q] = np.sort(cos)[-5]
    assert sum(r["score"] >= best[r["query_id"]] - 1e-12 for r in found) >= 0.9 * 5 * len(best)


def test_repeated_rows_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0], 1)] * 3 + [(2, [0.0, 1.0], 1)]
    found = sorted(tuple(r) for r in vectors.range_join(table(spark, rows), "vec_id").collect())
    assert found == [(1, 2, 1, True)] * 3 + [(2, 0, 2, True)]
    asked = vectors.nearest_vectors(table(spark, rows), "vec_id", F.col("vec_id") == 2).collect()
    assert {r["vec_id"] for r in asked} == {1}


def test_few_vectors_are_all_found(spark):
    rows = [(i, [float(i + 1), 1.0], 1) for i in range(4)]
    assert vectors.nearest_vectors(table(spark, rows), "vec_id", F.col("vec_id") == 0).count() == 3


@pytest.mark.parametrize("edges_of_a_task", [1 << 18, 16])
def test_components_of_chains_and_stars(spark, monkeypatch, edges_of_a_task):
    monkeypatch.setattr(components, "TASK_EDGES", edges_of_a_task)
    edges = [(i, i + 1) for i in range(100, 180)] + [(5, k) for k in range(6, 60)] + [(5, 5), (6, 5), (300, 200)]
    found = dict(tuple(r) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {i: 100 for i in range(101, 181)} | {k: 5 for k in range(6, 60)} | {300: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
