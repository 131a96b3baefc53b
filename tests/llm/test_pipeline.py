"""The pipeline: every stage against brute force on its own input, and the registered queries against SQL."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from histolode.llm import queries, sql
from tests.compare import SF, assert_same
from tests.llm import data
from tests.llm.test_documents import brute_lines, brute_near


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], sql.ORACLES[name])


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dup", "mixing", "packing"]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()] if name != "toxicity" else None
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.count()
        if name == "toxicity":
            labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            left = {r["doc_id"] for r in docs.collect()}
            assert 0.8 * n <= kept[name] < n and sum(1 for d, t in labels.items() if not t and d not in left) <= 2
        elif name == "line_dedup":
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == brute_lines(before, 10)
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
        elif name == "near_dup":
            assert {r["doc_id"] for r in docs.collect()} == {d for d, (_, _, k) in brute_near(before).items() if k}
        elif name == "mixing":
            counts = Counter(r["doc_id"] for r in docs.collect())
            assert set(counts.values()) <= {1, 2} and set(counts) <= {d for d, _ in before}
        if name != "packing":
            assert docs.columns == columns
    lengths = docs.agg(F.sum("length")).first()[0]
    whole = docs.select("doc_id", "doc_tokens", "sequence_id", "offset", "start").where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    assert lengths == whole and kept["packing"] >= kept["mixing"]


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    found = corpus_pipeline.run(spark, SF)
    ids = Counter((r["doc_id"], r["doc_tokens"]) for r in found.where("start = 0").collect())
    assert sorted(d for d, _ in ids.elements()) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())


def test_stages_on_odd_tables(spark):
    odd = data.documents(spark, data.with_odd_rows(data.rows()))
    for docs, n in ((odd, odd.count()), (odd.limit(0), 0), (odd.drop("n_chars"), odd.count())):
        kept = {}
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, SF)
            kept[name] = found.count()
            if name != "packing":
                assert found.columns == docs.columns
        assert kept["toxicity"] == kept["line_dedup"] == n and (kept["packing"] >= n)
        # the three equal rows of document 1 have one kept id; its copy under id 2 and what is like them go
        assert kept["near_dup"] < n if n else kept["near_dup"] == 0
        ids = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).select("doc_id").collect()]
        assert ids.count(1) == (3 if n else 0) and ids.count(None) == (2 if n else 0) and 2 not in ids
