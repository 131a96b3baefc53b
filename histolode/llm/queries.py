"""The registered queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lines, mixing, near_dup, packing, repeats, suffix_tree, surrogates, toxicity, vectors
from .common import id_text_crc, mapped, steps, table, texts_of


def op1_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("train", id_text_crc() % 10 != 0)
    return suffix_tree.score_texts(docs)


def op2_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.range_join(table(spark, sf_dir, "embeddings"), "vec_id", threshold=0.95)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(id_text_crc() % 5 != 0).select("doc_id", "toxic")
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", (id_text_crc() % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return repeats.without_repeats(table(spark, sf_dir, "documents"), repeats.removal_digest, schema, min_len=100)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined = lines.with_bitmaps(docs, lines.line_bitmaps(docs, min_docs=10, min_chars=1))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, "text"):
            texts = texts_of(step.column("text"))
            kept = [lines.kept_lines(t, k) for t, k in zip(texts, step.column("_keep").to_pylist(), strict=True)]
            n = [t.count(b"\n") + 1 for t in texts]
            dropped = [0 if k is None else lines.dropped_lines(k, c) for k, c in zip(step.column("_keep").to_pylist(), n, strict=True)]
            sums = [hashlib.sha256(k).hexdigest() for k in kept]
            yield pa.RecordBatch.from_arrays([step.column("doc_id"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sums)], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return mapped(joined, digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=5, percent=75)


def op7_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest_vectors(table(spark, sf_dir, "embeddings"), "vec_id", F.col("vec_id") % 50 == 0, k=5)


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_entities(docs, key="documents")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    schedule = mixing.mix_schedule(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, max_repeats=2)
    return schedule.select("doc_id", "size", "source_size", "target", "taken")


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), window=2048, end_id=1)
    return pieces.drop("boundary")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_tree_scores": op1_suffix_tree_scores,
    "op2_range_join": op2_range_join,
    "op3_toxicity": op3_toxicity,
    "op4_repeats": op4_repeats,
    "op5_line_dedup": op5_line_dedup,
    "op6_near_dup": op6_near_dup,
    "op7_permutation_index": op7_permutation_index,
    "op8_surrogates": op8_surrogates,
    "op9_mix_sources": op9_mix_sources,
    "op10_pack": op10_pack,
}
