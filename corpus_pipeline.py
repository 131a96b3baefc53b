"""The corpus pipeline: each stage reads what the one before kept.

Toxic documents go, lines found in ten documents or more go, one document of each
group of near-duplicates stays, sources are mixed to target weights, and what is left
is packed into windows of token ids.

Cases, in every stage: null and empty texts are documents without words (kept by the
filters, never taken by the mix); rows without id are scored and mixed like others, but
no line or near-duplicate is counted or dropped for them; equal rows get equal
decisions, and the mix takes each for itself; ties go by id; very long texts are read
whole; an empty table gives an empty table; extra columns are carried up to the last
stage, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histolode.llm import lines, mixing, near_dup, packing, toxicity
from histolode.llm.common import Scratch, free_prefix, id_text_crc, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier calls toxic; it learns from labels outside its held-out fold."""
    labels = table(spark, sf_dir, "labels").where(id_text_crc() % 5 != 0).select("doc_id", "toxic")
    score = free_prefix(docs) + "score"
    return toxicity.score(docs, toxicity.fit(docs, labels), score).where(F.col(score) < 0.5).drop(score)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines found in at least ten documents; a document that loses all of them stays, empty."""
    fewer = lines.drop_lines(docs, lines.line_bitmaps(docs.select("doc_id", "text"), min_docs=10, min_chars=1))
    if "n_chars" in docs.columns:
        fewer = fewer.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return fewer.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each component; those without words all stay."""
    lost = near_dup.near_duplicates(docs.select("doc_id", "text"), width=5, percent=75).where(~F.col("kept")).select("doc_id")
    return docs.join(lost, "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that each source comes near its target."""
    return mixing.mix(docs, weights=(3, 1, 2), share=1.5, max_repeats=2)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed windows."""
    return packing.pack_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), window=2048, end_id=1).drop("boundary")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("near_dup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]
#: Learning, MinHash and tokenising are not for SQL; tests run the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each one's rows are written and read again.

    A stage's own tables and its input go as soon as its rows are written; those of the
    last stage stay, for its rows are made when they are read.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with Scratch.collected() as made:
            rows = stage(spark, docs, sf_dir)
        kept = Scratch(spark, "pipeline")
        docs = kept.keep(rows, name)
        for done in (*made, *before):
            done.drop()
        before = [kept]
    return STAGES[-1][1](spark, docs, sf_dir)
