"""Line deduplication over range-partitioned line hashes.

Every line becomes (key hash, document, position), range-partitioned on all three
with a secondary sort, so a line that fills a third of the corpus spans many
partitions instead of one task.  Each partition streams its runs of equal keys and
decides those that lie inside it; the first and last run of a partition may go on
next door, and only those few are settled by a small aggregation.  The result is a
compressed keep bitmap per document that loses lines, not text.

Cases: null or empty text is one empty line; keys shorter than ``min_chars`` code
points are never dropped; a line that repeats inside one document counts it once;
rows without doc_id keep all their lines and count nowhere; rows that share an id
count as one document and each gets the bitmap of its own text; an empty table
gives no rows; extra columns are carried through untouched by ``drop_lines``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_prefix, mapped, partitions, steps, texts_of

_SPACES = b" \t\n\x0b\x0c\r"
_ROW = [("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_lines", pa.int64()), ("position", pa.int64()), ("key", pa.binary())]
_LINES = "doc_id long, text_key long, n_lines long, position long, key binary"
_FOUND = "doc_id long, text_key long, n_lines long, position long, key binary, role int"
#: Roles of the rows that a partition streams out.
DROP, OPEN, FIRST, PROOF = 0, 1, 2, 3


def line_key(line: bytes) -> bytes:
    return line.strip(_SPACES).lower()


def _hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, "text"):
            ids, marks = step.column("doc_id").to_pylist(), step.column("text_key").to_pylist()
            out: list[list] = [[], [], [], [], []]
            for doc, mark, text in zip(ids, marks, texts_of(step.column("text")), strict=True):
                lines = text.split(b"\n")
                for at, line in enumerate(lines):
                    key = line_key(line)
                    if len(key) >= min_chars and (min_chars < 2 or len(key.decode("utf-8", "replace")) >= min_chars) and key:
                        for column, value in zip(out, (doc, mark, len(lines), at, xxhash.xxh3_128_digest(key)), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(out, _ROW, strict=True)], [n for n, _ in _ROW])

    return run


def _runs(min_docs: int, keep_first: bool):
    """Streams sorted rows; holds at most the rows of min_docs - 1 documents of one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, docs, last, edge, settled = None, [], 0, None, True, False
        out: list[tuple] = []

        def closing(at_end: bool) -> None:
            """A run has ended; edge runs stay open unless they alone have enough documents."""
            if key is None or settled:
                return
            if edge or at_end:
                out.extend((*row, OPEN) for row in held)

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n, _ in _ROW), strict=True):
                if row[4] != key:
                    if key is not None:
                        closing(False)
                        if settled and edge:
                            out.append((None, None, None, None, key, PROOF))
                        edge = False
                    key, held, docs, last, settled = row[4], [], 0, None, False
                if row[0] != last:
                    docs, last = docs + 1, row[0]
                if settled:
                    out.append((*row, DROP))
                    continue
                held.append(row)
                if docs >= min_docs:
                    settled = True
                    out.extend((*r, DROP) for r in held[1:])
                    out.append((*held[0], FIRST if keep_first else DROP))
                    held = []
            if out:
                yield _found(out)
                out.clear()
        if key is not None:
            closing(True)
            if settled:
                out.append((None, None, None, None, key, PROOF))
        if out:
            yield _found(out)

    return run


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*(t for _, t in _ROW), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [*(n for n, _ in _ROW), "role"])


def line_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """doc_id, text_key, n_lines, n_dropped, keep (zlib of the packed keep bits) for documents that lose lines.

    keep_first keeps a repeated line where it comes first by (doc_id, position).
    """
    scratch = Scratch(docs.sparkSession, "lines")
    keyed = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    lines = scratch.keep(mapped(keyed, _hashes(min_chars), _LINES), "lines")
    order = ["key", "doc_id", "position", "text_key"]
    streamed = lines.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    found = scratch.keep(mapped(streamed, _runs(min_docs, keep_first), _FOUND), "found")
    scratch.drop("lines")

    def enough(rows: DataFrame) -> DataFrame:
        """Keys of edge runs that have enough documents in all; at most two keys per partition get here."""
        return rows.groupBy("key").agg(F.count_distinct("doc_id").alias("docs"), F.max((F.col("role") == PROOF).cast("int")).alias("proof")).where(f"docs >= {min_docs} or proof = 1").select("key")

    columns = ["doc_id", "text_key", "n_lines", "position"]
    drops = found.where(f"role = {DROP}").select(columns)
    open_rows = found.where(f"role in ({OPEN}, {PROOF})").join(enough(found.where(f"role in ({OPEN}, {PROOF})")), "key").where(f"role = {OPEN}")
    if not keep_first:
        drops = drops.unionByName(open_rows.select(columns))
    else:
        # What comes first in its partition's run is dropped unless it is the first of the key.
        firsts = found.where(f"role = {FIRST}").select(*columns, "key").unionByName(open_rows.select(*columns, "key"))
        least = firsts.groupBy("key").agg(F.min(F.struct("doc_id", "position", "text_key")).alias("least"))
        drops = drops.unionByName(firsts.join(least, "key").where("struct(doc_id, position, text_key) != least").select(columns))
    gathered = drops.groupBy("doc_id", "text_key", "n_lines").agg(F.collect_list("position").alias("dropped"))

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keeps, counts = [], []
            for n, dropped in zip(batch.column("n_lines").to_pylist(), batch.column("dropped").to_pylist(), strict=True):
                keep = np.ones(n, bool)
                keep[dropped] = False
                keeps.append(zlib.compress(np.packbits(keep).tobytes()))
                counts.append(n - int(keep.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), batch.column("n_lines"), pa.array(counts, pa.int64()), pa.array(keeps, pa.binary())], ["doc_id", "text_key", "n_lines", "n_dropped", "keep"])

    return mapped(gathered, bitmaps, "doc_id long, text_key long, n_lines long, n_dropped long, keep binary")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, keep: str = "_keep") -> DataFrame:
    """The documents with their bitmap in a column ``keep`` (null: all lines stay).

    Bitmaps grow with the corpus: the join sorts and merges at every size.
    """
    p = free_prefix(docs)
    side = bitmaps.select(F.col("doc_id").alias(f"{p}id"), F.col("text_key").alias(f"{p}mark"), F.col("keep").alias(keep))
    return docs.join(side.hint("merge"), (F.col("doc_id") == F.col(f"{p}id")) & (F.xxhash64("text") == F.col(f"{p}mark")), "left").drop(f"{p}id", f"{p}mark")


def kept_lines(text: bytes, keep: bytes | None) -> bytes:
    if keep is None:
        return text
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return b"\n".join(line for line, bit in zip(lines, bits, strict=True) if bit)


def drop_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents without the dropped lines; all columns stay, only ``text`` changes."""
    columns, keep = docs.columns, free_prefix(docs) + "keep"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, "text"):
            texts = [kept_lines(t, k) for t, k in zip(texts_of(step.column("text")), step.column(keep).to_pylist(), strict=True)]
            valid = step.column("text").is_valid().to_pylist()
            texts = [t if ok else None for t, ok in zip(texts, valid, strict=True)]
            fixed = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([fixed if n == "text" else step.column(n) for n in columns], columns)

    return mapped(with_bitmaps(docs, bitmaps, keep), run, docs.schema)


def dropped_lines(keep: bytes, n_lines: int) -> int:
    return n_lines - int(np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines).sum())
