"""Packing: concatenate all documents and cut the stream into fixed windows.

Pass one tokenises each input partition once, keeping ids and each document's
offset inside its partition in a scratch table.  The partitions' totals are
prefix-summed (one row per partition), so pass two knows every document's global
offset and cuts at multiples of the window without tokenising again.

Cases: null or empty text is the end id alone; a row is a document, so repeated
rows and repeated ids are packed as often as they occur; an empty table gives no
rows; very long texts are cut into as many windows as they need; other columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import STEP_BYTES, Scratch, mapped, rows_batch, steps

_encoders: dict[int, tuple] = {}


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def encoder(tokenizer_json: bytes):
    """A function from text to ids, equal to the tokenizer file's own without added special tokens.

    The vocabulary of a byte-level BPE whose ids are its merge ranks is run by
    tiktoken, several times faster; any other file is run by ``tokenizers``.
    """
    key = zlib.crc32(tokenizer_json)
    if key in _encoders:
        return _encoders[key]
    spec = json.loads(tokenizer_json)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    vocab = model.get("vocab", {})
    ranked = (
        model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        and spec.get("normalizer") is None and not model.get("ignore_merges") and len(vocab) == 256 + len(merges)
        and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
    )
    if ranked:
        import public_tokenizers
        import tiktoken

        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items()}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

        def encode(text: str) -> list[int]:
            if any(s in text for s in special):
                return own.encode(text, allowed_special="all", disallowed_special=())
            return own.encode_ordinary(text)
    else:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_str(tokenizer_json.decode())

        def encode(text: str) -> list[int]:
            return whole.encode(text, add_special_tokens=False).ids

    _encoders[key] = (encode, max(vocab.values(), default=0) + len(spec.get("added_tokens", [])) < 1 << 16)
    return _encoders[key]


_TOKENS = "doc_id long, part long, part_offset long, n_tokens long, ids binary"
_TOKENS_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("part_offset", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, boundary boolean"


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    with open(tokenizer_path, "rb") as file:
        shipped = docs.sparkSession.sparkContext.broadcast(file.read())  # the file's own fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, short = encoder(shipped.value)
        kind, part, at = np.uint16 if short else np.uint32, TaskContext.get().partitionId(), 0
        for step in steps(batches, "text", STEP_BYTES):
            ids = [np.array([*encode(t or ""), end_id], kind) for t in step.column("text").to_pylist()]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            ends = at + np.cumsum(sizes)
            yield rows_batch({"doc_id": step.column("doc_id"), "part": np.full(len(ids), part), "part_offset": ends - sizes, "n_tokens": sizes, "ids": [x.tobytes() for x in ids]}, _TOKENS_ARROW)
            at = int(ends[-1])

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, _TOKENS)


def _placed(tokens: DataFrame) -> DataFrame:
    """Each document with its global offset; the broadcast side has one row per input partition."""
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base"), "total")
    return tokens.join(F.broadcast(bases), "part").withColumn("at", F.col("base") + F.col("part_offset"))


def pack_pieces(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document; with_ids adds the ids as little-endian unsigned 32-bit binary.

    ``boundary`` marks pieces of windows that two input partitions share.  Only the
    last window of all can be short.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    tokens = scratch.keep(tokenised(docs, tokenizer_path, end_id), "tokens")
    schema = _PIECES + (", ids binary" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            fields = (batch.column(n).to_pylist() for n in ("doc_id", "at", "n_tokens", "ids", "base", "total"))
            for doc, at, n, raw, base, total in zip(*fields, strict=True):
                ids = np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32).astype("<u4")
                cuts = [at, *range((at // window + 1) * window, at + n, window), at + n]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    piece, first = ids[a - at : b - at].tobytes(), a // window * window
                    row = (doc, a - at, b - a, zlib.crc32(piece), n, a // window, a % window, first < base or first + window > base + total)
                    for name, value in zip(names, (*row, piece), strict=False):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=_arrow(schema))

    return mapped(_placed(tokens).select("doc_id", "at", "n_tokens", "ids", "base", "total"), cut, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))])


def pack_sequences(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, pad_id: int = 0) -> DataFrame:
    """The windows themselves: sequence_id, ids (padded to the window), n_tokens.

    A window's pieces are at most ``window`` rows, so grouping them is bounded.
    """
    pieces = pack_pieces(docs, tokenizer_path, window, end_id, with_ids=True)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = pieces.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("n_tokens"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(b"".join(p["ids"] for p in row), "<u4").astype(np.int64) for row in batch.column("parts").to_pylist()]
            rows = [np.concatenate([r, np.full(window - len(r), pad_id)]) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(rows, pa.list_(pa.int64())), batch.column("n_tokens")], ["sequence_id", "ids", "n_tokens"])

    return mapped(joined, join, "sequence_id long, ids array<long>, n_tokens long")
