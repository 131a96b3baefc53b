"""Shared plumbing of the operators: scratch tables, binary columns, tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ship import ship as _ship
from ..functions.tables import Tables as Scratch

#: White space between words and around lines; every operator uses this set.
SPACES = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: Bytes of text whose grams one merge task takes.
PART_BYTES = 32 << 20


def parts_for(docs: DataFrame) -> int:
    """Merge tasks for the texts of docs: as many as the session shuffles to, more if these would hold too much."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(partitions(docs.sparkSession), -(-size // PART_BYTES))


def id_text_crc(column: str = "doc_id") -> Column:
    """crc32 of the id's decimal text; null ids count as 1, so they are never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")), F.lit(1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column of the frame has, for columns that come and go."""
    prefix = "_h"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


# -- binary columns -------------------------------------------------------------

_zip = zstandard.ZstdCompressor(level=1)
_unzip = zstandard.ZstdDecompressor()


def pack(values: np.ndarray) -> bytes:
    """One numpy array as bytes: type, then zstd over the transposed byte planes."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()
    return values.dtype.str.encode().ljust(4) + len(planes).to_bytes(8, "little") + _zip.compress(planes)


def unpack(blob: bytes) -> np.ndarray:
    dtype = np.dtype(blob[:4].decode().strip())
    planes = _unzip.decompress(blob[12:], max_output_size=max(1, int.from_bytes(blob[4:12], "little")))
    return np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, -1).T.copy().view(dtype).reshape(-1)


def zipped(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _zip.compress(data)


def unzipped(blob: bytes) -> bytes:
    return _unzip.decompress(blob[8:], max_output_size=max(1, int.from_bytes(blob[:8], "little")))


# -- Arrow batches --------------------------------------------------------------

#: Bytes of one Arrow batch between Spark and Python.
BATCH_BYTES = 4 << 20
#: Bytes of text that one Python step holds at a time; a longer text is a step of its own.
STEP_BYTES = 8 << 20


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column, b"" for null; invalid UTF-8 is passed through."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of each stay under ``limit`` bytes where they can."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.fromiter((len(x) for x in texts_of(batch.column(column))), np.int64, batch.num_rows)
        cuts = np.unique((np.cumsum(sizes) - 1) // limit, return_index=True)[1]
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def ship(spark: SparkSession) -> None:
    """Sends this package's sources to the executors and bounds Arrow batches by bytes, not by rows of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    _ship(spark)


def mapped(df: DataFrame, function: Callable, schema) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def grouped(df: DataFrame, keys: list[str], function: Callable, schema) -> DataFrame:
    ship(df.sparkSession)
    return df.groupBy(*keys).applyInArrow(function, schema)


def rows_batch(columns: dict[str, list | np.ndarray | pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema
    )


# -- hashing --------------------------------------------------------------------

_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, on uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _C1
    x ^= x >> np.uint64(27)
    x *= _C2
    x ^= x >> np.uint64(31)
    return x
