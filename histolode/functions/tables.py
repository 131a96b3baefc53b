"""Tables in the cluster's shared folder, to cut lineage between iterations."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
#: Removes the shuffle files of an execution when it ends; what it wrote is read from the shared folder.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode and only if unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = tempfile.mkdtemp(prefix="histolode-")
    return "file://" + _local[context.applicationId]


class Tables:
    """Tables written to the shared folder: they cut lineage and survive lost executors.

    ``keep`` writes and rereads a frame and lets the shuffle files of that write go;
    ``drop`` deletes tables that no later step reads.  ``collected`` gathers the tables
    that operators make inside a block, for a caller that knows when nobody reads them.
    """

    _open: ClassVar[list[list[Tables]]] = []

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder = spark, f"{shared_folder(spark)}/histolode/{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[str, str] = {}
        for made in self._open:
            made.append(self)

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        path, before = f"{self.folder}/{tag}", self.spark.conf.get(_CLEANUP)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        self.paths[tag] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tags: str) -> None:
        """Deletes the named tables, or all that are left."""
        for tag in tags or tuple(self.paths):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(tag))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    @classmethod
    @contextmanager
    def collected(cls) -> Iterator[list[Tables]]:
        made: list[Tables] = []
        cls._open.append(made)
        try:
            yield made
        finally:
            cls._open.remove(made)
