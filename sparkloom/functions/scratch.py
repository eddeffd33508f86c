"""Scratch tables in the shared folder: they cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_LOCAL: dict[str, str] = {}
#: While a table is written: explicit removal of a query's shuffle files when the query has ended; names of generated
#: classes without the number of their stage, so that rounds of a loop use the classes of the first.
_WRITES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.codegen.useIdInClassName": "false"}
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Most bytes of an Arrow batch that a Python worker is given; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where a local session has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _LOCAL.setdefault("folder", "file://" + tempfile.mkdtemp(prefix="sparkloom-"))


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes, unless a smaller bound is set. Rows of any length then
    pass through JVM and Python workers in the same memory."""
    if int(spark.conf.get(_BATCH).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


@contextmanager
def _cleaned(spark: SparkSession, more: dict[str, str]):
    held = _WRITES | more
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Scratch:
    """Tables that one run of an operator writes to the shared folder. The run drops those it no longer reads; the
    folder goes when the driver ends, since lazy results may read it until then. Settings in `while_writing` hold for
    its writes only."""

    def __init__(self, spark: SparkSession, name: str, while_writing: dict[str, str] | None = None):
        self.spark, self.n, self.while_writing = spark, 0, while_writing or {}
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        bound_batches(spark)
        files, path = self._files(self.folder)
        files.mkdirs(path)  # only what exists can be marked
        files.deleteOnExit(path)

    def _files(self, path: str):
        context = self.spark.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(context._jsc.hadoopConfiguration()), where

    def save(self, df: DataFrame) -> DataFrame:
        """Write and read again with the same schema. The shuffle files of the writing go with its end."""
        self.n += 1
        path = f"{self.folder}/{self.n}"
        with _cleaned(self.spark, self.while_writing):
            df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def measure(self, df: DataFrame, *measures: Column) -> tuple[DataFrame, dict]:
        """save(), and aggregates of the rows on their way out."""
        seen = Observation()
        return self.save(df.observe(seen, *measures)), seen.get

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that save() gave back and that nothing reads any more."""
        for t in tables:
            files, path = self._files(t.scratch_path)
            files.delete(path, True)


def save(df: DataFrame, name: str) -> DataFrame:
    """A table of its own in the shared folder."""
    return Scratch(df.sparkSession, name).save(df)
