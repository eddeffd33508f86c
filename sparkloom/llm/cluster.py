"""Bucket counts, memory of Python workers and connected components."""

from __future__ import annotations

import ctypes
import time
from functools import cache

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.scratch import Scratch

__all__ = ["Scratch", "bucket_count", "components", "give_back", "give_back_driver", "join_skewed", "numbered"]

#: Rounds of components() have the driver return memory so many seconds apart at least, and when they last did.
DRIVER_SECONDS, _driver = 10.0, {"last": 0.0}


@cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return lambda pad: 0


def give_back() -> None:
    """Return freed memory to the system: Spark keeps workers for later tasks, and what they hold adds up."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def give_back_driver(spark: SparkSession) -> None:
    """Return memory that the driver's JVM has freed to the system. Short queries by the dozen leave garbage, for which
    the heap grows instead of being collected, and native memory in the arenas of hundreds of threads."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    jvm.System.gc()
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = gateway.new_array(jvm.java.lang.Object, 4)  # the last two, arguments and their types, stay null
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call.invoke(server, args)
    except Py4JError:  # another JVM or system
        pass


def bucket_count(docs: DataFrame, text: str, bytes_each: int = 6_000_000) -> int:
    """Buckets so that each holds about `bytes_each` of text, and shuffle partitions at least."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(-(-total // bytes_each), int(spark.conf.get("spark.sql.shuffle.partitions")))


def numbered(rows: DataFrame, id_col: str, text_col: str, as_col: str, scratch: Scratch) -> DataFrame:
    """The rows with a number of their own in `as_col`, in order of id (null first) and text. It is the id where
    ids are whole numbers, present and distinct; otherwise the rows are sorted and saved."""
    if rows.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long"):
        if rows.groupBy(id_col).count().filter(f"{id_col} is null or count > 1").isEmpty():
            return rows.withColumn(as_col, F.col(id_col).cast("bigint"))
    spread = rows.withColumn("_tie", F.monotonically_increasing_id())  # equal rows need not go to one task
    ranged = spread.orderBy(F.col(id_col).asc_nulls_first(), text_col, "_tie").drop("_tie")
    return scratch.save(ranged.withColumn(as_col, F.monotonically_increasing_id()))


def join_skewed(many: DataFrame, one: DataFrame, *keys: str) -> DataFrame:
    """The inner join of `many`, any number of rows of a key, and `one`, few rows of a key. Both sides come out of an
    exchange of the join's own, also where `one` is an aggregate by the key: only then may Spark, as it runs, split
    the partition of a hot key and give each part the other side's rows. What follows must shuffle anyway."""
    same = F.concat(keys[0], F.lit("")) if one.schema[keys[0]].dataType.typeName() == "string" else F.col(keys[0]).bitwiseOR(F.lit(0))
    moved = one.withColumn(keys[0], same)  # the same key, but not known to be dealt by it
    return many.join(moved, list(keys))


def components(edges: DataFrame, scratch: Scratch, u: str = "u", v: str = "v") -> DataFrame:
    """(id, component): of each vertex with an edge to another, the smallest vertex reachable.

    Alternating large-star and small-star rounds, O(log^2) of them. Minima are aggregated before their shuffle, and
    the joins with them may be split at a vertex of very many edges. A round is one table; its edges are counted and
    summed while they are written, and the table before it is dropped. Now and then the driver returns memory.
    """
    sums = (F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
    e, now = scratch.measure(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct(), *sums)
    while now["n"]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = join_skewed(both, low, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_skewed(large, low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        before, was = e, now
        e, now = scratch.measure(small.filter("u <> v").distinct(), *sums)
        scratch.drop(before)
        if time.monotonic() - _driver["last"] >= DRIVER_SECONDS:
            give_back_driver(edges.sparkSession)
            _driver["last"] = time.monotonic()
        if now == was:
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
