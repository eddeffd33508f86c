"""Small partitioned computations: partial sums, per-task sums, a threshold trigger, a matrix fill."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ones(spark: SparkSession, n: int = 400_000) -> DataFrame:
    """i, a = b = 1."""
    return spark.range(n).select(F.col("id").alias("i"), F.lit(1.0).alias("a"), F.lit(1.0).alias("b"))


def dot_partials(v: DataFrame, length: int = 100_000) -> DataFrame:
    """part, partial: the dot product by consecutive blocks of `length`."""
    return v.groupBy(F.floor(F.col("i") / length).alias("part")).agg(F.sum(F.col("a") * F.col("b")).alias("partial"))


def dot_total(v: DataFrame, length: int = 100_000) -> DataFrame:
    """total: the sum of the partial products."""
    return dot_partials(v, length).agg(F.sum("partial").alias("total"))


def trig_sums(spark: SparkSession, tasks: int = 15, terms: int = 1_000_000) -> DataFrame:
    """task, total: the sum of sin(i) tan(i) for i < terms, in each task."""
    i = (F.col("id") % terms).cast("double")
    return spark.range(tasks * terms).groupBy(F.floor(F.col("id") / terms).alias("task")).agg(F.sum(F.sin(i) * F.tan(i)).alias("total"))


def threshold_trigger(steps: DataFrame, limit: int = 12, extra: int = 125) -> DataFrame:
    """fired_at, final: the first count that reaches `limit`, and all steps with `extra` added if it did.
    steps: n, the order of increments by 1. The order is a handful of rows by nature: one ordered window."""
    counted = steps.select(F.row_number().over(Window.orderBy("n")).alias("count"))
    fired = F.min(F.when(F.col("count") >= limit, F.col("count")))
    return counted.agg(fired.cast("bigint").alias("fired_at"), (F.count("*") + F.when(fired.isNotNull(), extra).otherwise(0)).cast("bigint").alias("final"))


def matrix_fill(spark: SparkSession, n: int = 1000) -> DataFrame:
    """i, j, v = i * j / 3.452 + (n - i)."""
    cell = spark.range(n * n).select(F.floor(F.col("id") / n).alias("i"), (F.col("id") % n).alias("j"))
    return cell.select("i", "j", (F.col("i") * F.col("j") / 3.452 + (n - F.col("i"))).alias("v"))
