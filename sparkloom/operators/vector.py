"""Vector primitives over (i, x) or (i, x, y) rows; i is the index from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FIRST = 1  # ties in argmax and argmin go to the smallest index


def incset(spark: SparkSession, n: int, base: float) -> DataFrame:
    """i, x = base + i."""
    return spark.range(n).select(F.col("id").alias("i"), (F.col("id") + base).alias("x"))


def fill(spark: SparkSession, n: int, value: float) -> DataFrame:
    """i, x = value."""
    return spark.range(n).select(F.col("id").alias("i"), F.lit(float(value)).alias("x"))


def fill2d(spark: SparkSession, n: int, m: int, value: float) -> DataFrame:
    """i, row: n rows that are arrays of m values."""
    return spark.range(n).select(F.col("id").alias("i"), F.array_repeat(F.lit(float(value)), m).alias("row"))


def copy(v: DataFrame) -> DataFrame:
    return v.select("i", "x")


def vmax(v: DataFrame) -> DataFrame:
    """max; 0 for an empty vector."""
    return v.agg(F.coalesce(F.max("x"), F.lit(0.0)).alias("max"))


def vmin(v: DataFrame) -> DataFrame:
    """min; 0 for an empty vector."""
    return v.agg(F.coalesce(F.min("x"), F.lit(0.0)).alias("min"))


def argmax(v: DataFrame) -> DataFrame:
    """i of the largest x, the first of equals."""
    return v.orderBy(F.desc("x"), "i").limit(_FIRST).select("i")


def argmin(v: DataFrame) -> DataFrame:
    """i of the smallest x, the first of equals."""
    return v.orderBy("x", "i").limit(_FIRST).select("i")


def argmax_n(v: DataFrame, k: int) -> DataFrame:
    """i of the k-th largest x, k from 1."""
    return v.orderBy(F.desc("x"), "i").limit(k).orderBy("x", F.desc("i")).limit(1).select("i")


def vsum(v: DataFrame, step: int = 1) -> DataFrame:
    """sum of every step-th x."""
    return v.filter(F.col("i") % step == 0).agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("sum"))


def scale(v: DataFrame, alpha: float) -> DataFrame:
    return v.select("i", (F.col("x") * alpha).alias("x"))


def norm2(v: DataFrame) -> DataFrame:
    """norm: the root of the sum of squares."""
    return v.agg(F.sqrt(F.coalesce(F.sum(F.col("x") * F.col("x")), F.lit(0.0))).alias("norm"))


def dot(v: DataFrame, step: int = 1) -> DataFrame:
    """dot of x and y, every step-th."""
    return v.filter(F.col("i") % step == 0).agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0.0)).alias("dot"))


def axpy(v: DataFrame, alpha: float) -> DataFrame:
    """i, y + alpha * x."""
    return v.select("i", (F.col("y") + F.col("x") * alpha).alias("y"))


def clamp(v: DataFrame, low: float, high: float) -> DataFrame:
    """x no less than low and no more than high."""
    return v.select("i", F.least(F.greatest("x", F.lit(low)), F.lit(high)).alias("x"))
