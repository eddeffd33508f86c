"""Sparse matrices as (row, col, val); repeated cells and stored zeros are data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.scratch import save


#: Rows of a range of values, and ranges that an expression tells apart.
ROWS_EACH, FEW = 1_000_000, 64


def _ranged(df: DataFrame, order: str, rows_each: int) -> DataFrame:
    """df with `b_`, the number of its range of `order`; ranges ascend and hold about `rows_each` rows, so there
    are as many as the input needs. A few come from approximate quantiles, without an exchange; more are the
    partitions of a range exchange, saved, since their bounds are sampled."""
    seen = df.agg(F.percentile_approx(order, [i / FEW for i in range(1, FEW)], 1000).alias("e"), F.count("*").alias("n")).first()
    parts = -(-seen.n // rows_each)
    if parts > FEW:
        return save(df.repartitionByRange(parts, order).withColumn("b_", F.spark_partition_id()), "ranges")
    bucket = F.lit(0)
    for e in sorted(set(seen.e or [])):
        bucket = bucket + F.coalesce((F.col(order) > e).cast("int"), F.lit(0))  # nulls are in the first range
    return df.withColumn("b_", bucket)


def _dense_ids(values: DataFrame, name: str, rows_each: int = ROWS_EACH) -> DataFrame:
    """name, new: distinct values numbered from 0 in ascending order. Numbers are within ranges of values; the
    ranges' sizes are summed up, so that no task sees all values."""
    d = values.select(name).distinct()
    if d.schema[name].dataType.simpleString() != "bigint":
        d = d.select(F.col(name).cast("bigint"))
    return prefix_sum(d.withColumn("one_", F.lit(1)), name, "one_", rows_each).select(name, F.col("before").alias("new"))


def compact_columns(m: DataFrame) -> DataFrame:
    """Columns renumbered densely in their order; empty ones vanish."""
    return m.join(_dense_ids(m, "col"), "col").select("row", F.col("new").alias("col"), "val")


def column_map(m: DataFrame) -> DataFrame:
    """col, new_col: what compact_columns makes of each column."""
    return _dense_ids(m, "col").withColumnRenamed("new", "new_col")


def normalize(m: DataFrame, what: str = "row", norm: int = 2) -> DataFrame:
    """Rows or columns ('row', 'col', 'both': rows first) scaled to norm 1. The 1-norm sums signed values; what
    sums to 0 or less stays as it is."""
    if what == "both":
        return normalize(normalize(m, "row", norm), "col", norm)
    term = F.col("val") * F.col("val") if norm == 2 else F.col("val")
    s = m.groupBy(what).agg(F.sum(term).alias("s"))
    scale = 1 / F.sqrt("s") if norm == 2 else 1 / F.col("s")
    return m.join(s, what).select("row", "col", F.when(F.col("s") > 0, F.col("val") * scale).otherwise(F.col("val")).alias("val"))


def squared_norms(m: DataFrame, what: str = "row", binary: bool = False) -> DataFrame:
    """Squared norm of each row or column; for a matrix without values the number of its cells."""
    return m.groupBy(what).agg((F.count("*").cast("double") if binary else F.sum(F.col("val") * F.col("val"))).alias("norm"))


def inverted_index(m: DataFrame, what: str = "col") -> DataFrame:
    """Of each column its (row, val) in order of row, or of each row its (col, val)."""
    other = "row" if what == "col" else "col"
    return m.groupBy(what).agg(F.sort_array(F.collect_list(F.struct(other, "val"))).alias("entries"))


def index_rows(m: DataFrame, what: str = "col", parts: int | None = None) -> DataFrame:
    """The same order without lists: partitioned by `what`, sorted within."""
    other = "row" if what == "col" else "col"
    dealt = m.repartition(parts, what) if parts else m.repartition(what)
    return dealt.sortWithinPartitions(what, other)


def pointers(m: DataFrame) -> DataFrame:
    """row, ptr: cells before each row; rows without cells are left out."""
    n = m.groupBy("row").agg(F.count("*").alias("n"))
    return prefix_sum(n, "row", "n").select("row", F.col("before").alias("ptr"))


def prefix_sum(df: DataFrame, order: str, value: str, rows_each: int = ROWS_EACH) -> DataFrame:
    """df with `before`, the sum of `value` over rows of smaller `order`. `order` is distinct, but for nulls, which come
    first, in any order; so it is for any number of ranges. A null `value` adds nothing. Sums are within
    ranges of `order`, and the ranges' sums, one short row for each `rows_each` rows, are summed up and broadcast."""
    d = _ranged(df, order, rows_each)
    whole = d.groupBy("b_").agg(F.sum(value).alias("s_")).select("b_", F.coalesce(F.sum("s_").over(Window.orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o_"))
    inner = F.coalesce(F.sum(value).over(Window.partitionBy("b_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.join(F.broadcast(whole), "b_").withColumn("before", (inner + F.col("o_")).cast("bigint")).drop("b_", "o_")


def extract_rows(m: DataFrame, start: int, n: int, nrows: int | None = None) -> DataFrame:
    """Rows start .. start + n - 1, numbered from 0. Where `nrows` is given and the slice leaves it: ValueError."""
    if start < 0 or n < 0 or nrows is not None and start + n > nrows:
        raise ValueError("the slice leaves the matrix")
    return m.filter((F.col("row") >= start) & (F.col("row") < start + n)).select((F.col("row") - start).alias("row"), "col", "val")


def stats(m: DataFrame) -> DataFrame:
    """n_rows, n_cols, nnz, max_row: rows and columns with cells, cells, most cells in a row."""
    rows = m.groupBy("row").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("nnz"), F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("max_row"))
    cols = m.groupBy("col").count().agg(F.count("*").alias("n_cols"))
    return rows.join(cols).select("n_rows", "n_cols", "nnz", "max_row")
