"""Least squares on +-1 labels by cyclic coordinate descent, over points(id, features, label).

For few columns: one distributed pass builds the Gram matrix and the right-hand side, and all sweeps are exact steps
on these d * d numbers on the driver, so the data are read once however many sweeps there are. For any number of columns
there is `descent.py`, which keeps a distributed residual and gives the same weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cells(points: DataFrame) -> DataFrame:
    """id, j, x, label."""
    return points.select("id", F.posexplode("features").alias("j", "x"), "label").withColumn("j", F.col("j").cast("bigint"))


def nonzero_columns(points: DataFrame) -> DataFrame:
    """j, new_j: columns that are not 0 throughout, and their place among them."""
    from pyspark.sql.window import Window

    keep = cells(points).groupBy("j").agg(F.bool_or(F.col("x") != 0).alias("any")).filter("any")
    return keep.select("j", (F.row_number().over(Window.orderBy("j")) - 1).cast("bigint").alias("new_j"))


def denominators(points: DataFrame) -> DataFrame:
    """j, denominator: the sum of squares of each column that is not 0 throughout."""
    return cells(points).groupBy("j").agg(F.sum(F.col("x") * F.col("x")).alias("denominator")).filter("denominator > 0")


def mat_vec(points: DataFrame, w: list[float]) -> DataFrame:
    """id, xw."""
    weights = F.array(*[F.lit(float(x)) for x in w])
    return points.select("id", F.aggregate(F.zip_with("features", weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b).alias("xw"))


def squared_error(points: DataFrame, w: list[float]) -> DataFrame:
    """error: the sum of (xw - label)^2."""
    weights = F.array(*[F.lit(float(x)) for x in w])
    xw = F.aggregate(F.zip_with("features", weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return points.agg(F.coalesce(F.sum(F.pow(xw - F.col("label"), 2)), F.lit(0.0)).alias("error"))


def gram(points: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """X'X, X'y and y'y. A partition keeps one (d + 1)^2 sum; these are added pairwise by a second, small
    aggregate, cell by cell, and only the result comes to the driver."""

    def partial(batches):
        import pyarrow as pa

        total = None
        for b in batches:
            if b.num_rows:
                x = np.c_[b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), b.column(1).to_numpy(zero_copy_only=False)]
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int64)), pa.array(j.astype(np.int64)), pa.array(total[i, j])], ["i", "j", "v"])

    rows = points.select("features", "label").mapInArrow(partial, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    if not len(rows):
        return np.zeros((0, 0)), np.zeros(0), 0.0
    d = int(rows["j"].max())
    g = np.zeros((d + 1, d + 1))
    g[rows["i"], rows["j"]] = g[rows["j"], rows["i"]] = rows["v"]
    return g[:d, :d], g[:d, d], float(g[d, d])


@dataclass
class Fit:
    """weights by original column (0 columns left out), and the error before and after each sweep."""

    columns: np.ndarray
    weights: np.ndarray
    errors: list[float]


def fit(points: DataFrame, sweeps: int) -> Fit:
    """Cyclic coordinate descent from w = 0: no intercept, no penalty, a fixed number of sweeps."""
    g, b, yy = gram(points)
    keep = np.flatnonzero(np.diag(g) > 0)
    g, b = g[np.ix_(keep, keep)], b[keep]
    w, errors = np.zeros(len(keep)), [yy]
    for _ in range(sweeps):
        for j in range(len(w)):
            w[j] = (b[j] - g[j] @ w + g[j, j] * w[j]) / g[j, j]
        errors.append(float(w @ g @ w - 2 * (w @ b) + yy))
    return Fit(keep, w, errors)


def weights(points: DataFrame, sweeps: int) -> DataFrame:
    """j, w, by fit()."""
    f = fit(points, sweeps)
    return points.sparkSession.createDataFrame([(int(j), float(w)) for j, w in zip(f.columns, f.weights, strict=True)], "j bigint, w double")


def error_trace(points: DataFrame, sweeps: int) -> DataFrame:
    """iteration (0: before), error, by fit()."""
    f = fit(points, sweeps)
    return points.sparkSession.createDataFrame(list(enumerate(f.errors)), "iteration bigint, error double")
