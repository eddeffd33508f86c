"""Coordinate descent over a distributed residual against steps over single columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import descent

POINTS = "id bigint, features array<double>, label double"


def stepwise(x, y, sweeps):
    w, r, errors = np.zeros(x.shape[1]), y.copy(), [float(y @ y)]
    own = (x * x).sum(0)
    for _ in range(sweeps):
        for j in np.flatnonzero(own):
            new = x[:, j] @ (r + x[:, j] * w[j]) / own[j]
            r -= x[:, j] * (new - w[j])
            w[j] = new
        errors.append(float(r @ r))
    return {int(j): w[j] for j in np.flatnonzero(own)}, errors


@pytest.mark.parametrize(("width", "rows"), [(3, 7), (512, 1024)])
def test_blocks_of_columns_keep_the_order_of_steps(spark, width, rows):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8)) * (rng.random((60, 8)) < 0.6)
    x[:, [2, 6]] = 0
    y = rng.choice([-1.0, 1.0], 60)
    p = spark.createDataFrame([(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], POINTS)
    got, errors = descent.descend(p, 3, width, rows)
    want, trace = stepwise(x, y, 3)
    got = {r.j: r.w for r in got.collect()}
    assert got.keys() == want.keys() and all(abs(got[j] - want[j]) < 1e-10 for j in want)
    assert np.allclose(errors, trace)


def test_odd_rows(spark):
    rows = [(0, [1.0, None, 2.0], 1.0), (1, None, 1.0), (2, [1.0, 1.0, 1.0], None), (3, [], -1.0), (4, [0.0, 0.0, 1.0], -1.0), (4, [0.0, 0.0, 1.0], -1.0), (None, [1.0], 1.0)]
    x = np.array([[1, 0, 2], [0, 0, 0], [0, 0, 1], [0, 0, 1], [1, 0, 0]], float)
    want, trace = stepwise(x, np.array([1.0, -1, -1, -1, 1]), 2)
    p = spark.createDataFrame(rows, POINTS)
    got, errors = descent.descend(p, 2, 2, 2)
    assert {r.j: round(r.w, 12) for r in got.collect()} == {j: round(w, 12) for j, w in want.items()} and np.allclose(errors, trace)
    assert descent.descend(p.filter("label is null"), 2)[0].count() == 0
    assert [r.error for r in descent.error_trace(p.filter("id = 3"), 2).orderBy("iteration").collect()] == [1, 1, 1]
    assert descent.descend(p, 0)[0].count() == 0


def test_row_blocks_are_bounded(spark):
    p = spark.range(50, numPartitions=2).select("id", F.array_repeat(F.lit(1.0), 10).alias("features"), F.lit(1.0).alias("label"))
    blocks = descent.row_blocks(p, 4, 8, 40).collect()
    assert sum(len(b.y) for b in blocks) == 50 and sum(len(b.x) for b in blocks) == 500
    assert max(len(b.y) for b in blocks) <= 8 and max(len(b.x) for b in blocks) <= 5 * 4
    assert {max(b.c) for b in blocks if b.cb in (0, 1)} == {3} and {max(b.c) for b in blocks if b.cb == 2} == {1}


def test_twenty_thousand_columns(spark):
    """Sparse rows; only products within blocks of columns are formed, so there is no d * d object."""
    n, d, width = 120, 20000, 5000
    cell = "if(pmod(j * 7919 + id * 104729, 997) = 0, 1d + (j + id) % 5, 0d)"
    p = spark.range(n, numPartitions=4).selectExpr("id", f"transform(sequence(0, {d - 1}), j -> {cell}) features", "if(id % 3 = 0, 1d, -1d) label")
    i, j = np.mgrid[:n, :d]
    x = np.where((j * 7919 + i * 104729) % 997 == 0, 1.0 + (j + i) % 5, 0)
    want, trace = stepwise(x, np.where(np.arange(n) % 3 == 0, 1.0, -1.0), 1)
    got, errors = descent.descend(p, 1, width)
    got = {r.j: r.w for r in got.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and np.allclose(errors, trace)
