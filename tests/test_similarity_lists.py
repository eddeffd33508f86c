"""Lists of columns sent to row blocks against the join by columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import similarity
from sparkloom.operators import similarity_lists as lists
from sparkloom.operators import similarity_tiles as grid


def matrix(spark, rows, cols, n, values, seed):
    """Columns of a few cells in rows far apart, repeated cells, and one row and column of ids below 0 and beyond 32 bits; sums are exact."""
    rng = random.Random(seed)
    cells = [(rng.randrange(rows) - 3, rng.randrange(cols) - 3, float(rng.choice(values))) for _ in range(n)]
    return spark.createDataFrame(cells + [(1 << 40, c, 1.5) for c in range(-3, cols - 3)] + [(r, 1 << 41, 1 + 2.0**-25) for r in range(0, rows, 5)], "row bigint, col bigint, val double")


def blocks_of(m, measure, cells):
    blocked = grid.row_blocks(m, measure, cells, cells)
    return blocked, blocked.agg(F.max("block")).first()[0] + 1, grid.column_blocks(blocked)


@pytest.mark.parametrize(("measure", "minsim", "values", "k"), [("jaccard", 0.1, [1, 2, 3], 4), ("jaccard", 0.1, [1, 2, 3], -1), ("dot", 0.0, [-2, -1, 1, 2], -1), ("dot", 1.0, [0.5, 3], 3), ("minmax", 0.1, [-1, 1, 2, 3], 2)])
def test_lists_give_what_the_join_gives(spark, measure, minsim, values, k):
    m = matrix(spark, 60, 40, 250, values, 7)
    key = lambda r: (r.query, r.neighbor, r["rank"] if k == -1 else 0, round(r.sim, 9))
    want = sorted(map(key, similarity.neighbors(m, measure, minsim, k, tile=similarity.TILE, prefix=False).collect()))
    blocked, n, columns = blocks_of(m, measure, 50)
    assert n > 4
    for sizes in ({}, {"cells": 9, "sent": 5, "part": 20, "work": 60, "held": 7}):
        got = grid.ranked(lists.block_lists(blocked, measure, minsim, k, n, columns, **sizes), k).collect()
        assert sorted(map(key, got)) == want


def test_thin_columns_take_lists_and_send_no_more_cells_than_pairs(spark):
    """Columns whose few cells lie in as many blocks: the grid does not pay, and was left for a join that exchanges pairs."""
    m = spark.range(600).select((F.col("id") * 7 % 60).alias("row"), F.expr("id div 5").alias("col"), F.lit(1.0).alias("val"))
    blocked, n, columns = blocks_of(m, "jaccard", 20)
    told = columns.agg(F.sum(F.col("n") * (F.col("n") + 1) / 2).alias("pairs"), F.sum(F.col("n") * F.size("at")).alias("sent")).first()
    assert told.sent > told.pairs
    found = grid.grid_lists(m, "jaccard", 0.1, 5, 20, 20, pays=True)
    assert found is not None
    want = similarity.neighbors(m, "jaccard", 0.1, 5, tile=similarity.TILE, prefix=False)
    assert sorted(map(tuple, grid.ranked(found, 5).collect())) == sorted(map(tuple, want.collect()))
    cells = tuple(np.array(x) for x in zip(*blocked.select("col", F.col("block").cast("bigint"), "row", "val", "a").collect(), strict=True))
    assert sum(len(c[0]) for _, _, _, c in lists.lists_of(cells, np.ones(n, np.int64))) <= told.pairs


def test_packed_numbers_come_back():
    for x in (np.array([0, 1, 4_000_000_000]), np.array([-1, 1 << 50]), np.array([1.0, 37.0, 2.5]), np.array([0.1, np.inf, np.nan, 1e300, -0.0])):
        got = lists.unpacked(lists.packed(x), len(x), x.dtype.kind)
        assert got.dtype == x.dtype and got.tobytes() == x.tobytes()
