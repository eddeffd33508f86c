"""The grid of row blocks against the join by columns."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import similarity
from sparkloom.operators import similarity_tiles as grid


def matrix(spark, n, values, seed):
    rng = random.Random(seed)
    cells = [(rng.randrange(25), rng.randrange(12), float(rng.choice(values))) for _ in range(n)]
    return spark.createDataFrame(cells + [(25, c, 1.0) for c in range(12)] * 2, "row bigint, col bigint, val double")


@pytest.mark.parametrize(("measure", "minsim", "values"), [("jaccard", 0.1, [1, 2, 3]), ("dot", 0.0, [-2, -1, 1, 2]), ("minmax", 0.1, [-1, 1, 2, 3]), ("cosine", 0.2, [1, 2])])
def test_grid_gives_the_same_lists(spark, measure, minsim, values):
    """Repeated cells, values below 0, ties, and with 12 cells a block a row that is in none."""
    m = matrix(spark, 120, values, 5)
    key = lambda r: (r.query, r.neighbor, round(r.sim, 9))
    for cells, rows, k in ((12, 4, -1), (grid.CELLS, grid.ROWS, -1), (12, 4, 3)):
        if measure == "cosine" and k != -1:
            continue  # ties of rounded sums
        want = similarity.neighbors(m, measure, minsim, k).collect()
        got = grid.tiled_neighbors(m, measure, minsim, k, cells, rows).collect()
        assert sorted(map(key, got)) == sorted(map(key, want))


def test_what_tiles_exchange_is_bounded(spark):
    m = spark.range(40).select(F.col("id").alias("row"), F.expr("explode(sequence(0L, 4L)) col"), F.lit(1.0).alias("val"))
    blocked = grid.row_blocks(m, "jaccard", 50, 50)
    sizes = [r["count"] for r in blocked.groupBy("block").count().collect()]
    assert len(sizes) == 4 and max(sizes) <= 50 + 5
    lists = grid.tile_lists(blocked, "jaccard", 0.5, 3, 4)
    assert lists.count() == 40 * 4 * 3 and lists.groupBy("query").count().agg(F.max("count")).first()[0] == 3 * 4


def test_empty(spark):
    assert grid.tiled_neighbors(matrix(spark, 1, [1], 1).filter("row < 0")).count() == 0
    with pytest.raises(ValueError):
        grid.tiled_neighbors(matrix(spark, 1, [1], 1), "euclid")


def test_cells_go_only_to_blocks_that_share_their_column(spark):
    """Ten parts that share no columns, a block each: a cell is sent once, not to all blocks, and the lists are the same."""
    cells = [(100 * p + r, 50 * p + (r * 7 + i * i) % 23, float(1 + (r + i) % 3)) for p in range(10) for r in range(6) for i in range(5)]
    m = spark.createDataFrame(cells, "row bigint, col bigint, val double").groupBy("row", "col").agg(F.sum("val").alias("val"))
    blocked = grid.row_blocks(m, "jaccard", 30, 30)
    assert grid.column_blocks(blocked).agg(F.sum(F.col("n") * F.size("at"))).first()[0] <= 2 * m.count()
    for measure, prefix in (("jaccard", True), ("minmax", True), ("dot", False)):
        got = grid.ranked(grid.grid_lists(m, measure, 0.3, 4, 30, 30, prefix, pays=True), 4)
        want = similarity.neighbors(m, measure, 0.3, 4, tile=similarity.TILE, prefix=False)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
