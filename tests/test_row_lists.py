"""Row blocks that are sent packed lists of their columns against the join by columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions.scratch import Scratch
from sparkloom.operators import row_lists, similarity
from sparkloom.operators import similarity_tiles as grid


def matrix(spark, rows, cols, n, values, seed):
    """Rows that share columns with rows far apart, repeated cells, ids below 0 and beyond 32 bits; sums are exact."""
    rng = random.Random(seed)
    cells = [(rng.randrange(rows) - 3, rng.randrange(cols) - 3, float(rng.choice(values))) for _ in range(n)]
    return spark.createDataFrame(cells + [(1 << 60, c, 1.5) for c in range(-3, cols - 3)] + [(r, 1 << 41, 1 + 2.0**-25) for r in range(0, rows, 5)], "row bigint, col bigint, val double")


@pytest.mark.parametrize(("measure", "minsim", "values", "k"), [("jaccard", 0.1, [1, 2, 3], 4), ("dot", 0.0, [-2, -1, 1, 2], -1), ("dot", 1.0, [0.5, 3], 3), ("minmax", 0.1, [-1, 1, 2, 3], 2), ("cosine", 0.2, [1, 2], -1)])
def test_rows_are_finished_as_by_the_join(spark, measure, minsim, values, k):
    """In blocks of a row or a few, in one pass and in several."""
    m = matrix(spark, 60, 40, 250, values, 7)
    key = lambda r: (r.query, r.neighbor, r["rank"] if measure != "cosine" else 0, round(r.sim, 9))
    want = sorted(map(key, similarity.neighbors(m, measure, minsim, k, tile=similarity.TILE, prefix=False).collect()))
    for sizes in ({}, {"work": 40, "most": 900, "size": 20}):
        got = row_lists.neighbor_lists(m, measure, minsim, k, **sizes).collect()
        assert sorted(map(key, got)) == want


def thin(spark):
    """600 rows of 8 cells; columns of 8 cells in rows far apart."""
    return spark.range(4800).select((F.col("id") * 7 % 600).alias("row"), F.expr("id div 8").alias("col"), (1.0 + F.col("id") % 3).alias("val"))


def test_large_matrices_of_short_columns_take_lists(spark, monkeypatch):
    """Their cells were sent to a tile for each two blocks, or lists of neighbours of every block merged."""
    m = thin(spark)
    want = sorted(map(tuple, similarity.neighbors(m, "dot", 2.0, 3, tile=similarity.TILE, prefix=False).collect()))
    for name in ("grid_lists", "tile_lists"):
        monkeypatch.setattr(grid, name, None)
    monkeypatch.setattr(grid, "CELLS", 100)
    assert sorted(map(tuple, similarity.neighbors(m, "dot", 2.0, 3).collect())) == want
    assert sorted(map(tuple, grid.tiled_neighbors(m, "dot", 2.0, 3, 100, 100).collect())) == want


def test_a_row_that_meets_too_much_is_left_to_tiles(spark, monkeypatch):
    monkeypatch.setattr(row_lists, "ROW", 10)
    assert row_lists.neighbor_lists(thin(spark), "dot", 2.0, 3) is None
    assert not row_lists.pays(spark.range(5).select(F.lit(1000).alias("n")), 5000, 2500)
    assert row_lists.neighbor_lists(thin(spark).filter("row < 0"), "jaccard", 0.1, 3).count() == 0


def test_shuffles_of_a_pass_are_gone_before_the_next(spark, monkeypatch):
    """With several passes each is a table of its own; with one the result is lazy."""
    saved = []
    save = Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df: saved.append(df.columns) or save(self, df))
    few = row_lists.neighbor_lists(thin(spark), "dot", 2.0, 3)
    assert ["query", "neighbor", "rank", "sim"] not in saved
    many = row_lists.neighbor_lists(thin(spark), "dot", 2.0, 3, work=200, most=5000)
    assert saved.count(["query", "neighbor", "rank", "sim"]) > 3
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))


def test_packed_numbers_come_back():
    for x in (np.array([0, 1, 4_000_000_000]), np.array([-1, 1 << 50, -(1 << 63)]), np.array([1.0, 37.0, -2.0]), np.array([0.1, np.inf, np.nan, 1e300]), np.zeros(0), np.zeros(0, np.int64)):
        for deltas in {False, x.dtype.kind == "i"}:
            got = row_lists.unpacked(row_lists.packed(x, deltas), len(x), deltas)
            assert got.dtype == x.dtype and got.tobytes() == x.tobytes()


def test_the_best_are_kept_by_exact_values():
    """Similarities that are the same in 32 bits, ties, values below 0."""
    rng = np.random.default_rng(1)
    query, other = np.repeat(np.arange(4), 50), np.tile(np.arange(50), 4)
    sim = 1 + rng.integers(-9, 9, 200) * 1e-12 * rng.choice([1.0, -1e13], 200)
    want = [(q, int(o), r + 1, float(x)) for q in range(4) for r, (x, o) in enumerate(sorted(zip(-sim[query == q], other[query == q], strict=True))[:7]) for x in [-x]]
    assert [(int(q), int(o), int(r), float(x)) for q, o, r, x in zip(*row_lists.ranked(query, other, sim, 7), strict=True)] == want
