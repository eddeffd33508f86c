"""Tiled products and elimination against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import linalg

MATRIX = "i bigint, j bigint, v {}"


def cells(spark, m, kind="double"):
    return spark.createDataFrame([(i, j, v.item()) for (i, j), v in np.ndenumerate(m)], MATRIX.format(kind))


def test_product_of_sparse_tiles(spark):
    rng = np.random.default_rng(1)

    def some(rows, cols, n):
        at = [(int(rng.integers(rows)), int(rng.integers(cols)), int(rng.integers(-3, 4))) for _ in range(n)]
        return at + [(0, 0, 2**30 + 1), (None, 1, 1), (1, None, 1), (1, 1, None)]

    a, b = some(23, 31, 90), some(31, 19, 90)
    want = {}
    for i, k, x in a:
        for l, j, y in b:
            if None not in (i, k, x, l, j, y) and k == l:
                want[i, j] = want.get((i, j), 0) + x * y
    assert 0 in want.values()
    frames = [spark.createDataFrame(m, MATRIX.format("bigint")) for m in (a, b)]
    for side, together in ((4, 2), (7, 1), (256, 4)):
        got = linalg.mat_mat(*frames, side=side, together=together)
        assert {(r.i, r.j): r.v for r in got.collect()} == want
    assert linalg.mat_mat(frames[0].filter("false"), frames[1]).count() == 0


def test_product_is_exact_beyond_doubles(spark):
    a = spark.createDataFrame([(0, 0, 2**31 + 1), (0, 1, 1)], MATRIX.format("bigint"))
    b = spark.createDataFrame([(0, 0, 2**31 - 1), (1, 0, 3)], MATRIX.format("bigint"))
    assert linalg.mat_mat(a, b).first().v == 2**62 + 2
    with pytest.raises(Exception, match="too large"):
        linalg.mat_mat(a, b.withColumn("v", F.col("v") * 4)).collect()


def test_a_hot_inner_block_is_many_groups(spark):
    """All cells of one inner column: groups grow with the rows and columns, so none holds the product."""
    a = spark.range(64).select(F.col("id").alias("i"), F.lit(0).cast("bigint").alias("j"), F.lit(1).cast("bigint").alias("v"))
    got = linalg.mat_mat(a, a.selectExpr("j i", "i j", "v"), side=4, together=2)
    assert got.count() == 64 * 64 and got.agg(F.sum("v")).first()[0] == 64 * 64


def eliminated(x):
    for k in range(len(x)):
        x[k] /= x[k, k]
        x[k + 1 :] -= np.outer(x[k + 1 :, k], x[k])
    return x


def test_elimination_by_tiles(spark):
    rng = np.random.default_rng(2)
    for n, side in ((37, 8), (16, 8), (3, 8), (1, 1)):
        a, b = rng.normal(size=(n, n)) + n * np.eye(n), rng.normal(size=n)
        y = spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "i bigint, v double")
        got = linalg.eliminate(cells(spark, a).filter(F.col("v") != 0), y, side).collect()
        want = np.triu(eliminated(np.c_[a, b]))
        assert len(got) == n * (n + 1)
        assert all(abs(r.v - want[r.i, r.j]) < 1e-9 for r in got)


def test_elimination_with_absent_cells_and_a_zero_pivot(spark):
    a = spark.createDataFrame([(0, 0, 2.0), (1, 1, 0.0), (2, 2, 1.0), (2, 0, 1.0), (9, 9, 5.0)], MATRIX.format("double"))
    b = spark.createDataFrame([(0, 4.0), (1, 1.0), (2, 1.0)], "i bigint, v double")
    for side in (1, 2, 256):
        got = {(r.i, r.j): r.v for r in linalg.eliminate(a, b, side).collect()}
        assert [got[0, j] for j in range(4)] == [1, 0, 0, 2]
        assert [got[1, j] for j in range(4)] == [0, None, None, None] and [got[2, j] for j in range(4)] == [0, 0, None, None]
    assert linalg.eliminate(a, b.filter("false")).count() == 0


def test_elimination_of_two_thousand_unknowns(spark):
    """No row or task holds the four million cells; U x = y for the x that solves A x = b."""
    n = 2000
    a = spark.range(n * n, numPartitions=8).selectExpr(f"id div {n} i", f"id % {n} j").selectExpr("i", "j", f"pmod(i * 31 + j * j * 17 + i * j, 101) / 101d + if(i = j, {n}d, 0d) v")
    i, j = np.mgrid[:n, :n]
    dense, b = (i * 31 + j * j * 17 + i * j) % 101 / 101 + n * np.eye(n), np.arange(n) % 7 - 3.0
    x = np.linalg.solve(dense, b)
    done = linalg.eliminate(a, spark.range(n).selectExpr("id i", "id % 7 - 3d v"), 512)
    known = spark.createDataFrame([*enumerate(map(float, x)), (n, -1.0)], "i bigint, v double")
    off = linalg.mat_vec(done, known).agg(F.count("*"), F.max(F.abs("v"))).first()
    assert off[0] == n and off[1] < 1e-9


def test_cells_of_a_sparse_product_are_sent_and_multiplied_as_cells(spark, tmp_path):
    """Cells far from each other share no tile; each goes to one block that has its inner index, not to all."""
    m = spark.range(3000).select((F.col("id") * 1000).alias("i"), (F.col("id") * 700).alias("j"), F.lit(2).cast("bigint").alias("v"))
    t = m.selectExpr("j i", "i j", "v")
    met, blocks, parts = linalg.meetings(m, t, linalg.Scratch(spark, "test"), 300, 300)
    assert (blocks, parts, met.count()) == (10, 1, 2 * 3000) and met.select("gi", "gj").distinct().count() == 10
    got = linalg.mat_mat(m, t)
    assert got.count() == 3000 and got.filter("i = j and v = 4").count() == 3000


def test_sparse_product_of_long_rows_and_small_blocks(spark):
    rng = np.random.default_rng(5)
    x, y = (rng.integers(-2, 3, s) * (rng.random(s) < 0.3) for s in ((17, 40), (40, 23)))
    x[3] = 1
    some = lambda m, kind: spark.createDataFrame([(int(i), int(j), m[i, j].item() if kind == "bigint" else float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], MATRIX.format(kind))
    want = {(i, j): v for (i, j), v in np.ndenumerate(x @ y) if (x[i] * y[:, j]).any()}
    for kind in ("bigint", "double"):
        for rows, cells in ((3, 9), (1000, 1000)):
            a, b = some(x, kind), some(y, kind)
            got = linalg.sparse_product(a, b, kind, linalg.Scratch(spark, "test"), rows, cells).collect()
            assert {(r.i, r.j): r.v for r in got} == want and len(got) == len(want)
    parts = [p for held in (1, 100, 10**6) for p in [list(linalg.multiplied(*np.nonzero(x), x[x != 0], np.nonzero(y)[1], np.nonzero(y)[0], y[y != 0], True, held))]]
    assert len(parts[0]) > len(parts[1]) > len(parts[2]) == 1
    assert all({(i, j): v for p in ps for i, j, v in zip(*p, strict=True)} == want for ps in parts)


@pytest.mark.parametrize("full", [0.0, 1.0])
def test_infinite_cells_meet_only_cells_that_are_there(spark, full):
    a = spark.createDataFrame([(0, 0, float("inf")), (0, 1, 1.0)], MATRIX.format("double"))
    b = spark.createDataFrame([(0, 0, 2.0), (1, 0, 3.0), (1, 1, 5.0)], MATRIX.format("double"))
    got = linalg.mat_mat(a, b, full=full).collect()
    assert sorted(map(tuple, got)) == [(0, 0, float("inf")), (0, 1, 5.0)]
