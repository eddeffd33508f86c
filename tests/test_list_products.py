"""Products of blocks of rows that are sent packed lists."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.scratch import Scratch
from sparkloom.operators import linalg


def thin(spark):
    """600 rows of 8 cells; columns of 8 cells in rows far apart."""
    return spark.range(4800).select((F.col("id") * 7 % 600).alias("row"), F.expr("id div 8").alias("col"), (1.0 + F.col("id") % 3).alias("val"))


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_products_by_lists(spark, kind):
    """Rows of one matrix and of another, sums of 0, what has no partner, numbers that only whole ones hold."""
    rng = random.Random(3)
    cells = lambda n, big: list({(rng.randrange(30), rng.randrange(25) - 2): rng.choice([-2, 2, 3, big]) for _ in range(n)}.items())
    frame = lambda c: spark.createDataFrame([(*k, v) for k, v in c], "i bigint, j bigint, v bigint").withColumn("v", F.col("v").cast(kind))
    a, b = frame(cells(200, 2**40 + 1 if kind == "bigint" else 7)), frame(cells(150, 2**20 + 1))
    want = a.join(b.toDF("j", "k", "w"), "j").groupBy("i", "k").agg(F.sum(F.col("v") * F.col("w"))).collect()
    for sizes in ({}, {"work": 30, "size": 10}):
        got = linalg.list_product(a, b, kind, Scratch(spark, "test"), **sizes)
        assert got.schema["v"].dataType.simpleString() == kind
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))


def test_a_product_of_short_rows_in_many_blocks_sends_lists(spark):
    """Such cells were sent one by one to every pair of blocks that share an inner index."""
    m = thin(spark).toDF("i", "j", "v")
    t = m.selectExpr("j i", "i j", "v")
    assert linalg.lists_pay(m, t, 50, 100)
    long = spark.range(4800).select((F.col("id") % 100).alias("i"), F.expr("id div 100").alias("j"), F.lit(1.0).alias("v"))
    assert not linalg.lists_pay(long, long.selectExpr("j i", "i j", "v"))
