"""Blocks of sorted lists."""

from pyspark.sql import functions as F

from sparkloom.operators import lists


def test_blocks_join_to_the_lists(spark):
    import random

    rng = random.Random(4)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([*range(12), None]), rng.choice([0.5, 1.5])) for _ in range(300)]
    m = spark.createDataFrame(rows, "col bigint, row bigint, val double")
    first = lambda r: (r[0] is not None, r[0] or 0, r[1])
    want = {c: sorted([(r, v) for k, r, v in rows if k == c], key=first) for c in (1, 2, 3, None)}
    for size, parts in ((1, 3), (4, 1), (4, 5), (4096, None)):
        blocks = lists.blocked_lists(m, "col", ["row", "val"], size, parts)
        assert {r.col: [tuple(e) for e in r.entries] for r in lists.joined(blocks, "col").collect()} == want
        for b in blocks.collect():
            assert 1 <= len(b.entries) <= size and b.n == sum(e.times for e in b.entries)
            assert (b.first, b.last) == (b.entries[0].row, b.entries[-1].row)


def test_hot_key_is_many_rows_in_many_tasks(spark):
    edges = spark.range(30000).selectExpr("if(id % 3 = 0, 7, id) src", "id dst")
    blocks = lists.blocked_lists(edges, "src", ["dst"], 100, 8).withColumn("task", F.spark_partition_id())
    hot = blocks.filter("src = 7 and n > 0").agg(F.count("*"), F.count_distinct("task"), F.sum("n"), F.max("n")).first()
    assert hot[0] >= 100 and hot[1] >= 2 and hot[2] == 10001 and hot[3] <= 100


def test_equal_rows_are_one_entry(spark):
    edges = spark.range(5000).selectExpr("1L src", "2L dst")
    assert [(r.n, len(r.entries)) for r in lists.blocked_lists(edges, "src", ["dst"], 10).collect()] == [(5000, 1)]
    assert lists.blocked_lists(edges.filter("false"), "src", ["dst"]).count() == 0


def test_ranges_grow_with_the_input(spark, monkeypatch):
    """Not the session's 8 partitions: as many ranges as rows ask for, each of bounded rows."""
    monkeypatch.setattr(lists, "ROWS_EACH", 1000)
    edges = spark.range(30000).selectExpr("id % 50 src", "id dst")
    blocks = lists.blocked_lists(edges, "src", ["dst"], 100).withColumn("task", F.spark_partition_id())
    sizes = [r["n"] for r in blocks.groupBy("task").agg(F.sum("n").alias("n")).collect()]
    assert sum(sizes) == 30000 and len(sizes) >= 25 and max(sizes) <= 3000
