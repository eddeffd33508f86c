"""Queries that take whole tables, over small tables with gaps."""

import pytest

from sparkloom.plans.catalogue import QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two orders; parts 3, 5, 8 and 20 are bought, in small and large quantities."""
    folder = str(tmp_path_factory.mktemp("whole"))
    lines = [(1, 1, 20, 1, 1.0), (1, 2, 5, 1, 2.0), (2, 1, 5, 1, 61.0), (2, 2, 3, 1, 45.0), (2, 3, 8, 1, 10.0)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(1, 7), (2, 9)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(i,) for i in (3, 5, 8, 9, 20)], "p_partkey bigint").write.parquet(f"{folder}/part.parquet")
    return folder


def test_columns_of_the_whole_matrix(spark, tables):
    cells = QUERIES["csr_compact_columns_whole"](spark, tables).select("row", "col", "val").collect()
    assert sorted(map(tuple, cells)) == [(7, 1, 2.0), (7, 3, 1.0), (9, 0, 45.0), (9, 1, 61.0), (9, 2, 10.0)]
    assert sorted(map(tuple, QUERIES["csr_column_map_whole"](spark, tables).collect())) == [(3, 0), (5, 1), (8, 2), (20, 3)]


def test_degrees_of_the_whole_graph(spark, tables):
    got = QUERIES["graph_out_degree_whole"](spark, tables).select("id", "degree").collect()
    assert sorted(map(tuple, got)) == [(3, 1), (5, 1), (8, 0), (9, 0), (20, 1)]
