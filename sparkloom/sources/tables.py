"""Graphs, sparse and dense matrices derived from the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse customer x part matrix of quantities: row, col, val."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return line.join(order, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("row"), F.col("l_partkey").alias("col")).agg(F.sum("l_quantity").alias("val"))


def part_graph(spark: SparkSession, sf_dir: str, least: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices are parts; an edge leads from a line's part to that of the order's next line."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    if least is not None:
        line = line.filter(F.col("l_quantity") >= least)
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    edges = line.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).filter("dst is not null")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), edges


def nation_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vertices are nations; an edge for each line, from the customer's nation to the supplier's."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("src"))
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("dst"))
    edges = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id")), edges.select("src", "dst")


def points(spark: SparkSession, sf_dir: str, positive: int = 3) -> DataFrame:
    """Dense points with +-1 labels: id, features, label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), F.when(F.col("label") == positive, 1.0).otherwise(-1.0).alias("label"))


def region_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines by customer region i and supplier region j: i, j, v; absent cells are 0."""
    _, edges = nation_graph(spark, sf_dir)
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("n"), F.col("n_regionkey").cast("bigint").alias("r"))
    side = lambda name, to: nation.select(F.col("n").alias(name), F.col("r").alias(to))
    cells = edges.join(side("src", "i"), "src").join(side("dst", "j"), "dst").groupBy("i", "j").agg(F.count("*").alias("v"))
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("i"))
    grid = regions.withColumn("all", F.lit(1)).join(regions.select(F.col("i").alias("j"), F.lit(1).alias("all")), "all").select("i", "j")
    return grid.join(cells, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0)).cast("bigint").alias("v"))
