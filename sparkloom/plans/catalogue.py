"""The queries of the core library and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.scratch import Scratch
from sparkloom.operators import demos, descent, graph, linalg, lists, regression, similarity, similarity_tiles, sorting, sparse, vector
from sparkloom.plans.oracles import ORACLES
from sparkloom.sources import files
from sparkloom.sources import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
__all__ = ["QUERIES", "ORACLES"]
PARTS = 7


def query(name: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return add


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def over(make: Callable[[SparkSession, str], object], *steps: Callable) -> Query:
    """A query that makes its input from the tables and passes it through the steps."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = make(spark, sf_dir)
        for f in steps:
            x = f(x)
        return x

    return run


# Graphs


def sink_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return t.part_graph(spark, sf_dir, 45)


def unit_push(g: tuple[DataFrame, DataFrame]) -> DataFrame:
    """What one push of ranks 1 brings each vertex."""
    vertices, edges = g
    ranks = graph.out_degree(vertices, edges).withColumn("pr", F.lit(1.0)).filter("degree > 0")
    return graph.push(ranks, edges).groupBy("dst").agg(F.round(F.sum("share"), 6).alias("acc"))


def ranks(g: tuple[DataFrame, DataFrame]) -> DataFrame:
    # Ranks are often exact decimals that end in 5; the shift keeps both engines on one side of such ties.
    return graph.pagerank(*g).ranks.select("id", F.round(F.col("pr") + 1e-13, 9).alias("pr"))


def report(g: tuple[DataFrame, DataFrame]) -> DataFrame:
    r = graph.pagerank(*g)
    return r.ranks.agg(F.lit(r.iterations).cast("bigint").alias("iterations"), F.count("*").alias("n"))


QUERIES["graph_out_degree"] = over(sink_graph, lambda g: graph.out_degree(*g))
QUERIES["graph_out_degree_whole"] = over(t.part_graph, lambda g: graph.out_degree(*g))
QUERIES["graph_sinks"] = over(sink_graph, lambda g: graph.sinks(*g))
QUERIES["graph_push"] = over(t.part_graph, unit_push)
QUERIES["graph_reverse"] = over(t.part_graph, lambda g: graph.reverse(g[1]))
QUERIES["graph_incoming"] = over(t.part_graph, lambda g: graph.incoming(g[1], g[0].count(), PARTS))
QUERIES["graph_owner_blocks"] = over(t.part_graph, lambda g: g[0].select("id", graph.owner(g[0].count(), PARTS).alias("owner")))
QUERIES["graph_sorted_adjacency"] = over(t.part_graph, lambda g: graph.sorted_adjacency(g[1]).select("src", F.concat_ws(" ", F.col("nbrs").cast("array<string>")).alias("nbrs")))
QUERIES["graph_adjacency_blocks"] = over(t.part_graph, lambda g: lists.joined(lists.blocked_lists(g[1], "src", ["dst"]), "src").select("src", F.concat_ws(" ", F.transform("entries", lambda e: e["dst"].cast("string"))).alias("nbrs")))
QUERIES["pagerank_parts"] = over(t.part_graph, ranks)
QUERIES["pagerank_sinks"] = over(sink_graph, ranks)
QUERIES["pagerank_nation"] = over(t.nation_graph, ranks)
QUERIES["pagerank_report"] = over(t.part_graph, report)

# Sparse matrices


def entries(df: DataFrame) -> DataFrame:
    key = df.columns[0]
    other = "row" if key == "col" else "col"
    return df.select(key, F.concat_ws(" ", F.transform("entries", lambda e: F.concat_ws(":", e[other].cast("string"), e["val"].cast("bigint").cast("string")))).alias("entries"))


QUERIES["csr_stats"] = over(t.purchases, sparse.stats)
QUERIES["csr_compact_columns"] = over(t.purchases, lambda m: sparse.compact_columns(m.filter("val >= 60")))
QUERIES["csr_column_map"] = over(t.purchases, lambda m: sparse.column_map(m.filter("val >= 60")))
QUERIES["csr_compact_columns_whole"] = over(t.purchases, sparse.compact_columns)
QUERIES["csr_column_map_whole"] = over(t.purchases, sparse.column_map)
QUERIES["csr_row_sqnorms"] = over(t.purchases, sparse.squared_norms)
QUERIES["csr_col_sqnorms"] = over(t.purchases, lambda m: sparse.squared_norms(m, "col"))
QUERIES["csr_binary_norms"] = over(t.purchases, lambda m: sparse.squared_norms(m, "row", binary=True))
for _what in ("row", "col"):
    for _norm in (1, 2):
        QUERIES[f"csr_normalize_{_what}_l{_norm}"] = over(t.purchases, lambda m, w=_what, n=_norm: rounded(sparse.normalize(m, w, n), 9, "val"))
QUERIES["csr_normalize_both_l2"] = over(t.purchases, lambda m: rounded(sparse.normalize(m, "both", 2), 9, "val"))
QUERIES["csr_normalize_both_l1"] = over(t.purchases, lambda m: rounded(sparse.normalize(m, "both", 1), 9, "val"))
QUERIES["csr_inverted_index"] = over(t.purchases, sparse.inverted_index, entries)
QUERIES["csr_row_index"] = over(t.purchases, lambda m: sparse.inverted_index(m, "row"), entries)
QUERIES["csr_inverted_index_blocks"] = over(t.purchases, lambda m: lists.joined(lists.blocked_lists(m, "col", ["row", "val"]), "col"), entries)
QUERIES["csr_row_index_blocks"] = over(t.purchases, lambda m: lists.joined(lists.blocked_lists(m, "row", ["col", "val"]), "row"), entries)
QUERIES["csr_pointers"] = over(t.purchases, sparse.pointers)
QUERIES["csr_slice_rows"] = over(t.purchases, lambda m: sparse.extract_rows(m, 100, 300))

# Similarity

QUERIES["knn_jaccard"] = over(t.purchases, lambda m: similarity.neighbors(m, "jaccard", 0.05, 10))
QUERIES["knn_dot"] = over(t.purchases, lambda m: similarity.neighbors(m, "dot", 400, 10))
QUERIES["knn_cosine"] = over(t.purchases, lambda m: rounded(similarity.neighbors(m, "cosine", 0.1, -1), 6, "sim").drop("rank"))
QUERIES["knn_minmax"] = over(t.purchases, lambda m: similarity.neighbors(m, "minmax", 0.05, 10))
QUERIES["knn_close"] = over(t.purchases, lambda m: similarity.neighbors(m, "jaccard", 0.4, 10, prefix=True))
QUERIES["knn_grid"] = over(t.purchases, lambda m: similarity_tiles.tiled_neighbors(m, "jaccard", 0.05, 10))
QUERIES["knn_grid_minmax"] = over(t.purchases, lambda m: similarity_tiles.tiled_neighbors(m, "minmax", 0.05, 10))
QUERIES["knn_all"] = over(t.purchases, lambda m: similarity.neighbors(m, "jaccard", 0.05, -1))


@query("knn_query")
def knn_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers most like the first one."""
    m = t.purchases(spark, sf_dir)
    first = m.agg(F.min("row")).first()[0]
    return similarity.similar_rows(m, m.filter(F.col("row") == first).select("col", "val"), "jaccard", 0.02, 20)


# Sorting


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("value"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("key"), F.col("o_orderkey").alias("val"))


def orders_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t.table(spark, sf_dir, "orders")
    at = sparse.prefix_sum(o.select("o_orderkey", "o_custkey", F.lit(1).alias("one")), "o_orderkey", "one")
    return at.select(F.col("before").alias("pos"), F.col("o_custkey").alias("value"))


QUERIES["sort_keys"] = over(keys, sorting.positions)
QUERIES["sort_values"] = over(keys, sorting.sort_keys)
QUERIES["sort_locally"] = over(keys, sorting.sort_locally)
QUERIES["sort_balanced_blocks"] = over(keys, lambda k: sorting.redistributed(sorting.balanced_blocks(k, PARTS), PARTS), lambda b: b.withColumn("block", F.spark_partition_id().cast("bigint")))
QUERIES["sort_pivot"] = over(keys, sorting.pivot)
QUERIES["sort_pivot_split"] = over(keys, lambda k: sorting.pivot_split(k, PARTS))
QUERIES["sort_check"] = over(keys, sorting.positions, sorting.count_violations)
QUERIES["sort_check_input"] = over(orders_by_key, sorting.count_violations)
QUERIES["prefix_scan"] = over(lambda s, d: t.table(s, d, "orders").select("o_orderkey", "o_custkey"), lambda o: sparse.prefix_sum(o, "o_orderkey", "o_custkey").select("o_orderkey", "before"))
QUERIES["kv_sort_desc"] = over(pairs, sorting.kv_sort_desc)
QUERIES["kv_topk"] = over(pairs, lambda p: sorting.kv_topk(p, 25))
QUERIES["time_span"] = over(lambda s, d: t.table(s, d, "lineitem").select(F.to_date("l_shipdate").alias("day")), lambda x: sorting.time_span(x, "day", "day"))

# Vectors


def order_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, x, y: prices in order of key, and rounded."""
    o = t.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.lit(1).alias("one"))
    return sparse.prefix_sum(o, "o_orderkey", "one").select(F.col("before").alias("i"), F.col("o_totalprice").alias("x"), F.round("o_totalprice").alias("y"))


def y_as_x(v: DataFrame) -> DataFrame:
    return v.select("i", F.col("y").alias("x"), "y")


QUERIES["vec_sum"] = over(order_vector, lambda v: rounded(vector.vsum(v, 3), 2, "sum"))
QUERIES["vec_dot"] = over(order_vector, y_as_x, vector.dot)
QUERIES["vec_norm2"] = over(order_vector, y_as_x, lambda v: rounded(vector.norm2(v), 6, "norm"))
QUERIES["vec_scale"] = over(order_vector, y_as_x, lambda v: vector.scale(v, 2.5))
QUERIES["vec_axpy"] = over(order_vector, lambda v: vector.axpy(v, 0.5))
QUERIES["vec_max"] = over(order_vector, vector.vmax)
QUERIES["vec_min"] = over(order_vector, vector.vmin)
QUERIES["vec_argmax"] = over(order_vector, vector.argmax)
QUERIES["vec_argmin"] = over(order_vector, vector.argmin)
QUERIES["vec_argmax_n"] = over(order_vector, lambda v: vector.argmax_n(v, 7))
QUERIES["vec_clamp"] = over(order_vector, lambda v: vector.clamp(v, 1000.0, 100000.0))
QUERIES["vec_incset"] = lambda spark, sf_dir: vector.incset(spark, 1000, 5.0)
QUERIES["vec_fill"] = lambda spark, sf_dir: vector.copy(vector.fill(spark, 1000, 7.5))
QUERIES["vec_fill2d"] = lambda spark, sf_dir: vector.fill2d(spark, 20, 30, 2.0).select("i", F.posexplode("row").alias("j", "x")).withColumn("j", F.col("j").cast("bigint"))

# Regression

HALVES = [0.5] * 64
QUERIES["lc_nonzero_columns"] = over(t.points, regression.nonzero_columns)
QUERIES["lc_denominators"] = over(t.points, lambda p: rounded(regression.denominators(p), 6, "denominator"))
QUERIES["lc_mat_vec"] = over(t.points, lambda p: rounded(regression.mat_vec(p, HALVES), 6, "xw"))
QUERIES["lc_squared_error"] = over(t.points, lambda p: rounded(regression.squared_error(p, HALVES), 4, "error"))
QUERIES["lc_weights"] = over(t.points, lambda p: rounded(regression.weights(p, 2), 6, "w"))
QUERIES["lc_weights_residual"] = over(t.points, lambda p: rounded(descent.descend(p, 2)[0], 6, "w"))
QUERIES["lc_error_trace_residual"] = over(t.points, lambda p: rounded(descent.error_trace(p, 2), 4, "error"))
QUERIES["lc_error_trace"] = over(t.points, lambda p: rounded(regression.error_trace(p, 2), 4, "error"))

# Dense matrices


def region_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("i"), (F.col("r_regionkey") + 1).cast("bigint").alias("v"))


@query("mat_vec")
def mat_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region matrix times (1, 2, ...)."""
    return linalg.mat_vec(t.region_matrix(spark, sf_dir), region_vector(spark, sf_dir))


@query("mat_mat")
def mat_mat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region matrix squared."""
    m = t.region_matrix(spark, sf_dir)
    return linalg.mat_mat(m, m)


@query("mat_mat_purchases")
def mat_mat_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The purchase matrix by its transpose."""
    m = t.purchases(spark, sf_dir).toDF("i", "j", "v")
    return linalg.mat_mat(m, m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))


@query("gauss_upper")
def gauss_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[U | y] of the region matrix, made diagonally dominant, and (1, 2, ...)."""
    m = t.region_matrix(spark, sf_dir)
    big = m.agg((F.max("v") * F.count_distinct("i")).alias("d"))
    a = m.join(F.broadcast(big)).select("i", "j", (F.col("v") + F.when(F.col("i") == F.col("j"), F.col("d")).otherwise(0)).alias("v"))
    return rounded(linalg.eliminate(a, region_vector(spark, sf_dir)), 9, "v")


# Tutorials

QUERIES["demo_dot_partials"] = lambda spark, sf_dir: demos.dot_partials(demos.ones(spark))
QUERIES["demo_dot_total"] = lambda spark, sf_dir: demos.dot_total(demos.ones(spark))
QUERIES["demo_trig"] = lambda spark, sf_dir: rounded(demos.trig_sums(spark, 15, 1000), 4, "total")
QUERIES["demo_threshold"] = lambda spark, sf_dir: demos.threshold_trigger(spark.range(20).select(F.col("id").alias("n")))
QUERIES["demo_fill"] = lambda spark, sf_dir: rounded(demos.matrix_fill(spark), 6, "v")

# Text formats: tables written as text into the shared folder and read again


def text_folder(spark: SparkSession, name: str) -> str:
    return Scratch(spark, f"text-{name}").folder + "/text"


@query("file_csr")
def file_csr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The purchase matrix, written as lines of columns and values and read again."""
    m, path = t.purchases(spark, sf_dir), text_folder(spark, "csr")
    cells = m.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "val"))).alias("c"))
    last = m.agg(F.max("row")).first()[0]
    text = F.concat_ws(" ", F.transform(F.coalesce("c", F.array()), lambda e: F.concat_ws(" ", e["col"].cast("string"), e["val"].cast("string"))))
    files.write_lines(spark.range(last + 1).toDF("row").join(cells, "row", "left").orderBy("row").select(text.alias("value")), path)
    return files.read_csr(spark, path)


@query("file_adjacency")
def file_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part graph, written as an adjacency list and read again, with the multiplicity of its edges."""
    (vertices, edges), path = t.part_graph(spark, sf_dir), text_folder(spark, "adjacency")
    n = vertices.agg(F.max("id")).first()[0] + 1
    lists = edges.groupBy("src").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list("dst")), lambda x: (x + 1).cast("string"))).alias("value"))
    body = spark.range(n).toDF("src").join(lists, "src", "left").select("src", F.coalesce("value", F.lit("")).alias("value"))
    head = spark.createDataFrame([(-1, f"{n} {edges.count()}")], "src bigint, value string")
    files.write_lines(head.unionByName(body).orderBy("src").select("value"), path)
    return files.read_adjacency(spark, path)[1].groupBy("src", "dst").agg(F.count("*").alias("n_edges"))


@query("file_points")
def file_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and labels, written as text and read again; weights of the first coordinate's sign, and the label."""
    p = sparse.prefix_sum(t.points(spark, sf_dir).withColumn("one", F.lit(1)), "id", "one").select("before", "features", "label")
    n, d = p.agg(F.count("*"), F.max(F.size("features"))).first()
    where = {name: text_folder(spark, name) for name in ("points", "labels")}
    head = lambda text: spark.createDataFrame([(-1, text)], "before bigint, value string")
    rows = p.select("before", F.concat_ws(" ", F.transform("features", lambda x: x.cast("string"))).alias("value"))
    for name, first, body in (("points", f"{n} {d}", rows), ("labels", f"{n}", p.select("before", F.col("label").cast("string").alias("value")))):
        files.write_lines(head(first).unionByName(body).orderBy("before").select("value"), where[name])
    got = files.read_points(spark, where["points"], where["labels"])
    return got.select("id", F.posexplode("features").alias("j", "x"), "label").withColumn("j", F.col("j").cast("bigint"))


def written(write: Callable[[DataFrame, str], None], name: str) -> Callable[[DataFrame], DataFrame]:
    """line, value: what a writer made of a table."""

    def run(df: DataFrame) -> DataFrame:
        path = text_folder(df.sparkSession, name)
        write(df, path)
        return files.lines(df.sparkSession, path).select("line", F.concat_ws(" ", "tokens").alias("value"))

    return run


QUERIES["file_keys"] = over(keys, written(files.write_keys, "keys"))
QUERIES["file_ranks"] = over(t.nation_graph, lambda g: graph.pagerank(*g).ranks, written(files.write_ranks, "ranks"))
QUERIES["file_neighbors"] = over(t.purchases, lambda m: similarity.neighbors(m, "dot", 400, 10), written(files.write_neighbors, "neighbors"))


@query("file_stats")
def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, tokens and bytes of the file of sorted keys."""
    path = text_folder(spark, "stats")
    files.write_keys(keys(spark, sf_dir), path)
    return files.file_stats(spark, path)
