"""Golden values and edge cases of operators that take no file."""

import re

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import demos, graph, linalg, regression, similarity, sorting, sparse, vector
from sparkloom.streaming.trigger import running_count


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_products(spark):
    a = df(spark, [(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 4)], "i bigint, j bigint, v bigint")
    x = df(spark, [(0, 5), (1, 6)], "i bigint, v bigint")
    assert sorted(map(tuple, linalg.mat_vec(a, x).collect())) == [(0, 17), (1, 39)]
    b = df(spark, [(0, 0, 5), (0, 1, 6), (1, 0, 7), (1, 1, 8)], "i bigint, j bigint, v bigint")
    assert sorted(map(tuple, linalg.mat_mat(a, b).collect())) == [(0, 0, 19), (0, 1, 22), (1, 0, 43), (1, 1, 50)]


def test_elimination(spark):
    a = df(spark, [(i, j, float(v)) for i, r in enumerate([[4, 2, 1], [2, 5, 3], [1, 3, 6]]) for j, v in enumerate(r)], "i bigint, j bigint, v double")
    b = df(spark, [(0, 7.0), (1, 10.0), (2, 10.0)], "i bigint, v double")
    got = {(r.i, r.j): r.v for r in linalg.eliminate(a, b).collect()}
    want = [[1, 0.5, 0.25, 1.75], [0, 1, 0.625, 1.625], [0, 0, 1, 1]]
    assert all(abs(got[i, j] - want[i][j]) < 1e-12 for i in range(3) for j in range(4))


LC1 = [(0, [1.0, 0.0, 0.0, 0.0, 0.0], 1.0), (1, [0.0, 0.0, 1.0, 0.0, 0.0], 1.0), (2, [0.0, 0.0, 0.0, 0.0, 1.0], -1.0)]


def test_descent(spark):
    p = df(spark, LC1, "id bigint, features array<double>, label double")
    f = regression.fit(p, 1)
    assert f.columns.tolist() == [0, 2, 4] and f.weights.tolist() == [1, 1, -1] and f.errors == [3, 0]
    assert [tuple(r) for r in regression.nonzero_columns(p).orderBy("j").collect()] == [(0, 0), (2, 1), (4, 2)]
    assert regression.error_trace(p.filter("false"), 1).count() == 2


def test_descent_against_normal_equations(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(200, 3)), rng.choice([-1.0, 1.0], 200)
    p = df(spark, [(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id bigint, features array<double>, label double")
    f = regression.fit(p, 40)
    assert np.allclose(f.weights, np.linalg.lstsq(x, y, rcond=None)[0]) and all(b <= a + 1e-9 for a, b in zip(f.errors[:-1], f.errors[1:], strict=True))
    w = f.weights.tolist()
    assert abs(regression.squared_error(p, w).first().error - f.errors[-1]) < 1e-8


def test_sorting_edge_cases(spark):
    same = spark.range(25).select(F.lit(7).cast("bigint").alias("value"))
    got = sorting.balanced_blocks(same, 4)
    assert sorted(r.pos for r in got.collect()) == list(range(25))
    assert {r.block: r["count"] for r in got.groupBy("block").count().collect()} == {0: 6, 1: 6, 2: 6, 3: 7}
    assert sorting.pivot(spark.createDataFrame([(1,), (4,)], "value bigint")).first().pivot == 2
    assert sorting.positions(same.limit(0)).count() == 0
    assert sorting.kv_topk(spark.createDataFrame([(1.0, 2), (3.0, 4)], "key double, val bigint"), 9).count() == 2
    assert [r.value for r in sorting.sort_locally(same.limit(2)).collect()] == [7, 7]
    assert sorting.approximate_pivot(same).first().pivot == 7
    keys = sorting.random_keys(spark, 1000, 4)
    assert sorting.count_violations(sorting.positions(keys)).first().n_bad == 0
    assert keys.agg(F.min("value")).first()[0] >= 0


def test_split_rule(spark):
    row = spark.range(1).select(*[sorting.process_split(F.lit(a), F.lit(b), 8).alias(f"c{a}") for a, b in ((1, 99), (50, 50), (60, 40))]).first()
    assert tuple(row) == (1, 4, 4)


def test_similarity_edge_cases(spark):
    m = df(spark, [(0, 0, 0.0), (1, 0, 0.0), (2, 1, -1.0), (3, 1, 2.0)], "row bigint, col bigint, val double")
    assert {(r.query, r.neighbor) for r in similarity.neighbors(m, "jaccard", 0.0, -1).collect()} == {(2, 2), (3, 3)}
    assert (2, 3) not in {(r.query, r.neighbor) for r in similarity.neighbors(m, "dot", 0.0, -1).collect()}
    twice = df(spark, [(0, 0, 1.0), (0, 0, 1.0), (1, 0, 2.0)], "row bigint, col bigint, val double")
    assert {(r.query, r.neighbor): r.sim for r in similarity.neighbors(twice, "dot", 0.0, -1).collect()} == {(0, 0): 4.0, (0, 1): 4.0, (1, 0): 4.0, (1, 1): 4.0}
    with pytest.raises(ValueError):
        similarity.neighbors(m, "other")
    with pytest.raises(ValueError):
        sparse.extract_rows(m, 2, 9, nrows=4)


@pytest.mark.parametrize("measure, minsim", [("jaccard", 0.25), ("jaccard", 0.9), ("jaccard", 0.0), ("dot", 3.0), ("dot", 9.0), ("cosine", 0.5), ("minmax", 0.4), ("minmax", 1.0)])
@pytest.mark.parametrize("odd", [False, True])
@pytest.mark.parametrize("prefix", [False, True])
def test_tiles_and_bounds_lose_no_pair(spark, measure, minsim, odd, prefix):
    """Against all pairs: a column that every row has, tiles of a few rows; negative values and repeated cells."""
    import random

    rng = random.Random(5)
    cells = [(r, c, rng.choice([1.0, 2.0, 0.5, 4.0])) for r in range(60) for c in [0, *rng.sample(range(1, 12), rng.randrange(1, 6))]]
    if odd:
        cells += [(r, c, -v) for r, c, v in rng.sample(cells, 20)] + rng.sample(cells, 20) + [(60, 0, -1.0), (61, 0, 3.0)]
    rows = {}
    for r, c, v in cells:
        rows.setdefault(r, []).append((c, v))
    if measure == "cosine":
        rows = {r: [(c, v / sum(x * x for _, x in cs) ** 0.5) for c, v in cs] for r, cs in rows.items()}
    least, kind = min if measure == "minmax" else (lambda x, y: x * y), "dot" if measure == "cosine" else measure
    own = {r: sum(v if measure == "minmax" else v * v for _, v in cs) for r, cs in rows.items()}
    want = {}
    for q, a in rows.items():
        for h, b in rows.items():
            shared = [least(x, y) for i, x in a for j, y in b if i == j]
            below = own[q] + own[h] - sum(shared)
            if shared and (kind == "dot" or below):
                want[q, h] = sum(shared) if kind == "dot" else sum(shared) / below
    close = {p for p, x in want.items() if abs(x - minsim) < 1e-9}
    found = {(r.query, r.neighbor): r.sim for r in similarity.neighbors(df(spark, cells, "row bigint, col bigint, val double"), measure, minsim, -1, tile=7, prefix=prefix).collect()}
    assert {p for p, x in want.items() if x >= minsim} - close == set(found) - close
    assert all(abs(found[p] - want[p]) < 1e-9 for p in found)


def test_a_frequent_column_is_many_keys(spark):
    m = spark.range(100).selectExpr("id as row", "0L as col", "1.0D as val")
    dealt = similarity.tiles(m, m, 10)
    sizes = [r["count"] for r in dealt.groupBy("col", "block").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 30 and sum(sizes) == 100


def test_normalize_keeps_what_sums_to_nothing(spark):
    m = df(spark, [(0, 0, 1.0), (0, 1, -1.0), (1, 0, 2.0), (1, 1, 2.0)], "row bigint, col bigint, val double")
    assert sorted(map(tuple, sparse.normalize(m, "row", 1).collect())) == [(0, 0, 1.0), (0, 1, -1.0), (1, 0, 0.5), (1, 1, 0.5)]
    assert [r.col for r in sparse.index_rows(m, "col", 1).collect()] == [0, 0, 1, 1]


def test_vectors(spark):
    v = df(spark, [(0, 2.0), (1, 5.0), (2, 5.0), (3, 1.0)], "i bigint, x double")
    assert vector.argmax(v).first().i == 1 and vector.argmin(v).first().i == 3 and vector.argmax_n(v, 3).first().i == 0
    none = v.limit(0)
    assert vector.vmax(none).first().max == 0 and vector.vmin(none).first().min == 0 and vector.norm2(none).first().norm == 0


def test_tutorials(spark):
    assert [r.partial for r in demos.dot_partials(demos.ones(spark)).collect()] == [100_000.0] * 4
    cell = {(r.i, r.j): r.v for r in demos.matrix_fill(spark).filter("i < 2 and j < 2").collect()}
    assert cell[0, 0] == 1000 and abs(cell[1, 1] - (1 / 3.452 + 999)) < 1e-9
    assert tuple(demos.threshold_trigger(spark.range(11).withColumnRenamed("id", "n")).first()) == (None, 11)


def test_trigger_as_a_stream(spark):
    rate = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 20).option("numPartitions", 1).load()
    run = running_count(rate).writeStream.outputMode("complete").format("memory").queryName("trigger_counts").start()
    try:
        run.awaitTermination(8)
    finally:
        run.stop()
    r = spark.sql("select * from trigger_counts").first()
    assert r["count"] >= 20 and r.final == r["count"] + 125


def test_edges_survive_reversal(spark):
    e = df(spark, [(0, 1), (0, 1), (2, 0), (1, 1)], "src bigint, dst bigint")
    back = graph.reverse(e).select("src", "dst", F.explode(F.sequence(F.lit(1), "n_edges"))).select("src", "dst")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, e.collect()))
    assert graph.incoming(e, 3, 5).agg(F.sum("n_edges")).first()[0] == 4
    assert graph.pagerank(spark.range(0), e.limit(0)).iterations == 0


def test_as_many_ranges_as_rows_need(spark):
    """More ranges than an expression tells apart: positions and numbers are those of a plain count."""
    from sparkloom.operators import sparse

    rows = [(i * 37 % 10_007 * 3, i % 5) for i in range(9000)]
    df = spark.createDataFrame(rows, "k bigint, v int")
    got = sorted((r.k, r.v, r.before) for r in sparse.prefix_sum(df, "k", "v", rows_each=100).collect())
    want, total = [], 0
    for k, v in sorted(rows):
        want.append((k, v, total))
        total += v
    assert got == want
    ids = sparse._dense_ids(df.unionByName(df), "k", rows_each=100)
    assert sorted(map(tuple, ids.collect())) == [(k, i) for i, (k, _) in enumerate(sorted(rows))]


def hub_graph(spark, n=6000):
    """A source with a third of all edges, a target with another third, and a ring."""
    rows = spark.range(1, n + 1)
    out = rows.selectExpr("0L as src", "id as dst")
    into = rows.selectExpr("id as src", f"{n + 1}L as dst")
    ring = rows.selectExpr("id as src", f"id % {n} + 1 as dst")
    back = spark.createDataFrame([(n + 1, 0), (0, 1), (0, 1)], "src bigint, dst bigint")
    return spark.range(n + 3).toDF("id"), out.unionByName(into).unionByName(ring).unionByName(back)


def brute_ranks(vertices, edges, iterations, damping=0.85):
    ids, out = [r.id for r in vertices.collect()], {}
    for r in edges.collect():
        out.setdefault(r.src, []).append(r.dst)
    pr = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(iterations):
        new = dict.fromkeys(ids, (1 - damping) / len(ids))
        for s, ds in out.items():
            for d in ds:
                new[d] += damping * pr[s] / len(ds)
        pr = new
    return pr


def test_ranks_of_hubs(spark):
    vertices, edges = hub_graph(spark)
    for steps in (1, 4):
        got = graph.pagerank(vertices, edges, max_iterations=6, tolerance=0.0, steps=steps)
        want = brute_ranks(vertices, edges, 6)
        assert got.iterations == 6 and all(abs(r.pr - want[r.id]) < 1e-12 for r in got.ranks.collect())


def test_hubs_are_cut(spark):
    """Blocks are even whatever a vertex has, and one value goes to each block in which a source has edges."""
    from sparkloom.functions.scratch import Scratch

    vertices, edges = hub_graph(spark)
    cut = graph.layout(edges, Scratch(spark, "test"), 8)
    sizes = sorted(r["count"] for r in cut.edges.groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 8 and sizes[-1] < 2 * sizes[4] and cut.edges.agg(F.sum("m")).first()[0] == edges.count()
    values = cut.routes.count()
    assert values == cut.edges.select("src", "block").distinct().count() and cut.routes.filter("src = 0").count() == 8
    assert values < 0.8 * cut.edges.count()
    assert cut.edges.filter("dst = 6001").select("block").distinct().count() == 8
    state = vertices.select(cut.home("id").alias("home"), "id", F.lit(1.0).alias("p0")).repartition(8, "home")
    plans = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    made = int(re.search(r"plan_id=(\d+)", plans(spark.range(9).repartition(3)))[1])  # what made the layout was planned before
    before = {k: spark.conf.get(k) for k in ("spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        plan = plans(state.join(graph.exchanged(cut, state, "p0"), ["home", "id"], "left"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    moved = [line for line in plan.splitlines() if "Exchange" in line and int(re.search(r"plan_id=(\d+)", line)[1]) > made]
    assert len(moved) == 4 and not any("ENSURE" in line for line in moved), moved  # the state's own (twice, one of which is reused), ranks out, sums back


def test_names_of_blocks_are_partitions_of_their_own(spark):
    names = graph.blocks(spark, 11)
    dealt = spark.createDataFrame([(n,) for n in names], "name int").repartition(11, "name")
    assert len(set(names)) == 11 and dealt.groupBy(F.spark_partition_id()).count().count() == 11


@pytest.mark.parametrize("rows_each", [1000, 2])
def test_null_orders_come_first_in_any_number_of_ranges(spark, rows_each):
    rows = [(None, 5), (None, 7)] + [(i, i % 3 or None) for i in range(1, 200)]
    got = sparse.prefix_sum(df(spark, rows, "k bigint, v bigint"), "k", "v", rows_each).collect()
    assert len(got) == len(rows) and sorted(r.before for r in got if r.k is None) in ([0, 5], [0, 7])
    total = 12
    for r in sorted((r for r in got if r.k is not None), key=lambda r: r.k):
        assert r.before == total
        total += r.v or 0
    three = sorted(map(tuple, sorting.positions(df(spark, [(1,), (None,), (1,)], "value bigint")).collect()))
    assert three == [(0, None), (1, 1), (2, 1)]


def skewed_matrix(rng, rows=400, columns=3000):
    """Rows that share frequent columns of small values with all, and rare ones of large values with few."""
    cells = [(r, c, 0.2) for r in range(rows) for c in range(5)]
    for r in range(rows):
        own = rng.sample(range(5 + r // 3 * 7 % columns, 15 + r // 3 * 7 % columns), 6)
        cells += [(r, c, float(rng.randint(1, 4))) for c in own]
    return cells


@pytest.mark.parametrize("measure, minsim", [("jaccard", 0.4871), ("cosine", 0.6171), ("minmax", 0.4871), ("dot", 40.01)])  # no similarity is as near as rounding
def test_a_prefix_index_forms_few_pairs_and_loses_none(spark, measure, minsim):
    import random

    m = df(spark, skewed_matrix(random.Random(3)), "row bigint, col bigint, val double").cache()
    scaled, kind = (sparse.normalize(m, "row", 2), "dot") if measure == "cosine" else (m, measure)
    whole, few = similarity.formed(similarity.indexed(similarity.described(scaled, kind), kind, minsim))
    assert few * 20 < whole, (whole, few)
    made = [sorted((r.query, r.neighbor, r["rank"], round(r.sim, 9)) for r in similarity.neighbors(m, measure, minsim, 10, prefix=p).collect()) for p in (None, True, False)]
    assert made[0] == made[1] == made[2] and len(made[0]) > 200


def test_long_rows_are_their_own_prefix(spark, monkeypatch):
    monkeypatch.setattr(similarity, "LONG_ROW", 8)
    cells = [(r, c, 1.0) for r in (0, 1) for c in range(20)] + [(2, c, 1.0) for c in range(6)] + [(3, c, 1.0) for c in range(15, 20)]
    m = df(spark, cells, "row bigint, col bigint, val double")
    cut = similarity.indexed(similarity.described(m, "jaccard"), "jaccard", 0.9).filter("pre").groupBy("row").count().collect()
    assert {r.row: r["count"] for r in cut if r.row < 2} == {0: 20, 1: 20} and all(r["count"] < 6 for r in cut if r.row >= 2)
    one, two = ({tuple(r) for r in similarity.neighbors(m, "jaccard", 0.21, -1, prefix=p).collect()} for p in (True, False))
    assert one == two and len(one) > 6


def test_blocks_are_partitions(spark):
    """Keys lie where their block is, in order, and each partition has its share; a third of all keys are one."""
    keys = spark.range(3001).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * 7919 % 2003).alias("value"))
    moved = sorting.redistributed(sorting.balanced_blocks(keys, 7), 7)
    rows = moved.select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"), "pos", "value", "block").collect()
    assert all(r.p == r.block for r in rows) and moved.rdd.getNumPartitions() == 7
    assert [r.pos for r in sorted(rows, key=lambda r: (r.p, r.i))] == list(range(3001))
    assert [sum(r.p == p for r in rows) for p in range(7)] == [428] * 6 + [433]
    assert [r.value for r in sorted(rows, key=lambda r: r.pos)] == sorted(r.value for r in rows)


def test_selection_by_counting(spark, monkeypatch):
    import random

    rng = random.Random(2)
    for values in ([5], [3, 3, 3, 9], [rng.randrange(-(2**62), 2**62) for _ in range(501)], [rng.randrange(9) for _ in range(400)] + [4] * 300):
        keys = df(spark, [(v,) for v in values] + [(None,)], "value bigint")
        for few in (3, 64):
            monkeypatch.setattr(sorting, "RANGES", few)
            for k in (0, len(values) // 3, len(values) - 1):
                assert sorting.nth(keys, k) == sorted(values)[k]
        middle = sorted(values)[(len(values) - 1) // 2], sorted(values)[len(values) // 2]
        assert sorting.pivot(keys).first().pivot == sum(middle) // 2
        assert sorting.nth(keys, len(values)) is None and sorting.nth(keys, -1) is None
    assert sorting.pivot(keys.limit(0)).first().pivot is None
    many = spark.range(1_000_000).select(((F.col("id") * 48271) % 1_000_003).alias("value"))
    assert sorting.nth(many, 499_999) == sorted(i * 48271 % 1_000_003 for i in range(1_000_000))[499_999]


def test_blocks_of_a_small_graph_follow_its_size(spark, monkeypatch):
    """Few blocks where there are many shuffle partitions, more for more edges or vertices, with the same ranks."""
    from sparkloom.functions.scratch import Scratch

    edges = spark.range(400).selectExpr("id % 40 src", "(id * id + 3) % 40 dst")
    vertices = spark.range(40).toDF("id")
    want = {r.id: r.pr for r in graph.pagerank(vertices, edges, parts=8).ranks.collect()}
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, "20")
    try:
        assert graph.layout(edges, Scratch(spark, "test")).parts == spark.sparkContext.defaultParallelism
        monkeypatch.setattr(graph, "EACH", 4)
        assert graph.layout(edges, Scratch(spark, "test"), vertices=40).parts > spark.sparkContext.defaultParallelism
        got = {r.id: r.pr for r in graph.pagerank(vertices, edges).ranks.collect()}
    finally:
        spark.conf.set(name, before)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
