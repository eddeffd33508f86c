"""Readers, writers and their golden values."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.params import KnnParams, parse
from sparkloom.operators import graph, similarity, sorting, sparse
from sparkloom.sources import files


@pytest.fixture
def text(tmp_path):
    def write(content, name="f.txt"):
        path = tmp_path / name
        path.write_bytes(content.encode())
        return str(path)

    return write


def part(path):
    import glob

    (f,) = glob.glob(f"{path}/part-*")
    return open(f).read()


PR = [
    ("3 3\n2\n3\n1\n", [1 / 3, 1 / 3, 1 / 3], 3),
    ("4 7\n2 3\n3\n1\n3 3 1\n", [0.37733183, 0.19786603, 0.38730215, 0.0375], 41),
    ("3 2\n2\n3\n\n", [0.05, 0.0925, 0.128625], 4),
    ("3 2\r\n2\r\n3\r\n", None, None),
]


@pytest.mark.parametrize(("content", "ranks", "iterations"), PR)
def test_pagerank_files(spark, text, tmp_path, content, ranks, iterations):
    if ranks is None:
        with pytest.raises(ValueError, match="ends before"):
            files.read_adjacency(spark, text(content))
        return
    r = graph.pagerank(*files.read_adjacency(spark, text(content), partitions=2))
    got = [x.pr for x in r.ranks.orderBy("id").collect()]
    assert r.iterations == iterations and max(abs(a - b) for a, b in zip(got, ranks, strict=True)) < 1e-8
    files.write_ranks(r.ranks, str(tmp_path / "out"))
    assert part(tmp_path / "out").split("\n")[0] == f"{got[0]:.3e}"


def test_first_vertex_may_be_a_sink(spark, text):
    v, e = files.read_adjacency(spark, text("2 1\n\n1\n"))
    assert [tuple(r) for r in e.collect()] == [(1, 0)] and [r.id for r in graph.sinks(v, e).collect()] == [0]


@pytest.mark.parametrize("content", ["3 3\n4\n3\n1\n", "3 3\n0\n3\n1\n", "3 4\n2\n3\n1\n", "3 2\n2\n3\n", "3\n2\n", "", "2 1\n2\n\n1 2\n", "2 1\nx\n\n"])
def test_bad_graphs(spark, text, content):
    with pytest.raises(ValueError):
        files.read_adjacency(spark, text(content))


KNN = "0 1 1 2\n1 2 3 1\n0 2 1 4\n\n5 3\n"
SIMS = {(0, 0): (5, 1, 1, 1), (0, 1): (4, 0.666667, 0.8, 0.5), (0, 2): (10, 0.666667, 1, 0.5), (1, 1): (5, 1, 1, 1), (1, 2): (8, 0.470588, 0.8, 0.285714), (2, 2): (20, 1, 1, 1), (4, 4): (9, 1, 1, 1)}


@pytest.mark.parametrize(("i", "measure"), enumerate(["dot", "jaccard", "cosine", "minmax"]))
def test_similarities(spark, text, i, measure):
    m = sparse.compact_columns(files.read_csr(spark, text(KNN)))
    assert sorted({r.col for r in m.collect()}) == [0, 1, 2, 3]
    got = {(r.query, r.neighbor): r.sim for r in similarity.neighbors(m, measure, 0.0, -1).collect()}
    want = {k: v[i] for k, v in SIMS.items()} | {(b, a): v[i] for (a, b), v in SIMS.items()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_neighbours_and_their_file(spark, text, tmp_path):
    m = files.read_csr(spark, text(KNN))
    found = similarity.neighbors(m, "jaccard", 0.5, 2)
    got = {}
    for r in found.orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.neighbor)
    assert got == {0: [0, 1], 1: [1, 0], 2: [2, 0], 4: [4]}
    files.write_neighbors(found, str(tmp_path / "out"))
    assert part(tmp_path / "out").split("\n")[1] == "       0        1 0.667"
    one = similarity.similar_rows(m, m.filter("row = 0").select("col", "val"), "jaccard", 0.5, 2).collect()
    assert [r.neighbor for r in one] == [0, 1]


def test_other_sparse_formats(spark, text):
    assert [tuple(r) for r in files.read_csr(spark, text("2 6 3\n1 5 6 7\n2 1\n"), header=True).orderBy("row", "col").collect()] == [(0, 0, 5.0), (0, 5, 7.0), (1, 1, 1.0)]
    assert files.read_csr(spark, text("1 2\n\n2 2"), values=False, numbering=1).groupBy("row", "col").agg(F.sum("val").alias("n")).orderBy("row", "col").collect()[-1].n == 2
    s = files.file_stats(spark, text("1 2\r\n\n3 4 5\n")).first()
    assert (s.nlines, s.ntokens, s.max_line_tokens) == (3, 5, 3)


@pytest.mark.parametrize(("content", "more"), [("1 2 3\n", {}), ("-1 2\n", {}), ("0 2\n", {"numbering": 1}), ("1 x\n", {}), ("1 2\n1 2 3 4\n", {"header": True}), ("1 2 2\n1 2\n", {"header": True}), ("2 2 1\n1 2\n", {"header": True})])
def test_bad_matrices(spark, text, content, more):
    with pytest.raises(ValueError):
        files.read_csr(spark, text(content), **more)


def test_sort_file(spark, tmp_path):
    keys = spark.createDataFrame([(x,) for x in (5, 3, 3, 4294967295, 0, 3)], "value bigint")
    files.write_keys(keys, str(tmp_path / "out"))
    assert part(tmp_path / "out").split() == ["6", "0", "3", "3", "3", "5", "4294967295"]
    assert [r.value for r in sorting.positions(keys, step=2).orderBy("pos").collect()] == [0, 3, 3, 3, 5, 4294967295]


def test_points_and_labels(spark, text):
    p = files.read_points(spark, text("2 3\r\n1 2 3\r\n4 5 6", "p"), text("2\n1\n-1\n", "l"))
    assert [tuple(r) for r in p.orderBy("id").collect()] == [(0, [1.0, 2.0, 3.0], 1.0), (1, [4.0, 5.0, 6.0], -1.0)]
    with pytest.raises(ValueError):
        files.read_labels(spark, text("3\n1\n", "m"))
    with pytest.raises(ValueError):
        files.read_points(spark, text("2 3\n1 2 3\n4 5", "q"), text("2\n1\n-1\n", "l2"))


def test_parameters():
    assert parse(["in"]) == KnnParams(infstem="in")
    assert parse(["-nn", "5", "in", "-minsim", "0.5", "out"]) == KnnParams(5, 0.5, infstem="in", outfile="out")
    for bad in (["-nnbrs", "0", "in"], ["-minsim", "-1", "in"], ["-nthreads", "0", "in"]):
        with pytest.raises(ValueError):
            parse(bad)


def test_dumps(spark):
    edges = spark.createDataFrame([(0, 2), (0, 1), (1, 0)], "src bigint, dst bigint")
    assert [tuple(r) for r in files.dump_graph(edges).collect()] == [(0, "1 2"), (1, "0")]


def test_lines_of_many_splits_and_parts(spark, tmp_path):
    """Numbers follow the order of files and of their bytes, however Spark deals splits to tasks."""
    want = []
    for part in range(4):
        own = [f"{part} {i} " + "x" * ((i * 7 + part) % 50) for i in range(400 + 900 * (part == 2))]
        want += own
        (tmp_path / f"part-{part:05d}.txt").write_text("\n".join(own) + "\n" * (part % 2))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = files.lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        got = {r.line: " ".join(r.tokens) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {i: line.strip() for i, line in enumerate(want)}


def test_ordered_parts(spark, tmp_path):
    """Keys are written by several tasks, and parts by name are the sorted keys."""
    keys = spark.range(5000).selectExpr("(id * 7919) % 10007 as value")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.write_keys(keys, str(tmp_path / "parts"))
        files.write_lines(keys.orderBy("value").selectExpr("cast(value as string)"), str(tmp_path / "one"), one_file=True)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    parts = sorted((tmp_path / "parts").glob("part-*"))
    text = "".join(p.read_text() for p in parts).split()
    assert len([p for p in parts if p.stat().st_size]) > 4 and len(list((tmp_path / "one").glob("part-*"))) == 1
    assert text == ["5000", *map(str, sorted(i * 7919 % 10007 for i in range(5000)))]
    assert [" ".join(r.tokens) for r in files.lines(spark, str(tmp_path / "parts")).orderBy("line").collect()] == text
