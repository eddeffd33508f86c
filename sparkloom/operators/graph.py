"""Directed multigraphs as vertices(id) and edges(src, dst); repeated edges count."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from time import perf_counter

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.scratch import Scratch


def out_degree(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, degree; 0 for sinks."""
    d = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return vertices.join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def sinks(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices without out-edges."""
    return vertices.join(edges.select(F.col("src").alias("id")), "id", "left_anti")


def push(ranks: DataFrame, edges: DataFrame) -> DataFrame:
    """dst, share: what each edge carries, the source's rank by its degree. ranks: id, pr, degree."""
    return edges.join(ranks.select(F.col("id").alias("src"), (F.col("pr") / F.col("degree")).alias("share")), "src").select("dst", "share")


def owner(n: int, parts: int, id_col: str = "id"):
    """Block of each vertex: blocks of n // parts vertices, the rest to the last. With fewer vertices than
    parts, a vertex a block."""
    return F.least(F.floor(F.col(id_col) / max(1, n // parts)), F.lit(parts - 1)).cast("bigint")


def incoming(edges: DataFrame, n: int, parts: int) -> DataFrame:
    """owner, src, n_edges: of each block of destinations its distinct sources, as an exchange would send them."""
    return edges.groupBy(owner(n, parts, "dst").alias("owner"), "src").agg(F.count("*").alias("n_edges"))


def reverse(edges: DataFrame) -> DataFrame:
    """dst, src, n_edges: in-edges with their multiplicity."""
    return edges.groupBy("dst", "src").agg(F.count("*").alias("n_edges"))


def sorted_adjacency(edges: DataFrame) -> DataFrame:
    """src, nbrs: sorted out-neighbours, repeats kept."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))


@dataclass
class PageRank:
    """ranks: id, pr. iterations: performed. delta: last change (L2). seconds: in all."""

    ranks: DataFrame
    iterations: int
    delta: float
    seconds: float


#: Edges of a vertex from which on it is a hub, as a share of the edges of one block.
HUB = 0.25
#: Edges or vertices of a block, so that a small graph is not many rounds of tasks that have next to nothing to do.
EACH = 250_000


def blocks(spark: SparkSession, parts: int) -> list[int]:
    """A name of each of so many blocks, such that an exchange by name puts each into a partition of its own."""
    names: dict[int, int] = {}
    upto = 32 * parts
    while len(names) < parts:
        found = spark.range(upto).select(F.col("id").cast("int").alias("name")).groupBy(F.pmod(F.hash("name"), F.lit(parts)).alias("p")).agg(F.min("name").alias("name"))
        names, upto = {r.p: r["name"] for r in found.collect()}, 4 * upto
    return [names[p] for p in range(parts)]


@dataclass
class Layout:
    """A graph cut at its vertices. home: the block of a vertex. edges (block, src, dst, m): each distinct edge in a
    block, m times. routes (home, src, k, block): to which blocks a source of degree k sends its share."""

    home: Callable[[str], Column]
    edges: DataFrame
    routes: DataFrame
    parts: int


def layout(edges: DataFrame, scratch: Scratch, parts: int | None = None, vertices: int = 0) -> Layout:
    """A graph in `parts` blocks; if not given, in one for each EACH edges or vertices, as many as tasks run at a time at
    least (if there are so many shuffle partitions), and as many as shuffle partitions at most.

    Edges go to the block of their target, so a source with any share of all edges has them in all blocks. A target
    with more distinct in-edges than HUB of a block's share has them dealt to several blocks by source, from its own
    on; there are parts / HUB such targets at most, so their table is broadcast. Routes lie where their source is."""
    many, seen = scratch.measure(edges.groupBy("src", "dst").agg(F.count("*").alias("m")), F.count("*").alias("n"))
    if parts is None:
        most = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = min(most, max(edges.sparkSession.sparkContext.defaultParallelism, -(-max(seen["n"], vertices) // EACH)))
    names = F.lit(blocks(edges.sparkSession, parts))
    place = lambda i: F.element_at(names, (i + 1).cast("int"))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(parts))
    limit = max(1.0, HUB * seen["n"] / parts)
    hubs = many.groupBy("dst").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("dst", F.least(F.ceil(F.col("n") / limit), F.lit(parts)).alias("splits"))
    dealt = many.join(F.broadcast(hubs), "dst", "left")
    block = place(F.pmod(at("dst") + F.coalesce(F.pmod(F.xxhash64(F.lit(1), "src"), "splits"), F.lit(0)), F.lit(parts)))
    placed = dealt.select(block.alias("block"), "src", "dst", "m").repartition(parts, "block").sortWithinPartitions("block", "src").persist(StorageLevel.DISK_ONLY)
    degree = many.groupBy("src").agg(F.sum("m").alias("k"))
    routes = placed.select("src", "block").distinct().join(degree, "src").select(place(at("src")).alias("home"), "src", "k", "block").repartition(parts, "home").sortWithinPartitions("home", "src").persist(StorageLevel.DISK_ONLY)
    for table in (placed, routes):
        table.count()  # only of a table that is there does Spark know how it is dealt
    return Layout(lambda c: place(at(c)), placed, routes, parts)


def exchanged(graph: Layout, state: DataFrame, rank: str) -> DataFrame:
    """(home, id, acc): what vertices get, from state (home, id, `rank`). One value goes to each block in which a
    source has edges, whatever their number, and fans out there. Sums are by target within the block, so a target is
    one row of the second exchange, or one of each of its blocks, where it is a hub."""
    sent = graph.routes.join(state.select("home", F.col("id").alias("src"), F.col(rank).alias("p")), ["home", "src"])
    sent = sent.select("block", "src", (F.col("p") / F.col("k")).alias("share")).repartition(graph.parts, "block")
    got = graph.edges.join(sent, ["block", "src"]).groupBy("block", "dst").agg(F.sum(F.col("share") * F.col("m")).alias("acc"))
    got = got.select(graph.home("dst").alias("home"), F.col("dst").alias("id"), "acc").repartition(graph.parts, "home")
    return got.groupBy("home", "id").agg(F.sum("acc").alias("acc"))


def pagerank(vertices: DataFrame, edges: DataFrame, damping: float = 0.85, max_iterations: int = 100, tolerance: float = 1e-9, steps: int = 2, parts: int | None = None) -> PageRank:
    """Damped power iteration. Ranks begin at 1/n; an iteration is ``(1 - d)/n + d * sum of pr/degree``. Sinks
    pass nothing on. It stops after the first iteration from the third on that changes ranks by less than
    `tolerance` (L2).

    The graph is cut into `parts` blocks as layout() says, and only ranks move: an
    iteration sends one value for each source and block, and one sum for each target and block. `steps` iterations are
    one job. Each job's ranks are written to the shared folder, which cuts lineage; the changes of its iterations are
    summed as they are written, and only those numbers come to the driver. While they are written, Spark may join by
    block what is dealt by block alone.
    """
    began, spark = perf_counter(), vertices.sparkSession
    n = vertices.count()
    if n == 0:
        return PageRank(vertices.select("id", F.lit(0.0).alias("pr")).limit(0), 0, 0.0, perf_counter() - began)
    scratch, before = Scratch(spark, "pagerank", {"spark.sql.requireAllClusterKeysForCoPartition": "false"}), []
    graph = layout(edges, scratch, parts, n)
    state, done, delta = vertices.select(graph.home("id").alias("home"), "id", F.lit(1.0 / n).alias("p0")), 0, float("inf")
    while done < max_iterations:
        now = min(steps, max_iterations - done)
        state = state.repartition(graph.parts, "home")
        for i in range(now):
            state = state.join(exchanged(graph, state, f"p{i}"), ["home", "id"], "left")
            state = state.withColumn(f"p{i + 1}", F.lit((1 - damping) / n) + F.lit(damping) * F.coalesce("acc", F.lit(0.0))).drop("acc")
        changes = [F.sqrt(F.sum(F.pow(F.col(f"p{i + 1}") - F.col(f"p{i}"), 2))).alias(str(i)) for i in range(now)]
        state, moved = scratch.measure(state, *changes)
        stop = next((i for i in range(now) if done + i + 1 >= 3 and moved[str(i)] < tolerance), None)
        last = now if stop is None else stop + 1
        done, delta = done + last, moved[str(last - 1)]
        scratch.drop(*before)  # the table that this one was made of
        before = [state]
        state = state.select("home", "id", F.col(f"p{last}").alias("p0"))
        if stop is not None:
            break
    graph.edges.unpersist()
    graph.routes.unpersist()
    return PageRank(state.select("id", F.col("p0").alias("pr")), done, delta, perf_counter() - began)
