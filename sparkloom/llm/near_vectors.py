"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe, verified pairs.

A rotation is three rounds of random signs and a Walsh-Hadamard transform; a hash is the coordinate of largest
magnitude with its sign. A table joins the hashes of a few rotations; a vector goes to the bucket of its hashes
and, as probes, to those that lose least magnitude. Within a bucket all pairs of equal label are verified by
their cosine in double precision. A pair that shares several buckets counts in the first of them, so links are
counted, not listed: a bucket returns its vectors' link counts and a spanning forest of its links.

Equal vectors of one label are one representative with a weight. Buckets are cut into blocks of a bounded size,
and pairs of blocks are compared in tasks of their own, so a bucket of any size is whole and spread.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.cluster import Scratch, components, give_back

#: Vectors hashed at a time; each comes out once for each table and probe.
ROWS = 512


@dataclass(frozen=True)
class Hashing:
    """tables: independent tables; 0: by the hashes a table joins, so that recall does not fall with them.
    probes: buckets of each vector in a table. tops: alternatives of one hash
    that probes are chosen from. hashes: rotations a table joins; 0: by the number of vectors, so that
    buckets hold few unlike vectors at any size."""

    tables: int = 0
    probes: int = 2
    tops: int = 3
    hashes: int = 0
    seed: int = 23

    def tables_of(self, k: int) -> int:
        """A pair at cosine 0.98 shares a bucket of one table with probability 0.6 for k = 3 and 0.4 for k = 4 in
        768 dimensions."""
        return self.tables or {1: 4, 2: 4, 3: 7, 4: 12}.get(k, 12 * 2 ** max(0, k - 4))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, orthonormal; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        pairs = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def codes(x: np.ndarray, how: Hashing, k: int) -> np.ndarray:
    """Bucket codes (rows, tables, probes) of vectors of length 1; a table's first is the vector's own."""
    d = 1 << max(0, x.shape[1] - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    rng, tops = np.random.default_rng(how.seed), min(how.tops, d)
    combos = list(itertools.product(range(tops), repeat=k))
    out = np.empty((len(x), how.tables_of(k), min(how.probes, len(combos))), np.int64)
    for t in range(how.tables_of(k)):
        code = np.zeros((len(x), len(combos)), np.int64)
        loss = np.zeros((len(x), len(combos)))
        for j in range(k):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            at = np.argsort(-np.abs(y), 1, kind="stable")[:, :tops]
            value = np.take_along_axis(y, at, 1)
            hashed, lost = at * 2 + (value < 0), np.abs(value[:, :1]) - np.abs(value)
            place = [c[j] for c in combos]
            code = code * (2 * d) + hashed[:, place]
            loss += lost[:, place]
        best = np.argsort(loss, 1, kind="stable")[:, : out.shape[2]]
        out[:, t] = np.take_along_axis(code, best, 1)
    return out


def _rows(column: pa.Array) -> np.ndarray:
    """A list column without nulls, of one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _hash(how: Hashing, k: int):
    """A row for each bucket of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("vector"))
            dims = np.asarray(pa.compute.list_value_length(vectors))
            for d in np.unique(dims).tolist():
                whole = batch.filter(pa.array(dims == d))
                for part in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                    yield hashed(part)
            give_back()

    def hashed(part: pa.RecordBatch) -> pa.RecordBatch:
        x = _rows(part.column(part.schema.get_field_index("vector")))
        c = codes(x / np.linalg.norm(x, axis=1, keepdims=True), how, k)
        n, tables, probes = c.shape
        row = np.repeat(np.arange(n), tables * probes)
        take = part.take(pa.array(row))
        made = [pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), probes), n)), pa.array(c.reshape(-1)), pa.array([c[i].tobytes() for i in row.tolist()], pa.binary())]
        return pa.RecordBatch.from_arrays([*take.columns, *made], [*take.schema.names, "tab", "code", "codes"])

    return run


def _verify(threshold: float, probes: int):
    """Of each tile: link counts of its vectors and a spanning forest of its links."""

    def tile(part: pa.Table) -> list[tuple[int, int, int]]:
        ids, weight = part.column("rep").to_numpy(), part.column("weight").to_numpy()
        side = part.column("side").to_numpy()
        x = _rows(part.column("vector").combine_chunks() if isinstance(part.column("vector"), pa.ChunkedArray) else part.column("vector"))
        c = np.stack([np.frombuffer(b, np.int64).reshape(-1, probes) for b in part.column("codes").to_pylist()])
        t, code = part.column("tab")[0].as_py(), part.column("code")[0].as_py()
        norm = np.linalg.norm(x, axis=1)
        cos = (x @ x.T) / (norm[:, None] * norm[None, :])
        link = np.triu(cos >= threshold, 1)
        if side.any() and not side.all():
            link &= side[:, None] != side[None, :]
        a, b = np.nonzero(link)
        if not len(a):
            return []
        first = np.ones(len(a), bool)  # the bucket is the pair's first
        for s in range(t + 1):
            for i in range(probes):
                for j in range(probes):
                    same = c[a, s, i] == c[b, s, j]
                    first &= ~(same & (c[a, s, i] < code)) if s == t else ~same
        a, b = a[first], b[first]
        n = np.zeros(len(ids), np.int64)
        np.add.at(n, a, weight[b])
        np.add.at(n, b, weight[a])
        top = list(range(len(ids)))

        def find(i: int) -> int:
            while top[i] != i:
                top[i] = top[top[i]]
                i = top[i]
            return i

        out = []
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            p, q = find(i), find(j)
            if p != q:
                top[max(p, q)] = min(p, q)
                out.append((int(ids[i]), 0, int(ids[j])))
        return out + [(int(ids[i]), int(n[i]), int(ids[i])) for i in np.flatnonzero(n).tolist()]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("tile", "ascending"), ("rep", "ascending")])
        tiles, found = table.column("tile").to_numpy(), []
        cut = np.flatnonzero(np.r_[True, tiles[1:] != tiles[:-1]]) if len(tiles) else []
        for a, b in zip(cut, [*cut[1:], len(tiles)], strict=True):
            if b - a > 1:
                found += tile(table.slice(a, b - a))
        a, n, b = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"rep": pa.array(a, pa.int64()), "n": pa.array(n, pa.int64()), "other": pa.array(b, pa.int64())})

    return run


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", threshold: float = 0.98, how: Hashing = Hashing(), block: int = 256) -> DataFrame:
    """Links of vectors of equal label whose cosine is `threshold` or more.

    Returns `id_col`, n_links (other vectors linked directly), component_id (smallest id reachable by links,
    itself included), kept (the id is its component's). Vectors that are null, empty, zero or hold null or
    non-finite components, and those without a label, link with nothing and are kept; only vectors of one
    length are compared. With `label_col` None all labels are equal. Rows with a null id are left out. Rows that
    repeat an id with equal vector and label are one vector; with others, links of each count for the id.
    Other columns, of any name, are not looked at. Empty table: empty result.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "vectors")
    label = F.lit(0) if label_col is None else F.col(label_col)
    base = rows.select(F.col(id_col).cast("bigint").alias("id"), label.cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector")).filter("id is not null")
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fit = F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists("vector", lambda v: v != 0)
    # Tiny or huge vectors: scale by a power of two, so that no square under- or overflows; in two steps, since the
    # power for the smallest numbers is beyond a double itself.
    most = F.array_max(F.transform("vector", lambda v: F.abs(v)))
    power = F.floor(F.log2(most))
    half = F.floor(-power / 2)
    base = base.withColumn("fit", F.coalesce(fit, F.lit(False))).withColumn("vector", F.when(F.col("fit"), F.transform("vector", lambda v: v * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), -power - half))))
    keyed = base.withColumn("k1", F.xxhash64(F.lit(1), "label", "vector")).withColumn("k2", F.xxhash64(F.lit(2), "vector", "label"))
    keyed = scratch.save(keyed.select("id", "label", "vector", "fit", "k1", "k2"))
    one = keyed.filter("fit").groupBy("k1", "k2", "label", "vector").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("weight"))
    reps = scratch.save(one.select("k1", "k2", "label", "vector", "rep", "weight"))
    d = reps.agg(F.max(F.size("vector"))).first()[0] or 1
    n = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    k = how.hashes or int(np.clip(round(np.log(n) / np.log(2 * max(2, d))), 1, 4))
    hashed = reps.select("label", "vector", "rep", "weight").mapInArrow(_hash(how, k), "label string, vector array<double>, rep bigint, weight bigint, tab int, code bigint, codes binary")
    hashed = hashed.withColumn("bucket", F.xxhash64("label", F.size("vector"), "tab", "code"))
    keys = ["bucket", "label", "tab", "code"]
    # Buckets of more than one vector, cut into blocks.
    sizes = hashed.groupBy(*keys).agg(F.count("*").alias("c")).filter("c > 1").select(*keys, F.ceil(F.col("c") / block).cast("int").alias("blocks"))
    full = hashed.join(sizes, keys).withColumn("blk", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("blocks")).cast("int"))
    mine = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, F.col("blk")).alias("x"), F.greatest(i, F.col("blk")).alias("y"), (i < F.col("blk")).cast("int").alias("side")))
    tiles = full.select(*keys, "vector", "rep", "weight", "codes", F.explode(mine).alias("s")).withColumn("tile", F.xxhash64("bucket", "s.x", "s.y"))
    tiles = tiles.select("tile", "tab", "code", "vector", "rep", "weight", "codes", F.col("s.side").alias("side"))
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-reps.count() * how.tables_of(k) * how.probes // 20_000))
    probes = min(how.probes, min(how.tops, 1 << max(0, d - 1).bit_length()) ** k)
    found = tiles.withColumn("g", F.pmod("tile", F.lit(groups)).cast("int")).groupBy("g").applyInArrow(_verify(threshold, probes), "rep bigint, n bigint, other bigint")
    found = scratch.save(found)
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    comp = components(found.filter("rep <> other").select(F.col("rep").alias("u"), F.col("other").alias("v")), Scratch(spark, "vector-links"))
    rep = reps.select("k1", "k2", "label", "vector", "rep", "weight").join(links, "rep", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    rep = rep.select("k1", "k2", "rep", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    whole = keyed.select("id", "fit", "k1", "k2").distinct()
    out = whole.filter("fit").join(rep, ["k1", "k2"]).select("id", "n_links", "component", "rep")
    out = out.unionByName(whole.filter("not fit").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component"), F.col("id").alias("rep")))
    out = out.groupBy("id").agg(F.sum("n_links").alias("n_links"), F.min("component").alias("component"))
    return out.select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
