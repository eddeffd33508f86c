"""Cyclic coordinate descent with a distributed residual, for widths at which d * d numbers fit nowhere.

Rows lie in row blocks, columns in column blocks of `width`; a tile holds the cells other than 0 of a row block in a
column block. The residual y - Xw is a table of one array a row block. A visit of a column block is two steps: one
pass over the residual takes the last block's changes of weights off, meets the tiles of this block and sums their products
with it; then the block's weights take their exact steps one after the other, which its own width x width
products suffice for, since only they change within it. So the order of steps is the cyclic one, and the weights are
those of steps over single columns.

A task holds a row block with its tiles of two column blocks, or width * width numbers; the driver holds
block numbers and one error a sweep.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.scratch import Scratch

#: Columns of a column block; rows and cells at which a row block ends (it holds a row more at most).
WIDTH, ROWS, CELLS = 512, 1024, 1 << 20

_TILE = "rb bigint, cb bigint, p array<int>, c array<int>, x array<double>, y array<double>"


def _lists(values: list[np.ndarray], kind):
    import pyarrow as pa

    ends = np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*values, np.zeros(0)]), kind, safe=False))


def row_blocks(points: DataFrame, width: int = WIDTH, rows: int = ROWS, cells: int = CELLS) -> DataFrame:
    """rb, cb, p, c, x: tiles, p and c the places of cells in their blocks; y: the labels, in a row of each row block with
    cb -1. One pass without a shuffle. The numbers of row blocks depend on the partitions, so save it before use."""

    def deal(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number, held, labels, parts = TaskContext.get().partitionId() << 33, 0, [], []

        def block():
            p, j, x = (np.concatenate(v) for v in zip(*parts, strict=True))
            order = np.argsort(j // width, kind="stable")
            p, j, x = p[order], j[order], x[order]
            names, starts = np.unique(j // width, return_index=True)
            cut = lambda v: [np.zeros(0), *np.split(v, starts[1:])][: len(names) + 1]
            y = [np.concatenate(labels), *[np.zeros(0)] * len(names)]
            columns = [pa.array(np.full(len(y), number)), pa.array(np.r_[-1, names].astype(np.int64)), _lists(cut(p), pa.int32()), _lists(cut(j % width), pa.int32()), _lists(cut(x), pa.float64()), _lists(y, pa.float64())]
            return pa.RecordBatch.from_arrays(columns, ["rb", "cb", "p", "c", "x", "y"])

        for batch in batches:
            lengths = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
            ends, at = np.cumsum(lengths), 0
            while at < batch.num_rows:
                room = np.searchsorted(ends, (ends[at - 1] if at else 0) + cells) + 1
                to = int(min(batch.num_rows, at + rows - held, max(room, at + 1)))
                part, n = batch.slice(at, to - at), lengths[at:to]
                x = part.column(0).flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
                j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                full = np.flatnonzero(x)
                parts.append((np.repeat(np.arange(held, held + to - at), n)[full], j[full], x[full]))
                labels.append(part.column(1).to_numpy(zero_copy_only=False))
                held, at = held + to - at, to
                if held >= rows or sum(len(q[0]) for q in parts) >= cells:
                    yield block()
                    number, held, labels, parts = number + 1, 0, [], []
        if held:
            yield block()

    known = points.filter("features is not null and label is not null")
    return known.select(F.col("features").cast("array<double>").alias("features"), F.col("label").cast("double").alias("label")).mapInArrow(deal, _TILE)


def block_products(tiles: DataFrame, width: int = WIDTH) -> DataFrame:
    """cb, products: of each column block its columns' products a <= b other than 0, as (a, b, v). A task sums those
    of one column block at a time, since tiles come to it in that order."""

    def multiply(batches):
        import pyarrow as pa

        of, total = None, None

        def done():
            a, b = np.nonzero(np.triu(total))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), of)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b])], ["cb", "a", "b", "v"])

        for batch in batches:
            for cb, p, c, x in zip(*(batch.column(k) for k in ("cb", "p", "c", "x")), strict=True):
                if cb.as_py() != of:
                    if of is not None:
                        yield done()
                    of, total = cb.as_py(), np.zeros((width, width))
                rows, p = np.unique(p.values.to_numpy(), return_inverse=True)
                cols, c = np.unique(c.values.to_numpy(), return_inverse=True)
                dense = np.zeros((len(rows), len(cols)))
                dense[p, c] = x.values.to_numpy()
                total[np.ix_(cols, cols)] += dense.T @ dense
        if of is not None:
            yield done()

    met = tiles.filter("cb >= 0").select("cb", "p", "c", "x").mapInArrow(multiply, "cb bigint, a int, b int, v double")
    return met.groupBy("cb", "a", "b").agg(F.sum("v").alias("v")).groupBy("cb").agg(F.collect_list(F.struct("a", "b", "v")).alias("products"))


def pass_over(residual: DataFrame, tiles: DataFrame, last: int | None, change: DataFrame | None, following: int | None, width: int = WIDTH) -> DataFrame:
    """rb, r: the residual less the changes of block `last`. In a row of each task with a null rb, g: the sum of
    products of block `following` with it, and e: the sum of its squares."""
    none = F.lit(None)
    old = tiles.filter(F.col("cb") == (-2 if last is None else last)).select("rb", "cb", F.col("p").alias("p0"), F.col("c").alias("c0"), F.col("x").alias("x0"))
    old = old.withColumn("change", none.cast("array<double>")).drop("cb") if change is None else old.join(F.broadcast(change.select("cb", "change")), "cb").drop("cb")
    new = tiles.filter(F.col("cb") == (-2 if following is None else following)).select("rb", F.col("p").alias("p1"), F.col("c").alias("c1"), F.col("x").alias("x1"))

    def step(batches):
        import pyarrow as pa

        g, e, schema = np.zeros(width), 0.0, pa.schema([("rb", pa.int64()), ("r", pa.list_(pa.float64())), ("g", pa.list_(pa.float64())), ("e", pa.float64())])
        for batch in batches:
            out = []
            for r, p0, c0, x0, change, p1, c1, x1 in zip(*batch.columns[1:], strict=True):
                r = r.values.to_numpy()
                if p0.is_valid:
                    r = r - np.bincount(p0.values.to_numpy(), x0.values.to_numpy() * change.values.to_numpy()[c0.values.to_numpy()], len(r))
                if p1.is_valid:
                    g += np.bincount(c1.values.to_numpy(), x1.values.to_numpy() * r[p1.values.to_numpy()], width)
                e += float(r @ r)
                out.append(r)
            n = len(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(out, pa.float64()), pa.nulls(n, pa.list_(pa.float64())), pa.nulls(n, pa.float64())], schema=schema)
        yield pa.RecordBatch.from_pylist([{"rb": None, "r": None, "g": g.tolist(), "e": e}], schema=schema)

    met = residual.filter("rb is not null").select("rb", "r").join(old, "rb", "left").join(new, "rb", "left")
    return met.select("rb", "r", "p0", "c0", "x0", "change", "p1", "c1", "x1").mapInArrow(step, "rb bigint, r array<double>, g array<double>, e double")


def steps(passed: DataFrame, products: DataFrame, block: int, before: DataFrame | None, width: int = WIDTH) -> DataFrame:
    """cb, w, change: one row, of the block's weights after a step for each of its columns in turn; columns of zeros
    have no weight."""
    sums = passed.filter("rb is null").select(F.posexplode("g").alias("a", "v")).groupBy("a").agg(F.sum("v").alias("v"))
    one = sums.agg(F.sort_array(F.collect_list(F.struct("a", "v"))).alias("g")).select(F.lit(block).cast("bigint").alias("cb"), F.transform("g", lambda s: s["v"]).alias("g"))
    one = one.join(products.filter(F.col("cb") == block), "cb")
    one = one.withColumn("w", F.lit(None).cast("array<double>")) if before is None else one.join(before.select("cb", "w"), "cb", "left")

    def solve(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for cb, g, m, w in zip(*(batch.column(k) for k in ("cb", "g", "products", "w")), strict=True):
                m, g = m.values, g.values.to_numpy().copy()
                a, b, v = (m.field(k).to_numpy() for k in ("a", "b", "v"))
                full = np.zeros((width, width))
                full[a, b] = full[b, a] = v
                w = np.nan_to_num(w.values.to_numpy(zero_copy_only=False)) if w.is_valid else np.zeros(width)
                own = np.diag(full)
                change = np.zeros(width)
                for j in np.flatnonzero(own > 0):
                    change[j] = (g[j] + own[j] * w[j]) / own[j] - w[j]
                    g -= full[j] * change[j]
                w = [x if used else None for x, used in zip((w + change).tolist(), own > 0, strict=True)]
                out.append({"cb": cb.as_py(), "w": w, "change": change.tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("cb", pa.int64()), ("w", pa.list_(pa.float64())), ("change", pa.list_(pa.float64()))]))

    return one.mapInArrow(solve, "cb bigint, w array<double>, change array<double>")


def error_trace(points: DataFrame, sweeps: int) -> DataFrame:
    """iteration (0: before), error."""
    errors = descend(points, sweeps)[1]
    return points.sparkSession.createDataFrame(list(enumerate(errors)), "iteration bigint, error double")


def descend(points: DataFrame, sweeps: int, width: int = WIDTH, rows: int = ROWS) -> tuple[DataFrame, list[float]]:
    """(j, w) and the error before and after each sweep, from w = 0.

    Rows with null features or label are left out, null components are 0, repeated rows count as often as they
    are there, and rows may differ in length. Without a column other than 0 there are no weights, and the error stays.
    """
    spark: SparkSession = points.sparkSession
    scratch = Scratch(spark, "descent")
    tiles = scratch.save(row_blocks(points, width, rows).sortWithinPartitions("cb", "rb"))
    products = scratch.save(block_products(tiles, width))
    blocks = [r.cb for r in products.select("cb").orderBy("cb").collect()]
    passed, seen = scratch.measure(pass_over(tiles.filter("cb = -1").select("rb", F.col("y").alias("r")), tiles, None, None, blocks[0] if blocks else None, width), F.sum("e").alias("e"))
    errors = [seen["e"] or 0.0]
    weights: dict[int, DataFrame] = {}
    visits = [(s, k) for s in range(sweeps) for k in range(len(blocks))]
    for at, (_, k) in enumerate(visits):
        block, before = blocks[k], weights.get(blocks[k])
        weights[block] = scratch.save(steps(passed, products, block, before, width))
        following = blocks[visits[at + 1][1]] if at + 1 < len(visits) else None
        last, (passed, seen) = passed, scratch.measure(pass_over(passed, tiles, block, weights[block], following, width), F.sum("e").alias("e"))
        scratch.drop(last, *[before] if before is not None else [])
        if k + 1 == len(blocks):
            errors.append(seen["e"])
    errors += errors[:1] * (sweeps + 1 - len(errors))
    if not weights:
        return spark.createDataFrame([], "j bigint, w double"), errors
    found = spark.read.schema("cb bigint, w array<double>").parquet(*[w.scratch_path for w in weights.values()])
    return found.select("cb", F.posexplode("w").alias("c", "w")).filter("w is not null").select((F.col("cb") * width + F.col("c")).alias("j"), "w"), errors
