"""Matrices as (i, j, v), vectors as (i, v); products and elimination work on square tiles.

Absent cells are 0, cells given more than once add up, and cells with a null in i, j or v are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.scratch import Scratch
from sparkloom.operators import row_lists
from sparkloom.operators.sparse import prefix_sum

#: Rows and columns of a tile, and tiles a side that one task multiplies at a time.
SIDE, TOGETHER = 256, 4
#: Matrices of fewer cells than this share of their tiles are multiplied cell by cell, in blocks of at most so many rows of
#: the left or columns of the right and about so many cells; so many products or places are held at a time.
FULL, ROWS, CELLS, HELD = 1 / 32, 1 << 13, 1 << 18, 1 << 21


def mat_vec(a: DataFrame, x: DataFrame) -> DataFrame:
    """i, v."""
    return a.join(x.select(F.col("i").alias("j"), F.col("v").alias("x")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def tiles(m: DataFrame, side: int = SIDE) -> DataFrame:
    """bi, bj, cells: tiles that have cells, each with its distinct cells as (p, v), p = row * side + column in the tile.
    One exchange: what is dealt by tile is summed by cell and gathered where it lies."""
    known = m.filter("i is not null and j is not null and v is not null")
    dealt = known.select(F.expr(f"i div {side}").alias("bi"), F.expr(f"j div {side}").alias("bj"), F.expr(f"cast(i % {side} * {side} + j % {side} as int)").alias("p"), "v").repartition("bi", "bj")
    return dealt.groupBy("bi", "bj", "p").agg(F.sum("v").alias("v")).groupBy("bi", "bj").agg(F.collect_list(F.struct("p", "v")).alias("cells"))


def mat_mat(a: DataFrame, b: DataFrame, side: int = SIDE, together: int = TOGETHER, full: float = FULL) -> DataFrame:
    """i, j, v where a row and a column share an inner index, so that sums of 0 stay. Integral values give exact bigint
    sums (an error beyond 2^63), others double.

    Where both matrices' tiles of `side` x `side` have at least the share `full` of their cells, dense tiles are multiplied
    (dense_product), else cells: in blocks of rows that are sent whole rows of the right as packed lists (list_product) where
    these are short and lie in many blocks, else in blocks of rows and of columns (sparse_product)."""
    whole = all(m.schema["v"].dataType.typeName() in ("byte", "short", "integer", "long") for m in (a, b))
    kind = "bigint" if whole else "double"
    scratch = Scratch(a.sparkSession, "product")
    known = lambda m: m.filter("i is not null and j is not null and v is not null").groupBy(F.col("i").cast("bigint"), F.col("j").cast("bigint")).agg(F.sum(F.col("v").cast(kind)).alias("v")).toDF("i", "j", "v")
    a, b = (scratch.save(known(m)) for m in (a, b))
    share = [m.groupBy(F.expr(f"i div {side}"), F.expr(f"j div {side}")).count().agg(F.avg("count")).first()[0] for m in (a, b)]
    if all(n is not None and n >= full * side * side for n in share):
        return dense_product(a, b, kind, scratch, side, together)
    product = list_product(a, b, kind, scratch) if lists_pay(a, b) else None
    return sparse_product(a, b, kind, scratch) if product is None else product


def lists_pay(a: DataFrame, b: DataFrame, rows: int = ROWS, cells: int = CELLS) -> bool:
    """Whether list_product sends fewer bytes than sparse_product, by the most that either can send; a cell of a list has
    about a fifth of the bytes of one that is sent alone."""
    blocks = lambda m, c: F.lit(float(max(-(-x // y) for x, y in zip(m.agg(F.count("*"), F.count_distinct(c)).first(), (cells, rows), strict=True))))
    n = a.groupBy(F.col("j").alias("k")).agg(F.count("*").cast("double").alias("x")).join(b.groupBy(F.col("i").alias("k")).agg(F.count("*").cast("double").alias("y")), "k")
    told = n.agg(F.sum(F.col("x") * F.col("y")).alias("lists"), F.sum(F.col("x") * F.least("y", blocks(b, "j")) + F.col("y") * F.least("x", blocks(a, "i"))).alias("alone")).first()
    return bool(told.lists) and told.lists <= 5 * told.alone


def list_product(a: DataFrame, b: DataFrame, kind: str, scratch: Scratch, work: int = row_lists.WORK, size: int = row_lists.CELLS) -> DataFrame | None:
    """i, j, v of distinct cells without nulls. Each block of rows of a is sent the rows of b that it meets, packed, and
    finishes its rows; no product or partial sum is exchanged. None where a row of a meets more than row_lists.ROW cells."""
    n = b.groupBy(F.col("i").alias("j")).agg(F.count("*").alias("n"))
    left = a.join(n, "j").select(F.col("i").alias("row"), F.col("j").alias("col"), F.col("v").alias("val"), "n")
    blocked, longest, total = row_lists.row_blocks(left, False, scratch, work)
    if longest > row_lists.ROW:
        return None
    none, no = F.lit(0).cast("bigint"), F.lit(0.0).alias("a")
    has = blocked.select("col", "block", none.alias("row"), F.lit(0).cast(kind).alias("val"), no, F.lit(True).alias("has"), F.lit(False).alias("listed"))
    listed = b.select(F.col("i").alias("col"), none.alias("block"), F.col("j").alias("row"), F.col("v").alias("val"), no, F.lit(False).alias("has"), F.lit(True).alias("listed"))
    both = has.unionByName(listed)
    parts = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-both.count() // row_lists.EACH))
    table, cells = row_lists.runs(both, parts, scratch, size)
    whole = kind == "bigint"

    def finish(own, lists):
        (i, k, x, _), (head, n, j, y, _) = own, lists
        exact = _exact(x, y, min(len(x), len(y)), whole)
        for row, col, v, _, _ in row_lists.met((i, k, x.astype(exact)), (head, n, j, y.astype(exact)), np.multiply):
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(col), pa.array(v.astype(np.int64) if whole else v)], ["i", "j", "v"])

    return row_lists.by_blocks(blocked, table, cells, total, finish, f"i bigint, j bigint, v {kind}", False, scratch, once=True, block=work)


def _exact(x: np.ndarray, y: np.ndarray, inner: int, whole: bool):
    """The type of numbers in which sums of `inner` products are exact."""
    most = float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(y.astype(float)).max(initial=0)) * inner
    return np.float64 if not whole or most < 2**53 else np.int64 if most < 2**62 else object


def _numbered(m: DataFrame, of: str, rows: int, cells: int) -> DataFrame:
    """of, block: runs of values of `of` in order that together have about `cells` cells and number at most `rows`, one more
    at an end. A value of more cells is a block of its own, or with some before it."""
    n = m.groupBy(of).agg(F.greatest(F.count("*"), F.lit(-(-cells // rows))).alias("weight"))
    return prefix_sum(n, of, "weight").select(of, F.expr(f"before div {cells}").alias("block"))


def meetings(a: DataFrame, b: DataFrame, scratch: Scratch, rows: int = ROWS, cells: int = CELLS) -> tuple[DataFrame, int, int]:
    """gi, gj, part, left, at, k, v: of each block of rows of a (gi) and block of columns of b (gj) the cells by which they
    meet, each by its row or column `at` and inner index k, and the numbers of blocks and parts. Cells go only to blocks
    that have their inner index, so to no more than there are products to form by them. Inner indices are dealt to
    parts, more than one where a row or a column has more than `cells` cells."""
    longest = max(m.groupBy(c).count().agg(F.max("count")).first()[0] or 0 for m, c in ((a, "i"), (b, "j")))
    parts = max(1, -(-longest // cells))
    at = [m.join(scratch.save(_numbered(m, c, rows, cells * parts)), c).select("block", F.col(c).alias("at"), F.col(k).alias("k"), "v") for m, c, k in ((a, "i", "j"), (b, "j", "i"))]
    (one, seen1), (two, seen2) = (scratch.measure(m, F.max("block").alias("last")) for m in at)
    of = lambda m: m.groupBy("k").agg(F.collect_set("block").alias("with"))
    part = F.pmod(F.xxhash64("k"), F.lit(parts)).cast("int").alias("part")
    sent = one.join(of(two), "k").select(F.col("block").alias("gi"), F.explode("with").alias("gj"), part, F.lit(True).alias("left"), "at", "k", "v")
    back = two.join(of(one), "k").select(F.explode("with").alias("gi"), F.col("block").alias("gj"), part, F.lit(False).alias("left"), "at", "k", "v")
    return sent.unionByName(back), max(-1 if s["last"] is None else s["last"] for s in (seen1, seen2)) + 1, parts


def multiplied(i, k1, x, j, k2, y, whole: bool, held: int = HELD):
    """Rows, columns and values of the product of cells (i, k1, x) and (k2, j, y), in slices of whole rows of which each
    holds about `held` products and places."""
    rows, i = np.unique(i, return_inverse=True)
    cols, j = np.unique(j, return_inverse=True)
    order, by = np.argsort(i, kind="stable"), np.argsort(k2, kind="stable")
    i, k1, x, j, k2, y = i[order], k1[order], x[order], j[by], k2[by], y[by]
    kind = _exact(x, y, min(len(x), len(y)), whole)
    x, y = x.astype(kind), y.astype(kind)
    lo = np.searchsorted(k2, k1, "left")
    n = np.searchsorted(k2, k1, "right") - lo
    first = np.searchsorted(i, np.arange(len(rows) + 1))
    upto = np.r_[0, np.cumsum(n)][first]
    step, r = max(1, held // max(1, len(cols))), 0
    while r < len(rows):
        end = min(r + step, max(r + 1, int(np.searchsorted(upto, upto[r] + held, "right")) - 1), len(rows))
        here = slice(first[r], first[end])
        of = np.repeat(np.arange(here.start, here.stop), n[here])
        to = np.arange(len(of)) - np.repeat(np.cumsum(n[here]) - n[here] - lo[here], n[here])
        at, size = (i[of] - r) * len(cols) + j[to], (end - r) * len(cols)
        if kind is np.float64:
            s = np.bincount(at, x[of] * y[to], size)
        else:
            s = np.zeros(size, kind)
            np.add.at(s, at, x[of] * y[to])
        met = np.zeros(size, bool)
        met[at] = True
        at = np.flatnonzero(met)
        yield rows[at // len(cols) + r], cols[at % len(cols)], s[at].astype(np.int64) if whole else s[at]
        r = end


def sparse_product(a: DataFrame, b: DataFrame, kind: str, scratch: Scratch, rows: int = ROWS, cells: int = CELLS) -> DataFrame:
    """i, j, v of distinct cells without nulls. Each block of rows of a and block of columns of b that share an inner index
    form their products and finish their sums in one group, so cells are exchanged and products are not; its rows
    leave it in slices. Only where the longest row or column is more than a block's cells do the parts of
    the inner index give sums that are added up."""
    met, blocks, parts = meetings(a, b, scratch, rows, cells)
    whole = kind == "bigint"

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        left = t.column("left").to_numpy()
        at, k, v = (t.column(c).to_numpy() for c in ("at", "k", "v"))
        for i, j, x in multiplied(at[left], k[left], v[left], at[~left], k[~left], v[~left], whole):
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(x)], ["i", "j", "v"])

    # A task for each block at least, since blocks are full.
    tasks = max(blocks * parts, int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = ["gi", "gj", "part"]
    out = met.repartition(tasks, *keys).groupBy(*keys).applyInArrow(tile, f"i bigint, j bigint, v {kind}")
    return out if parts == 1 else out.groupBy("i", "j").agg(F.sum("v").alias("v"))


def dense_product(a: DataFrame, b: DataFrame, kind: str, scratch: Scratch, side: int = SIDE, together: int = TOGETHER) -> DataFrame:
    """i, j, v of cells without nulls.

    Tiles meet by inner block, in groups of `together` tiles a side, so a task holds that many tiles of each matrix and
    their product, whatever the matrices and however many cells an inner block has. A group's product is
    summed over the inner block before it leaves the task; sums over the inner blocks are one aggregate of cells.
    """
    whole = kind == "bigint"
    left = scratch.save(tiles(a, side).select(F.col("bj").alias("k"), F.expr(f"bi div {together}").alias("gi"), F.col("bi").alias("block"), "cells"))
    right = scratch.save(tiles(b, side).select(F.col("bi").alias("k"), F.expr(f"bj div {together}").alias("gj"), F.col("bj").alias("block"), "cells"))
    rows, cols = left.groupBy("k", "gi").count().toDF("k", "gi", "n"), right.groupBy("k", "gj").count().toDF("k", "gj", "n")
    left, right = left.join(cols, "k").toDF(*"k", "gi", "block", "cells", "gj", "n"), right.join(rows, "k").toDF(*"k", "gj", "block", "cells", "gi", "n")

    def unpacked(table):
        """Block number, place and value of each cell."""
        cells = table.column("cells").combine_chunks()
        flat = cells.flatten()
        block = np.repeat(table.column("block").to_numpy(), cells.value_lengths().to_numpy(zero_copy_only=False))
        return block, flat.field("p").to_numpy(), flat.field("v").to_numpy()

    def product(one, other):
        block, p, x = unpacked(one)
        block, p = block * side + p // side, p % side
        other_block, q, y = unpacked(other)
        other_block, q = other_block * side + q % side, q // side
        if not (np.isfinite(x).all() and np.isfinite(y).all()):  # times an absent cell they are no number
            return pa.table(dict(zip(("i", "j", "v"), (np.concatenate(c) for c in zip(*multiplied(block, p, x, other_block, q, y, whole), strict=True)), strict=True)))
        rows, i = np.unique(block, return_inverse=True)
        cols, j = np.unique(other_block, return_inverse=True)
        inner, k = np.unique(np.r_[p, q], return_inverse=True)
        exact = _exact(x, y, len(inner), whole)
        l, r = np.zeros((len(rows), len(inner)), exact), np.zeros((len(inner), len(cols)), exact)
        l[i, k[: len(p)]], r[k[len(p) :], j] = x, y
        met_l, met_r = (np.zeros(m.shape, np.float32) for m in (l, r))
        met_l[i, k[: len(p)]], met_r[k[len(p) :], j] = 1, 1
        at, to = np.nonzero(met_l @ met_r)
        v = (l @ r)[at, to]
        return pa.table({"i": rows[at], "j": cols[to], "v": v.astype(np.int64) if whole else v})

    keys = ["gi", "gj", "k"]
    out = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(product, f"i bigint, j bigint, v {kind}")
    return out.groupBy("i", "j").agg(F.sum("v").alias("v"))


def _panel(side: int):
    """Of the tiles of block row and block column k, with tile (k, k) beside each: the finished tiles of U and y in the row,
    the multipliers in the column."""

    def solve(batches):
        import pyarrow as pa

        last, inverse, upper = None, None, None
        for batch in batches:
            out = []
            for bi, bj, t, pivot in zip(*(batch.column(c) for c in ("bi", "bj", "t", "pivot")), strict=True):
                d = pivot.values.to_numpy()
                if last is None or not np.array_equal(d, last, equal_nan=True):
                    last = d
                    m = np.c_[d.reshape(side, side), np.eye(side)]
                    for r in range(side):
                        m[r] = m[r] / m[r, r] if m[r, r] else np.nan
                        m[r + 1 :] -= np.outer(m[r + 1 :, r], m[r])
                    upper, inverse = m[:, :side], m[:, side:]
                x = t.values.to_numpy().reshape(side, -1)
                if bi.as_py() == bj.as_py():
                    x = upper
                elif bi.as_py() < bj.as_py():
                    x = inverse @ x
                else:
                    x = np.linalg.solve(upper.T, x.T).T
                out.append(x.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("bi"), batch.column("bj"), _lists(out)], ["bi", "bj", "t"])

    return solve


def _trail(side: int):
    def update(batches):
        import pyarrow as pa

        for batch in batches:
            t, l, u = ([v.values.to_numpy().reshape(side, -1) for v in batch.column(c)] for c in ("t", "l", "u"))
            yield pa.RecordBatch.from_arrays([batch.column("bi"), batch.column("bj"), _lists([(x - y @ z).ravel() for x, y, z in zip(t, l, u, strict=True)])], ["bi", "bj", "t"])

    return update


def _lists(arrays: list[np.ndarray]):
    import pyarrow as pa

    return pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(x) for x in arrays])].astype(np.int32), np.concatenate([*arrays, np.zeros(0)]))


def _dense(side: int, n: int):
    """Tiles as rows of numbers; beyond n the diagonal is 1, and the last block column is the right-hand side alone."""
    last = -(-n // side)

    def fill(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for bi, bj, cells in zip(*(batch.column(c) for c in ("bi", "bj", "cells")), strict=True):
                bi, bj = bi.as_py(), bj.as_py()
                x = np.zeros((side, side))
                if cells.is_valid and len(cells):
                    x.ravel()[cells.values.field("p").to_numpy()] = cells.values.field("v").to_numpy()
                if bi == bj:
                    beyond = np.arange(max(n - bi * side, 0), side)
                    x[beyond, beyond] = 1
                out.append((x[:, :1] if bj == last else x).ravel())
            yield pa.RecordBatch.from_arrays([batch.column("bi"), batch.column("bj"), _lists(out)], ["bi", "bj", "t"])

    return fill


def eliminate(a: DataFrame, b: DataFrame, side: int = SIDE) -> DataFrame:
    """i, j, v of [U | y]: Gaussian elimination without pivoting to a unit upper triangle; column n is y.

    n is the number of rows of b; cells of a outside n x n are left out. The right-hand side is eliminated with the matrix, as the textbook has it. The
    matrix is dense tiles, right-looking: step k finishes block row k and the multipliers of block column k from the
    one tile (k, k), which goes to each of their tiles, and then subtracts the product of both from what is right of and
    below them, by joins on block row and block column. So no row or task holds more than a few tiles. The n / side steps
    follow each other, each cut off by a table in the shared folder.

    Pivots must not be 0: from the first row with a pivot of 0 on, cells on and right of the diagonal are null.
    """
    n = b.count()
    blocks = -(-n // side)
    spark, schema = a.sparkSession, "bi bigint, bj bigint, t array<double>"
    scratch = Scratch(spark, "elimination")
    kept = a.select("i", "j", F.col("v").cast("double").alias("v")).filter(f"i < {n} and j < {n}")
    cells = kept.unionByName(b.select("i", F.lit(blocks * side).cast("bigint").alias("j"), F.col("v").cast("double").alias("v")))
    grid = spark.range(blocks * (blocks + 1)).select(F.expr(f"id div {blocks + 1}").alias("bi"), (F.col("id") % (blocks + 1)).alias("bj"))
    rest = scratch.save(grid.join(tiles(cells, side), ["bi", "bj"], "left").mapInArrow(_dense(side, n), schema))
    panels = []
    for k in range(blocks):
        pivot = rest.filter((F.col("bi") == k) & (F.col("bj") == k)).select(F.col("bi").alias("k"), F.col("t").alias("pivot"))
        edge = rest.filter((F.col("bi") == k) | (F.col("bj") == k)).withColumn("k", F.least("bi", "bj"))
        panel = scratch.save(edge.join(F.broadcast(pivot), "k").select("bi", "bj", "t", "pivot").mapInArrow(_panel(side), schema).withColumn("k", F.lit(k).cast("bigint")))
        panels.append(panel.scratch_path)
        if k + 1 < blocks:
            l = panel.filter(F.col("bi") > k).select("bi", F.col("t").alias("l"))
            u = panel.filter((F.col("bi") == k) & (F.col("bj") > k)).select("bj", F.col("t").alias("u"))
            right = rest.filter((F.col("bi") > k) & (F.col("bj") > k)).join(l, "bi").join(u, "bj")
            done, rest = rest, scratch.save(right.select("bi", "bj", "t", "l", "u").mapInArrow(_trail(side), schema))
            scratch.drop(done)
    if not panels:
        return spark.createDataFrame([], "i bigint, j bigint, v double")
    done = spark.read.schema(schema + ", k bigint").parquet(*panels)
    upper = done.filter("bi = k").select("bi", "bj", "t")
    lower = done.filter("bi > k").select("bi", "bj", F.array_repeat(F.lit(0.0), side * side).alias("t"))
    at = upper.unionByName(lower).select("bi", "bj", F.posexplode("t").alias("p", "v"))
    y = F.col("bj") == blocks
    row, col = F.when(y, F.col("p")).otherwise(F.expr(f"p div {side}")), F.when(y, n).otherwise(F.col("bj") * side + F.col("p") % side)
    at = at.select((F.col("bi") * side + row).alias("i"), col.cast("bigint").alias("j"), y.alias("y"), "v")
    return at.filter((F.col("i") < n) & (F.col("y") | (F.col("j") < n))).select("i", "j", F.when(F.col("j") < F.col("i"), 0.0).otherwise(F.nanvl("v", F.lit(None).cast("double"))).alias("v"))
