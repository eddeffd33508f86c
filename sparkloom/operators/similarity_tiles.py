"""Top-k similarity by a grid of row blocks, each two blocks a tile that finishes its similarities.

What leaves a tile is bounded: at most k neighbours for each of its rows, so at most k a block for each query are exchanged
and merged, where the join by columns exchanges every pair. A cell goes only to tiles of its block and one that has a
cell of its column, so a tile is there only for blocks that share a column, and cells are shuffled as often as
their columns have blocks: where rows in order are alike, that is a few times, whatever the number of rows. Where columns
are spread over more blocks than they have pairs of rows to form, `similarity.neighbors` sends lists (similarity_lists).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.scratch import Scratch, save
from sparkloom.operators.similarity import MEASURES, indexed, row_norms
from sparkloom.operators.sparse import normalize, prefix_sum

#: Cells and rows of a row block (a row more at most); similarities, or products of cells, that a tile holds at a time.
CELLS, ROWS, HELD = 1 << 19, 1 << 14, 1 << 22

_LIST = "query bigint, neighbor bigint, sim double"


def row_blocks(m: DataFrame, measure: str, cells: int = CELLS, rows: int = ROWS) -> DataFrame:
    """described() cells with `block`: runs of rows in order that together have about `cells` cells and at most `rows`
    rows. Rows of more than `cells` cells have none (null)."""
    m = save(m.select("row", "col", F.col("val").cast("double").alias("val")), "cells")
    norms = save(row_norms(m, measure), "norms")
    short = norms.filter(F.col("cells") <= cells).select("row", F.greatest("cells", F.lit(-(-cells // rows))).alias("weight"))
    numbered = prefix_sum(short, "row", "weight").select("row", F.expr(f"before div {cells}").alias("block"))
    return m.join(norms.join(numbered, "row", "left"), "row")


def column_blocks(blocked: DataFrame) -> DataFrame:
    """col, at, n, each: of each column the blocks that have a cell of it, its cells in blocks, and those of each block."""
    each = blocked.filter("block is not null").groupBy("col", "block").agg(F.count("*").alias("n"))
    told = each.groupBy("col").agg(F.collect_list(F.struct("block", "n")).alias("each"), F.sum("n").alias("n"))
    return told.select("col", F.col("each.block").alias("at"), "n", "each")


def products(r1: np.ndarray, lo: np.ndarray, n: np.ndarray, held: int):
    """(of, to): numbers of left cells, and of the right cells that each meets, which are n from lo on; about `held` at a
    time."""
    upto = np.cumsum(n)
    at = 0
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + held, "right")))
        of = np.repeat(np.arange(at, end), n[at:end])
        first = np.cumsum(n[at:end]) - n[at:end]
        yield of, np.arange(len(of)) - np.repeat(first - lo[at:end], n[at:end])
        at = end


def best(query: np.ndarray, other: np.ndarray, x: np.ndarray, nnbrs: int) -> tuple[np.ndarray, ...]:
    """The `nnbrs` best of each query (-1: all), ties to the smaller neighbour."""
    if nnbrs == -1 or not len(query):
        return query, other, x
    order = np.lexsort((other, -x, query))
    query, other, x = query[order], other[order], x[order]
    at = np.arange(len(query))
    keep = at - np.maximum.accumulate(np.where(np.r_[True, query[1:] != query[:-1]], at, 0)) < nnbrs
    return query[keep], other[keep], x[keep]


def tile_lists(blocked: DataFrame, measure: str, minsim: float, nnbrs: int, blocks: int, held: int = HELD, columns: DataFrame | None = None) -> DataFrame:
    """query, neighbor, sim: of each tile its rows' `nnbrs` best (-1: all) with sim >= minsim. columns: column_blocks().
    Where cells have `pre` and `free` (see similarity.indexed), only pairs that share a column in both prefixes, or with a
    free row, are formed; all that they share is in the tile, which completes them."""
    prefix = "pre" in blocked.columns
    columns = column_blocks(blocked) if columns is None else columns
    more = ["pre", "free"] if prefix else []
    sent = blocked.filter("block is not null").join(columns.select("col", "at"), "col").select("block", F.explode("at").alias("with"), "row", "col", "val", F.col("a").cast("double").alias("a"), *more)
    sent = sent.select(F.least("block", "with").alias("q"), F.greatest("block", "with").alias("h"), "block", "row", "col", "val", "a", *more)
    counted = prefix or not minsim > 0

    def side(t):
        t = t.take(np.lexsort((t.column("col").to_numpy(), t.column("row").to_numpy())))
        rows, r = np.unique(t.column("row").to_numpy(), return_inverse=True)
        a = np.zeros(len(rows))
        a[r] = t.column("a").to_numpy()
        flags = [t.column(c).to_numpy(zero_copy_only=False) for c in more]
        return rows, r, t.column("col").to_numpy(), t.column("val").to_numpy(), a, flags

    def tile(key, table):
        import pyarrow as pa
        import pyarrow.compute as pc

        q, h = (k.as_py() for k in key)
        rows1, r1, c1, v1, a1, f1 = side(table.filter(pc.equal(table.column("block"), q)))
        rows2, r2, c2, v2, a2, f2 = side(table.filter(pc.equal(table.column("block"), h))) if q != h else (rows1, r1, c1, v1, a1, f1)
        by = np.argsort(c2, kind="stable")
        r2, c2, v2, f2 = r2[by], c2[by], v2[by], [f[by] for f in f2]
        lo = np.searchsorted(c2, c1, "left")
        n = np.searchsorted(c2, c1, "right") - lo
        step = max(1, held // max(1, len(rows2)))
        cuts = np.searchsorted(r1, np.arange(0, len(rows1) + step, step))
        own, theirs = [], []
        for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            size = (min(len(rows1), (i + 1) * step) - i * step) * len(rows2)
            s, met = np.zeros(size), np.zeros(size) if counted else None
            for of, to in products(r1[x:y], lo[x:y], n[x:y], held):
                of = of + x
                at = (r1[of] - i * step) * len(rows2) + r2[to]
                s += np.bincount(at, np.minimum(v1[of], v2[to]) if measure == "minmax" else v1[of] * v2[to], size)
                if counted:
                    met += np.bincount(at, (f1[0][of] & f2[0][to]) | f1[1][of] | f2[1][to] if prefix else None, size)
            at = np.flatnonzero(met if counted else s)
            s, one, two = s[at], at // len(rows2) + i * step, at % len(rows2)
            with np.errstate(all="ignore"):
                rest = a1[one] + a2[two] - s
                sim = s if measure == "dot" else s / rest
            good = ~np.isnan(sim) & (sim >= minsim) & (True if measure == "dot" else rest != 0)
            one, two, sim = rows1[one[good]], rows2[two[good]], sim[good]
            own.append(best(one, two, sim, nnbrs))
            if q != h:
                theirs.append(best(two, one, sim, nnbrs))
        lists = own + ([best(*(np.concatenate(c) for c in zip(*theirs, strict=True)), nnbrs)] if theirs else [])
        return pa.table(dict(zip(("query", "neighbor", "sim"), (np.concatenate(c) for c in zip(*lists, strict=True)), strict=True)))

    # A task for each block at least, since blocks are full, but no more than there may be tiles.
    parts = min(max(blocks, int(blocked.sparkSession.conf.get("spark.sql.shuffle.partitions"))), blocks * (blocks + 1) // 2)
    return sent.repartition(parts, "q", "h").groupBy("q", "h").applyInArrow(tile, _LIST)


def _of_long_rows(blocked: DataFrame, measure: str, minsim: float) -> DataFrame:
    """query, neighbor, sim of pairs with a row that is in no block, by the columns that they share."""
    one = blocked.filter("block is null").select("col", F.col("row").alias("r1"), F.col("val").alias("v1"), F.col("a").alias("a1"))
    two = blocked.select("col", F.col("row").alias("r2"), F.col("val").alias("v2"), F.col("a").alias("a2"), F.col("block").isNull().alias("long"))
    term = F.least("v1", "v2") if measure == "minmax" else F.col("v1") * F.col("v2")
    p = one.join(two, "col").groupBy("r1", "r2").agg(F.sum(term).alias("s"), F.max(F.col("a1") + F.col("a2")).alias("own"), F.first("long").alias("long"))
    sim = F.col("s") if measure == "dot" else F.try_divide(F.col("s"), F.col("own") - F.col("s"))
    p = p.withColumn("sim", sim).filter(F.col("sim").isNotNull() & ~F.isnan("sim") & (F.col("sim") >= minsim))
    return p.select(F.col("r1").alias("query"), F.col("r2").alias("neighbor"), "sim").unionByName(p.filter("not long").select(F.col("r2").alias("query"), F.col("r1").alias("neighbor"), "sim"))


def ranked(lists: DataFrame, nnbrs: int) -> DataFrame:
    """query, neighbor, rank, sim: lists with ranks, of each query `nnbrs` (-1: all)."""
    r = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "neighbor")).cast("bigint"))
    return (r if nnbrs == -1 else r.filter(F.col("rank") <= nnbrs)).select("query", "neighbor", "rank", "sim")


def grid_lists(m: DataFrame, measure: str, minsim: float, nnbrs: int, cells: int = CELLS, rows: int = ROWS, prefix: bool = False, pays: bool = False) -> DataFrame | None:
    """query, neighbor, sim of all tiles, and of rows longer than a block. With `pays`: by lists (similarity_lists, for which
    `prefix` is not needed) where columns are spread over so many blocks that more cells would be sent than pairs of rows
    are to be formed, and None where a row is longer than a block or there is none."""
    scratch = Scratch(m.sparkSession, "grid")
    blocked, seen = scratch.measure(row_blocks(m, measure, cells, rows), F.max("block").alias("last"), F.count_if(F.col("block").isNull()).alias("long"))
    pairs, sent = F.sum(F.col("n") * (F.col("n") + 1.0) / 2).alias("pairs"), F.sum(F.col("n") * F.size("at")).alias("sent")
    columns, told = scratch.measure(column_blocks(blocked), pairs, sent)
    if pays and (seen["long"] or seen["last"] is None):
        return None
    if pays and told["sent"] > told["pairs"]:
        from sparkloom.operators.similarity_lists import block_lists

        return block_lists(blocked, measure, minsim, nnbrs, seen["last"] + 1, columns)
    known = scratch.save(indexed(blocked, measure, minsim)) if prefix and minsim > 0 else blocked
    parts = [tile_lists(known, measure, minsim, nnbrs, seen["last"] + 1, columns=columns)] if seen["last"] is not None else []
    if seen["long"] or not parts:
        parts.append(_of_long_rows(blocked, measure, minsim))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def tiled_neighbors(m: DataFrame, measure: str = "jaccard", minsim: float = 0.25, nnbrs: int = 100, cells: int = CELLS, rows: int = ROWS) -> DataFrame:
    """query, neighbor, rank, sim: what `similarity.neighbors` gives, by the rules stated there.

    Two blocks are multiplied once, for the queries of both. A task holds the cells that two blocks share columns by, and
    some of the similarities of their rows. Rows of more than `cells` cells meet the others by columns, outside the grid,
    so no task holds one. Rows, columns and values are whole: cells with a null are left out. Where the grid would send more
    than the lists of its columns (short columns that lie in many blocks), these are sent to blocks of rows (row_lists).
    """
    if measure not in MEASURES:
        raise ValueError(f"measure must be one of {MEASURES}")
    m = m.filter("row is not null and col is not null and val is not null")
    if [m.schema[c].dataType.typeName() for c in ("row", "col", "val")] == ["long", "long", "double"]:
        from sparkloom.operators.row_lists import neighbors_if_pays

        m = save(m, "matrix")
        found = neighbors_if_pays(m, measure, minsim, nnbrs, cells)
        if found is not None:
            return found
    if measure == "cosine":
        m, measure = normalize(m, "row", 2), "dot"
    return ranked(grid_lists(m, measure, minsim, nnbrs, cells, rows), nnbrs)
