"""Thresholded top-k similarity of the rows of a sparse matrix, all queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.scratch import save
from sparkloom.operators.sparse import normalize

MEASURES = ("jaccard", "dot", "cosine", "minmax")


#: Rows of a column's block. A column of more rows is joined as tiles of a block of queries and one of candidates.
TILE = 10_000


def tiles(rows: DataFrame, m: DataFrame, tile: int) -> DataFrame:
    """rows with `block`, of `blocks` blocks of its column. Only columns of more than `tile` cells have several."""
    many = m.groupBy("col").agg(F.count("val").alias("n")).filter(F.col("n") > tile).select("col", F.ceil(F.col("n") / tile).cast("int").alias("blocks"))
    dealt = rows.join(many, "col", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return dealt.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))


def may_reach(measure: str, minsim: float):
    """Whether rows of squared norms (or, for minmax, sums) a1 and a2 can be as similar as `minsim`, from these two
    alone; None if any can. A dot product is at most the product of the norms. For jaccard with r, the smaller norm
    by the larger, that leaves r / (1 + r^2 - r) at most, so r has a least value; a sum of minima is at most the
    smaller sum, if no value is negative (`low`). With a repeated cell in one of the rows (`rep`) nothing of this
    holds, so such pairs stay. Bounds are a trifle loose, for rounding."""
    if not minsim > 0:
        return None
    loose, low, high, free = 1 - 1e-9, F.least("a1", "a2"), F.greatest("a1", "a2"), F.col("rep1") | F.col("rep2")
    if measure == "dot":
        return free | (F.sqrt("a1") * F.sqrt("a2") >= minsim * loose)
    if minsim > 1:
        minsim = 1.0
    if measure == "minmax":
        return free | (F.least("low1", "low2") < 0) | (low >= high * (minsim * loose))
    least = 2 * minsim / ((1 + minsim) + ((1 + minsim) ** 2 - 4 * minsim**2) ** 0.5)
    return free | (low >= high * (least * loose) ** 2)


#: Cells of a row from which on its prefix is the whole row, so that no task orders more of one row.
LONG_ROW = 1_000_000
#: The prefix index is tried if last cells of at least the first share of a row's mass are too little, and used if it
#: forms at most the second share of the pairs that sharing a column forms; completing pairs has its cost, too.
TRIED, GAIN = 0.15, 0.25


def row_norms(m: DataFrame, measure: str) -> DataFrame:
    """Of each row `a`, its squared norm (row sum for minmax), least value `low`, whether a cell repeats, and `cells`."""
    own = F.sum("val") if measure == "minmax" else F.sum(F.col("val") * F.col("val"))
    return m.groupBy("row").agg(own.alias("a"), F.min("val").alias("low"), (F.count_distinct("col") < F.count("*")).alias("rep"), F.count("*").alias("cells"))


def described(m: DataFrame, measure: str) -> DataFrame:
    """m with what row_norms() says of its row."""
    return m.join(row_norms(m, measure), "row")


def indexed(cells: DataFrame, measure: str, minsim: float) -> DataFrame:
    """described() cells with `pre`: whether they are in their row's prefix, and `free`: whether of their row nothing
    of this holds, so that all of its pairs must be formed.

    Columns are ordered from rare to frequent. The last cells of a row that together cannot bring it to `minsim` with
    any other row are no part of its prefix; the rest is. With mass s of the last cells (squares; for minmax values): a
    dot product with a row of norm b is sqrt(s) * b at most, so s < (minsim / largest norm)^2 is too little; for
    jaccard a pair needs a dot product of r / (1 + r) * (a + b), which at best is twice sqrt(a * b) times that, so
    s < (2r / (1 + r))^2 * a is; minima must add up to r * a, since the other sum is r * a at least. Of two rows that
    reach `minsim`, the one whose prefix ends first shares a column with the other in both prefixes: if all that they
    share came later, its last cells would have sufficed."""
    free = F.col("rep") | (F.col("low") < 0) if measure == "minmax" else F.col("rep")
    cells = cells.withColumn("free", free)
    if measure == "dot":
        most = cells.agg(F.sqrt(F.max("a"))).first()[0]
        least = F.lit((minsim / most) ** 2 if most and most < float("inf") else 0.0)
    else:
        r = min(minsim, 1.0)
        least = F.col("a") * (r if measure == "minmax" else (2 * r / (1 + r)) ** 2)
    often = cells.groupBy("col").agg(F.count("*").alias("often"))
    mass = F.col("val") if measure == "minmax" else F.col("val") * F.col("val")
    late = Window.partitionBy("row").orderBy(F.desc("often"), F.desc("col"))
    short = ~F.col("free") & (F.col("cells") <= LONG_ROW)
    kept = cells.filter(~short).withColumn("pre", F.lit(True))
    cut = cells.filter(short).join(often, "col").withColumn("pre", ~(F.sum(mass).over(late) < least * (1 - 1e-9)))
    return kept.unionByName(cut.drop("often")) if minsim > 0 else cells.withColumn("pre", F.lit(True))


def formed(cells: DataFrame) -> tuple[int, int]:
    """Pairs of rows that share a column, and those that do so in both prefixes; columns count each for itself."""
    n = cells.groupBy("col").agg(F.count("*").cast("double").alias("n"), F.count_if("pre").cast("double").alias("p"))
    got = n.agg(*[F.sum(F.col(c) * (F.col(c) + 1) / 2) for c in ("n", "p")]).first()
    return int(got[0] or 0), int(got[1] or 0)


def _tiled(cells: DataFrame, measure: str, minsim: float, tile: int) -> DataFrame:
    """q <= h that share a column of `cells` and by their norms may reach `minsim`, with own, the sum of these, and s,
    the sum of products, or of minima, over the columns that they share here."""
    rows = tiles(cells, cells, tile)
    one = rows.select("col", F.col("row").alias("r1"), F.col("val").alias("v1"), F.col("a").alias("a1"), F.col("low").alias("low1"), F.col("rep").alias("rep1"), F.col("block").alias("b1"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("b2"))
    two = rows.select("col", F.col("row").alias("r2"), F.col("val").alias("v2"), F.col("a").alias("a2"), F.col("low").alias("low2"), F.col("rep").alias("rep2"), F.explode(F.sequence(F.lit(0), "block")).alias("b1"), F.col("block").alias("b2"))
    pairs = one.join(two, ["col", "b1", "b2"]).filter("b1 < b2 or r1 <= r2")
    bound = may_reach(measure, minsim)
    kept = pairs if bound is None else pairs.filter(bound)
    return kept.groupBy(F.least("r1", "r2").alias("q"), F.greatest("r1", "r2").alias("h")).agg(F.sum(_term(measure)).alias("s"), F.max(F.col("a1") + F.col("a2")).alias("own"))


def _term(measure: str):
    return F.least("v1", "v2") if measure == "minmax" else F.col("v1") * F.col("v2")


def _completed(found: DataFrame, cells: DataFrame, measure: str) -> DataFrame:
    """Pairs found by prefixes, with what they share outside: last cells of q with all cells of h, and prefix cells
    of q with last cells of h. The last cells are few, and only those of found pairs are looked at."""
    side = lambda c, row, v: c.select(F.col("row").alias(row), "col", F.col("val").alias(v))
    last, pre, pairs = cells.filter("not pre"), cells.filter("pre"), found.select("q", "h")
    more = [pairs.join(side(last, "q", "v1"), "q").join(side(cells, "h", "v2"), ["h", "col"]), pairs.join(side(last, "h", "v2"), "h").join(side(pre, "q", "v1"), ["q", "col"])]
    rest = [x.select("q", "h", _term(measure).alias("s"), F.lit(None).cast("double").alias("own")) for x in more]
    both = found.select("q", "h", "s", "own").unionByName(rest[0]).unionByName(rest[1])
    return both.groupBy("q", "h").agg(F.sum("s").alias("s"), F.max("own").alias("own"))


def pair_sums(m: DataFrame, measure: str, minsim: float = 0.0, tile: int = TILE, prefix: bool | None = None) -> DataFrame:
    """q <= h that share a column and may reach `minsim`, with own, the sum of their squared norms (or row sums for
    minmax), and s, the sum of products, or of minima.

    A pair's similarity is symmetric, so half of the pairs are formed. The rows of a frequent column are dealt to
    blocks, and each two blocks, or a block and itself, are a tile with a join key of its own: a column with a
    third of all cells is many tasks of at most about `tile` squared pairs.

    With a prefix index (see indexed) only pairs that share a column in both prefixes are formed, and then completed;
    pairs with a row of repeated cells, or for minmax of a negative value, are formed by all their columns. Unless
    `prefix` says so or not, it is used where counts of columns tell that it forms GAIN of the pairs at most; for dot
    products these counts are made for any `minsim`.
    """
    cells, r = described(m, measure), min(minsim, 1.0)
    little = {"jaccard": (2 * r / (1 + r)) ** 2, "minmax": r}.get(measure, 1.0)
    if prefix is False or not minsim > 0 or prefix is None and little < TRIED:
        return _tiled(cells, measure, minsim, tile)
    cells = save(indexed(cells, measure, minsim), "cells")
    if prefix is None:
        whole, few = formed(cells)
        if few > GAIN * whole:
            return _tiled(cells, measure, minsim, tile)
    plain, free = cells.filter("not free"), cells.filter("free")
    found = _completed(save(_tiled(plain.filter("pre"), measure, minsim, tile), "found"), plain, measure)
    if free.isEmpty():
        return found
    odd = free.select("row").distinct().withColumn("odd", F.lit(True))
    any_ = _tiled(cells.join(free.select("col").distinct(), "col", "left_semi"), measure, minsim, tile)
    flag = lambda c: odd.withColumnRenamed("row", c).withColumnRenamed("odd", f"odd_{c}")
    own = any_.join(flag("q"), "q", "left").join(flag("h"), "h", "left").filter("odd_q or odd_h")
    return found.unionByName(own.select("q", "h", "s", "own"))


def neighbors(m: DataFrame, measure: str = "jaccard", minsim: float = 0.25, nnbrs: int = 100, tile: int | None = None, prefix: bool | None = None) -> DataFrame:
    """query, neighbor, rank, sim: of each row the `nnbrs` most similar rows (-1: all) with sim >= minsim.

    Candidates share a column, so a dot product of 0 or less is one too; a row is its own neighbour; a row
    without cells has none. jaccard: dot / (|a|^2 + |b|^2 - dot). dot: the plain product. cosine: dot of rows of
    length 1. minmax: sum of minima / sum of maxima. A pair whose similarity is undefined (0 / 0) is dropped.
    Ties go to the smaller neighbour. `tile` and `prefix` are as in pair_sums and change no result.

    Where the matrix is large and its columns are short, each row is finished in one task that is sent the lists of its
    columns (row_lists). Else, where rows in order share columns, so that fewer cells than pairs are exchanged, pairs are
    formed and finished in tiles of two row blocks (similarity_tiles), elsewhere in a row block that is sent lists
    (similarity_lists). Where a row is longer than a block or a `tile` is given, and for other types, by the join of
    pair_sums.
    """
    if measure not in MEASURES:
        raise ValueError(f"measure must be one of {MEASURES}")
    kept = tile is None and [m.schema[c].dataType.typeName() for c in ("row", "col", "val")] == ["long", "long", "double"]
    if kept:
        from sparkloom.operators import row_lists
        from sparkloom.operators import similarity_tiles as grid

        m = save(m.filter("row is not null and col is not null and val is not null"), "matrix")
        found = row_lists.neighbors_if_pays(m, measure, minsim, nnbrs, grid.CELLS)
        if found is not None:
            return found
    if measure == "cosine":
        m, measure = normalize(m, "row", 2), "dot"
        if prefix is None and minsim**2 < TRIED:  # the share of a row of length 1 that is too little
            prefix = False
    if kept:
        lists = grid.grid_lists(m, measure, minsim, nnbrs, prefix=bool(prefix), pays=True)
        if lists is not None:
            return grid.ranked(lists, nnbrs)
    p = pair_sums(m, measure, minsim, tile or TILE, prefix)
    sim = F.col("s") if measure == "dot" else F.try_divide(F.col("s"), F.col("own") - F.col("s"))
    p = p.select("q", "h", sim.alias("sim")).filter(F.col("sim").isNotNull() & ~F.isnan("sim") & (F.col("sim") >= minsim))
    both = F.when(F.col("q") == F.col("h"), F.array(F.struct(F.col("q").alias("query"), F.col("h").alias("neighbor")))).otherwise(F.array(F.struct(F.col("q").alias("query"), F.col("h").alias("neighbor")), F.struct(F.col("h").alias("query"), F.col("q").alias("neighbor"))))
    p = p.select(F.explode(both).alias("p"), "sim").select("p.query", "p.neighbor", "sim")
    ranked = p.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "neighbor")))
    return (ranked if nnbrs == -1 else ranked.filter(F.col("rank") <= nnbrs)).select("query", "neighbor", F.col("rank").cast("bigint").alias("rank"), "sim")


def similar_rows(m: DataFrame, query: DataFrame, measure: str = "jaccard", minsim: float = 0.25, nnbrs: int = 100) -> DataFrame:
    """neighbor, sim: rows of `m` most similar to one query vector (col, val)."""
    own = "sum(val)" if measure == "minmax" else "sum(val * val)"
    if measure == "cosine":
        m = normalize(m, "row", 2)
        query = normalize(query.select(F.lit(0).alias("row"), "col", "val"), "row", 2).select("col", "val")
        measure = "dot"
    term = F.least("val", "vq") if measure == "minmax" else F.col("val") * F.col("vq")
    s = m.join(query.select("col", F.col("val").alias("vq")), "col").groupBy("row").agg(F.sum(term).alias("s"))
    a = m.groupBy("row").agg(F.expr(own).alias("ah"))
    b = query.agg(F.expr(own).alias("aq"))
    sim = F.col("s") if measure == "dot" else F.try_divide(F.col("s"), F.col("aq") + F.col("ah") - F.col("s"))
    out = s.join(a, "row").join(F.broadcast(b)).select(F.col("row").alias("neighbor"), sim.alias("sim")).filter(F.col("sim").isNotNull() & ~F.isnan("sim") & (F.col("sim") >= minsim)).orderBy(F.desc("sim"), "neighbor")
    return out if nnbrs == -1 else out.limit(nnbrs)
