"""Similarity where columns are spread over many row blocks: each block is sent the lists of its columns, and finishes.

The cells of a column meet in one task. Of each two blocks one, the owner, is sent the other's cells of the columns that
they share, once a block and not once a cell, as arrays packed by bytes. So never more cells are sent than there are
pairs of rows to form (but for a block's own, which go to each of its parts), each of a few bytes, and no pair is
exchanged before it is known to reach the threshold. Of a column, a task holds all cells: where the grid does not pay, a
column has at most sqrt(2 * cells * blocks), since the pairs of one alone are fewer than all cells times all blocks.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.similarity_tiles import _LIST, HELD, best, products

#: Cells of columns that a task packs at a time; cells that it sends at a time; cells and products of a part of a block.
CELLS, SENT, PART, WORK = 1 << 18, 1 << 21, 1 << 22, 1 << 26

_PACKED = "q int, part int, own boolean, n int, cols binary, rows binary, vals binary, norms binary"


def packed(x: np.ndarray) -> bytes:
    """Numbers byte by byte: all first bytes, then all second bytes, and so on, compressed. Numbers of 64 bits that are
    the same in 32 are packed so."""
    import pyarrow as pa

    with np.errstate(all="ignore"):
        short = x.astype(np.uint32 if x.dtype.kind == "i" else np.float32)
    x = short if np.array_equal(short.astype(x.dtype), x) else x
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T), codec="zstd", asbytes=True) + bytes([x.itemsize])


def unpacked(data: bytes, n: int, kind: str) -> np.ndarray:
    """What packed() has packed: n numbers of `kind` i or f."""
    import pyarrow as pa

    size = data[-1]
    planes = np.frombuffer(pa.decompress(data[:-1], decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    short = {"i": np.uint32, "f": np.float32}[kind]
    return np.ascontiguousarray(planes.T).view(short if size == 4 else f"{kind}8").ravel().astype(f"{kind}8", copy=False)


def owns(q: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether q, and not h, is sent the cells of the other: of each two blocks one is, each of about half the others."""
    return np.where((q + h) % 2 == 0, q < h, q > h)


def lists_of(cells: tuple[np.ndarray, ...], parts: np.ndarray, sent: int = SENT):
    """(q, part, own, cells) of whole columns: col, block, row, val, a. A block's own cells go to each of its parts, those
    of a block that it owns to one; about `sent` cells at a time."""
    order = np.lexsort((cells[2], cells[1], cells[0]))
    col, block, row, val, a = (c[order] for c in cells)
    first = np.flatnonzero(np.r_[True, (col[1:] != col[:-1]) | (block[1:] != block[:-1])])
    long, of = np.diff(np.r_[first, len(col)]), block[first]
    begins = np.flatnonzero(np.r_[True, col[first][1:] != col[first][:-1]])
    many = np.diff(np.r_[begins, len(first)])
    lo, n = np.repeat(begins, many), np.repeat(many, many)  # of each run of a column's block, the column's runs
    every = np.arange(len(first))

    def cut(one, two, part, own):
        upto, at = np.cumsum(long[two]), 0
        while at < len(two):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + sent, "right")))
            key = np.lexsort((two[at:end], part[at:end], of[one[at:end]]))
            i, j, p = one[at:end][key], two[at:end][key], part[at:end][key]
            ends = np.flatnonzero(np.r_[(of[i][1:] != of[i][:-1]) | (p[1:] != p[:-1]), True]) + 1
            for x, y in zip(np.r_[0, ends[:-1]], ends, strict=True):
                size = long[j[x:y]]
                to = np.arange(size.sum()) + np.repeat(first[j[x:y]] - (np.cumsum(size) - size), size)
                yield int(of[i[x]]), int(p[x]), own, (col[to], row[to], val[to], a[to])
            at = end

    if len(col):
        copies = parts[of]
        one = np.repeat(every, copies)
        yield from cut(one, one, np.arange(len(one)) - np.repeat(np.cumsum(copies) - copies, copies), True)
        for one, two in products(every, lo, n, sent):
            good = owns(of[one], of[two])
            one, two = one[good], two[good]
            yield from cut(one, two, of[two] % parts[of[one]], False)


def summed(key: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the sums of their values."""
    order = np.argsort(key, kind="stable")
    key, x = key[order], x[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    return key[first], np.add.reduceat(x, first) if len(key) else x


def finished(own: tuple[np.ndarray, ...], others: tuple[np.ndarray, ...], inner: bool, measure: str, minsim: float, nnbrs: int, held: int = HELD):
    """(query, neighbor, sim): of the rows of a block and those of others the `nnbrs` best (-1: all) with sim >= minsim.
    Cells are col, row, val, a. With `inner` the block's rows meet each other, too. A row's products are never parted."""
    own = tuple(x[np.argsort(own[1], kind="stable")] for x in own)
    c1, w1, v1, a1 = own
    c2, w2, v2, a2 = (np.concatenate(x) for x in zip(own, others, strict=True)) if inner else others
    by = np.argsort(c2, kind="stable")
    c2, w2, v2, a2 = c2[by], w2[by], v2[by], a2[by]
    rows1, at1, r1 = np.unique(w1, return_index=True, return_inverse=True)
    rows2, at2, r2 = np.unique(w2, return_index=True, return_inverse=True)
    a1, a2, apart = a1[at1], a2[at2], ~np.isin(rows2, rows1)
    lo = np.searchsorted(c2, c1, "left")
    n = np.searchsorted(c2, c1, "right") - lo
    ends, upto, at = np.r_[at1[1:], len(w1)], np.r_[0, np.cumsum(n)], 0
    theirs, waits = [], 0
    while at < len(rows1):
        x = at1[at]
        end = max(at + 1, int(np.searchsorted(upto[ends], upto[x] + held, "right")))
        y, key, s = ends[end - 1], np.zeros(0, np.int64), np.zeros(0)
        for of, to in products(r1[x:y], lo[x:y], n[x:y], held):
            of = of + x
            more = np.minimum(v1[of], v2[to]) if measure == "minmax" else v1[of] * v2[to]
            key, s = summed(np.r_[key, r1[of] * len(rows2) + r2[to]], np.r_[s, more])
        one, two = key // max(1, len(rows2)), key % max(1, len(rows2))
        with np.errstate(all="ignore"):
            rest = a1[one] + a2[two] - s
            sim = s if measure == "dot" else s / rest
        good = ~np.isnan(sim) & (sim >= minsim) & (True if measure == "dot" else rest != 0)
        one, two, sim = one[good], two[good], sim[good]
        yield best(rows1[one], rows2[two], sim, nnbrs)
        out = apart[two]
        theirs.append((rows2[two[out]], rows1[one[out]], sim[out]))
        waits += int(out.sum())
        if waits > held or nnbrs == -1:
            theirs = [best(*(np.concatenate(c) for c in zip(*theirs, strict=True)), nnbrs)]
            waits = 0
        if nnbrs == -1:
            yield theirs.pop()
        at = end
    if theirs:
        yield best(*(np.concatenate(c) for c in zip(*theirs, strict=True)), nnbrs)


def parts_of(columns: DataFrame, blocks: int, part: int = PART, work: int = WORK) -> np.ndarray:
    """Of each block in how many parts it is finished: one for each `part` cells that it may be sent, or `work` products."""
    each = columns.select(F.explode("each").alias("e"), "n").groupBy("e.block").agg(F.sum("n").alias("cells"), F.sum(F.col("n") * F.col("e.n")).alias("work"))
    parts = np.ones(blocks, np.int64)
    for r in each.select("block", F.greatest(F.ceil(F.col("cells") / (2 * part)), F.ceil(F.col("work") / (2 * work))).alias("parts")).collect():
        parts[r.block] = min(max(1, r.parts), blocks)
    return parts


def block_lists(blocked: DataFrame, measure: str, minsim: float, nnbrs: int, blocks: int, columns: DataFrame, cells: int = CELLS, sent: int = SENT, part: int = PART, work: int = WORK, held: int = HELD) -> DataFrame:
    """query, neighbor, sim: of each part of a block its rows' `nnbrs` best (-1: all), and those of the rows it was sent,
    with sim >= minsim. Blocks have numbers from 0 to `blocks`; columns: similarity_tiles.column_blocks()."""
    parts = parts_of(columns, blocks, part, work)
    least = int(blocked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ("col", "block", "row", "val", "a")

    def taken(batches):
        """Runs of whole columns of about `cells` cells."""
        kept, n = [], 0
        for b in batches:
            kept.append(tuple(b.column(c).to_numpy(zero_copy_only=False) for c in names))
            n += b.num_rows
            if n >= cells:
                x = tuple(np.concatenate(c) for c in zip(*kept, strict=True))
                end = int(np.searchsorted(x[0], x[0][-1], "left"))  # the last column may go on
                if end:
                    yield tuple(c[:end] for c in x)
                kept, n = [tuple(c[end:] for c in x)], 0
        if kept:
            yield tuple(np.concatenate(c) for c in zip(*kept, strict=True))

    def pack(batches):
        import pyarrow as pa

        for x in taken(batches):
            for q, p, own, (col, row, val, a) in lists_of(x, parts, sent):
                norms = None if measure == "dot" else packed(a)
                yield pa.RecordBatch.from_pydict({"q": pa.array([q], pa.int32()), "part": pa.array([p], pa.int32()), "own": [own], "n": pa.array([len(col)], pa.int32()), "cols": [packed(col)], "rows": [packed(row)], "vals": [packed(val)], "norms": pa.array([norms], pa.binary())})

    def finish(batches):
        import pyarrow as pa

        def cells_of(got, own):
            got = [r for r in got if r["own"] == own]
            read = lambda c, kind: np.concatenate([np.zeros(0, f"{kind}8"), *(unpacked(r[c], r["n"], kind) for r in got)])
            col, row, val = read("cols", "i"), read("rows", "i"), read("vals", "f")
            return col, row, val, np.zeros(len(col)) if measure == "dot" else read("norms", "f")

        for (q, p), got in groupby((r for b in batches for r in b.to_pylist()), lambda r: (r["q"], r["part"])):
            got = list(got)
            for found in finished(cells_of(got, True), cells_of(got, False), q % int(parts[q]) == p, measure, minsim, nnbrs, held):
                if len(found[0]):
                    yield pa.RecordBatch.from_pydict(dict(zip(("query", "neighbor", "sim"), found, strict=True)))

    cols = blocked.filter("block is not null").select("col", F.col("block").cast("bigint").alias("block"), "row", "val", F.col("a").cast("double").alias("a"))
    lists = cols.repartition(max(least, blocks), "col").sortWithinPartitions("col").mapInArrow(pack, _PACKED)
    return lists.repartition(max(least, int(parts.sum())), "q", "part").sortWithinPartitions("q", "part").mapInArrow(finish, _LIST)
