"""Row blocks that are sent every list of their columns, so that each row is finished in one task.

A block is a run of rows whose cells meet about WORK cells of the other matrix. Lists (the cells of a column, or of a row of
the right factor) are packed once, in runs of whole lists, and saved; each block is sent those of its columns, by deltas
and byte planes, a few bytes a cell. A row's sums are finished where they are formed, so neither products nor partial lists
of neighbours are exchanged, and nothing is merged. Where all that is sent would be more than PASS cells, blocks are done in
passes whose shuffle files go before the next, so disk holds one pass at a time.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.scratch import Scratch

#: Cells that a block meets; most that a row may meet; cells packed in a run; cells sent in a pass; products held at a time.
WORK, ROW, CELLS, PASS, HELD = 1 << 21, 1 << 23, 1 << 20, 1 << 30, 1 << 18
#: Cells of a partition of rows, or of columns.
EACH = 1 << 20

_RUN = "sent bigint, lists int, cells int, met int, heads binary, sizes binary, rows binary, vals binary, norms binary, blocks binary, meets binary"
_SENT = "q bigint, own boolean, lists int, cells int, heads binary, sizes binary, rows binary, vals binary, norms binary"


def _planes(x: np.ndarray) -> bytes:
    """Unsigned numbers byte by byte, each plane compressed for itself; planes of zeros above the highest are left out."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    b = np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(len(x), 8)
    out = [pa.compress(np.ascontiguousarray(b[:, i]), codec="zstd", asbytes=True) for i in range(width)]
    return struct.pack(f"<B{width}I", width, *map(len, out)) + b"".join(out)


def packed(x: np.ndarray, deltas: bool = False) -> bytes:
    """Numbers of 64 bits: whole ones, if `deltas` as differences, folded so that small negative ones are short, others as bits."""
    tag = b"i"
    if x.dtype.kind == "f":
        with np.errstate(all="ignore"):
            short = x.astype(np.int64)
            if not (np.array_equal(short, x) and (np.abs(x) < 2**53).all()):
                return b"f" + _planes(x.view(np.uint64))
        x, tag = short, b"w"
    x = np.diff(x, prepend=np.int64(0)) if deltas else x
    return tag + _planes(((x << 1) ^ (x >> 63)).view(np.uint64))


def unpacked(data: bytes, n: int, deltas: bool = False) -> np.ndarray:
    """What packed() has packed: n numbers."""
    width = data[1]
    sizes = struct.unpack_from(f"<{width}I", data, 2)
    b, at = np.zeros((n, 8), np.uint8), 2 + 4 * width
    for i, size in enumerate(sizes):
        b[:, i] = np.frombuffer(pa.decompress(data[at : at + size], decompressed_size=n, codec="zstd", asbytes=True), np.uint8)
        at += size
    x = b.view("<u8").ravel()
    if data[:1] == b"f":
        return x.view(np.float64)
    x = (x >> np.uint64(1)).view(np.int64) ^ -(x & np.uint64(1)).view(np.int64)
    x = np.cumsum(x) if deltas else x
    return x.astype(np.float64) if data[:1] == b"w" else x


def whole(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], cells: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns `names` of runs of about `cells` rows, cut where the first of them, which is in order, changes."""
    kept, n = [], 0
    for b in batches:
        kept.append(tuple(b.column(c).to_numpy(zero_copy_only=False) for c in names))
        n += b.num_rows
        if n >= cells:
            x = tuple(np.concatenate(c) for c in zip(*kept, strict=True))
            end = int(np.searchsorted(x[0], x[0][-1], "left"))  # the last may go on
            if end:
                yield tuple(c[:end] for c in x)
            kept = [tuple(c[end:] for c in x)]
            n = len(kept[0][0]) if end else 0  # a long one is looked at again when as much has come
    if kept and len(kept[0][0]) + len(kept) > 1:
        yield tuple(np.concatenate(c) for c in zip(*kept, strict=True))


def firsts(x: np.ndarray) -> np.ndarray:
    """Where values of x, of which equal ones lie together, begin."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0] .. lo[0] + n[0] - 1, lo[1] .. and so on."""
    return np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)


def row_blocks(cells: DataFrame, square: bool, scratch: Scratch, work: int = WORK, each: int = EACH) -> tuple[DataFrame, int, int]:
    """row, col, val, a, block of cells (row, col, val, n), n being what a cell meets; a is the row's sum of squares (or
    of values). Blocks are runs of rows in order. With them the most that a row meets, and what all do."""
    seen, total = Observation(), Observation()
    kind = cells.schema["val"].dataType.simpleString()
    cells = scratch.save(cells.observe(total, F.count("*").alias("cells"), F.sum("n").alias("work")))

    def deal(batches):
        block, before = TaskContext.get().partitionId() << 32, 0
        for row, col, val, n in whole(batches, ("row", "col", "val", "n"), each >> 2):
            first = firsts(row)
            long = np.diff(np.r_[first, len(row)])
            with np.errstate(all="ignore"):
                a = np.add.reduceat((val * val if square else val).astype(np.float64), first)
            met = np.add.reduceat(n, first)
            upto = before + np.cumsum(met)
            at, before = block + (upto - met) // work, int(upto[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (row, col, val, np.repeat(a, long), np.repeat(at, long), np.repeat(met, long))], ["row", "col", "val", "a", "block", "met"])

    parts = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total.get["cells"] or 0) // each))
    dealt = cells.repartitionByRange(parts, "row").sortWithinPartitions("row", "col").mapInArrow(deal, f"row bigint, col bigint, val {kind}, a double, block bigint, met bigint")
    out = scratch.save(dealt.observe(seen, F.max("met").alias("most")).drop("met"))
    scratch.drop(cells)
    return out, seen.get["most"] or 0, total.get["work"] or 0


def runs(cells: DataFrame, parts: int, scratch: Scratch, size: int = CELLS) -> tuple[DataFrame, int]:
    """Packed runs of whole lists of cells (col, block, row, val, a), and how many cells will be sent. A cell without `row`
    only tells that a block has the column; one without `block` is only part of the list."""

    def pack(batches):
        for col, block, row, val, a, has, listed in whole(batches, ("col", "block", "row", "val", "a", "has", "listed"), size):
            heads, head = np.unique(col, return_inverse=True)
            order = np.lexsort((row[listed], head[listed]))
            sizes = np.bincount(head[listed], minlength=len(heads))
            row, val, a = (x[listed][order] for x in (row, val, a))
            of, block = head[has], block[has]
            order = np.lexsort((block, of))
            of, block = of[order], block[order]
            once = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (block[1:] != block[:-1])][: len(of)])
            of, block = of[once], block[once]
            met = np.bincount(of, minlength=len(heads))
            if len(row) and len(of):
                yield pa.RecordBatch.from_pylist([dict(zip(_RUN.replace(",", "").split()[::2], (int((sizes * met).sum()), len(heads), len(row), len(of), packed(heads, True), packed(sizes), packed(row, True), packed(val), packed(a), packed(block, True), packed(met)), strict=True))], schema=pa.schema([("sent", pa.int64()), *((c, pa.int32()) for c in ("lists", "cells", "met")), *((c, pa.binary()) for c in ("heads", "sizes", "rows", "vals", "norms", "blocks", "meets"))]))

    dealt = cells.repartition(parts, "col").sortWithinPartitions("col", "row")
    table, seen = scratch.measure(dealt.mapInArrow(pack, _RUN), F.sum("sent").alias("sent"))
    return table, seen["sent"] or 0


_SCHEMA = pa.schema([("q", pa.int64()), ("own", pa.bool_()), ("lists", pa.int32()), ("cells", pa.int32()), *((c, pa.binary()) for c in ("heads", "sizes", "rows", "vals", "norms"))])


def _row(q, own, heads, sizes, rows, vals, norms):
    return dict(q=int(q), own=own, lists=len(heads), cells=len(rows), heads=packed(heads, True), sizes=packed(sizes), rows=packed(rows, True), vals=packed(vals), norms=None if norms is None else packed(norms))


def sent(of: int, turn: int, norms: bool) -> Callable:
    """Of runs the lists for each block of this turn, packed."""

    def send(batches):
        for b in batches:
            for run in b.to_pylist():
                heads, sizes = unpacked(run["heads"], run["lists"], True), unpacked(run["sizes"], run["lists"])
                rows, vals = unpacked(run["rows"], run["cells"], True), unpacked(run["vals"], run["cells"])
                a = unpacked(run["norms"], run["cells"]) if norms else None
                block, head = unpacked(run["blocks"], run["met"], True), np.repeat(np.arange(run["lists"]), unpacked(run["meets"], run["lists"]))
                mine = np.flatnonzero((block % of == turn) & (sizes[head] > 0))
                mine = mine[np.argsort(block[mine], kind="stable")]
                lo, begins = np.cumsum(sizes) - sizes, firsts(block[mine])
                out, held = [], 0
                for x, y in zip(begins, np.r_[begins[1:], len(mine)][: len(begins)], strict=True):
                    h = head[mine[x:y]]
                    to = spread(lo[h], sizes[h])
                    out.append(_row(block[mine[x]], False, heads[h], sizes[h], rows[to], vals[to], a[to] if norms else None))
                    held += len(to)
                    if held > HELD:
                        yield pa.RecordBatch.from_pylist(out, _SCHEMA)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, _SCHEMA)

    return send


def _own(norms: bool):
    """A block's own cells; where they come in several batches, in several pieces. Their columns are `heads`, one a cell."""

    def pack(batches):
        for b in batches:
            block, row, col, val, a = (b.column(c).to_numpy(zero_copy_only=False) for c in ("block", "row", "col", "val", "a"))
            order = np.lexsort((col, row, block))
            begins = firsts(block[order])
            out = []
            for x, y in zip(begins, np.r_[begins[1:], len(block)][: len(begins)], strict=True):
                at = order[x:y]
                out.append(_row(block[at[0]], True, col[at], np.zeros(0, np.int64), row[at], val[at], a[at] if norms else None))
            if out:
                yield pa.RecordBatch.from_pylist(out, _SCHEMA)

    return pack


def met(own: tuple[np.ndarray, ...], lists: tuple[np.ndarray, ...], term: Callable, held: int = HELD):
    """(row, other, sum, where row and other have a cell): for slices of whole rows of own (row, col, val) the sums of
    term(val, theirs) over what they meet in lists (head, size, row, val), in order of row and other."""
    order = np.lexsort((own[1], own[0]))
    w, c, v = (x[order] for x in own[:3])
    heads, sizes, rows, vals = lists
    by = np.argsort(heads)
    lo = (np.cumsum(sizes) - sizes)[by]
    heads, sizes = heads[by], sizes[by]
    if not len(heads) or not len(w):
        return
    at = np.minimum(np.searchsorted(heads, c), len(heads) - 1)
    n = np.where(heads[at] == c, sizes[at], 0)
    lo = lo[at]
    low, high = int(rows.min()), int(rows.max())
    if high - low < 1 << 40:
        code, span = rows - low, high - low + 1
    else:
        distinct, code = np.unique(rows, return_inverse=True)
        span = len(distinct)
    at1 = firsts(w)
    ends, r1 = np.r_[at1[1:], len(w)], np.repeat(np.arange(len(at1)), np.diff(np.r_[at1, len(w)]))
    upto, r = np.r_[0, np.cumsum(n)], 0
    while r < len(at1):
        x = at1[r]
        end = max(r + 1, int(np.searchsorted(upto[ends], upto[x] + held, "right")))
        y = ends[end - 1]
        to = spread(lo[x:y], n[x:y])
        of = np.repeat(np.arange(x, y), n[x:y])
        key = (r1[of] - r) * span + code[to]
        bits = max(1, len(key).bit_length())
        if ((end - r) * span).bit_length() + bits <= 63:  # places beside the keys: numbers are sorted faster than places
            key = np.sort((key << bits) | np.arange(len(key)))
            key, by = key >> bits, key & ((1 << bits) - 1)
        else:
            by = np.argsort(key, kind="stable")
            key = key[by]
        of, to = of[by], to[by]
        first = firsts(key)
        if len(first):
            s = np.add.reduceat(term(v[of], vals[to]), first)
            yield w[of[first]], rows[to[first]], s, order[of[first]], to[first]
        r = end


def ranked(query: np.ndarray, other: np.ndarray, sim: np.ndarray, nnbrs: int):
    """The `nnbrs` best (-1: all) of each query, ties to the smaller, and their ranks; queries lie together."""
    first = firsts(query)
    if nnbrs != -1 and len(query) > len(first) * nnbrs:  # what in 32 bits is after the last of the best cannot be one
        with np.errstate(all="ignore"):
            bits = (-sim + 0.0).astype(np.float32).view(np.uint32)
        bits = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
        size = np.diff(np.r_[first, len(query)])
        key = (np.repeat(np.arange(len(first), dtype=np.uint64), size) << np.uint64(32)) | bits
        last = np.sort(key)[first + np.minimum(size, nnbrs) - 1]
        kept = key <= np.repeat(last, size)
        query, other, sim = query[kept], other[kept], sim[kept]
    order = np.lexsort((other, -sim, query))
    query, other, sim = query[order], other[order], sim[order]
    first = firsts(query)
    rank = np.arange(1, len(query) + 1) - np.repeat(first, np.diff(np.r_[first, len(query)]))
    good = slice(None) if nnbrs == -1 else rank <= nnbrs
    return query[good], other[good], rank[good], sim[good]


def finished(finish: Callable, norms: bool) -> Callable:
    """What finish(own, lists) gives of each block, own being (row, col, val, a) and lists (head, size, row, val, a)."""

    def run(batches):
        for _, got in groupby((r for b in batches for r in b.to_pylist()), lambda r: r["q"]):
            sides = {True: [], False: []}
            for r in got:
                n, k = r["cells"], r["lists"]
                sizes = [] if r["own"] else [unpacked(r["sizes"], k)]
                a = unpacked(r["norms"], n) if norms else np.zeros(0)
                sides[r["own"]].append([unpacked(r["heads"], k, True), *sizes, unpacked(r["rows"], n, True), unpacked(r["vals"], n), a])
            if sides[True] and sides[False]:
                own, lists = ([np.concatenate(x) for x in zip(*sides[s], strict=True)] for s in (True, False))
                sides.clear()
                yield from finish((own[1], own[0], *own[2:]), lists)

    return run


def by_blocks(own: DataFrame, table: DataFrame, cells: int, work: int, finish: Callable, schema: str, norms: bool, scratch: Scratch, once: bool = False, block: int = WORK, most: int = PASS) -> DataFrame:
    """What `finish` makes of all blocks: own are row_blocks(), table and cells their runs()."""
    spark = own.sparkSession
    turns = 1 if once else max(1, -(-cells // most))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-work // (block * turns)))

    def turn(t: int) -> DataFrame:
        mine = own.filter(F.pmod("block", F.lit(turns)) == t).select("block", "row", "col", "val", "a").mapInArrow(_own(norms), _SENT)
        both = table.mapInArrow(sent(turns, t, norms), _SENT).unionByName(mine)
        return both.repartition(tasks, "q").sortWithinPartitions("q").mapInArrow(finished(finish, norms), schema)

    if turns == 1:
        return turn(0)
    return spark.read.schema(schema).parquet(*[scratch.save(turn(t)).scratch_path for t in range(turns)])


def neighbor_lists(m: DataFrame, measure: str, minsim: float, nnbrs: int, work: int = WORK, most: int = PASS, size: int = CELLS) -> DataFrame | None:
    """query, neighbor, rank, sim of similarity.neighbors, m being its bigint rows and columns and double values without
    nulls; None where a row meets more than ROW cells."""
    scratch = Scratch(m.sparkSession, "rows")
    norms = measure != "dot"
    blocked, longest, total = row_blocks(m.withColumn("n", F.count("*").over(Window.partitionBy("col"))), measure != "minmax", scratch, work)
    if longest > ROW:
        return None
    parts = max(int(m.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-blocked.count() // EACH))
    table, cells = runs(blocked.select("col", "block", "row", "val", "a", F.lit(True).alias("has"), F.lit(True).alias("listed")), parts, scratch, size)

    def finish(own, lists):
        (row, col, val, a), (head, n, other, theirs, b) = own, lists
        with np.errstate(all="ignore"):
            if measure == "cosine":
                val, theirs = (np.where(s > 0, x * (1 / np.sqrt(s)), x) for x, s in ((val, a), (theirs, b)))
            for query, neighbor, s, i, j in met((row, col, val), (head, n, other, theirs), np.minimum if measure == "minmax" else np.multiply):
                if measure in ("dot", "cosine"):
                    sim, good = s, ~np.isnan(s) & (s >= minsim)
                else:
                    rest = a[i] + b[j] - s
                    sim = s / rest
                    good = ~np.isnan(sim) & (sim >= minsim) & (rest != 0)
                found = ranked(query[good], neighbor[good], sim[good], nnbrs)
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query", "neighbor", "rank", "sim"])

    return by_blocks(blocked, table, cells, total, finish, "query bigint, neighbor bigint, rank bigint, sim double", norms, scratch, block=work, most=most)


def pays(columns: DataFrame, cells: int, block: int) -> bool:
    """Whether lists of these columns (n: their cells) are sent with fewer bytes than cells to tiles of blocks of `block`
    cells, by the most that either can send; a cell of a list has about a fifth of the bytes of one sent to a tile."""
    n = F.col("n").cast("double")
    told = columns.agg(F.sum(n * n).alias("lists"), F.sum(n * F.least(n, F.lit(float(-(-cells // block))))).alias("tiles")).first()
    return bool(told.lists) and told.lists <= 5 * told.tiles


def neighbors_if_pays(m: DataFrame, measure: str, minsim: float, nnbrs: int, block: int) -> DataFrame | None:
    """neighbor_lists() where that pays against tiles of blocks of `block` cells."""
    columns, seen = Scratch(m.sparkSession, "columns").measure(m.groupBy("col").agg(F.count("*").alias("n")), F.sum("n").alias("cells"))
    return neighbor_lists(m, measure, minsim, nnbrs) if pays(columns, seen["cells"] or 0, block) else None
