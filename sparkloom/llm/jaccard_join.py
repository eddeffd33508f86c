"""Exact Jaccard self-join of shingle sets by universe-partition pigeonhole.

Two sets with Jaccard >= t differ in at most ``H = floor((|a| + |b|) (1 - t) / (1 + t))`` elements. A size
band ends at lo / t, so partners lie in one band or in neighbouring ones; each set is signed with the
parameters of its own band and of the next. A band's hash universe is cut into ``m = H + 1`` segments: two
sets within H differences agree in some segment whole (pigeonhole). A segment's subset is one signature.

Cost-based allocation: a first pass counts how many sets have each small subset of a segment, in a table of
counters of fixed size. A subset's signature costs one entry, and comparisons with all sets of its posting list,
fewer the more elements they share; the alternative costs an entry for each element of the next segment. Where
the list costs more, the subset's budget goes to the one-deletion neighbourhood of the next segment: its key is
joined with that segment's subset and with each subset that lacks one element. It stays exact. The decision
depends on the key alone, so both sets of a pair treat an equal subset alike, however rough the counters are. Let Z
be the segments in which a pair agrees and whose subset is so treated. If no other segment agrees, the others differ
in one element each at least, so within H differences some successor of a segment of Z differs in at most one, and
the joined keys meet.

Within a key, each set is compared with the set of smallest id by parity sketches: an element flips one bit, so
sketches differ in no more bits than sets in elements, and what fails is no link. Where some fail, all sets of
the key are compared in this way, in blocks. What passes forms candidate families (connected components). Each
family is cut into blocks by size band and hash; pairs of blocks of neighbouring bands are compared whole,
with an exact lower bound first (parity sketches: one difference flips one bit) and then the sets themselves.
A family's links are gathered as a spanning forest: pairs already connected are not verified again. Large
families run in two waves; the second takes only sets that the first left outside the family's largest
component, against all of the family. Equal sets are one set throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import words as W
from sparkloom.llm.cluster import Scratch, bucket_count, components, give_back, join_skewed

U64 = np.uint64
BLOB = "bucket int, kind int, payload binary"
LINK = "kind int, a bigint, b bigint, k bigint, s binary"
#: Counters of the first pass, 4 bytes each, and subsets of how many elements it counts.
COUNTERS, COUNTED = 1 << 20, 4
#: Of a posting list of subsets with one element more, a set is compared with so many times fewer in vain.
PER_ELEMENT = 4.0
#: Bits of the map of ids whose texts a wave reads, and of a row of it.
MAP_BITS, ROW_BITS = 1 << 26, 1 << 15
#: Sets in a block of a large family.
BLOCK = 128


class Bands:
    """Size bands for a threshold: where each begins, and the segments of its universe."""

    def __init__(self, threshold: Fraction):
        self.threshold, self.loss = threshold, (1 - threshold) / (1 + threshold)
        self.starts, self.segments = [1], []

    def grow(self, size: int) -> None:
        """Until the band of this size and the next are there."""
        while len(self.segments) < 2 or self.starts[-2] <= size:
            last = int(self.starts[-1] / self.threshold)
            self.segments.append(int(2 * last * self.loss) + 1)
            self.starts.append(last + 1)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        """Band of each size; sizes are 1 or more."""
        self.grow(int(sizes.max(initial=1)))
        return np.searchsorted(np.array(self.starts), sizes, "right") - 1


def _light(threshold: Fraction) -> int:
    """Largest subset that counts as small where no frequencies are known: two elements, or one where segments hold
    few on average."""
    return 2 if (1 + threshold) / (2 * (1 - threshold)) >= 6 else 1


class Posts:
    """How many sets have a subset, by its key: counters that several keys share, less what they share on average."""

    def __init__(self, counters: np.ndarray):
        self.counters, self.noise = counters, int(counters.mean())

    def dear(self, keys: np.ndarray, size: np.ndarray, load: float) -> np.ndarray:
        """Whether the posting list costs more than `load` + 2 entries, the one-deletion neighbourhood of a segment
        of `load` elements. `size` is the subset's own."""
        n = np.maximum(0, self.counters[(keys >> U64(44)).astype(np.int64)].astype(np.int64) - self.noise)
        return (size <= COUNTED) & (n > PER_ELEMENT ** np.minimum(size, COUNTED) * (load + 2))


def _segments(s: np.ndarray, band: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one set under one band's m segments: where each begins, its elements mixed, their sum, and its key."""
    salt = U64((band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    seg = (((s >> U64(32)) * U64(m)) >> U64(32)).astype(np.int64)  # s is sorted, so seg is
    mixed = W.mix(s ^ salt)
    total = np.zeros(len(s) + 1, U64)
    np.cumsum(mixed, out=total[1:])
    edge = np.searchsorted(seg, np.arange(m + 1))
    raw = total[edge[1:]] - total[edge[:-1]]
    return edge, mixed, raw, W.mix(raw + np.arange(1, m + 1).astype(U64) * U64(0xD1B54A32D192ED03) + salt)


def _signatures(s: np.ndarray, band: int, m: int, light: int, posts: Posts | None = None, load: float = 0.0) -> np.ndarray:
    """Keys of one set under one band's m segments. `posts` decides which subsets go with the neighbourhood of the
    next segment, given the `load` of the band's segments; without it, those of `light` elements at most."""
    edge, mixed, raw, sums = _segments(s, band, m)
    size = np.diff(edge)
    dear = size <= light if posts is None else posts.dear(sums, size, load)
    i = np.flatnonzero(dear)
    if not len(i):
        return sums
    j = (i + 1) % m
    whose = np.repeat(np.arange(len(i)), size[j])  # a key for each element of the next segment, left out
    place = np.arange(len(whose)) - np.repeat(np.cumsum(size[j]) - size[j], size[j]) + edge[j][whose]
    near = np.concatenate([raw[j] + sums[i], raw[j][whose] - mixed[place] + sums[i][whose]])
    return np.concatenate([sums[~dear], W.mix(W.mix(near) + U64(0xA24BAED4963EE407))])


def _digest(s: np.ndarray, salt: int = 0) -> int:
    """The sum of a set's mixed elements."""
    return int(W.mix(s ^ U64(salt)).sum(dtype=U64)) if len(s) else 0


def _count(k: int, threshold: Fraction, ranges: int):
    """Of each task, how many of its sets have each small subset: counters by range, those that are not 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, total = Bands(threshold), np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for c in W.chunks(batch.column(0), True):
                sets = {_digest(s): s for s in W.shingle_sets(c, k) if len(s)}
                sets = list(sets.values())
                for s, b in zip(sets, bands.of(np.array([len(s) for s in sets], np.int64)).tolist() if sets else [], strict=True):
                    for band in (b, b + 1):
                        if bands.segments[band] > 1:
                            edge, _, _, keys = _segments(s, band, bands.segments[band])
                            np.add.at(total, (keys[np.diff(edge) <= COUNTED] >> U64(44)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield _batch(_pieces(at * ranges // COUNTERS, 0, at.astype(np.uint32), total[at]))
        give_back()

    return run


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counters of a range, summed."""
    at, n = np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    for batch in batches:
        for blob in batch.column("payload"):
            more_at, more_n = W.unpack(blob.as_buffer(), np.uint32, np.uint32)
            at, where = np.unique(np.r_[at, more_at], return_inverse=True)
            n = np.minimum(np.bincount(where, np.r_[n, more_n], len(at)), 2**32 - 1).astype(np.uint32)
    if len(at):
        yield _batch([(0, 0, W.pack(at, n))])


def posting_counts(texts: DataFrame, k: int, threshold: Fraction, ranges: int = 64) -> Posts:
    """The first pass over `texts` (_text). The counters come to the driver: COUNTERS of 4 bytes, whatever the input."""
    counters = np.zeros(COUNTERS, np.uint32)
    for r in texts.select("_text").mapInArrow(_count(k, threshold, ranges), BLOB).groupBy("bucket").applyInArrow(_total, BLOB).collect():
        at, n = W.unpack(r.payload, np.uint32, np.uint32)
        counters[at] = n
    return Posts(counters)


def _sign(k: int, threshold: Fraction, n: int, posts: Posts):
    """Of each task: sizes of its sets, links of equal sets, links by keys to the smallest id, and one
    entry of each key and each set's digest for the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, light = Bands(threshold), _light(threshold)
        for batch in batches:
            all_ids = batch.column(0).to_numpy(zero_copy_only=False)
            for c in W.chunks(batch.column(1), True):
                ids = all_ids[c.lo : c.hi]
                sets = list(W.shingle_sets(c, k))
                size = np.array([len(s) for s in sets], np.int64)
                digest, check = (np.array([_digest(s, salt) for s in sets], U64) for salt in (0, 0x94D049BB133111EB))
                full = np.flatnonzero(size)
                order = full[np.lexsort((ids[full], size[full], check[full], digest[full]))]
                new = np.ones(len(order), bool)
                new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in (digest, check, size)])
                head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
                out = _pack_rows(1, ids[order[~new]], ids[head[~new]], n) + _pack_rows(2, ids, size, n) + _pack_rows(5, ids, digest.view(np.int64), n)
                out += [(int(b), 6, W.pack(ids[i : i + 1], size[i : i + 1]) + _sketch(sets[i]).tobytes()) for i, b in zip(order[new].tolist(), W.spark_bucket(ids[order[new]], n).tolist(), strict=True)]
                own = order[new]
                if len(own):
                    keys, whose = [], []
                    for i, b in zip(own.tolist(), bands.of(size[own]).tolist(), strict=True):
                        for band in (b, b + 1):
                            if bands.segments[band] > 1:  # else only equal sets link
                                m = bands.segments[band]
                                keys.append(_signatures(sets[i], band, m, light, posts, bands.starts[band] / m))
                                whose.append(np.full(len(keys[-1]), ids[i]))
                    if keys:
                        key, doc = np.concatenate(keys), np.concatenate(whose)
                        order = np.lexsort((doc, key))
                        key, doc = key[order], doc[order]
                        new = np.r_[True, key[1:] != key[:-1]]
                        first = doc[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
                        more = ~new & (doc != first)
                        out += _pack_links(key[more], doc[more], first[more], n) + _pack_keys(3, key[new], doc[new], n)
                    key = W.mix(digest[own] + size[own].astype(U64))
                    order = np.argsort(key, kind="stable")
                    out += _pack_keys(4, key[order], ids[own[order]], n, check[own[order]])
                yield _batch(out)
        give_back()

    return run


def _batch(rows: list) -> pa.RecordBatch:
    b, k, p = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(p, pa.binary())], ["bucket", "kind", "payload"])


def _pieces(to: np.ndarray, kind: int, *arrays: np.ndarray) -> list:
    if not len(to):
        return []
    cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
    return [(int(to[x]), kind, W.pack(*(a[x:y] for a in arrays))) for x, y in zip(cut, np.r_[cut[1:], len(to)], strict=True)]


def _pack_rows(kind: int, a: np.ndarray, b: np.ndarray, n: int) -> list:
    to = W.spark_bucket(a, n)
    order = np.argsort(to, kind="stable")
    return _pieces(to[order], kind, a[order], b[order])


def _pack_keys(kind: int, key: np.ndarray, doc: np.ndarray, n: int, *more: np.ndarray) -> list:
    return _pieces(W.key_bucket(key, n), kind, key, doc, *more)


def _pack_links(key: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> list:
    return _pieces(W.key_bucket(key, n), 0, key, a, b)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the entries of a key (kind 0, with the key) and of a digest (1, equal sets: equal in 128 bits and
    in size); sizes (2) and digests (5) of ids; sketches (6), with sizes, which pass on as they come."""
    parts: dict[int, list] = {3: [], 4: []}
    out = []
    for batch in batches:
        payload, sketches = batch.column("payload"), []
        for i, k in enumerate(batch.column("kind").to_pylist()):
            blob = payload[i].as_buffer()
            if k in (0, 4):
                x = W.unpack(blob, np.uint64, np.int64, np.int64 if k == 0 else np.uint64)
                parts[4].append(x) if k else out.append((0, x[1], x[2], x[0].view(np.int64)))
            elif k == 3:
                parts[3].append(W.unpack(blob, np.uint64, np.int64))
            elif k in (1, 2, 5):
                doc, other = W.unpack(blob, np.int64, np.int64)
                out.append((k, doc, other, np.zeros(len(doc), np.int64)))
            else:
                doc, size = W.unpack(blob, np.int64, np.int64)
                sketches.append((int(doc[0]), int(size[0]), blob[_PACKED_PAIR:].to_pybytes()))
        if sketches:
            a, b, c = zip(*sketches, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([6] * len(a), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([0] * len(a), pa.int64()), pa.array(c, pa.binary())], ["kind", "a", "b", "k", "s"])
    for want, becomes in ((3, 0), (4, 1)):
        if parts[want]:
            key, doc, *check = (np.concatenate(x) for x in zip(*parts[want], strict=True))
            parts[want].clear()
            order = np.lexsort((doc, *check, key))
            doc, keys = doc[order], [x[order] for x in (key, *check)]
            new = np.ones(len(doc), bool)
            new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in keys])
            first = doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]
            out.append((becomes, doc[~new], first[~new], keys[0][~new].view(np.int64)))
    flat = [np.concatenate(x) for x in zip(*[(np.full(len(a), k, np.int64), a, b, key) for k, a, b, key in out], strict=True)] if out else [np.zeros(0, np.int64)] * 4
    order = np.lexsort(flat[::-1])
    flat = [x[order] for x in flat]
    keep = np.ones(len(order), bool)
    keep[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in flat])
    keep &= (flat[0] >= 2) | (flat[1] != flat[2])
    kind, a, b, key = (x[keep] for x in flat)
    step = 100_000
    for i in range(0, len(kind), step):
        cut = slice(i, i + step)
        yield pa.RecordBatch.from_arrays([pa.array(kind[cut].astype(np.int32)), pa.array(a[cut]), pa.array(b[cut]), pa.array(key[cut]), pa.nulls(len(kind[cut]), pa.binary())], ["kind", "a", "b", "k", "s"])
    give_back()


#: Bytes of two packed numbers: a count, and for each its minimum and its rest.
_PACKED_PAIR = 8 + 2 * 16


def _sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the elements in each of some bits, four to eight for an element."""
    width = 1 << int(np.clip(len(s) * 4, 64, 1 << 16)).bit_length()
    return np.packbits(np.bincount((s & U64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1)


def _folded(blobs: list[bytes]) -> np.ndarray:
    """Sketches as rows of the narrowest one's width: halving a sketch is the parity of its halves, since a
    bit's place is the element's lowest bits, in reverse within bytes throughout."""
    narrow = min(map(len, blobs))
    rows = []
    for b in blobs:
        x = np.frombuffer(b, np.uint8)
        while len(x) > narrow:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        rows.append(x)
    return np.stack(rows).view(U64)


def _near(threshold: Fraction):
    """Whether the sketches of a pair let it be a link: (a, b, ok)."""
    num, den = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            limit = (n + m) * (den - num) // (den + num)
            ok = []
            for x, y, most in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), limit.tolist(), strict=True):
                p, q = _folded([x, y])
                ok.append(int(np.bitwise_count(p ^ q).sum(dtype=np.int64)) <= most)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    return run


def _tile_pairs(table: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows of each tile of more than one, and their sides."""
    table = table.sort_by([("tile", "ascending"), ("id", "ascending")])
    tiles = table.column("tile").to_numpy()
    cut = np.flatnonzero(np.r_[True, tiles[1:] != tiles[:-1]]) if len(tiles) else []
    for a, b in zip(cut, [*cut[1:], len(tiles)], strict=True):
        if b - a > 1:
            part = table.slice(a, b - a)
            yield part, part.column("side").to_numpy()


def _passing(marks: np.ndarray, size: np.ndarray, side: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile that sketches let be links, nearest first."""
    limit = (size[:, None] + size[None, :]) * (den - num) // (den + num)
    apart = np.empty((len(size), len(size)), np.int32)
    for i in range(len(size)):
        apart[i] = np.bitwise_count(marks ^ marks[i]).sum(1, dtype=np.int32)
    ok = np.triu(apart <= limit, 1)
    if side.any() and not side.all():  # two blocks: pairs within one are another tile's
        ok &= side[:, None] != side[None, :]
    x, y = np.nonzero(ok)
    order = np.argsort(apart[x, y] / np.maximum(1, limit[x, y]), kind="stable")
    return x[order], y[order]


def _pass(threshold: Fraction):
    """Of each tile a spanning forest of the pairs that sketches let be links."""
    num, den = threshold.numerator, threshold.denominator

    def run(table: pa.Table) -> pa.Table:
        found = []
        for part, side in _tile_pairs(table):
            ids, forest = part.column("id").to_pylist(), Forest()
            x, y = _passing(_folded(part.column("s").to_pylist()), part.column("n").to_numpy(), side, num, den)
            found += [(ids[i], ids[j]) for i, j in zip(x.tolist(), y.tolist(), strict=True) if forest.join(ids[i], ids[j])]
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _sets(k: int):
    """Shingle sets as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in W.chunks(batch.column(0), True):
                rest = batch.slice(c.lo, c.hi - c.lo)
                made = pa.array([s.tobytes() for s in W.shingle_sets(c, k)], pa.binary())
                yield pa.RecordBatch.from_arrays([*rest.columns[1:], made], [*rest.schema.names[1:], "items"])

    return run


class Forest:
    """Union-find over ids."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _compare(threshold: Fraction):
    """Verified links of each tile, as a spanning forest together with what is known to be connected."""
    num, den = threshold.numerator, threshold.denominator

    def tile(ids: list[int], known: list[int], side: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        forest, found = Forest(), []
        first: dict[int, int] = {}
        for i, c in zip(ids, known, strict=True):
            if c in first:
                forest.join(i, first[c])
            first.setdefault(c, i)
        x, y = _passing(_folded([_sketch(s).tobytes() for s in sets]), np.array([len(s) for s in sets], np.int64), side, num, den)
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            if forest.top(ids[i]) == forest.top(ids[j]):
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both * den >= num * (len(sets[i]) + len(sets[j]) - both):
                forest.join(ids[i], ids[j])
                found.append((ids[i], ids[j]))
        return found

    def run(table: pa.Table) -> pa.Table:
        found = []
        for part, side in _tile_pairs(table):
            sets = [np.frombuffer(x, U64) for x in part.column("items").to_pylist()]
            found += tile(part.column("id").to_pylist(), part.column("known").to_pylist(), side, sets)
        x, y = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    return run


def _candidates(keyed: DataFrame, sketches: DataFrame, threshold: Fraction, block: int, groups: int, scratch: Scratch) -> DataFrame:
    """a, b: links whose components hold all links of sets that share a key. keyed: k, a, b (a key's smallest id)."""
    own = lambda x: sketches.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("s").alias(f"s_{x}"))
    pairs = keyed.select("a", "b").distinct().join(own("a"), "a").join(own("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    tried = scratch.save(pairs.mapInArrow(_near(threshold), "a bigint, b bigint, ok boolean"))
    passed = tried.filter("ok").select("a", "b")
    failed = tried.filter("not ok").select("a", "b")
    mixed = keyed.join(failed, ["a", "b"]).select("k").distinct()
    pairs = join_skewed(keyed, mixed, "k").select("k", "a", "b")
    members = pairs.select("k", F.explode(F.array("a", "b")).alias("id")).distinct()
    # Only keys whose sets are not connected yet; in them what is outside the largest component, against all.
    comp = components(passed, Scratch(keyed.sparkSession, "passed"), "a", "b")
    members = scratch.save(members.join(comp, "id", "left").select("k", "id", F.coalesce("component", "id").alias("known")))
    part = members.groupBy("k", "known").agg(F.count("*").alias("c"))
    shape = part.groupBy("k").agg(F.max_by("known", F.struct("c", -F.col("known"))).alias("main"), F.max("c").alias("most"), F.sum("c").alias("all")).filter(F.col("most") < F.col("all"))
    shape = shape.select("k", "main", F.when(F.col("all") <= block, 0).otherwise(F.ceil((F.col("all") - F.col("most")) / block)).cast("int").alias("nx"), F.ceil(F.col("all") / block).cast("int").alias("ny"))
    placed = join_skewed(members, shape, "k")
    tile = lambda x, y, side: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(side).alias("side"))
    own = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), "nx"))
    whole = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), "nx") - 1), lambda i: tile(i, F.pmod(F.xxhash64("id"), F.col("ny")), 1))
    outside = F.when(F.col("known") != F.col("main"), F.transform(F.sequence(F.lit(0), F.col("ny") - 1), lambda i: tile(own, i, 0))).otherwise(F.array().cast("array<struct<x:int,y:int,side:int>>"))
    sides = F.when(F.col("nx") == 0, F.array(tile(F.lit(0), F.lit(0), 0))).otherwise(F.concat(whole, outside))
    tiles = placed.select("k", "id", F.explode(sides).alias("t")).select("id", F.xxhash64("k", "t.x", "t.y").alias("tile"), "t.side")
    rows = tiles.join(sketches, "id").select("id", "tile", "side", "n", "s").withColumn("g", F.pmod("tile", F.lit(groups)).cast("int"))
    return passed.unionByName(rows.groupBy("g").applyInArrow(_pass(threshold), "a bigint, b bigint"))


def _only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `texts` (_id, _text) whose id may be in `ids` (id): all that are, and few others. A map of the hashed
    ids, of MAP_BITS at most, goes to where the texts are, so that a join that follows shuffles no others."""
    place = lambda x: F.pmod(F.xxhash64(x), F.lit(MAP_BITS))
    row, bit = lambda x: F.floor(place(x) / ROW_BITS).cast("int"), lambda x: F.pmod(place(x), F.lit(ROW_BITS))
    bits = ids.groupBy(row("id").alias("_row")).agg(F.bitmap_construct_agg(bit("id")).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit("_id") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    marked = texts.withColumn("_row", row("_id")).join(F.broadcast(bits), "_row")
    return marked.filter(F.call_function("shiftright", byte, F.pmod(bit("_id"), F.lit(8)).cast("int")).bitwiseAND(1) == 1).select(*texts.columns)


def _tiles(members: DataFrame, pairs_of: DataFrame, texts: DataFrame, k: int, threshold: Fraction, n: int) -> DataFrame:
    """members: id, fam, blk, known. pairs_of: fam, blk, tile, side. Links found in these tiles. texts: all that
    members need, at least."""
    placed = members.join(pairs_of, ["fam", "blk"]).select("id", "known", "tile", "side")
    whole = texts.join(placed, texts["_id"] == placed["id"]).select("_text", "id", "known", "tile", "side")
    sets = whole.mapInArrow(_sets(k), "id bigint, known bigint, tile bigint, side int, items binary")
    return sets.withColumn("bucket", F.pmod("tile", F.lit(n)).cast("int")).groupBy("bucket").applyInArrow(_compare(threshold), "a bigint, b bigint")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: Fraction | str = "0.8", block: int = BLOCK) -> DataFrame:
    """Near-duplicate groups: of each id, its number of shingles and the smallest id that links reach.

    A document's set is its distinct shingles of `shingle` words, with A-Z in lower case; a document with fewer
    words has its whole sequence as one, without words or text none. Two documents link when the Jaccard
    similarity of their sets is `threshold` or more; every such link counts, no candidate is capped. Returns
    `id_col`, n_shingles, component_id; one row for each id. Rows with a null id are left out. Rows that repeat
    an id count as links of that id, and n_shingles is the largest of them. Other columns, of any name, are not
    looked at. Empty table: empty result.
    """
    threshold = Fraction(threshold)
    if not Fraction(1, 2) <= threshold < 1:
        raise ValueError("threshold must be in [0.5, 1)")
    scratch = Scratch(docs.sparkSession, "jaccard")
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text")).filter("_id is not null")
    n = bucket_count(docs, text_col)
    posts = posting_counts(texts, shingle, threshold)
    met = scratch.save(texts.mapInArrow(_sign(shingle, threshold, n, posts), BLOB).groupBy("bucket").applyInArrow(_meet, LINK).distinct())
    sizes = met.filter("kind = 2").groupBy(F.col("a").alias("id")).agg(F.max("b").alias("n"))
    same = met.filter("kind = 1").select("a", "b")
    several = met.filter("kind = 5").groupBy("a").count().filter("count > 1")  # ids with more than one text
    stands = same.join(several, "a", "left_anti").groupBy("a").agg(F.min("b").alias("for"))
    near = met.filter("kind = 0").select("k", "a", "b")
    for side in ("a", "b"):
        own = stands.select(F.col("a").alias(side), "for")
        near = near.join(own, side, "left").withColumn(side, F.coalesce("for", side)).select("k", "a", "b")
    sketches = met.filter("kind = 6").groupBy(F.col("a").alias("id"), F.col("b").alias("n"), "s").agg(F.lit(1).alias("one")).select("id", "n", "s")
    keyed = scratch.save(near.filter("a <> b"))
    near = _candidates(keyed, sketches, threshold, 2 * block, n, scratch)
    family = components(near, Scratch(docs.sparkSession, "families"), "a", "b").withColumnRenamed("component", "fam")
    family = scratch.save(family.join(sizes, "id"))
    scratch.drop(keyed)
    # Blocks: by size band and hash; as many in a band as its share of the family needs.
    step = float(1 / threshold)
    family = family.withColumn("band", F.floor(F.log("n") / F.lit(float(np.log(step))) + 1e-9).cast("int"))
    count = family.groupBy("fam", "band").agg(F.count("*").alias("members"))
    total = count.groupBy("fam").agg(F.sum("members").alias("all_members"))
    shape = scratch.save(count.join(total, "fam").select("fam", F.when(F.col("all_members") <= block, 0).otherwise(F.col("band")).alias("band"), F.when(F.col("all_members") <= block, 1).otherwise(F.ceil(F.col("members") / block)).cast("int").alias("blocks"), "all_members").distinct())
    family = join_skewed(family, total, "fam").withColumn("band", F.when(F.col("all_members") <= block, 0).otherwise(F.col("band")))
    placed = join_skewed(family, shape.select("fam", "band", "blocks"), "fam", "band")
    members = scratch.save(placed.select("id", "fam", (F.col("band") * 1_000_000 + F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("blk"), F.col("id").alias("known"), "all_members"))
    blocks = shape.select("fam", "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i")).select("fam", "band", (F.col("band") * 1_000_000 + F.col("i")).alias("blk"), "i")

    def tiles(pairs: DataFrame) -> DataFrame:
        """x, y: blocks of one family; a row for each side of the tile."""
        sides = F.when(F.col("x") == F.col("y"), F.array(F.struct(F.col("x").alias("blk"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("x").alias("blk"), F.lit(0).alias("side")), F.struct(F.col("y").alias("blk"), F.lit(1).alias("side"))))
        return pairs.select("fam", F.xxhash64("fam", "x", "y").alias("tile"), F.explode(sides).alias("s")).select("fam", "s.blk", "tile", "s.side")

    # First wave: each block within itself, and against the first block of its own and of the next band.
    heads = blocks.filter("i = 0").select(F.col("fam"), F.col("band"), F.col("blk").alias("x"))
    first = blocks.select("fam", "band", F.col("blk").alias("y"), "i")
    one = first.select("fam", F.col("y").alias("x"), "y").unionByName(heads.join(first.filter("i > 0"), ["fam", "band"]).select("fam", "x", "y")).unionByName(heads.select("fam", (F.col("band") + 1).alias("band"), "x").join(first, ["fam", "band"]).select("fam", "x", "y"))
    found = scratch.save(_tiles(members.select("id", "fam", "blk", "known"), tiles(one), _only(texts, members), shingle, threshold, n))
    large = shape.filter(F.col("all_members") > block)
    if not large.isEmpty():
        # Second wave: what is not yet in its family's largest component, against all of the family.
        comp = components(found, Scratch(docs.sparkSession, "first"), "a", "b")
        now = members.filter(F.col("all_members") > block).join(comp, "id", "left").select("id", "fam", "blk", F.coalesce("component", "id").alias("known"))
        most = now.groupBy("fam", "known").agg(F.count("*").alias("c")).groupBy("fam").agg(F.max_by("known", F.struct("c", -F.col("known"))).alias("main"))
        apart = join_skewed(now, most, "fam").filter(F.col("known") != F.col("main")).select("id", "fam", "blk", "known")
        hot = apart.groupBy("fam", "blk").agg(F.count("*").alias("c"))
        rest = hot.select("fam", (-F.col("blk") - 1).alias("x"), F.floor(F.col("blk") / 1_000_000).alias("band"))
        every = blocks.select("fam", "band", F.col("blk").alias("y"))
        pairs = rest.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).join(every, ["fam", "band"]).select("fam", "x", "y")
        wide = now.unionByName(apart.withColumn("blk", -F.col("blk") - 1))
        found = found.unionByName(scratch.save(_tiles(wide, tiles(pairs), _only(texts, members.filter(F.col("all_members") > block)), shingle, threshold, n)))
    links = found.unionByName(same)
    comp = components(links, Scratch(docs.sparkSession, "links"), "a", "b")
    return sizes.join(comp, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
