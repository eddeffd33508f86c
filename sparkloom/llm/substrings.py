"""Substring dedup with fixed-block anchors.

Every window of `width` words holds a whole block at a multiple of `block` words when
``width >= 2 * block - 1``. So of two equal windows, the block inside one of them also stands somewhere
inside the other:

1. Index the hashes of all non-overlapping blocks and probe them with the hash of every rolling window of
   `block` words. What occurs twice and is once such a block is an anchor.
2. Extend: hash every window of `width` words around an anchor and find, for each sequence, where it starts
   first. All later ones are repeats; consecutive ones merge into maximal repeats.
3. Drop the words that a repeat covers.

Hashes move in packed blobs, one for each task and hash bucket, in which each hash of a task occurs once:
a passage that a third of all documents share is at most one entry a task. Buckets follow the input's size,
so memory a task needs does not. Both hash tables are exchanged once; the texts once, by doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import words as W
from sparkloom.llm.cluster import Scratch, bucket_count, give_back, numbered

BLOB = "bucket int, kind int, payload binary"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
#: Text whose windows travel together: a blob for each so many bytes and bucket.
FLUSH_BYTES = 4_000_000


def _blobs(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, p = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(p, pa.binary())], ["bucket", "kind", "payload"])


def _split(buckets: np.ndarray, kind: int, *arrays: np.ndarray) -> list[tuple[int, int, bytes]]:
    """A blob for each run of equal buckets; buckets ascend."""
    if not len(buckets):
        return []
    cut = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
    return [(int(buckets[a]), kind, W.pack(*(x[a:b] for x in arrays))) for a, b in zip(cut, np.r_[cut[1:], len(buckets)], strict=True)]


def _by_doc(doc: np.ndarray, pos: np.ndarray, n: int, kind: int) -> list[tuple[int, int, bytes]]:
    """Places as blobs for the buckets of their documents."""
    to = W.spark_bucket(doc, n)
    order = np.lexsort((pos, doc, to))
    return _split(to[order], kind, doc[order], pos[order].astype(np.uint32))


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: whether each begins a run, and the length of each run."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return new, np.diff(np.r_[at, len(new)])


def _probe(block: int, n: int):
    """Each task's distinct block-long windows: hash, whether a block, whether here twice, first place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for c in W.chunks(batch.column(1), False, FLUSH_BYTES):
                row = c.row_of_word()
                start = np.flatnonzero(np.arange(len(row)) + block <= c.offsets[1:][row])
                key = W.grams(c.hashes, block)[start] >> W.U64(16) if len(start) else np.zeros(0, W.U64)
                pos = start - c.offsets[:-1][row[start]]
                order = np.argsort(key, kind="stable")
                key, pos, doc = key[order], pos[order], ids[c.lo : c.hi][row[start[order]]]
                if not len(key):
                    continue
                new, size = _runs(key)
                at, many = np.flatnonzero(new), np.repeat(size > 1, size)
                flag = np.maximum.reduceat((pos % block == 0).astype(np.uint8), at) | (size > 1).astype(np.uint8) * np.uint8(2)
                yield _blobs(_split(W.key_bucket(key[at], n, 48), 0, key[at], flag, doc[at], pos[at].astype(np.uint32)) + _by_doc(doc[many], pos[many], n, 1))

    return run


def _taken(batches: Iterator[pa.RecordBatch], parts: list, *dtypes: type) -> Iterator[pa.RecordBatch]:
    """Blobs of kind 0 are unpacked into `parts`, a batch at a time; those of kind 1 pass on."""
    for batch in batches:
        kind, payload = batch.column("kind").to_numpy(), batch.column("payload")
        parts += [W.unpack(payload[i].as_buffer(), *dtypes) for i in np.flatnonzero(kind == 0).tolist()]
        if kind.any():
            yield batch.filter(pa.array(kind == 1)).select(["bucket", "kind", "payload"])


def _joined(parts: list) -> list[np.ndarray]:
    """The columns of `parts`, which is emptied."""
    out = [np.concatenate(x) for x in zip(*parts, strict=True)]
    parts.clear()
    return out


def _anchors(n: int):
    """Places of hashes that two tasks have and one of them as a block; a task's own repeats pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        yield from _taken(batches, parts, np.uint64, np.uint8, np.int64, np.uint32)
        if parts:
            key, flag, doc, pos = _joined(parts)
            order = np.argsort(key, kind="stable")
            new, size = _runs(key[order])
            whole = np.bitwise_or.reduceat(flag[order], np.flatnonzero(new)) & 1
            hit = order[np.repeat((size > 1) & (whole > 0), size)]
            hit = hit[flag[hit] < 2]
            yield _blobs(_by_doc(doc[hit], pos[hit], n, 1))
        give_back()

    return run


def _group(docs: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Rows by id, and their ids."""
    docs = docs.sort_by([("_id", "ascending")])
    return docs, docs.column("_id").to_numpy()


def _places(blobs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    parts = [W.unpack(x.as_buffer(), np.int64, np.uint32) for x in blobs.column("payload")]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]).astype(np.int64)


def _windows(block: int, width: int, n: int):
    """Windows around anchors: the first place of each sequence among these documents, and its repeats here."""

    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        if not hits.num_rows or not docs.num_rows:
            return pa.Table.from_batches([_blobs([])])
        docs, ids = _group(docs)
        parts = list(W.chunks(docs.column("_text"), False))
        hashes = np.concatenate([c.hashes for c in parts])
        offs = np.r_[0, np.cumsum(np.concatenate([np.diff(c.offsets) for c in parts]))]
        doc, pos = _places(hits)
        hit = np.zeros(len(hashes) + 1, np.int32)
        hit[1 + offs[np.searchsorted(ids, doc)] + pos] = 1
        hit = np.cumsum(hit)
        row = np.repeat(np.arange(len(ids)), np.diff(offs))
        start = np.flatnonzero(np.arange(len(row)) + width <= offs[1:][row])
        start = start[hit[start + width - block + 1] > hit[start]]
        if not len(start):
            return pa.Table.from_batches([_blobs([])])
        key, check = W.grams(hashes, width)[start], (W.grams(hashes, width, True)[start] >> W.U64(32)).astype(np.uint32)
        order = np.lexsort((check, key))
        new, size = _runs(key[order], check[order])
        own, at = ids[row[start]], start - offs[:-1][row[start]]
        one, rest = order[new], order[~new]
        return pa.Table.from_batches([_blobs(_split(W.key_bucket(key[one], n), 0, key[one], check[one], own[one], at[one].astype(np.uint32)) + _by_doc(own[rest], at[rest], n, 1))])

    return run


def _repeats(n: int):
    """Of each sequence all places but the first; a group's own repeats pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        yield from _taken(batches, parts, np.uint64, np.uint32, np.int64, np.uint32)
        if parts:
            key, check, doc, pos = _joined(parts)
            order = np.lexsort((pos, doc, check, key))
            new, _ = _runs(key[order], check[order])
            rest = order[~new]
            yield _blobs(_by_doc(doc[rest], pos[rest], n, 1))
        give_back()

    return run


def _drop(width: int, carry: list[str], rejoin: bool):
    """The documents without the words that a repeat covers."""

    def run(docs: pa.Table, repeats: pa.Table) -> pa.Table:
        docs, ids = _group(docs)
        texts = docs.column("_text").cast(pa.large_binary())
        offs = np.r_[0, np.cumsum(np.concatenate([np.diff(x) for x in W.word_offsets(docs.column("_text"))] or [np.zeros(0, np.int64)]))].astype(np.int64)
        doc, pos = _places(repeats)
        cover = np.zeros(offs[-1] + width + 1, np.int32)
        at = offs[np.searchsorted(ids, doc)] + pos
        np.add.at(cover, at, 1)
        np.subtract.at(cover, at + width, 1)
        gone = np.cumsum(cover)[: offs[-1]] > 0
        kept, removed, spans, lens = [], [], [], []
        for text, a, b in zip(texts, offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            mask, text = gone[a:b], text.as_py()
            k = int(np.count_nonzero(mask))
            removed.append(k)
            lens.append(0)
            if k:
                d = np.diff(np.r_[False, mask, False].astype(np.int8))
                spans.append(np.stack([np.flatnonzero(d == 1), np.flatnonzero(d == -1)], 1))
                lens[-1] = len(spans[-1])
                text = b" ".join(w for w, g in zip(text.split(), mask.tolist(), strict=True) if not g)
            elif rejoin:
                text = b" ".join((text or b"").split())
            kept.append(text)
        flat = np.concatenate(spans).astype(np.int32) if spans else np.zeros((0, 2), np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lens)].astype(np.int32)), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "stop"]))
        new = [pa.array(np.diff(offs)), pa.array(np.array(removed, np.int64), pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), lists.cast(_SPAN)]
        return pa.Table.from_arrays([docs.column(c) for c in carry] + new, [*carry, "n_words", "n_removed", "kept_text", "removed"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), width: int = 20, block: int = 10, rejoin: bool = True) -> DataFrame:
    """Each document without the words of repeated passages.

    A window is `width` consecutive words of one document. A word goes if a window that covers it has a word
    sequence that also starts earlier: in a document of smaller id, or earlier in the same one. Windows are
    judged on the input. Returns `id_col`, the columns in `carry`, n_words, n_removed, kept_text (kept words
    joined by one space; without `rejoin`, a text that loses nothing stays as it is, null too) and removed (word
    spans start..stop, maximal, ascending); columns of other names are not looked at. Null text: no words. Ids are
    of any type that sorts. A null id is below all others. Rows that share an id, or have none, are documents of
    their own in order of id and text, so a repeated row loses what it repeats. Only then, and where ids are no
    whole numbers, the rows are sorted and saved once with numbers of their own. Empty table: empty result.
    """
    if width < 2 * block - 1:
        raise ValueError("width must be at least 2 * block - 1")
    scratch, names = Scratch(docs.sparkSession, "substrings"), ["n_words", "n_removed", "kept_text", "removed"]
    clash = set(names) & {id_col, *carry}
    if clash:
        raise ValueError(f"reserved column names: {sorted(clash)}")
    keep = list(dict.fromkeys([id_col, *carry]))
    inner = [f"_c{i}" for i in range(len(keep))]  # no name of the input can clash with these
    slim = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, inner, strict=True)], F.col(text_col).alias("_text"))
    slim = numbered(slim, "_c0", "_text", "_id", scratch)
    n = bucket_count(slim, "_text")
    hits = scratch.save(slim.select("_id", "_text").mapInArrow(_probe(block, n), BLOB).groupBy("bucket").applyInArrow(_anchors(n), BLOB))
    placed = slim.withColumn("bucket", F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int"))
    grouped = placed.select("bucket", "_id", "_text").groupBy("bucket").cogroup(hits.groupBy("bucket"))
    repeats = scratch.save(grouped.applyInArrow(_windows(block, width, n), BLOB).groupBy("bucket").applyInArrow(_repeats(n), BLOB))
    scratch.drop(hits)
    fields = ", ".join(f"{k} {slim.schema[k].dataType.simpleString()}" for k in inner)
    out = placed.groupBy("bucket").cogroup(repeats.groupBy("bucket")).applyInArrow(_drop(width, inner, rejoin), f"{fields}, n_words bigint, n_removed bigint, kept_text string, removed array<struct<start:int,stop:int>>")
    return out.toDF(*keep, *names)
