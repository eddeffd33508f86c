"""Words and word n-grams of whole texts as 64-bit hashes, a column of texts at a time.

A word is a maximal run of bytes other than space and 0x09-0x0D; that is the pattern
``[^\\x20\\x09-\\x0D]+``, since UTF-8 never uses those bytes inside a longer character. All work is
on whole numpy arrays: an n-gram's hash is a difference of prefix sums of ``h[i] * M**i`` (mod 2**64),
divided by ``M**start``, which is exact because M is odd.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BYTE_M, _WORD_M, _CHECK_M = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Text handled at a time; a longer document is handled whole, alone.
CHUNK_BYTES = 2_000_000
#: Bytes of words hashed at a time; arrays of so many numbers stay in the processor's caches.
PIECE_BYTES = 1 << 17
#: Most powers held of one multiplier, 16 bytes each.
HELD = 1 << 19


def powers(m: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """M**i and M**-i modulo 2**64 for i < n."""
    have = _powers.get(m)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, m, U64), np.full(size, pow(m, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        have = _powers[m] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size > HELD:  # one very long text: do not hold its table
            _powers.pop(m)
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def spark_bucket(ids: np.ndarray, n: int) -> np.ndarray:
    """What ``pmod(xxhash64(id), n)`` gives for a BIGINT column."""
    p1, p2, p3, p4, p5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    x = ids.astype(np.int64).view(U64) * p2
    x = ((x << U64(31)) | (x >> U64(33))) * p1
    h = (U64(42) + p5 + U64(8)) ^ x
    h = ((h << U64(27)) | (h >> U64(37))) * p1 + p4
    h = (h ^ (h >> U64(33))) * p2
    h = (h ^ (h >> U64(29))) * p3
    return np.mod((h ^ (h >> U64(32))).view(np.int64), n).astype(np.int32)


def span_sums(values: np.ndarray, m: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Of each span, the sum of value[i] * m**(i - start)."""
    up, down = powers(m, len(values) + 1)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[:-1], out=total[1:])
    return (total[stop] - total[start]) * down[start]


@dataclass
class Chunk:
    """The words of rows lo..hi of a batch: hash, and where each row's words begin (n_rows + 1)."""

    lo: int
    hi: int
    hashes: np.ndarray
    offsets: np.ndarray

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a string column; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    if len(texts) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of each word; words end where rows do."""
    inside = ~_SPACE[data]
    full = offs[1:] > offs[:-1]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offs[:-1][full]
    first[at] |= inside[at]
    at = offs[1:][full] - 1
    last[at] |= inside[at]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_spans(data: np.ndarray, start: np.ndarray, stop: np.ndarray, lower: bool) -> np.ndarray:
    """Hash of the bytes of each span; spans ascend. About PIECE_BYTES at a time, a longer span alone."""
    out, i = np.empty(len(start), U64), 0
    while i < len(start):
        base = int(start[i])
        j = max(i + 1, int(np.searchsorted(stop, base + PIECE_BYTES, "right")))
        piece = data[base : int(stop[j - 1])]
        values = (_LOWER[piece] if lower else piece).astype(U64)
        values += U64(1)
        size = (stop[i:j] - start[i:j]).astype(U64)
        out[i:j] = mix(span_sums(values, _BYTE_M, start[i:j] - base, stop[i:j] - base) + size * U64(0xFF51AFD7ED558CCD))
        i = j
    return out


def hash_words(data: np.ndarray, offs: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the index of each row's first word (n_rows + 1)."""
    if not len(data):
        return np.zeros(0, U64), np.zeros(len(offs), np.int64)
    start, stop = word_spans(data, offs)
    return hash_spans(data, start, stop, lower), np.searchsorted(start, offs)


def chunks(texts: pa.Array, lower: bool, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The words of a column, about `limit` bytes of text at a time; rows stay whole."""
    data, offs = text_buffers(texts)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hashes, words = hash_words(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], lower)
        yield Chunk(lo, hi, hashes, words)
        lo = hi


def word_offsets(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[np.ndarray]:
    """Where each row's words begin (n_rows + 1), about `limit` bytes of text at a time."""
    data, offs = text_buffers(texts)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        own = offs[lo : hi + 1] - offs[lo]
        yield np.searchsorted(word_spans(data[offs[lo] : offs[hi]], own)[0], own) if own[-1] else np.zeros(len(own), np.int64)
        lo = hi


def grams(hashes: np.ndarray, k: int, check: bool = False) -> np.ndarray:
    """Hash of the k words from each word on, without regard to rows; k - 1 fewer than words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    at = np.arange(n)
    return mix(span_sums(hashes, _CHECK_M if check else _WORD_M, at, at + k) + U64(k))


def shingle_sets(chunk: Chunk, k: int) -> Iterator[np.ndarray]:
    """Of each row, the sorted distinct k-word shingles; with fewer words the whole sequence as one."""
    rolled = grams(chunk.hashes, k)
    for a, b in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(rolled[a : b - k + 1])
        elif b > a:
            yield grams(chunk.hashes[a:b], b - a)
        else:
            yield np.zeros(0, U64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as bytes, less their minimum and byte plane by byte plane, which LZ4 then shrinks."""
    n = len(arrays[0])
    out = [np.array([n], np.int64).tobytes()]
    for a in arrays:
        base = a.min() if n else a.dtype.type(0)
        out += [np.array([base], a.dtype).tobytes(), (a - base).view(np.uint8).reshape(n, a.dtype.itemsize).T.tobytes()]
    return b"".join(out)


def unpack(blob: bytes, *dtypes: type) -> list[np.ndarray]:
    """The arrays that pack() was given."""
    n, at, out = int(np.frombuffer(blob, np.int64, 1)[0]), 8, []
    for kind in map(np.dtype, dtypes):
        w = kind.itemsize
        base = np.frombuffer(blob, kind, 1, at)
        planes = np.frombuffer(blob, np.uint8, n * w, at + w).reshape(w, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind) + base[0] if n else np.zeros(0, kind))
        at += w + n * w
    return out


def key_bucket(keys: np.ndarray, n: int, bits: int = 64) -> np.ndarray:
    """Bucket of a hash of so many bits by its highest 32, so that sorted keys have sorted buckets."""
    return (((keys >> U64(bits - 32)) * U64(n)) >> U64(32)).astype(np.int32)
