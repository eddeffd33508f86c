"""Byte-pair encoding by speculation and verification, and decoding.

Texts are cut into words where the vocabulary's pattern cuts, with numpy over classes of characters. Distinct words
are encoded once a worker. Greedy longest match in a trie of the tokens *proposes* tokens for each word. A sequence
of tokens is the encoding of its text if and only if each adjacent pair is the encoding of its own two texts, so
*verification* is one vectorised test of all adjacent pairs: the inner edges of two neighbours are taken apart in the
reverse order of their merges, and no merge may ever have been possible across the boundary before those that made
the two. Words with a pair that fails, and only these, are merged exactly, lowest rank and leftmost first.

Decoding gathers the bytes of all tokens of a batch at once.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.scratch import bound_batches
from sparkloom.llm.cluster import give_back
from sparkloom.llm.words import text_buffers

OTHER, LETTER, NUMBER, SPACE = range(4)
#: White space, and the endings that the pattern cuts off after an apostrophe.
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_BEFORE_SPACE = re.compile(r"\S(?=\s)")
#: Characters that are cut and looked up at a time; a stretch without white space is never parted.
GROUP_CHARS = 1 << 20
#: Distinct words whose tokens a worker keeps, and the longest of them in characters; others are encoded each time.
KEPT_WORDS, KEPT_CHARS = 600_000, 64
#: Words of up to so many bytes are merged by looking for the lowest rank again and again, longer ones with a heap.
SCANNED_BYTES = 48


@cache
def character_classes(path: str) -> bytes:
    """Class of every code point, as the library cuts: its Unicode version decides. Zlib-compressed, some kB. Planes 4
    to 13, 15 and 16 are unassigned or for private use, so neither letters nor numbers."""
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    out = np.zeros(0x110000, np.uint8)
    for lo in (*range(0, 0xD800, 1 << 11), *range(0xE000, 0x40000, 1 << 11), *range(0xE0000, 0xF0000, 1 << 11)):
        text = "".join(f"\na{chr(c)}1" for c in range(lo, lo + (1 << 11)))
        starts = np.zeros(len(text) + 1, bool)
        starts[[a for _, (a, _) in cut(text)]] = True
        at = np.arange(2, len(text), 4)  # a letter before it, a digit after it
        out[lo : lo + len(at)] = np.where(~starts[at], LETTER, np.where(~starts[at + 1], NUMBER, OTHER))
        out[[lo + i for i in range(len(at)) if _WHITE.match(chr(lo + i))]] = SPACE
    return zlib.compress(out.tobytes(), 9)


@cache
def _classes(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def word_starts(text: str, firsts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where words begin in segments of a text; `firsts` ascend from 0, and no word crosses them.

    Runs of one class are words. White space before another run gives its last character away: a blank joins the run,
    any other character is a word of its own. An apostrophe alone takes one of the endings from the letters after it."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n, kind = len(code), classes[code]
    cut = np.r_[True, kind[1:] != kind[:-1]]
    cut[firsts] = True
    ends = np.zeros(n, bool)  # the last character of a segment
    ends[firsts[1:] - 1] = True
    ends[-1] = True
    last = np.r_[cut[1:], True]  # the last character of a run
    given = (kind == SPACE) & last & ~ends  # what white space gives away
    blank = given & (code == 0x20)
    cut[given] = True
    cut[1:] &= ~blank[:-1]
    # An apostrophe that is a word, before letters.
    mark = np.flatnonzero((code[:-1] == 0x27) & cut[:-1] & (kind[1:] == LETTER) & ~ends[:-1])
    if len(mark):
        after = np.r_[code, 0, 0]
        whole = np.r_[ends | last, True, True]
        for ending in _ENDINGS:
            hit = after[mark + 1] == ord(ending[0])
            if len(ending) == 2:
                hit &= (after[mark + 2] == ord(ending[1])) & ~whole[mark + 1]
            at = mark[hit]
            cut[at + 1] = False
            at = at[~whole[at + len(ending)]] + len(ending) + 1
            cut[at] = True
    return np.flatnonzero(cut)


class Vocabulary:
    """Tokens, merges and their trie as arrays, from a vocabulary file; and the tokens of words met so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the file writes as themselves
        others = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        ids = {bytes(map(byte.__getitem__, t)): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.n = max([*ids.values(), *self.special.values()]) + 1
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        text = [b""] * self.n
        for t, i in [*ids.items(), *((t.encode(), i) for t, i in self.special.items())]:
            text[i] = t
        self.size = np.array([len(t) for t in text], np.int64)
        self.bytes, self.start = np.frombuffer(b"".join(text), np.uint8), np.r_[0, np.cumsum(self.size)[:-1]]
        self.known = self.size > 0
        # A token of a merge has its rank from 1 and its two parts; a byte has rank 0.
        self.rank, self.left, self.right = np.zeros(self.n, np.int64), np.full(self.n, -1), np.full(self.n, -1)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for k, m in enumerate(spec["model"]["merges"], 1):
            a, b = m.split(" ") if isinstance(m, str) else m
            a, b = (ids[bytes(map(byte.__getitem__, x))] for x in (a, b))
            c = ids[text[a] + text[b]]
            self.pairs[a, b] = k, c
            self.rank[c], self.left[c], self.right[c] = k, a, b
        key = np.array([a * self.n + b for a, b in self.pairs])
        order = np.argsort(key)
        self._pair, self._pair_rank = key[order], np.array([k for k, _ in self.pairs.values()])[order]
        self._byte = [ids[bytes([b])] for b in range(256)]
        self.byte_id = np.array(self._byte)
        self._trie(ids)
        self._clear()

    def _trie(self, ids: dict[bytes, int]) -> None:
        node, edges, accept = {b"": 0}, {}, {0: -1}
        for t, i in ids.items():
            for k in range(1, len(t) + 1):
                if t[:k] not in node:
                    node[t[:k]] = len(node)
                    edges[node[t[: k - 1]] * 256 + t[k - 1]] = node[t[:k]]
            accept[node[t]] = i
        self._edge = np.array(sorted(edges))
        self._next = np.array([edges[e] for e in self._edge.tolist()])
        self._accept = np.full(len(node), -1)
        self._accept[list(accept)] = list(accept.values())

    def _clear(self) -> None:
        self.number, self._ids, self._first, self._n_ids, self._n = {}, np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), 0, 0

    def propose(self, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match over words that follow each other and end (exclusive) at `stop`: tokens, and where
        each begins. The longest token from each byte on is found for all bytes at once, a level of the trie a step."""
        end = np.repeat(stop, np.diff(np.r_[0, stop]))
        at, state, depth = np.arange(len(data)), np.zeros(len(data), np.int64), 0
        best, length = self.byte_id[data], np.ones(len(data), np.int64)
        while len(at):
            key = state * 256 + data[at + depth]
            found = np.minimum(np.searchsorted(self._edge, key), len(self._edge) - 1)
            hit = self._edge[found] == key
            at, state, depth = at[hit], self._next[found[hit]], depth + 1
            done = self._accept[state]
            best[at[done >= 0]], length[at[done >= 0]] = done[done >= 0], depth
            more = at + depth < end[at]
            at, state = at[more], state[more]
        follow, i, n = length.tolist(), 0, len(data)
        begins = []
        while i < n:
            begins.append(i)
            i += follow[i]
        begins = np.array(begins, np.int64)
        return best[begins], begins

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a[i], b[i] side by side stay apart, if their texts are merged as one.

        x and y are what touches the boundary at some time, going back: the later made of the two is taken apart, the
        right one of equals, since its merge came after. A merge of x and y is in time if its rank is below that of
        the merge that took x to its left, and not above that of the merge that took y to its right."""
        ok, x, y = np.ones(len(a), bool), a.copy(), b.copy()
        far = np.iinfo(np.int64).max
        by_x, by_y, at = np.full(len(a), far), np.full(len(a), far), np.arange(len(a))
        while len(at):
            key = x * self.n + y
            found = np.minimum(np.searchsorted(self._pair, key), len(self._pair) - 1)
            rank = np.where(self._pair[found] == key, self._pair_rank[found], far)
            bad = (rank < by_x) & (rank <= by_y) & (rank < far)
            ok[at[bad]] = False
            go = ~bad & ((self.rank[x] > 0) | (self.rank[y] > 0))
            at, x, y, by_x, by_y = at[go], x[go], y[go], by_x[go], by_y[go]
            on_left = self.rank[x] > self.rank[y]
            by_x, by_y = np.where(on_left, self.rank[x], by_x), np.where(on_left, by_y, self.rank[y])
            x, y = np.where(on_left, self.right[x], x), np.where(on_left, y, self.left[y])
        return ok

    def merge(self, word: bytes) -> list[int]:
        """The exact merges of one word: lowest rank first, leftmost of equals."""
        part = [self._byte[b] for b in word]
        return self._scan(part) if len(part) <= SCANNED_BYTES else self._heap(part)

    def _scan(self, part: list[int]) -> list[int]:
        none, find = (1 << 62, -1), self.pairs.get
        next_to = [find(p, none) for p in zip(part, part[1:], strict=False)]
        while next_to and (low := min(next_to)) != none:
            i = next_to.index(low)
            part[i : i + 2] = [low[1]]
            del next_to[i]
            if i:
                next_to[i - 1] = find((part[i - 1], part[i]), none)
            if i < len(next_to):
                next_to[i] = find((part[i], part[i + 1]), none)
        return part

    def _heap(self, part: list[int]) -> list[int]:
        n = len(part)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*self.pairs[p], i, *p) for i, p in enumerate(zip(part, part[1:], strict=False)) if p in self.pairs]
        heap = [(k, i, a, b, c) for k, c, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, c = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j < 0 or part[j] != b:
                continue
            part[i], part[j], after[i] = c, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for u, v in ((before[i], i), (i, after[i])):
                if u >= 0 and v >= 0 and (p := (part[u], part[v])) in self.pairs:
                    k, made = self.pairs[p]
                    heapq.heappush(heap, (k, u, *p, made))
        return [t for t in part if t >= 0]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, and each word's number of tokens."""
        raw = [w.encode("utf-8", "replace") for w in words]
        data, stop = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw])
        ids, begins = self.propose(data, stop)
        word = np.searchsorted(stop, begins, "right")
        inner = np.flatnonzero(word[1:] == word[:-1])
        failed = np.unique(word[inner[~self.compatible(ids[inner], ids[inner + 1])]])
        count = np.bincount(word, minlength=len(words))
        if len(failed):
            parts = np.split(ids, np.cumsum(count)[:-1])
            for w in failed.tolist():
                parts[w] = np.array(self.merge(raw[w]))
            ids, count = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, count

    def _learn(self, words: list[str]) -> None:
        ids, count = self.encode_words(words)
        while self._n_ids + len(ids) > len(self._ids):
            self._ids = np.r_[self._ids, np.zeros_like(self._ids)]
        while self._n + len(words) + 1 > len(self._first):
            self._first = np.r_[self._first, np.zeros_like(self._first)]
        self._ids[self._n_ids : self._n_ids + len(ids)] = ids
        self._first[self._n + 1 : self._n + len(words) + 1] = self._n_ids + np.cumsum(count)
        self.number.update(zip(words, range(self._n, self._n + len(words)), strict=True))
        self._n, self._n_ids = self._n + len(words), self._n_ids + len(ids)

    def segments(self, text: str) -> Iterator[tuple[str, int]]:
        """Parts of a text that may be cut each for itself, and -1; special tokens, and their ids. Parts end before
        white space, where a word always ends, or at special tokens."""
        at = 0
        for m in self._special.finditer(text) if self._special else ():
            yield from ((s, -1) for s in _parts(text[at : m.start()]))
            yield m[0], self.special[m[0]]
            at = m.end()
        yield from ((s, -1) for s in _parts(text[at:] if at else text))

    def encode_segments(self, segments: list[tuple[str, int]], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all segments, and each segment's number of tokens."""
        text, size = "".join(s for s, _ in segments), np.array([len(s) for s, _ in segments])
        firsts = np.r_[0, np.cumsum(size)]
        starts = word_starts(text, firsts[:-1], classes)
        given = np.array([i for _, i in segments])
        segment = np.searchsorted(firsts, starts, "right") - 1
        keep = (given[segment] < 0) | (starts == firsts[segment])  # a special token is one word
        starts, segment = starts[keep], segment[keep]
        cuts = [*starts.tolist(), len(text)]
        words = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        if self._n > KEPT_WORDS:
            self._clear()
        special = np.flatnonzero(given[segment] >= 0).tolist()
        for i in special:
            words[i] = ""  # no other word is empty
        if new := [w for w in dict.fromkeys(words) if w and w not in self.number]:
            self._learn(new)
        self.number.setdefault("", 0)
        number = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        del self.number[""]
        first, count = self._first[number], self._first[number + 1] - self._first[number]
        first[special], count[special] = 0, 1
        ends = np.cumsum(count)
        ids = self._ids[np.arange(ends[-1]) + np.repeat(first - (ends - count), count)]
        for i in special:
            ids[ends[i] - 1] = given[segment[i]]
        if any(len(w) > KEPT_CHARS for w in new):
            self._clear()
        return ids, np.bincount(segment, count, len(segments)).astype(np.int64)

    def encode(self, texts: list[str], classes: np.ndarray) -> pa.ListArray:
        """Tokens of each text."""
        ids, row, counts, group, chars = [], [], [], [], 0

        def flush() -> None:
            if group:
                got, count = self.encode_segments(group, classes)
                ids.append(got)
                counts.extend(count.tolist())

        for r, text in enumerate(texts):
            for s in self.segments(text):
                group.append(s)
                row.append(r)
                chars += len(s[0])
                if chars >= GROUP_CHARS:
                    flush()
                    group, chars = [], 0
        flush()
        total = np.bincount(np.array(row, np.int64), np.array(counts, float), len(texts)) if row else np.zeros(len(texts))
        offsets = np.r_[0, np.cumsum(total)].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Text of each row of tokens; bytes that are no UTF-8 become U+FFFD."""
        size = self.size[ids]
        ends = np.cumsum(size)
        data = self.bytes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - (ends - size), size)].tobytes()
        at = np.r_[0, ends][offsets].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]


def _parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > GROUP_CHARS:
        m = _BEFORE_SPACE.search(text, at + GROUP_CHARS)
        if m is None:
            break
        yield text[at : m.end()]
        at = m.end()
    if at < len(text):
        yield text[at:] if at else text


@cache
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file; a worker loads it once."""
    return Vocabulary(path)


def _encode(path: str, packed: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(0).to_pylist()]
            ids = vocabulary(path).encode(texts, _classes(packed))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], ids], [*batch.schema.names[1:], "ids"])
            give_back()

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = column.flatten()
            have = flat.is_valid().to_numpy(zero_copy_only=False)
            ids = flat.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            have &= (ids >= 0) & (ids < v.n)
            have[have] = v.known[ids[have]]
            offsets = np.r_[0, np.cumsum(have)][np.r_[0, np.cumsum(lengths)]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(v.decode(ids[have], offsets), pa.string())], [*batch.schema.names, "decoded"])

    return run


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids): the tokens of each whole text, as a byte-level vocabulary file in JSON says.

    Special tokens of the file that stand in a text become their ids; none is added. A null or empty text has no
    tokens. Texts are encoded whole, whatever their length, in stretches that end at white space. Each row is encoded
    for itself, so rows that repeat, null ids and ties give a row each. Other columns, of any name, are not looked
    at. Empty table: empty result. One pass, no shuffle. The file must be at `vocabulary` on every executor.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    inner = docs.select(F.col(text_col).alias("t"), F.col(id_col).alias("id"))
    return inner.mapInArrow(_encode(vocabulary, character_classes(vocabulary)), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def bpe_decode(tokens: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, ids_col, decoded): the text of each row's tokens, special tokens among them.

    Null ids, and ids that the vocabulary does not have, give nothing; a null row gives an empty text. Bytes that
    are no UTF-8 become U+FFFD. Rows are decoded each for itself. Empty table: empty result. One pass, no shuffle.
    """
    bound_batches(tokens.sparkSession)
    kinds = [tokens.schema[c].dataType.simpleString() for c in (id_col, ids_col)]
    inner = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    out = inner.mapInArrow(_decode(vocabulary), f"id {kinds[0]}, ids {kinds[1]}, decoded string")
    return out.withColumnsRenamed({"id": id_col, "ids": ids_col})
