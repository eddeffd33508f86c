"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

An item's MinHash sketch is its smallest shingle hashes (bottom-k). Items are partitioned by size, in bands of a
factor of two, and a band's largest size u fixes its parameters:

- at most ``m = u - ceil(t u)`` shingles of an item of the band are missing from a document that holds a share t;
- the sketch has ``k = m + SPARE`` hashes, or all of a smaller item's;
- so at least ``k - m`` of an item's sketch must be among the document's hashes. That is the band's cut.

The sketch's share in a document estimates containment directly, however long the document: sketches of the
documents themselves would agree with probability n / |document|, near 0 for short items in long documents, so
a document is looked up with its whole set. The cut is a bound, not an estimate, so no item is missed (recall is
1), and what passes it is verified by its exact share of shingles.

The items' index is broadcast in parts of a fixed number of shingles: one pass over the documents for each part,
no shuffle, and memory that follows neither side. With several parts, each pass is saved before a third part is
read, so that two parts are held at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import words as W
from sparkloom.llm.cluster import Scratch

#: Shingles of items in one broadcast part: 8 bytes each, with places at most 64 MB.
PART_SHINGLES = 2_000_000
#: Hashes of a sketch beyond those that a document may lack: the cut of items that have so many.
SPARE = 4


class Index:
    """Items of one part: their shingles, and from a MinHash to the items that have it."""

    def __init__(self, items: list[tuple[int, np.ndarray]], threshold: Fraction):
        self.ids = np.array([i for i, _ in items], np.int64)
        self.sizes = np.array([len(s) for _, s in items], np.int64)
        self.need = np.array([-(-threshold.numerator * n // threshold.denominator) for n in self.sizes.tolist()], np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes)].astype(np.int64)
        self.shingles = np.concatenate([s for _, s in items])
        band = np.floor(np.log2(np.maximum(1, self.sizes))).astype(np.int64)
        self.sketch, self.cut = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
        keys, owner = [], []
        for p in np.unique(band).tolist():
            own = np.flatnonzero(band == p)
            most = int(self.sizes[own].max())
            missing = most - -(-threshold.numerator * most // threshold.denominator)
            self.sketch[own] = np.minimum(self.sizes[own], missing + SPARE)
            self.cut[own] = np.maximum(1, self.sketch[own] - missing)
            for i in own.tolist():
                keys.append(items[i][1][: self.sketch[i]])  # shingles ascend
                owner.append(np.full(len(keys[-1]), i))
        key, own = np.concatenate(keys), np.concatenate(owner)
        order = np.argsort(key, kind="stable")
        self.keys, self.first = np.unique(key[order], return_index=True)
        self.first = np.r_[self.first, len(key)]
        self.owner = own[order]

    def candidates(self, found: np.ndarray) -> np.ndarray:
        """Items whose band's cut the hashes at these places of `keys` reach."""
        item, n = np.unique(np.concatenate([self.owner[self.first[i] : self.first[i + 1]] for i in found.tolist()]), return_counts=True)
        return item[n >= self.cut[item]]


def _found(index: Index, widths: list[int], texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, shared, size) where a text holds enough of an item."""
    for c in W.chunks(texts, True):
        row, at, hits = c.row_of_word(), np.arange(len(c.hashes)), []
        for width in widths:
            g = W.grams(c.hashes, width)
            place = np.searchsorted(index.keys, g)
            ok = index.keys[np.minimum(place, len(index.keys) - 1)] == g
            ok &= at[: len(g)] + width <= c.offsets[1:][row[: len(g)]]
            hits.append(np.stack([row[: len(g)][ok], place[ok]], 1))
        hit = np.unique(np.concatenate(hits), axis=0)
        edge = np.searchsorted(hit[:, 0], np.arange(len(c.offsets)))
        for r in np.unique(hit[:, 0]).tolist():
            passed = index.candidates(hit[edge[r] : edge[r + 1], 1])
            if not len(passed):
                continue
            words = c.hashes[c.offsets[r] : c.offsets[r + 1]]
            own = np.unique(np.concatenate([W.grams(words, width) for width in widths]))
            for i in passed.tolist():
                s = index.shingles[index.starts[i] : index.starts[i + 1]]
                shared = int(np.count_nonzero(own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s))
                if shared >= index.need[i]:
                    yield c.lo + r, int(index.ids[i]), shared, int(index.sizes[i])


def _pairs(index: Index, widths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, *rest = _columns(_found(index, widths, batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(x, pa.int64()) for x in rest]], ["id", "item", "n_shared", "n_item"])

    return run


def _clean(index: Index, widths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[r for r, *_ in _found(index, widths, batch.column(batch.num_columns - 1))]] = False
            yield batch.filter(pa.array(keep))

    return run


def _columns(rows: Iterator[tuple]) -> list[list]:
    rows = list(rows)
    return [list(x) for x in zip(*rows, strict=True)] if rows else [[], [], [], []]


def _parts(items: DataFrame, item_col: str, item_text: str, shingle: int, threshold: Fraction, part: int) -> Iterator[tuple[Index, list[int]]]:
    """The items' index in parts, in order of their ids."""
    held: list[tuple[int, np.ndarray]] = []
    lengths, size = {shingle}, 0
    for r in items.select(F.col(item_col).cast("bigint").alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null").distinct().orderBy("i", "t").toLocalIterator():
        (c,) = W.chunks(pa.array([r.t]), True)
        n = len(c.hashes)
        if not n:
            continue
        s = np.unique(W.grams(c.hashes, min(n, shingle)))
        if held and size + len(s) > part:
            yield Index(held, threshold), sorted(lengths)
            held, lengths, size = [], {shingle}, 0
        held.append((r.i, s))
        lengths.add(min(n, shingle))
        size += len(s)
    if held:
        yield Index(held, threshold), sorted(lengths)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shingle: int = 5, threshold: Fraction | str = "0.8", part: int = PART_SHINGLES) -> DataFrame:
    """Pairs of a document and a test item of whose shingles the document holds `threshold` or more.

    Words are runs other than space and 0x09-0x0D, with A-Z in lower case; an item's set is its distinct
    shingles of `shingle` words, or its whole sequence if it has fewer words. Returns `id_col`, `item_col`,
    n_shared, n_item (shingles), containment, one row a pair. Null or wordless texts hold nothing and are held
    by nothing; rows with a null item id are left out, rows with a null document id are reported with null. Item ids are whole numbers.
    Rows that repeat give one row; an item id with several texts gives one row for each text held. Other
    columns, of any name, are not looked at. Without documents or items the result is empty.
    """
    threshold = Fraction(threshold)
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fields = f"id {texts.schema['id'].dataType.simpleString()}, item bigint, n_shared bigint, n_item bigint"
    scratch = Scratch(docs.sparkSession, "contaminated")
    found = _passes(_parts(items, item_col, item_text, shingle, threshold, part), lambda p, _: texts.mapInArrow(_pairs(*p), fields), scratch.save)
    if not found:
        found = [docs.sparkSession.createDataFrame([], fields)]
    out = reduce(DataFrame.unionByName, found).distinct()
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def _passes(parts: Iterator, run: Callable, save: Callable) -> list[DataFrame]:
    """run(part, frames so far) of each part; all but a single one are saved before the next part is made."""
    done: list[DataFrame] = []
    held = next(parts, None)
    while held is not None:
        df, held = run(held, done), None
        held = next(parts, None)
        done.append(df if held is None and not done else save(df))
    return done


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shingle: int = 5, threshold: Fraction | str = "0.8", part: int = PART_SHINGLES) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose text holds too little of every item to be in
    `contaminated`. Rows are judged one by one, so null and repeated ids make no difference; no shuffle."""
    names, scratch = docs.columns, Scratch(docs.sparkSession, "decontaminate")
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("text", F.col(f"c{names.index(text_col)}"))

    def save(df: DataFrame) -> DataFrame:
        out = scratch.save(df)
        scratch.drop(*kept)
        kept[:] = [out]
        return out

    kept: list[DataFrame] = []
    done = _passes(_parts(items, item_col, item_text, shingle, Fraction(threshold), part), lambda p, so_far: (so_far[-1] if so_far else inner).mapInArrow(_clean(*p), inner.schema), save)
    return (done[-1] if done else inner).drop("text").toDF(*names)
