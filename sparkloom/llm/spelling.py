"""Spelling variants: words that are one edit apart, found by merging the light subtrees of a trie.

The sorted distinct words are a trie: a node is a prefix, and its words are a range. Two words one edit apart leave
each other at one node, the end of their common prefix of d characters; then either both have another character there
and the same rest (replaced), or one has a character more (skipped). At each node the child of most words is heavy and
goes on the heavy path; the words of the other, light children, and a word that ends at the node, are merged into the
rest of the node's trie three times: with the character skipped, replaced by the heavy one, and with the heavy one put
before. Where a merged word coincides with another's end, the two are a pair. Of the words of two light children the
skipped forms coincide. A word is in at most log2(n) light children, so n words are merged n log n times at most.

Prefixes of more words than one task may have are merged by joins on the same three forms; words below them go to
tasks by the first prefix that has fewer. Common prefixes are taken at once: they are those of the least and the
greatest word.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from sparkloom.functions.scratch import Scratch, bound_batches
from sparkloom.llm.cluster import give_back, join_skewed

#: Words that one task's tries may have together, about, and words of one subtrie at most: a partition's share of all
#: words, but not fewer than the first nor more than the second.
LEAST, LIMIT = 1_000, 50_000
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000
_LAST = chr(0x10FFFF)


def _counts(shortest: int, every: int):
    """Counts of words of documents' texts; see word_counts()."""
    runs = re.compile(b"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % shortest)

    def made(words: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array(words.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                begun = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(runs.findall((text or "").encode("utf-8", "replace").lower())).items():  # lower() of bytes: A-Z only
                    h = zlib.crc32(word, begun)
                    if h % every == 0:
                        chars = word.decode()
                        at = h % len(chars)
                        if len(chars) == shortest:
                            continue
                        word = (chars[:at] + chars[at + 1 :]).encode()
                    total[word] += n
                if len(total) >= COUNTED:
                    yield made(total)
                    total.clear()
            give_back()
        if total:
            yield made(total)

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, least: int = 2, every: int = 31) -> DataFrame:
    """(word, n): maximal runs of letters A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z lower-cased. With
    h = crc32 of "id:run", a run whose h is divisible by `every` loses its code point h % length. Kept are results of
    `shortest` code points and more that occur `least` times and more. A null id counts as an empty one, a null or
    empty text has no words, each repeated row counts. A run is never parted, whatever its length. Tasks count words
    before the shuffle, so a word with a third of all occurrences is a row a task. Empty table: empty result."""
    bound_batches(docs.sparkSession)
    inner = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"))
    found = inner.mapInArrow(_counts(shortest, every), "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # the first difference is in lo .. hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


@F.pandas_udf(IntegerType())
def _common_prefix(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_common(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def merge_light(words: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs of places of words one edit apart, each once; words ascend and are distinct."""
    place = {w: i for i, w in enumerate(words)}
    heads = [(0, len(words))] if words else []
    while heads:
        lo, hi = heads.pop()
        while hi - lo > 1:  # down a heavy path
            d = _common(words[lo], words[hi - 1])
            prefix, ends, parts = words[lo][:d], [], []
            at = lo
            if len(words[lo]) == d:
                ends, at = [lo], lo + 1
            while at < hi:
                stop = bisect_left(words, prefix + words[at][d] + _LAST, at, hi)
                parts.append((at, stop))
                at = stop
            heavy = max(parts, key=lambda p: p[1] - p[0])
            letter, merged = words[heavy[0]][d], {}
            for light in (ends, *(range(*p) for p in parts if p != heavy)):
                for i in light:
                    w = words[i]
                    if (j := place.get(prefix + letter + w[d:])) is not None:
                        yield i, j
                    if len(w) == d:
                        continue
                    skipped, replaced = prefix + w[d + 1 :], prefix + letter + w[d + 1 :]
                    if (j := place.get(replaced)) is not None:
                        yield i, j
                    if (j := place.get(skipped)) is not None and words[j][d : d + 1] != w[d]:
                        yield i, j
                    same = merged.setdefault(skipped, [])
                    for j in same:
                        yield i, j
                    same.append(i)
            heads += [p for p in parts if p != heavy and p[1] - p[0] > 1]
            lo, hi = heavy


_LINKS = "word string, near bigint, most bigint, best string"


def _links(batch: pa.Table) -> pa.Table:
    """Of each word of some subtries that has a near word: how many, and the best of them."""
    pdf = batch.to_pandas()
    found = []
    for _, part in pdf.sort_values(["node", "word"]).groupby("node", sort=False):
        words, n = part["word"].tolist(), part["n"].tolist()
        near: dict[int, list] = {}
        for i, j in merge_light(words):
            for a, b in ((i, j), (j, i)):
                own = near.setdefault(a, [0, 0, ""])
                own[0] += 1
                if n[b] > own[1] or n[b] == own[1] and words[b] < own[2]:
                    own[1:] = n[b], words[b]
        found += [(words[i], *own) for i, own in near.items()]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.table([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], ["word", "near", "most", "best"])


def near_words(words: DataFrame, scratch: Scratch, limit: int | None = None) -> DataFrame:
    """(word, near, most, best): of each of the distinct words of (word, n) that differs from another by exactly one
    inserted, deleted or replaced code point, the number of such words, and n and text of the best, which has most n
    and is the smallest of those. Words without any have no row. A word may be as long as a text; an empty word, too,
    is a word. The result does not depend on the limit."""
    rows, seen = scratch.measure(words.select("word", "n", F.lit("").alias("node")), F.count("*").alias("rows"))
    words, partitions = rows.drop("node"), int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    if limit is None:
        limit = min(LIMIT, max(LEAST, seen["rows"] // partitions))
    dealt, tops = [], []
    while True:
        size = rows.groupBy("node").agg(F.count("*").alias("c"), F.min("word").alias("lo"), F.max("word").alias("hi"))
        top = scratch.save(size.filter(F.col("c") > max(limit, 1)).select("node", _common_prefix("lo", "hi").alias("d")))
        dealt.append(rows.join(top, "node", "left_anti").select("node", "word", "n"))
        if top.isEmpty():
            break
        here = join_skewed(rows, top, "node").withColumn("letter", F.expr("substring(word, d + 1, 1)"))
        heavy = here.filter("letter <> ''").groupBy("node", "letter").agg(F.count("*").alias("c")).groupBy("node").agg(F.max(F.struct("c", "letter")).alias("m")).select("node", F.col("m.letter").alias("heavy"))
        here = scratch.save(join_skewed(here, heavy, "node"))
        tops.append(here.filter("letter <> heavy").drop("node"))
        rows = here.filter("letter <> ''").select(F.expr("substring(word, 1, d + 1)").alias("node"), "word", "n")
    buckets = max(partitions, -(-seen["rows"] // max(limit, 1)))
    below = dealt[0]
    for d in dealt[1:]:
        below = below.unionByName(d)
    links = below.withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(buckets))).groupBy("bucket").applyInArrow(_links, _LINKS)
    if tops:
        light = tops[0]
        for t in tops[1:]:
            light = light.unionByName(t)
        pairs = _merged(light, words)
        mirrored = pairs.select(F.explode(F.array(F.struct("a", "b", F.col("n_b").alias("n")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_a").alias("n")))).alias("p")).select("p.*")
        links = links.unionByName(mirrored.select(F.col("a").alias("word"), F.lit(1).cast("bigint").alias("near"), F.col("n").alias("most"), F.col("b").alias("best")))
    best = F.min(F.struct((-F.col("most")).alias("m"), "best"))
    return links.groupBy("word").agg(F.sum("near").alias("near"), best.alias("x")).select("word", "near", (-F.col("x.m")).alias("most"), F.col("x.best").alias("best"))


def _merged(light: DataFrame, words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): pairs that leave each other at a prefix of the top. light: word, n, d, letter, heavy."""
    skipped = F.expr("concat(substring(word, 1, d), substring(word, d + 2))")
    made = {
        "before": F.expr("concat(substring(word, 1, d), heavy, substring(word, d + 1))"),
        "replaced": F.expr("concat(substring(word, 1, d), heavy, substring(word, d + 2))"),
        "skipped": skipped,
    }
    forms = F.array(*[F.struct(F.lit(kind).alias("kind"), form.alias("form")) for kind, form in made.items()])
    probes = light.withColumn("f", F.explode(forms)).filter("letter <> '' or f.kind = 'before'").select(F.col("word").alias("a"), F.col("n").alias("n_a"), "d", "letter", "f.*")
    ends = words.select(F.col("word").alias("form"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    met = probes.join(ends, "form").filter("kind <> 'skipped' or substring(b, d + 1, 1) <> letter").select("a", "n_a", "b", "n_b")
    one = light.filter("letter <> ''").select(skipped.alias("form"), "d", F.col("word").alias("a"), F.col("n").alias("n_a"))
    both = one.join(one.withColumnsRenamed({"a": "b", "n_a": "n_b"}), ["form", "d"]).filter("a < b").select("a", "n_a", "b", "n_b")
    return met.unionByName(both)


def spelling_variants(words: DataFrame, times: int = 10, limit: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each of the distinct words of (word, n).

    n_near counts the words that are near: one inserted, deleted or replaced code point apart. form is the near word
    of largest n (ties: smallest by code point) if its n is `times` that of the word or more, else null; form_n is its
    n. root is where forms lead, the word itself where it has none; each step has `times` the n, so they end, and the
    rounds that double the steps are known from the largest n. Null words, and null n, are no words. Empty table:
    empty result.
    """
    if times < 2:
        raise ValueError("times must be 2 or more, or forms could lead in circles")
    scratch = Scratch(words.sparkSession, "spelling")
    bound_batches(words.sparkSession)
    words = scratch.save(words.select("word", F.col("n").cast("bigint").alias("n")).dropna())
    near = near_words(words, scratch, limit)
    all_, seen = scratch.measure(words.join(near, "word", "left"), F.max("n").alias("n"))
    has = F.col("most") >= times * F.col("n")
    chains = all_.filter(has).select("word", F.col("best").alias("to"))
    steps, n = 0, seen["n"] or 0
    while n >= times:
        steps, n = steps + 1, n // times
    for _ in range(int(np.ceil(np.log2(steps))) if steps > 1 else 0):
        chains = scratch.save(chains)
        on = chains.select(F.col("word").alias("to"), F.col("to").alias("on"))
        chains = chains.join(on, "to", "left").select("word", F.coalesce("on", "to").alias("to"))
    out = all_.join(chains, "word", "left")
    return out.select("word", F.when(has, F.col("best")).alias("form"), F.coalesce("to", "word").alias("root"), "n", F.coalesce("near", F.lit(0)).alias("n_near"), F.when(has, F.col("most")).alias("form_n"))
