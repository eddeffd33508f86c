"""Mixing sources to target weights by subset-sum budget fitting.

1. Targets: sources share the total by weight; a source stops at `most` times its size and its excess is
   shared again by weight.
2. A source is repeated whole ``floor(target / size)`` times. What is left is a budget for one more copy of
   some documents.
3. Documents are counted by exact length. Most of the budget is dealt in proportion to these counts; the rest,
   bounded by `window`, is fitted by a bounded-knapsack dynamic program over what is left of each length. Where
   that misses the budget, the program is given more of it, up to the whole, or runs in a coarser unit first.
4. So many documents of each length are selected in the order of a seeded hash.

Counts are aggregated before any shuffle, by source, length and a hash slice. There are as many slices as the
square root of the largest source's documents, so neither the documents of a hot length in one slice nor the
slices of that length gather in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.cluster import Scratch

#: Up to so many sources, the table of targets is broadcast: one short row a source.
FEW_SOURCES = 100_000
_PATTERN = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict, total: float, weights: dict, most: float) -> dict:
    """Each source's target: shares of `total` by weight, none above `most` times its size."""
    out, open_, left = dict.fromkeys(sizes, 0.0), {s for s in sizes if sizes[s] > 0}, total
    while open_:
        whole = math.fsum(weights[s] for s in open_)
        if whole <= 0:
            break
        full = {s for s in open_ if left * weights[s] / whole > most * sizes[s]}
        if not full:
            out |= {s: left * weights[s] / whole for s in open_}
            break
        out |= {s: float(most * sizes[s]) for s in full}
        left = total - math.fsum(out[s] for s in out if s not in open_ or s in full)
        open_ -= full
    return out


def _steps(lengths: np.ndarray, spare: np.ndarray, room: int) -> int:
    """Steps of `_knapsack`, each of which holds a bit for every sum."""
    return sum(min(int(n), room // int(size)).bit_length() for size, n in zip(lengths, spare, strict=True))


def _knapsack(lengths: np.ndarray, spare: np.ndarray, room: int) -> np.ndarray:
    """How many of each length to take for the greatest sum up to `room`: bounded knapsack with a bit for each
    sum that can be reached; items of one length in powers of two."""
    mask, sums, steps = (1 << room + 1) - 1, 1, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, left, k = int(lengths[i]), min(int(spare[i]), room // int(lengths[i])), 1
        while left > 0:
            n = min(k, left)
            steps.append((i, n, sums))
            sums |= sums << n * size & mask
            left -= n
            k *= 2
        if sums >> room & 1:
            break
    at, take = sums.bit_length() - 1, np.zeros(len(lengths), np.int64)
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            at -= n * int(lengths[i])
            take[i] += n
    return take


def _proportional(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int, bits: int) -> np.ndarray:
    """A fit that deals all but `window` words in proportion. What floors leave beyond the window is dealt longest
    first or, with `bits`, by the knapsack in a unit of words that keeps its steps within so many bits."""
    goal = max(0, budget - window // 2)
    take = np.floor(counts * (goal / int(lengths @ counts))).astype(np.int64)
    rest, spare = budget - int(lengths @ take), counts - take
    if bits and rest > window:
        unit = -(-_steps(lengths, spare, rest) * (rest + 1) // bits)
        room = rest if unit == 1 else rest - window // 2
        more = _knapsack(-(-lengths // unit), spare, room // unit)  # lengths rounded up: never beyond the room
        take, spare, rest = take + more, spare - more, rest - int(lengths @ more)
    for i in np.argsort(-lengths, kind="stable").tolist():
        if rest <= window:
            break
        k = min(int(spare[i]), (rest - window // 2) // int(lengths[i]))
        if k > 0:
            take[i] += k
            spare[i] -= k
            rest -= k * int(lengths[i])
    return take + _knapsack(lengths, spare, rest)


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = 1 << 16, bits: int = 1 << 30) -> np.ndarray:
    """How many of each length to take so that the sum of lengths comes near to `budget`, from below. Lengths are
    distinct and positive.

    Most is dealt in proportion, the last `window` words by the dynamic program. Where that misses the budget,
    the window grows up to the whole budget, with which the sum is a best one, as long as the program's steps
    stay within `bits` bits; beyond, the program runs in a coarser unit of words first. The best fit is taken."""
    total = int(lengths @ counts)
    if budget <= 0 or total == 0:
        return np.zeros(len(counts), np.int64)
    if budget >= total:
        return counts.copy()
    best = _proportional(lengths, counts, budget, window, 0)
    wide = window
    while int(lengths @ best) < budget and wide < 2 * budget:
        wide = min(4 * wide, 2 * budget)
        if _steps(lengths, counts, min(wide, budget)) * (min(wide, budget) + 1) > bits:
            now = _proportional(lengths, counts, budget, window, bits)
            wide = 2 * budget
        else:
            now = _proportional(lengths, counts, budget, wide, 0)
        best = max(best, now, key=lambda take: int(lengths @ take))
    return best


def _fit_source(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    pdf = pdf.sort_values("size")
    take = fit(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), int(pdf["budget"].iloc[0]), window)
    return pd.DataFrame({"src": pdf["src"], "size": pdf["size"], "take": take})


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict | tuple = (1, 2, 3), share: float = 1.0, most: int = 3, seed: int = 17, window: int = 1 << 16) -> DataFrame:
    """How many words of each document a mix takes, whole copies of documents throughout.

    A document's size is its number of words, runs other than space and 0x09-0x0D; a null text has 0. `weights`
    is a mapping from source to weight or a tuple dealt out in turn to the sources by code point, null last.
    The sources share `share` of all sizes; a source's target stops at `most` times its size. Returns one row
    for each row of the input: `id_col`, source, size, source_size, target, taken (a multiple of size, at most
    `most` times it). Ties in the seeded hash go to the smaller id; rows that repeat an id are told apart by
    nothing and may be taken in either order, with the same result. Null ids take part. A source all of whose
    documents are empty has target 0. Other columns, of any name, are not looked at. Empty table: empty result.
    One row a source comes to the driver; nothing else does.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mixing")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(source_col).cast("string").alias("src"), F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.regexp_count(F.col(text_col), F.lit(_PATTERN))).cast("bigint").alias("size"))
    rows = scratch.save(rows)
    by_source = rows.groupBy("src").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    order = sorted(by_source, key=lambda r: (r.src is None, r.src or ""))
    sizes = {r.src: r["size"] for r in order}
    given = {s: weights[i % len(weights)] for i, s in enumerate(sizes)} if isinstance(weights, tuple) else {s: weights.get(s, 0) for s in sizes}
    goal = targets(sizes, share * sum(sizes.values()), given, most)
    if not order:
        return rows.select(F.col("id").alias(id_col), F.col("src").alias("source"), "size", F.lit(0).cast("bigint").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("bigint").alias("taken"))
    plan = [(s, sizes[s], goal[s], k := min(most, int(goal[s] // sizes[s])) if sizes[s] else 0, round(goal[s] - k * sizes[s]) if sizes[s] and k < most else 0) for s in sizes]
    plan = spark.createDataFrame(plan, "src string, source_size bigint, target double, epochs bigint, budget bigint")
    n_slices = math.isqrt(max(r.n for r in order)) + 1
    pick = F.xxhash64(F.lit(seed), "id")
    sliced = rows.withColumn("pick", pick).withColumn("slice", F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(n_slices)).cast("int"))
    count = scratch.save(sliced.filter("size > 0").groupBy("src", "size", "slice").agg(F.count("*").alias("n")))
    lengths = count.groupBy("src", "size").agg(F.sum("n").alias("n"))
    few = F.broadcast if len(order) <= FEW_SOURCES else (lambda df: df)
    budget = plan.select(F.col("src").alias("psrc"), "budget")
    lengths = lengths.join(few(budget), F.col("src").eqNullSafe(F.col("psrc"))).select("src", "size", "n", "budget")
    take = lengths.groupBy("src").applyInPandas(lambda pdf: _fit_source(pdf, window), "src string, size bigint, take bigint")
    take = take.filter("take > 0").withColumnsRenamed({"src": "tsrc", "size": "tsize"})
    on = F.col("src").eqNullSafe(F.col("tsrc")) & (F.col("size") == F.col("tsize"))
    before = F.sum("n").over(Window.partitionBy("src", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    quota = count.join(take, on).withColumn("before", F.coalesce(before, F.lit(0)))
    quota = quota.select(F.col("src").alias("qsrc"), F.col("size").alias("qsize"), F.col("slice").alias("qslice"), F.least("n", F.greatest(F.lit(0), F.col("take") - F.col("before"))).alias("quota")).filter("quota > 0")
    on = F.col("src").eqNullSafe(F.col("qsrc")) & (F.col("size") == F.col("qsize")) & (F.col("slice") == F.col("qslice"))
    rank = F.row_number().over(Window.partitionBy("src", "size", "slice").orderBy("pick", "id"))
    chosen = sliced.join(quota, on, "left").withColumn("extra", F.when(rank <= F.col("quota"), 1).otherwise(0))
    out = chosen.join(few(plan.withColumnRenamed("src", "psrc")), F.col("src").eqNullSafe(F.col("psrc")))
    return out.select(F.col("id").alias(id_col), F.col("src").alias("source"), "size", "source_size", "target", (F.col("size") * (F.col("epochs") + F.col("extra"))).alias("taken"))
