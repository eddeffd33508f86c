"""Global sorts, selection and balanced blocks of keys, a column `value`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators.sparse import prefix_sum


def random_keys(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """n keys in 0 .. 2**31 - 1."""
    return spark.range(n).select(F.floor(F.rand(seed) * 2147483648).cast("bigint").alias("value"))


def sort_keys(keys: DataFrame) -> DataFrame:
    """Keys ascending; repeats and all of the 32-bit range kept. One range exchange, then local sorts."""
    return keys.select("value").orderBy("value")


def sort_locally(keys: DataFrame) -> DataFrame:
    """Each partition sorted, without an exchange."""
    return keys.sortWithinPartitions("value")


def positions(keys: DataFrame, step: int = 10_000) -> DataFrame:
    """pos (from 0), value; null keys, too, have positions, the first. Equal keys are counted first, so a frequent key is one row in the exchange and is
    spread again afterwards, `step` rows at a time."""
    n = keys.groupBy("value").agg(F.count("*").alias("n"))
    at = prefix_sum(n, "value", "n")
    starts = at.select("value", "before", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(step))).alias("a"))
    each = starts.select("value", "before", F.explode(F.sequence(F.col("a"), F.least(F.col("a") + step, F.col("n")) - 1)).alias("i"))
    return each.select((F.col("before") + F.col("i")).alias("pos"), "value")


def balanced_blocks(keys: DataFrame, parts: int, n: int | None = None) -> DataFrame:
    """pos, value, block: blocks of n // parts keys in global order; the remainder goes to the last."""
    n = keys.count() if n is None else n
    return positions(keys).withColumn("block", F.least(F.floor(F.col("pos") / max(1, n // parts)), F.lit(parts - 1)).cast("bigint"))


def redistributed(blocks: DataFrame, parts: int) -> DataFrame:
    """balanced_blocks() moved: partition i holds block i, in order of position."""
    return blocks.repartitionById(parts, F.col("block").cast("int")).sortWithinPartitions("pos")


#: Ranges that the keys in question are counted in at a time.
RANGES = 64


def nth(keys: DataFrame, k: int):
    """The k-th smallest key (from 0) that is not null, repeats counted; None if there are fewer. Keys are counted in
    ranges between a sketch's quantiles, and the range that holds the k-th is cut again, until it is one key; equal
    keys, however many, end it. Counts alone come to the driver, and a round leaves a RANGES-th or so."""
    inside, below = keys.filter("value is not null"), 0
    while True:
        seen = inside.agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"), F.percentile_approx("value", [i / RANGES for i in range(1, RANGES)], 10_000).alias("e")).first()
        if not 0 <= k - below < seen.n:
            return None
        if seen.lo == seen.hi:
            return seen.lo
        edges = sorted({e for e in seen.e if e < seen.hi} | {seen.lo})
        counts = inside.agg(*[F.count_if(F.col("value") <= e) for e in edges]).first()
        i = next((i for i, c in enumerate(counts) if below + c > k), len(edges))
        if i < len(edges):
            inside = inside.filter(F.col("value") <= edges[i])
        if i:
            inside, below = inside.filter(F.col("value") > edges[i - 1]), below + counts[i - 1]


def pivot(keys: DataFrame) -> DataFrame:
    """pivot: the median, for an even number of keys the floored mean of the middle two; null without keys."""
    n = keys.agg(F.count("value")).first()[0]
    middle = [nth(keys, k) for k in sorted({(n - 1) // 2, n // 2})] if n else []
    value = (middle[0] + middle[-1]) // 2 if middle else None
    return keys.sparkSession.createDataFrame([(None if value is None else int(value),)], "pivot bigint")


def approximate_pivot(keys: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """pivot: a key near the median, from a sketch of bounded size."""
    return keys.agg(F.percentile_approx("value", 0.5, accuracy).alias("pivot"))


def process_split(lesser: Column, greater: Column, parts: int) -> Column:
    """Processes for the lesser side: its share of `parts`, rounded down but at least 1."""
    share = F.try_divide(lesser, lesser + greater) * parts
    return F.when(share < 1, F.ceil(share)).otherwise(F.floor(share)).cast("bigint")


def pivot_split(keys: DataFrame, parts: int) -> DataFrame:
    """pivot, lesser (keys below it), greater (the others), parts_lesser."""
    p = pivot(keys)
    n = keys.join(F.broadcast(p)).groupBy("pivot").agg(F.count_if(F.col("value") < F.col("pivot")).alias("lesser"), F.count_if(F.col("value") >= F.col("pivot")).alias("greater"))
    return n.withColumn("parts_lesser", process_split(F.col("lesser"), F.col("greater"), parts))


def count_violations(ordered: DataFrame, order: str = "pos") -> DataFrame:
    """n_bad: rows smaller than the row before them. Neighbours are matched by position, a join on pos + 1."""
    before = ordered.select((F.col(order) + 1).alias(order), F.col("value").alias("prev"))
    return ordered.join(before, order).agg(F.count_if(F.col("value") < F.col("prev")).alias("n_bad"))


def kv_sort_desc(pairs: DataFrame) -> DataFrame:
    """key, val by key descending, then val."""
    return pairs.orderBy(F.desc("key"), "val")


def kv_topk(pairs: DataFrame, k: int) -> DataFrame:
    """The k pairs of largest key (all, if fewer); ties by val."""
    return pairs.orderBy(F.desc("key"), "val").limit(k)


def time_span(times: DataFrame, start: str, stop: str) -> DataFrame:
    """Earliest start and latest stop."""
    return times.agg(F.min(start).alias("first_start"), F.max(stop).alias("last_stop"))


def rank_within(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """df with rank 1, 2, ... within each key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
