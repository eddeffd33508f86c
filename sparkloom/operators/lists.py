"""Sorted lists of a key in blocks of bounded length, so that a hot column or a hub is many rows in many tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.scratch import Scratch

#: Most different entries of a block.
BLOCK = 4096
#: Different rows of a range, about; fewer where that leaves tasks idle, down to FEW.
ROWS_EACH, FEW = 500_000, 50_000
#: While equal rows are counted, exchanges are cut finely and put together to so many bytes a task, however large the input.
_FINE, _BYTES = 1024, 8 << 20


def blocked_lists(df: DataFrame, key: str, fields: list[str], size: int = BLOCK, parts: int | None = None) -> DataFrame:
    """key, first, last, n, entries: of each key its rows in order of `fields`, in blocks. Entries are the different
    ones, each as (fields, times); first and last are values of the first field, n counts rows. Blocks of a key do not
    overlap. They have at most `size` entries, fewer at the end of a key or of a partition. Null keys are one key, and nulls
    come first.

    Equal rows are counted first, into a table in the shared folder; then one range exchange by key and fields deals the
    list of a hot key to many tasks, and a task cuts its sorted rows as they come, holding one block besides the batch.
    There are as many ranges (`parts`) as the different rows ask for, so that no task grows with the input.
    """
    order, conf = [key, *fields], df.sparkSession.conf
    usual = int(conf.get("spark.sql.shuffle.partitions"))
    scratch = Scratch(df.sparkSession, "lists", {"spark.sql.shuffle.partitions": str(max(usual, _FINE)), "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(_BYTES)})
    counted, seen = scratch.measure(df.groupBy(*order).agg(F.count("*").alias("times")), F.count("*").alias("n"))
    parts = parts or max(1, -(-seen["n"] // ROWS_EACH), min(usual, -(-seen["n"] // FEW)))
    dealt = counted.repartitionByRange(parts, *order)
    of = {f: df.schema[f].dataType.simpleString() for f in order}
    entry = ", ".join(f"`{f}`: {of[f]}" for f in fields)
    schema = f"`{key}` {of[key]}, first {of[fields[0]]}, last {of[fields[0]]}, n bigint, entries array<struct<{entry}, times: bigint>>"

    def cut(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def blocks(t, starts, end):
            ends = np.r_[starts[1:], end]
            columns = [t.column(c).combine_chunks() for c in [*fields, "times"]]
            inner = pa.StructArray.from_arrays([c.slice(0, end) for c in columns], [*fields, "times"])
            n = np.add.reduceat(columns[-1].to_numpy(), starts) if end == len(t) else np.add.reduceat(columns[-1].to_numpy()[:end], starts)
            lists = pa.ListArray.from_arrays(np.r_[starts, end].astype(np.int32), inner)
            return pa.RecordBatch.from_arrays([t.column(key).combine_chunks().take(pa.array(starts)), columns[0].take(pa.array(starts)), columns[0].take(pa.array(ends - 1)), pa.array(n), lists], [key, "first", "last", "n", "entries"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            k = t.column(key).combine_chunks()
            null = k.is_null().to_numpy(zero_copy_only=False)
            other = pc.fill_null(pc.not_equal(k.slice(1), k.slice(0, len(k) - 1)), False).to_numpy(zero_copy_only=False)
            new = np.r_[True, other | (null[1:] != null[:-1])]
            at = np.arange(len(k))
            starts = np.flatnonzero((at - np.maximum.accumulate(np.where(new, at, 0))) % size == 0)
            if len(starts) > 1:
                yield blocks(t, starts[:-1], int(starts[-1]))
            held = t.slice(int(starts[-1])).combine_chunks()
        if held is not None:
            yield blocks(held, np.zeros(1, np.int64), len(held))

    return dealt.sortWithinPartitions(*order).mapInArrow(cut, schema)


def joined(blocks: DataFrame, key: str) -> DataFrame:
    """key, entries: blocks of a key put together, entries as often as they were there. A row for each key, however long."""
    fields = [f.name for f in blocks.schema["entries"].dataType.elementType.fields if f.name != "times"]
    whole = blocks.groupBy(key).agg(F.flatten(F.sort_array(F.collect_list("entries"))).alias("entries"))
    again = lambda e: F.array_repeat(F.struct(*[e[f].alias(f) for f in fields]), e["times"].cast("int"))
    return whole.select(key, F.flatten(F.transform("entries", again)).alias("entries"))
