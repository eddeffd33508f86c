"""The threshold trigger as a structured stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_count(events: DataFrame, limit: int = 12, extra: int = 125) -> DataFrame:
    """count, final of a stream (or table) of increments: `extra` joins the count once it reaches `limit`.
    As a stream: complete mode, one row of state."""
    n = events.groupBy().agg(F.count("*").alias("count"))
    return n.select("count", (F.col("count") + F.when(F.col("count") >= limit, extra).otherwise(0)).alias("final"))
