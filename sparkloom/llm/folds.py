"""The fold that language labels may be learned from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text is divisible by 5; a null id counts as the empty text, which is held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learnable(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.filter(~held_out(id_col))
