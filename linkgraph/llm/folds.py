"""Folds by document id, and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(n)


def thin(df: DataFrame, total: int, bound: int, seed: int) -> DataFrame:
    """About `bound` of the `total` rows (all if there are fewer), chosen by a
    hash of doc_id, so that reruns and recomputed tasks agree."""
    if total <= bound:
        return df
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30))
    return df.where(draw < int((1 << 30) * (bound / total)))
