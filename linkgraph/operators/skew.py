"""Skew-safe building blocks.

A key (a user, a friend) may hold a large share of all rows.  Aggregations
are safe (partial aggregation combines map-side), but a join or window keyed
on such a key sends all its rows to one task.  The helpers here keep hot
keys out of any single task:

* the per-key counts come from a partial aggregation;
* keys holding more than 1/share of all rows ("hot") number at most `share` by
  counting, so that set is broadcast with a proven bound;
* rows of hot keys are dropped or handled map-side through that broadcast,
  before the key shuffle.
The share follows the partition count (at least HOT_SHARE, at most MAX_SHARE),
so that a key that stays cold holds about one partition's rows at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A hot key holds more than 1/HOT_SHARE of the rows: at most HOT_SHARE keys.
HOT_SHARE = 1024
MAX_SHARE = 65_536


def share_of(df: DataFrame) -> int:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(HOT_SHARE, min(MAX_SHARE, n))


def key_counts(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def hot_keys(counts: DataFrame, key: str, count_col: str, floor: int) -> DataFrame:
    """Keys whose count exceeds both `floor` and total/share.

    The total is a scalar subquery over the (already aggregated) counts, so
    no row travels to the driver; the result has at most `share` rows."""
    total = counts.agg(F.sum(count_col).alias("t")).select("t")
    limit = F.greatest(F.lit(floor), total.scalar() / F.lit(share_of(counts)))
    return counts.where(F.col(count_col) > limit).select(key)


def filter_by_key_count(df: DataFrame, key: str, lo: int, hi: int,
                        counts: DataFrame | None = None) -> DataFrame:
    """Rows of `df` whose `key` occurs between lo and hi times (inclusive).

    Keys above `hi` are out of the band; the hot ones among them are removed
    by a broadcast anti join (bounded size) before the shuffle of the semi
    join, so no task receives a hot key's rows."""
    counts = counts if counts is not None else key_counts(df, key)
    cnt_col = [c for c in counts.columns if c != key][0]
    hot = hot_keys(counts, key, cnt_col, hi)
    in_band = counts.where(F.col(cnt_col).between(lo, hi)).select(key)
    cool = df.join(F.broadcast(hot), key, "left_anti")
    return cool.join(in_band, key, "left_semi").select(*df.columns)


def join_per_key(df: DataFrame, right: DataFrame, key: str, how: str = "inner",
                 counts: DataFrame | None = None) -> DataFrame:
    """Join `df` with `right` (at most one row per key) without sending a hot
    key's rows to one task.

    Rows of the hot keys (at most MAX_SHARE of them) meet their `right` rows
    through a broadcast of those few rows, map-side; all other rows take the
    ordinary shuffle join.  `how` is one of inner, left, left_semi, left_anti."""
    counts = counts if counts is not None else key_counts(df, key)
    cnt_col = [c for c in counts.columns if c != key][0]
    hot = hot_keys(counts, key, cnt_col, 0)
    right_hot = right.join(hot, key, "left_semi")
    hot_part = (df.join(F.broadcast(hot), key, "left_semi")
                .join(F.broadcast(right_hot), key, how))
    cool_part = df.join(F.broadcast(hot), key, "left_anti").join(right, key, how)
    return hot_part.unionByName(cool_part)
