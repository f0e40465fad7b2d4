"""2-hop statistics of common friends.

For a pair (p1, p2) look at every pair (ca, cb) of its common friends that
is itself a candidate, and aggregate that pair's common count, link flag and
degree ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.operators.candidates import friend_lists


def candidate_ratios(labelled: DataFrame) -> DataFrame:
    """A5: common / max(deg1, deg2) and common / min(deg1, deg2), NULL when a
    degree is missing or 0 (Spark 4 ANSI: try_divide instead of Infinity)."""
    c = F.col("common_cnt").cast("double")
    hi = F.greatest("deg1", "deg2").cast("double")
    lo = F.least("deg1", "deg2").cast("double")
    return labelled.select("p1", "p2", "common_cnt", "label", "deg1", "deg2",
                           F.round(F.try_divide(c, hi), 6).alias("ratio_max"),
                           F.round(F.try_divide(c, lo), 6).alias("ratio_min"))


def twohop_stats(pairs: DataFrame, ratios: DataFrame, candidates: DataFrame | None = None,
                 partitions: int | None = None) -> DataFrame:
    """J14 + J7 + A4 over every pair with common friends.

    With `candidates`, only those pairs: the feature join reads no others, and
    the semi join saves the rest of the work (`partitions`: see `friend_lists`)."""
    return twohop_of_lists(friend_lists(pairs, candidates, partitions), ratios)


def twohop_of_lists(lists: DataFrame, ratios: DataFrame) -> DataFrame:
    """`twohop_stats` of pairs whose common friends are listed: (p1, p2, friends ARRAY).

    A pair with one common friend has no two of them and leaves before anything is
    made of it; a list of n gives n (n - 1) / 2 rows, n at most max_degree."""
    ca = lists.where(F.size("friends") > 1).select("p1", "p2", F.explode("friends").alias("ca"), "friends")
    pp = ca.select("p1", "p2", "ca", F.explode("friends").alias("cb")).where(F.col("ca") < F.col("cb"))
    st = ratios.select(F.col("p1").alias("ca"), F.col("p2").alias("cb"), "common_cnt", "label",
                       "ratio_max", "ratio_min")
    return (pp.join(st, ["ca", "cb"])
            .groupBy("p1", "p2")
            .agg(F.max("common_cnt").alias("max_common"),
                 F.sum("label").cast("bigint").alias("linked_pairs"),
                 F.max("ratio_max").alias("max_ratio_maxdeg"),
                 F.max("ratio_min").alias("max_ratio_mindeg")))
