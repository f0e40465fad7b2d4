"""Scoring fan-out and top-k lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkgraph.config import Params


def flip_scores(scored: DataFrame, score: str = "score") -> DataFrame:
    """Each pair (p1, p2, s) yields (p1 -> p2, s) and (p2 -> p1, s) in
    one scan (explode of a two-element array, no union of two scans)."""
    both = F.explode(F.array(
        F.struct(F.col("p1").alias("user_id"), F.col("p2").alias("candidate_id")),
        F.struct(F.col("p2").alias("user_id"), F.col("p1").alias("candidate_id"))))
    return scored.select(both.alias("_d"), F.col(score).alias("score")).select("_d.*", "score")


def target_users(directed: DataFrame, p: Params = Params(), residue: int | None = None,
                 threshold: float | None = None) -> DataFrame:
    """Score cut, and (when `residue` is given) the target-group cut."""
    thr = p.threshold if threshold is None else threshold
    out = directed.where(F.col("score") >= F.lit(thr))
    if residue is not None:
        out = out.where(F.col("user_id") % p.modulus == residue)
    return out


def top_k(directed: DataFrame, k: int = 100) -> DataFrame:
    """W1 + W2: best k candidates per user by score (ties: smaller id first),
    with the 1-based rank.  `row_number() <= k` lets Spark insert a
    WindowGroupLimit that trims every map partition to k rows per user before
    the shuffle, so a user with a huge candidate set never ships it whole."""
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), F.asc("candidate_id"))
    return (directed.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))


def ranked_lines(ranked: DataFrame) -> DataFrame:
    """K3 layout: one line per user, `user \\t c1 \\t c2 ...` in rank order.
    The list is at most k long; lines are range-partitioned by user (O2)."""
    items = F.array_sort(F.collect_list(F.struct("rank", F.col("candidate_id").cast("string").alias("c"))))
    return (ranked.groupBy("user_id").agg(items.alias("_l"))
            .select("user_id", F.concat_ws("\t", F.col("user_id").cast("string"),
                                           F.col("_l.c")).alias("line"))
            .orderBy("user_id"))
