"""Graph basics: degree, bands, reversal, positives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.config import Params
from linkgraph.operators.skew import filter_by_key_count, join_per_key, key_counts


def degree(edges: DataFrame) -> DataFrame:
    """user_id, deg (out-degree).  Partial + final hash aggregate."""
    return key_counts(edges, "user_id", "deg")


def distinct_users(edges: DataFrame) -> DataFrame:
    """The set of users; used as the right side of semi joins."""
    return edges.select("user_id").distinct()


def reverse_edges(edges: DataFrame) -> DataFrame:
    """User -> friend becomes friend -> user (a projection, no shuffle)."""
    return edges.select("friend_id", "user_id", "mask")


def degree_band(edges: DataFrame, p: Params = Params(), deg: DataFrame | None = None) -> DataFrame:
    """Edges of users whose degree is in [min_degree, max_degree]."""
    counts = deg if deg is not None else degree(edges)
    return filter_by_key_count(edges, "user_id", p.min_degree, p.max_degree, counts)


def kept_edges(edges: DataFrame, p: Params = Params(), deg: DataFrame | None = None) -> DataFrame:
    """P2 then P3: degree band, then friends whose (banded) reversed list has
    min_in_list..max_in_list entries.  These bound every later pair explosion:
    a friend contributes at most C(max_in_list, 2) pairs."""
    banded = degree_band(edges, p, deg)
    return filter_by_key_count(banded, "friend_id", p.min_in_list, p.max_in_list)


def reverse_adjacency(kept: DataFrame, with_masks: bool = False) -> DataFrame:
    """A1 + O1: per friend the sorted list (array_sort) of users naming it (after the bands, so
    each list is bounded by max_in_list).  The mask variant carries
    (user_id, mask) structs, sorted by user."""
    if with_masks:
        items = F.array_sort(F.collect_list(F.struct("user_id", "mask")))
    else:
        items = F.array_sort(F.collect_list("user_id"))
    return kept.groupBy("friend_id").agg(items.alias("users"))


def positives(edges: DataFrame, with_mask: bool = False) -> DataFrame:
    """P4 + J1: known edges in canonical order (p1 < p2) whose friend end is
    itself a user.  The "is a user" test is a semi join against the distinct
    users, keyed on friend_id: a friend named by a large share of all edges
    is matched map-side (join_per_key), not in one task."""
    users = distinct_users(edges).withColumnRenamed("user_id", "friend_id")
    cols = [F.col("user_id").alias("p1"), F.col("friend_id").alias("p2")]
    if with_mask:
        cols.append("mask")
    canon = edges.where(F.col("friend_id") > F.col("user_id"))
    return join_per_key(canon, users, "friend_id", "left_semi").select(*cols)
