"""Relation-mask histograms (J13, X3-X6, A3, P10, J3) in long form.

The reference adds a dense 254-cell vector per (pair, common friend) row.
Here each row explodes only the cells it sets (usually one or a few), and
the histogram is a partial+final hash aggregate on (p1, p2, cell)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkgraph.functions.masks import MASK_BITS, N_POSITIONS, mask_bits_string, pair_cells


def mask_pair_hist(lists: DataFrame, min_support: int = 5) -> DataFrame:
    """X4 + A3 + X5 + P10: (p1, p2, cell, cnt) for cells 1..252 of the pairs with
    more than `min_support` common friends, from `candidates.pair_lists`.

    `lists` made with least = min_support + 1 hold no other pairs.  The survivors
    expand the cells of each distinct mask pair once, weighted by how often it
    occurs.  All counts stay on the lists' (p1, p2) partitioning, so beyond the
    explosion nothing is shuffled."""
    per = lists.where(F.col("common_cnt") > min_support).select("p1", "p2", F.inline("common"))
    counted = per.groupBy("p1", "p2", "mask1", "mask2").agg(F.count(F.lit(1)).alias("n"))
    cells = counted.select("p1", "p2", "n", F.explode(pair_cells("mask1", "mask2")).alias("cell"))
    return cells.where("cell >= 1").groupBy("p1", "p2", "cell").agg(F.sum("n").alias("cnt"))


def diagonal_type(cell: Column, offset: int = 1) -> Column:
    """The relation type whose count X6 reads at `cell`, else NULL: comparisons
    of one number with 21 constants, in generated code."""
    out = F.lit(None).cast("int")
    for i in range(MASK_BITS):
        out = F.when(cell == F.lit(i + offset + N_POSITIONS * i - i * (i + 1) // 2), F.lit(i)).otherwise(out)
    return out


def mask_diag_counts(hist: DataFrame, offset: int = 1) -> DataFrame:
    """Per pair the count of relation type i (0..20) read at cell
    (i, i + offset); long form (p1, p2, type, cnt), zero counts omitted."""
    return (hist.select("p1", "p2", diagonal_type(F.col("cell"), offset).alias("type"), "cnt")
            .where(F.col("type").isNotNull()))


def edge_mask_bits(pairs: DataFrame, positives_masked: DataFrame) -> DataFrame:
    """X2 + J3: the 21 mask digits of the known edge p1 -> p2, 21 zeros when
    the pair is not a known edge."""
    pos = positives_masked.select("p1", "p2", mask_bits_string("mask").alias("_b"))
    return (pairs.select("p1", "p2").join(pos, ["p1", "p2"], "left")
            .select("p1", "p2", F.coalesce("_b", F.lit("0" * MASK_BITS)).alias("bits")))


def hist_vectors(hist: DataFrame, n_cells: int = 252) -> DataFrame:
    """(p1, p2, ARRAY<DOUBLE>(252)) for cells 1..252 (a pair has at most
    252 entries, so the per-pair collect is bounded)."""
    m = F.map_from_entries(F.collect_list(F.struct("cell", "cnt")))
    dense = F.transform(F.sequence(F.lit(1), F.lit(n_cells)),
                        lambda i: F.coalesce(F.element_at(F.col("_m"), i), F.lit(0)).cast("double"))
    return (hist.groupBy("p1", "p2").agg(m.alias("_m"))
            .select("p1", "p2", dense.alias("hist")))
