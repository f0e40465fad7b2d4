"""Hand-worked relation-mask cases (FIXTURES.md part A) and brute force."""

import itertools

from pyspark.sql import functions as F

from linkgraph.functions.masks import (cell_index, diagonal_cell, mask_bits, mask_positions,
                                       pair_cells)


def cell(lo, hi):
    return hi + 22 * lo - lo * (lo + 1) // 2


def positions(m):
    p = [i for i in range(1, 22) if (m >> (i - 1)) & 1]
    return p or [0]


def test_bits_and_positions(spark):
    df = spark.createDataFrame([(0,), (5,), (1 << 20,)], "mask BIGINT")
    rows = {r["mask"]: r for r in df.select("mask", mask_bits("mask").alias("b"),
                                             mask_positions("mask").alias("p")).collect()}
    assert rows[0]["b"] == [0] * 21 and rows[0]["p"] == [0]
    assert rows[5]["p"] == [1, 3] and rows[5]["b"][-3:] == [1, 0, 1]
    assert rows[1 << 20]["p"] == [21] and rows[1 << 20]["b"][0] == 1


def test_cell_formula_is_a_bijection():
    cells = [cell(lo, hi) for lo in range(22) for hi in range(lo, 22)]
    assert sorted(cells) == list(range(253))


def test_pair_cells_examples(spark):
    # positions {1,2} x {1,2} -> cells 22, 23, 43
    df = spark.createDataFrame([(3, 3)], "m1 BIGINT, m2 BIGINT")
    got = df.select(F.array_sort(pair_cells("m1", "m2")).alias("c")).first()["c"]
    assert got == [22, 23, 43]
    assert spark.range(1).select(cell_index(F.lit(1), F.lit(2)).alias("c")).first()["c"] == 23


def test_pair_cells_brute_force(spark):
    masks = [0, 1, 2, 5, 6, 1 << 20, (1 << 20) | 1, 7]
    rows = list(itertools.product(masks, masks))
    df = spark.createDataFrame(rows, "m1 BIGINT, m2 BIGINT")
    got = {(r["m1"], r["m2"]): sorted(r["c"]) for r in
           df.select("m1", "m2", pair_cells("m1", "m2").alias("c")).collect()}
    for a, b in rows:
        exp = sorted({cell(min(i, j), max(i, j)) for i in positions(a) for j in positions(b)})
        assert got[(a, b)] == exp


def test_diagonal_offset(spark):
    got = spark.range(21).select(diagonal_cell(F.col("id").cast("int"), 1).alias("c1"),
                                 diagonal_cell(F.col("id").cast("int"), 0).alias("c0")).collect()
    for i, r in enumerate(got):
        assert r["c1"] == cell(i, i + 1)
        assert r["c0"] == cell(i, i)
