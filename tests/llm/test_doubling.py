"""Prefix doubling of op9 against plain counts."""

import random

import pytest
from pyspark.sql import functions as F

from linkgraph.llm import doubling


def test_sizes_end_at_single_windows():
    assert doubling.sizes(400, 200) == [64, 16, 4, 1]
    assert doubling.sizes(40, 20) == [16, 4, 1]
    assert doubling.sizes(40, 40) == [1]


def plain(rows, window):
    seen = {}
    for k, t in rows:
        b = t.encode()
        for i in range(len(b) - window + 1):
            seen.setdefault(b[i: i + window], set()).add((k, i))
    out = {}
    for k, t in rows:
        b = t.encode()
        gone = [False] * len(b)
        for i in range(len(b) - window + 1):
            if len(seen[b[i: i + window]]) > 1:
                gone[i: i + window] = [True] * window
        out[k] = bytes(x for x, g in zip(b, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize("ratio, rows, gram", [(4, 1 << 16, 20), (2, 3, 20), (8, 7, 12), (64, 1 << 16, 33)])
def test_rounds_against_plain_windows(spark, monkeypatch, ratio, rows, gram):
    """Passages with different neighbours, periods of several words, a passage in most
    texts and repeats inside one text, looked at a few rows at a time."""
    monkeypatch.setattr(doubling, "ROWS", rows)
    monkeypatch.setattr(doubling, "RATIO", ratio)
    rng = random.Random(gram + ratio)

    def some(n):
        return "".join(rng.choice("abcde ") for _ in range(n))
    passage, other = some(90), some(60)
    texts = [some(30) + passage + some(25) if i % 3 else some(40) + other + some(9) + other for i in range(24)]
    texts += ["ab cd ef " * 30, some(20) + "ab cd ef " * 12, passage[10:75], "x" * 130, texts[3], "", some(500)]
    data = list(enumerate(texts))
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = doubling.dedup(docs, window=40, gram=gram, with_bytes=True)
    keyed = docs.select("doc_id", doubling.text_key(F.col("text")).alias("k")).join(got, "k")
    assert {r["doc_id"]: bytes(r["kept"]) for r in keyed.collect()} == plain(data, 40)


def test_a_core_that_goes_on_over_tasks_keeps_one_rank(spark):
    """One core has two thirds of the rows, so that the range sort must cut it; of its
    contents, every one occurs twice but the last, which occurs once."""
    n = 4000
    core, i = F.col("id") % 3 > 0, F.col("id")
    number = F.floor(i / 3)
    w = F.when(core, F.when(number == n // 3, i + 9 * n).otherwise(number)).otherwise(0)
    rows = spark.range(n).select(F.when(core, 7).otherwise(10 + i).alias("x"), F.lit(0).cast("long").alias("y"),
                                 w.cast("long").alias("w"), i.alias("j"), F.lit(3).cast("long").alias("at"),
                                 F.lit(1).cast("long").alias("n"), F.lit(3).cast("long").alias("a"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = doubling.reranked(rows)
        assert len(got.inputFiles()) > 1
        got = got.where("whole or go").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    per = {}
    for k in range(n):
        if k % 3:
            per.setdefault(k + 9 * n if k // 3 == n // 3 else k // 3, []).append(k)
    assert {r["j"] for r in got if r["whole"]} == {k for v in per.values() if len(v) > 1 for k in v}
    goes = {r["j"] for r in got if r["go"]}
    assert all(goes & set(v) for v in per.values()) and goes <= {k for v in per.values() for k in v}
    assert len({r["rank"] for r in got}) == 1


def test_places_are_looked_up_for_edge_rows_only(spark):
    """Two rows of every content, so that some content goes on over tasks: the join by
    place takes the rows at the tasks' edges, not every rank."""
    n, i = 4000, F.col("id")
    zero = F.lit(0).cast("long")
    rows = spark.range(n).select(F.lit(7).cast("long").alias("x"), zero.alias("y"), zero.alias("w"), i.alias("j"),
                                 zero.alias("at"), (zero + 1).alias("n"), zero.alias("a"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = doubling.reranked(rows)
        assert got.where("whole").count() == n
        plan = got._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by_place = plan[plan.index("(j#"):]
    assert "isnotnull(x#" in by_place and "isnull(x#" in by_place
