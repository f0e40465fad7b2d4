"""Pair rows by user: no row lost or doubled, none exchanged, tasks of bounded size."""

import random
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from linkgraph.operators import candidates as C
from linkgraph.operators import twohop as TH


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(17)
    rows = sorted({(rng.randrange(40), rng.randrange(25), 0) for _ in range(420)})
    rows = [(u, f, rng.choice([0, 1, 5, 1 << 20])) for u, f, _ in rows]
    return rows, spark.createDataFrame(rows, "user_id long, friend_id long, mask long").repartition(3)


def common(rows):
    by, out = defaultdict(dict), defaultdict(list)
    for u, f, m in rows:
        by[f][u] = m
    for f, users in by.items():
        for a, b in combinations(sorted(users), 2):
            out[a, b].append((f, users[a], users[b]))
    return out


@pytest.mark.parametrize("block", [2_000, 4])
def test_rows_by_user_are_the_pair_rows(spark, graph, monkeypatch, block):
    monkeypatch.setattr(C, "FRIEND_BLOCK", block)
    rows, kept = graph
    odd = kept.unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0), (4, 2, 0), (4, 2, 0)], kept.schema))
    for df in (kept, odd):
        want = sorted(tuple(r) for r in C.pair_rows(df, partitions=3).collect())
        assert sorted(tuple(r) for r in C.pair_rows_by_user(df, 5).select("p1", "p2", "friend_id").collect()) == want
    plan = C.pair_counts(C.pair_rows_by_user(kept, 5))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(p1" in plan and plan.index("REPARTITION_BY_NUM") < plan.index("ObjectHashAggregate")
    assert plan.count("Exchange hashpartitioning(p1") == 1 and "Exchange hashpartitioning(p2" not in plan


def test_lists_made_in_place(graph, monkeypatch):
    rows, kept = graph
    want = common(rows)
    counts = C.pair_counts(C.pair_rows_by_user(kept, 5)).where("common_cnt > 2")
    got = C.friend_lists(C.pair_rows_by_user(kept, 5), counts, 5)
    assert {(r.p1, r.p2): sorted(r.friends) for r in got.collect()} == {
        k: sorted(f for f, _, _ in v) for k, v in want.items() if len(v) > 2}
    monkeypatch.setattr(C, "ROWS_BY_USER", 0)
    monkeypatch.setattr(C, "BROADCAST_PAIRS", 0)
    monkeypatch.setattr(C, "SUPPORTED_SHARE", 1.0)
    for counted in (None, counts):
        lists = {(r.p1, r.p2): sorted(map(tuple, r.common)) for r in C.pair_lists(kept, 3, counts=counted).collect()}
        assert lists == {k: sorted(v) for k, v in want.items() if len(v) > 2}
    assert kept.sparkSession.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_twohop_by_lists_and_by_rows(graph):
    rows, kept = graph
    pairs = C.pair_rows_by_user(kept, 5)
    cands = C.pair_counts(pairs).where("common_cnt > 1")
    ratios = TH.candidate_ratios(cands.withColumn("label", F.lit(1)).withColumn("deg1", F.lit(9)).withColumn("deg2", F.lit(7)))
    every = sorted(map(tuple, TH.twohop_stats(pairs, ratios).collect()))
    assert every and every == sorted(map(tuple, TH.twohop_stats(pairs, ratios, cands, 5).collect()))
    assert "ObjectHashAggregate" in TH.twohop_stats(pairs, ratios)._jdf.queryExecution().executedPlan().toString()


def test_a_counting_task_has_few_pairs(graph):
    """540 million pair rows (60 times sf0.1): some 2 million a task, not 20."""
    n = C.explosion_partitions(graph[1], 540_000_000)
    assert 540_000_000 / n <= 2_000_000


def test_the_model_reads_a_written_sample_and_nothing_else(spark):
    """No vector outside the sample is written, and the solver's passes do not remake them."""
    from linkgraph.operators.sampling import train_valid
    from linkgraph.plans.queries import ML_STAGES
    from linkgraph.plans.views import Views
    from tests.conftest import SF_SMALL
    v = Views(spark, SF_SMALL, stages=ML_STAGES)
    for part in v.ml_split:
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "linkgraph-stages/sample" in "".join(part.inputFiles())
    key = lambda df: sorted((r.p1, r.p2, r.label, tuple(r.features.toArray())) for r in df.collect())
    assert "linkgraph-stages/vectors" not in "".join(v.vectors.inputFiles())
    for part, plain in zip(v.ml_split, train_valid(v.vectors, v.p), strict=True):
        assert key(part) == key(plain)


@pytest.mark.parametrize("least", [1, 2, 3, 5])
@pytest.mark.parametrize("block", [2_000, 4])
def test_counts_from_sorted_lists_are_those_of_the_pair_rows(graph, monkeypatch, least, block):
    monkeypatch.setattr(C, "FRIEND_BLOCK", block)
    _, kept = graph
    odd = kept.unionByName(kept.sparkSession.createDataFrame(
        [(None, 1, 0), (3, None, 0), (4, 2, 0), (4, 2, 0), (0, 2, 0), (-7, 2, 0), (-7, 3, 0)], kept.schema))
    for df in (kept, odd, kept.limit(0)):
        want = C.pair_counts(C.pair_rows(df, partitions=3)).where(F.col("common_cnt") >= least)
        got = C.counts_by_user(df, least, 5)
        assert got.schema.simpleString() == want.schema.simpleString()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_only_supported_pairs_reach_the_hash_table(graph):
    """Rows of pairs with less support end in the sorted list: the exploded rows are the
    supported pairs' counts above least - 1."""
    _, kept = graph
    counts = C.common_friends(kept)
    rows = {"met": 0}

    def walk(node):
        if node.getClass().getSimpleName() == "GenerateExec" and "met" in node.toString():
            rows["met"] += node.metrics().apply("numOutputRows").value()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            return walk(node.plan())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))
    got = counts.collect()
    walk(counts._jdf.queryExecution().executedPlan())
    assert rows["met"] == sum(r.common_cnt - 8 for r in got)
