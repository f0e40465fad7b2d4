"""Labels and degrees of candidates: no candidate is exchanged for them but by p2, once."""

import random

import pytest
from pyspark.sql import functions as F

from linkgraph.config import Params
from linkgraph.operators import candidates as C
from linkgraph.operators import graph as G
from linkgraph.operators import sampling as S

P = Params(min_degree=2, max_degree=30, min_in_list=2, max_in_list=40, min_support=1)


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(3)
    rows = sorted({(rng.randrange(60), rng.randrange(70), 0) for _ in range(700)})
    rows += [(61, f, 0) for f in range(50)]  # beyond the degree band
    edges = spark.createDataFrame(rows, "user_id long, friend_id long, mask long").repartition(3)
    deg = G.degree(edges)
    return edges, deg, G.kept_edges(edges, P, deg)


def test_in_place_labels_and_degrees_are_those_of_the_joins(graph):
    edges, deg, kept = graph
    cands = C.counts_by_user(kept, 2, 5)
    want = C.with_degrees(C.label_candidates(cands, C.canonical_edges(edges)), deg)
    lab = C.label_candidates(cands, C.canonical_edges(G.degree_band(edges, P, deg)), 5)
    got = C.with_degrees(lab, deg, partitions=5)
    assert got.dtypes == want.dtypes
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) and {r[3] for r in rows} == {0, 1}
    # nulls and repeated candidates stay as they are
    odd = cands.unionByName(cands.limit(3)).unionByName(
        cands.limit(1).select("p1", F.lit(None).cast("long").alias("p2"), "common_cnt"))
    pos = C.canonical_edges(G.degree_band(edges, P, deg))
    assert sorted(map(str, C.label_candidates(odd, pos, 5).collect())) == \
        sorted(map(str, C.label_candidates(odd, pos).collect()))


def test_a_task_of_the_labels_does_not_grow_with_the_input(graph):
    """Every exchange of candidates has the number of partitions that follows the pair rows."""
    edges, deg, kept = graph
    lab = C.label_candidates(C.counts_by_user(kept, 2, 977), C.canonical_edges(G.degree_band(edges, P, deg)), 977)
    plan = C.with_degrees(lab, deg, partitions=977)._jdf.queryExecution().executedPlan().toString()
    exchanged = [x for x in plan.splitlines() if "Exchange hashpartitioning(p1" in x or "Exchange hashpartitioning(p2" in x]
    assert exchanged and all(", 977)" in x for x in exchanged)
    assert not [x for x in exchanged if "p1" in x and "p2" in x.split("977")[0]]


def test_training_pairs_outside_the_hold_out_stay_out_of_the_subtraction(spark):
    rng = random.Random(9)
    rows = [(a, b, rng.choice([0, 1])) for a in range(60) for b in range(a + 1, 60)]
    df = spark.createDataFrame(rows, "p1 long, p2 long, label int")
    train, _ = S.train_valid(df, P)
    got = {(r.p1, r.p2) for r in S.holdout(df, train, P).collect()}
    taken = {(r.p1, r.p2) for r in train.collect()}
    assert got == {(r.p1, r.p2) for r in df.where(S.holdout_group(P)).collect()} - taken


def test_one_reader_of_scores_writes_no_labelled_pairs(spark):
    from linkgraph.plans.queries import QUERIES
    from linkgraph.sources import store
    before = set(store._stages)
    for name in ("auc", "best_threshold"):
        QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert not [x for x in set(store._stages) - before if "/labelled-" in x]
