"""Metric properties and hand cases."""

import math
import random

from pyspark.sql import functions as F

from linkgraph.operators import metrics as MT
from linkgraph.operators import ranking as R
from linkgraph.operators.prefix import running_totals


def scored(spark, n=400, seed=1):
    rnd = random.Random(seed)
    rows = [(i, i + 1, round(rnd.random(), 2), int(rnd.random() < 0.3)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "p1 BIGINT, p2 BIGINT, score DOUBLE, label INT")


def brute_auc(rows):
    pos = [s for _, _, s, y in rows if y == 1]
    neg = [s for _, _, s, y in rows if y == 0]
    tot = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return tot / (len(pos) * len(neg))


def test_auc_matches_pairwise_count(spark):
    rows, df = scored(spark)
    got = MT.auc(df).first()["auc"]
    assert abs(got - brute_auc(rows)) < 1e-6
    flipped = MT.auc(df.withColumn("score", -F.col("score"))).first()["auc"]
    assert abs(got + flipped - 1.0) < 2e-6


def test_running_totals_many_buckets(spark):
    rows, df = scored(spark, n=300, seed=4)
    counts = MT.score_counts(df)
    got = running_totals(counts, "threshold", ["pos", "neg"], buckets=16).toPandas()
    pdf = counts.toPandas().sort_values("threshold", ascending=False)
    pdf["cp"] = pdf["pos"].cumsum()
    m = got.merge(pdf, on="threshold")
    assert len(m) == len(pdf) and (m["cum_pos"] == m["cp"]).all()


def test_fbeta_best_threshold_hand_case(spark):
    rows = [(1, 2, 0.9, 1), (1, 3, 0.8, 0), (1, 4, 0.7, 1), (1, 5, 0.1, 0)]
    df = spark.createDataFrame(rows, "p1 BIGINT, p2 BIGINT, score DOUBLE, label INT")
    fb = {r["threshold"]: r for r in MT.fbeta_by_threshold(MT.roc_curve(df), 2.0).collect()}
    # at 0.7: tp 2, fp 1 -> p 2/3, r 1 -> f2 = 5*(2/3)/(4*(2/3)+1) = 10/11
    assert abs(fb[0.7]["fbeta"] - 10 / 11) < 1e-12
    best = MT.best_threshold(MT.fbeta_by_threshold(MT.roc_curve(df), 2.0)).first()
    assert best["threshold"] == 0.7


def test_ndcg_of_truth_is_one(spark):
    truth = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "user_id BIGINT, neighbour_id BIGINT")
    ranked = truth.select("user_id", F.col("neighbour_id").alias("candidate_id"), F.lit(1.0).alias("score"))
    out = MT.ndcg(R.top_k(ranked, 100), truth).first()
    assert abs(out["ndcg_x1000"] - 1000.0) < 1e-6 and out["truth_users"] == 2


def test_ndcg_hand_case(spark):
    truth = spark.createDataFrame([(1, 10)], "user_id BIGINT, neighbour_id BIGINT")
    ranked = spark.createDataFrame([(1, 9, 0.9), (1, 10, 0.5)], "user_id BIGINT, candidate_id BIGINT, score DOUBLE")
    out = MT.ndcg(R.top_k(ranked, 100), truth).first()
    assert abs(out["ndcg_x1000"] - 1000.0 / math.log2(3)) < 1e-6


def test_top_k_ties_and_limit(spark):
    rows = [(1, c, 1.0) for c in range(5, 0, -1)] + [(2, 7, 0.5)]
    df = spark.createDataFrame(rows, "user_id BIGINT, candidate_id BIGINT, score DOUBLE")
    got = [(r["user_id"], r["rank"], r["candidate_id"]) for r in R.top_k(df, 3).orderBy("user_id", "rank").collect()]
    assert got == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 7)]


def test_roc_binned_totals(spark):
    rows, df = scored(spark)
    b = MT.roc_binned(df).toPandas()
    assert b["tp"].max() == sum(r[3] for r in rows)
    assert b["fp"].max() == sum(1 - r[3] for r in rows)


def test_ideal_dcg_chunks(spark):
    from linkgraph.operators.metrics import IDCG_CHUNK, ideal_dcg
    ns = [1, 2, IDCG_CHUNK, IDCG_CHUNK + 1, 3 * IDCG_CHUNK + 7]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(ns)], "user_id BIGINT, n_truth BIGINT")
    got = {r["user_id"]: r["idcg"] for r in ideal_dcg(df).collect()}
    for i, n in enumerate(ns):
        exp = sum(1.0 / math.log2(k + 1.0) for k in range(1, n + 1))
        assert abs(got[i] - exp) < 1e-9 * max(1.0, exp)
