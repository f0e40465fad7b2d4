"""Candidates, histogram and 2-hop statistics against brute force on small graphs."""

import itertools
import random
from collections import defaultdict

from pyspark.sql import functions as F

from linkgraph.config import Params
from linkgraph.operators import candidates as C
from linkgraph.operators import graph as G
from linkgraph.operators import masks as MK
from linkgraph.operators import twohop as TH
from linkgraph.operators.skew import filter_by_key_count


def random_edges(seed=7, users=40, friends=60, p=0.25):
    rnd = random.Random(seed)
    out = []
    for u in range(users):
        for f in range(friends):
            if rnd.random() < p:
                m = 0 if rnd.random() < 0.3 else (1 << rnd.randrange(21)) | (1 << rnd.randrange(21))
                out.append((u, f, m))
    return out


PARAMS = Params(min_degree=2, max_degree=40, min_in_list=2, max_in_list=30, min_support=1,
                hist_min_support=1)


def brute_kept(edges, p=PARAMS):
    deg = defaultdict(int)
    for u, f, m in edges:
        deg[u] += 1
    band = [e for e in edges if p.min_degree <= deg[e[0]] <= p.max_degree]
    n = defaultdict(int)
    for u, f, m in band:
        n[f] += 1
    return [e for e in band if p.min_in_list <= n[e[1]] <= p.max_in_list]


def test_kept_and_candidates(spark):
    edges = random_edges()
    df = spark.createDataFrame(edges, "user_id BIGINT, friend_id BIGINT, mask BIGINT")
    kept = brute_kept(edges)
    got = sorted(tuple(r) for r in G.kept_edges(df, PARAMS).select("user_id", "friend_id", "mask").collect())
    assert got == sorted(kept)
    by_f = defaultdict(list)
    for u, f, m in kept:
        by_f[f].append(u)
    cnt = defaultdict(int)
    for f, us in by_f.items():
        for a, b in itertools.combinations(sorted(us), 2):
            cnt[(a, b)] += 1
    exp = sorted((a, b, c) for (a, b), c in cnt.items() if c > PARAMS.min_support)
    kdf = spark.createDataFrame(kept, "user_id BIGINT, friend_id BIGINT, mask BIGINT")
    got = sorted(tuple(r) for r in C.common_friends(kdf, PARAMS).collect())
    assert got == exp
    # permuting / repartitioning the input changes nothing
    got2 = sorted(tuple(r) for r in C.common_friends(kdf.repartition(7).orderBy("mask"), PARAMS).collect())
    assert got2 == exp


def test_hot_key_band_filter(spark):
    # one friend holds about a third of all rows
    rows = [(u, 0) for u in range(600)] + [(u, 1 + u % 50) for u in range(1200)]
    df = spark.createDataFrame(rows, "user_id BIGINT, friend_id BIGINT")
    got = sorted(tuple(r) for r in filter_by_key_count(df, "friend_id", 2, 100).collect())
    n = defaultdict(int)
    for _, f in rows:
        n[f] += 1
    assert got == sorted(r for r in rows if 2 <= n[r[1]] <= 100)


def brute_hist(kept, min_support):
    def pos(m):
        p = [i for i in range(1, 22) if (m >> (i - 1)) & 1]
        return p or [0]
    by_f = defaultdict(list)
    for u, f, m in kept:
        by_f[f].append((u, m))
    hist, sup = defaultdict(int), defaultdict(int)
    for f, lst in by_f.items():
        for (a, ma), (b, mb) in itertools.combinations(sorted(lst), 2):
            sup[(a, b)] += 1
            cells = {max(i, j) + 22 * min(i, j) - min(i, j) * (min(i, j) + 1) // 2
                     for i in pos(ma) for j in pos(mb)}
            for c in cells:
                if c >= 1:
                    hist[(a, b, c)] += 1
    return sorted((a, b, c, n) for (a, b, c), n in hist.items() if sup[(a, b)] > min_support)


def test_mask_pair_hist(spark):
    kept = brute_kept(random_edges(seed=3))
    kdf = spark.createDataFrame(kept, "user_id BIGINT, friend_id BIGINT, mask BIGINT")
    got = sorted(tuple(r) for r in MK.mask_pair_hist(C.pair_lists(kdf), 2).select("p1", "p2", "cell", "cnt").collect())
    assert got == brute_hist(kept, 2)


def test_twohop(spark):
    kept = brute_kept(random_edges(seed=5))
    kdf = spark.createDataFrame(kept, "user_id BIGINT, friend_id BIGINT, mask BIGINT")
    pairs = C.pair_rows(kdf)
    cands = C.pair_counts(pairs).where("common_cnt > 1")
    deg = G.degree(kdf)
    lab = C.with_degrees(cands.withColumn("label", (cands.p1 % 2).cast("int")), deg, "inner")
    ratios = TH.candidate_ratios(lab)
    got = {(r["p1"], r["p2"]): (r["max_common"], r["linked_pairs"]) for r in
           TH.twohop_stats(pairs, ratios, cands).collect()}
    cand = {(r["p1"], r["p2"]): r["common_cnt"] for r in cands.collect()}
    common = defaultdict(set)
    for r in pairs.collect():
        common[(r["p1"], r["p2"])].add(r["friend_id"])
    everything = {(r["p1"], r["p2"]): (r["max_common"], r["linked_pairs"]) for r in
                  TH.twohop_stats(pairs, ratios).collect()}
    exp, exp_all = {}, {}
    for pr, fs in common.items():
        hits = [(cand[(a, b)], a % 2) for a, b in itertools.combinations(sorted(fs), 2) if (a, b) in cand]
        if hits:
            exp_all[pr] = (max(h[0] for h in hits), sum(h[1] for h in hits))
        if pr not in cand:
            continue
        hits = [(cand[(a, b)], a % 2) for a, b in itertools.combinations(sorted(fs), 2) if (a, b) in cand]
        if hits:
            exp[pr] = (max(h[0] for h in hits), sum(h[1] for h in hits))
    assert got == exp
    assert everything == exp_all and set(exp) <= set(exp_all)


def test_long_friend_lists_meet_in_blocks(spark, monkeypatch):
    """A friend of 20,000 users (band widened): cut into blocks, no pair is lost or
    met twice; and with small blocks against brute force."""
    big = spark.range(20_000).selectExpr("id AS user_id", "7 AS friend_id", "0 AS mask")
    n, d = C.pair_rows(big, partitions=8).agg(F.count(F.lit(1)), F.sum(F.col("p1") * 3 + F.col("p2") * 5)).first()
    assert n == 20_000 * 19_999 // 2
    assert d == sum(3 * i * (19_999 - i) + 5 * i * i for i in range(20_000))
    monkeypatch.setattr(C, "FRIEND_BLOCK", 3)
    kept = brute_kept(random_edges(seed=9))
    kdf = spark.createDataFrame(kept, "user_id BIGINT, friend_id BIGINT, mask BIGINT")
    by = defaultdict(dict)
    for u, f, m in kept:
        by[f][u] = m
    exp = sorted((a, b, f, us[a], us[b]) for f, us in by.items() for a, b in itertools.combinations(sorted(us), 2))
    assert sorted(tuple(r) for r in C.pair_rows(kdf, with_masks=True).collect()) == exp


def test_join_per_key_hot_key(spark):
    from linkgraph.operators.skew import join_per_key
    rows = [(u, 0) for u in range(900)] + [(u, 1 + u % 40) for u in range(1800)]
    df = spark.createDataFrame(rows, "user_id BIGINT, friend_id BIGINT")
    right = spark.createDataFrame([(0, "a"), (3, "b"), (99, "c")], "friend_id BIGINT, tag STRING")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = sorted(tuple(r) for r in join_per_key(df, right, "friend_id", how)
                     .select(*(["friend_id", "user_id"] + (["tag"] if how in ("inner", "left") else []))).collect())
        exp = sorted(tuple(r) for r in df.join(right, "friend_id", how)
                     .select(*(["friend_id", "user_id"] + (["tag"] if how in ("inner", "left") else []))).collect())
        assert got == exp, how


def test_skewed_graph_end_to_end(spark):
    """One friend named by about a third of all edges and one user owning a
    large share: bands, candidates, positives and labels still match brute
    force (the hot keys take the map-side paths)."""
    rnd = random.Random(11)
    edges = set()
    for u in range(300):
        edges.add((u, 10_000, 0))                      # hot friend (also a user below)
        for f in rnd.sample(range(40), 3):
            edges.add((u, f, 1 << rnd.randrange(21)))
    for f in range(200, 500):
        edges.add((10_000, f, 2))                      # hot user
    edges.add((5, 10_000, 0))
    edges = sorted(edges)
    p = Params(min_degree=2, max_degree=5000, min_in_list=2, max_in_list=5000, min_support=1)
    df = spark.createDataFrame(edges, "user_id BIGINT, friend_id BIGINT, mask BIGINT")
    kept = brute_kept(edges, p)
    got_kept = sorted(tuple(r) for r in G.kept_edges(df, p).select("user_id", "friend_id", "mask").collect())
    assert got_kept == sorted(kept)
    users = {u for u, _, _ in edges}
    pos = sorted((u, f) for u, f, _ in edges if f > u and f in users)
    assert sorted(tuple(r) for r in G.positives(df).collect()) == pos
    kdf = spark.createDataFrame(kept, "user_id BIGINT, friend_id BIGINT, mask BIGINT")
    cands = C.common_friends(kdf, p)
    lab = {(r["p1"], r["p2"]): r["label"] for r in
           C.label_candidates(cands, C.canonical_edges(df)).collect()}
    by_f = defaultdict(list)
    for u, f, _ in kept:
        by_f[f].append(u)
    cnt = defaultdict(int)
    for f, us in by_f.items():
        for a, b in itertools.combinations(sorted(us), 2):
            cnt[(a, b)] += 1
    exp = {k for k, v in cnt.items() if v > 1}
    assert set(lab) == exp
    pset = set(pos)
    assert all(lab[k] == (1 if k in pset else 0) for k in lab)
