"""Pairs leave the block search once, and only if the full sketches allow a link."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from linkgraph.llm import jaccard


def copies(edits, n=24, size=400, seed=3):
    """Texts of one original, each with `edits` words of its own."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(size)]
    rows = []
    for d in range(n):
        own = list(base)
        for k in rng.sample(range(size), edits):
            own[k] = f"x{d}y{k}"
        rows.append((d, " ".join(own)))
    return rows


def searched(spark, monkeypatch, rows, keys=40):
    """(rows that leave the search, info) where all texts share `keys` keys, none linked yet."""
    info = jaccard.described(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80)
    members = info.select("node").crossJoin(spark.range(keys).select(F.xxhash64("id").alias("key"))).select("key", "node")
    none = spark.createDataFrame([], "id long, component long")
    with monkeypatch.context() as m:
        m.setattr(type(members), "distinct", lambda self: self)
        out = jaccard.crossing(members, members.limit(0), none, info, 80)
    return out, info


def test_a_pair_leaves_once(spark, monkeypatch):
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    was = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    try:
        for n in (24, 60):  # compared together, compared by itself
            rows, info = searched(spark, monkeypatch, copies(8, n))
            got = [(r.a, r.b) for r in rows.collect()]
            nodes = sorted(r.node for r in info.collect())
            assert sorted(got) == list(combinations(nodes, 2))  # 40 keys: once a task before
    finally:
        spark.conf.set(conf, was)


def test_a_pair_leaves_only_if_its_full_sketch_may_link(spark, monkeypatch):
    rows, info = searched(spark, monkeypatch, copies(27))
    met = {(r.a, r.b) for r in rows.collect()}
    assert met == {(r.a, r.b) for r in jaccard.near(rows.distinct(), info, 80).collect()}


def test_the_first_shared_key_gives_the_pair():
    rng = random.Random(5)
    have = {n: sorted(rng.sample(range(60), rng.choice([1, 3, 20, 40]))) for n in range(40)}
    times = dict.fromkeys(((a, b) for a, b in combinations(have, 2) if set(have[a]) & set(have[b])), 0)
    for key in range(60):
        nodes = [n for n in have if key in have[n]]
        before = [[k for k in have[n] if k < key][-jaccard.EARLIER:] for n in nodes]
        tab = pa.table({"node": pa.array(nodes, pa.int64()), "before": pa.array(before, pa.list_(pa.int64()))})
        a, b = np.triu_indices(len(nodes), 1)
        for pair in jaccard.first_met(tab, a, b).tolist():
            times[tuple(pair)] += 1
    shared = sum(len(set(have[a]) & set(have[b])) for a, b in times)
    assert min(times.values()) == 1
    assert sum(times.values()) < shared / 2
