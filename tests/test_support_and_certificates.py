"""Support-first explosion, sparse cell vectors, and the certificates of the
trained end: right results pass them, wrong ones don't."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from linkgraph.operators import candidates as C
from linkgraph.operators import masks as MK
from linkgraph.operators import model as ML
from linkgraph.plans import jobs
from linkgraph.sources import tables as TB
from linkgraph.sources import text as X


@pytest.fixture(scope="module")
def graph(spark):
    """Users with skewed friend lists, as (rows, DataFrame)."""
    rng = random.Random(3)
    rows = {(u, int(60 * rng.random() ** 3) + 1000): rng.randrange(1 << 21) for u in range(40) for _ in range(14)}
    rows = [(u, f, m) for (u, f), m in rows.items()]
    return rows, spark.createDataFrame(rows, "user_id long, friend_id long, mask long").cache()


def plain_lists(rows, least):
    by = defaultdict(list)
    for u, f, m in rows:
        by[f].append((u, m))
    out = defaultdict(list)
    for f, users in by.items():
        for (a, ma), (b, mb) in combinations(sorted(users), 2):
            out[a, b].append((f, ma, mb))
    return {k: sorted(v) for k, v in out.items() if len(v) >= least}


@pytest.mark.parametrize("share,broadcast", [(0.5, 2_000_000), (1.0, 2_000_000), (1.0, 0), (-1.0, 0)])
@pytest.mark.parametrize("least", [1, 2, 4, 99])
def test_pair_lists_on_every_path(graph, monkeypatch, share, broadcast, least):
    monkeypatch.setattr(C, "SUPPORTED_SHARE", share)
    monkeypatch.setattr(C, "BROADCAST_PAIRS", broadcast)
    monkeypatch.setattr(C, "FRIEND_BLOCK", 5)
    rows, kept = graph
    got = {(r.p1, r.p2): sorted(map(tuple, r.common)) for r in C.pair_lists(kept, least).collect()}
    assert got == plain_lists(rows, least)


@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_only_rows_of_supported_pairs_reach_the_lists(graph, monkeypatch, broadcast):
    monkeypatch.setattr(C, "BROADCAST_PAIRS", broadcast)
    rows, kept = graph
    s = C.supported_pairs(kept, 4)
    want = plain_lists(rows, 4)
    assert (s.n_pairs, s.n_rows) == (len(want), sum(map(len, want.values())))
    assert C.only_supported(C.pair_rows(kept, with_masks=True), s).count() == s.n_rows < C.pair_explosion_size(kept)


def test_shuffled_semi_join_has_one_exchange_and_a_bloom_filter(spark, graph, monkeypatch):
    monkeypatch.setattr(C, "BROADCAST_PAIRS", 0)
    monkeypatch.setattr(C, "SUPPORTED_SHARE", 1.0)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        plan = C.pair_lists(graph[1], 4)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert "might_contain" in plan
    # grouped by the join's keys: no second exchange of the rows
    assert "Exchange hashpartitioning(pair" in plan and "Exchange hashpartitioning(p1" not in plan


def hist(spark, rows):
    return spark.createDataFrame(rows, "p1 long, p2 long, cell int, cnt long")


@pytest.fixture(scope="module")
def cells(spark):
    rng = random.Random(8)
    rows = {(p, p + 1, rng.choice([1, 2, 3, 40, 252])): rng.randint(1, 6) for p in range(300) for _ in range(3)}
    return hist(spark, [(*k, n) for k, n in rows.items()]).cache()


def test_cell_vectors_are_the_histograms(cells):
    dense = {(r.p1, r.p2): r.hist for r in MK.hist_vectors(cells).collect()}
    out = ML.cell_vectors(cells).collect()
    assert {(r.p1, r.p2): r.cells.toArray().tolist() for r in out} == dense
    assert all(len(r.cells.values) <= 3 for r in out)


def test_covariance_of_the_whole_grid(cells):
    x = np.array([r.hist for r in MK.hist_vectors(cells).collect()])
    cov = np.cov(x.T)
    got = {(r.x, r.y): r["cov"] for r in ML.cell_covariance(cells).collect()}
    assert set(got) == {(i, j) for i in range(1, 253) for j in range(i, 253)}
    assert all(abs(v - cov[i - 1, j - 1]) < 1e-9 for (i, j), v in got.items())


def test_covariance_of_no_pairs_is_unknown(spark):
    got = ML.cell_covariance(hist(spark, []), 4).collect()
    assert len(got) == 10 and all(r["cov"] is None for r in got)


def test_covariance_of_cells_that_never_meet(spark):
    got = {(r.x, r.y): r["cov"] for r in ML.cell_covariance(hist(spark, [(1, 2, 1, 3), (1, 3, 2, 4)]), 3).collect()}
    assert got == {(1, 1): 4.5, (1, 2): -6.0, (1, 3): 0.0, (2, 2): 8.0, (2, 3): 0.0, (3, 3): 0.0}


def test_certificate_of_a_right_and_of_wrong_projections(spark, cells):
    vectors = ML.cell_vectors(cells).cache()
    out = {(r.part, r.i): r.value for r in ML.pca_certificate(cells, ML.pca_model(vectors, 3), vectors).collect()}
    assert all(abs(v) < 1e-8 for (part, _), v in out.items() if part != "moment")
    cov = np.cov(np.array([r.cells.toArray() for r in vectors.collect()]).T)
    for m in (1, 2, 3):
        assert np.isclose(out["moment", m], np.trace(np.linalg.matrix_power(cov, m)))
    # components fitted on other pairs are no eigenvectors here
    other = ML.pca_model(vectors.where("p1 < 40"), 3)
    bad = {(r.part, r.i): r.value for r in ML.pca_certificate(cells, other, vectors).collect()}
    assert max(v for (part, _), v in bad.items() if part == "residual") > 1e-3
    assert bad["off_diagonal", 0] > 1e-4 and bad["leading", 0] > 0


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3)) * [1, 5, 0.2] + 1
    y = (x[:, 0] + rng.normal(size=400) > 1).astype(float)
    rows = [(i, i + 1, float(y[i]), [*map(float, x[i]), 7.0]) for i in range(400)]
    df = spark.createDataFrame(rows, "p1 long, p2 long, label double, f array<double>")
    return df.select("p1", "p2", "label", array_to_vector("f").alias("features")).cache()


def test_gradient_is_zero_only_at_the_optimum(labelled, tmpdir_path):
    done = ML.reloaded(ML.fit(labelled), tmpdir_path + "/m")
    g = {r.term: (r.gradient, r.observed) for r in ML.gradient(done, labelled).collect()}
    assert sorted(g) == [-1, 0, 1, 2, 3] and all(abs(v) < 1e-4 for v, _ in g.values())
    total = labelled.agg(F.sum("label")).first()[0]
    assert g[-1][1] == total and np.isclose(g[3][1], 7 * total)
    early = ML.reloaded(ML.fit(labelled, max_iter=1), tmpdir_path + "/early")
    assert max(abs(r.gradient) for r in ML.gradient(early, labelled).collect()) > 1e-3


def test_reloaded_model_scores_like_its_stored_numbers(labelled, tmpdir_path):
    fitted = ML.fit(labelled, rows=400)
    model = ML.reloaded(fitted, tmpdir_path + "/m")
    assert np.allclose(model.stages[-1].coefficients.toArray(), fitted.stages[-1].coefficients.toArray())
    a = {r.p1: r.score for r in ML.score(model, labelled).collect()}
    b = {r.p1: r.score for r in ML.score_by_columns(model, labelled).collect()}
    assert len(a) == 400 and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_scoring_after_an_observed_query(spark, labelled, tmpdir_path):
    """The stored model can be shipped to tasks whatever the session has done."""
    _, seen = jobs._save_counted(labelled, tmpdir_path + "/rows")
    assert seen == {"n": 400, "n1": int(labelled.agg(F.sum("label")).first()[0])}
    model = ML.reloaded(ML.fit(labelled), tmpdir_path + "/m")
    assert ML.score(model, labelled).where("score > 0.5").count() > 0


def test_counts_of_a_reused_stage(spark, tmpdir_path, monkeypatch):
    df = spark.range(10).select((F.col("id") % 2).alias("label"))
    assert jobs._save_counted(df, tmpdir_path + "/s")[1] == {"n": 10, "n1": 5}
    monkeypatch.setattr(jobs, "REUSE_STAGES", True)
    assert jobs._save_counted(df.limit(3), tmpdir_path + "/s")[1] == {"n": 10, "n1": 5}
    assert jobs._save_counted(df.where("label > 7"), tmpdir_path + "/none")[1] == {"n": 0, "n1": 0}


def test_lines_are_numbered_through_the_files(spark, tmpdir_path):
    df = spark.range(200).select(F.col("id").alias("p1"), (F.col("id") * 2).alias("p2"))
    for files in (1, 7):
        path = f"{tmpdir_path}/t{files}"
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        X.write_lines(X.render_pairs(df).repartitionByRange(files, F.length("value"), "value"), path)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        got = X.numbered_lines(spark, path).orderBy("position").collect()
        assert [r.position for r in got] == list(range(1, 201))
        read = []
        import glob
        import gzip
        for f in sorted(glob.glob(path + "/part-*")):
            read += gzip.open(f, "rt").read().split("\n")[:-1]
        assert [r["value"] for r in got] == read
        assert X.parse_pairs(X.numbered_lines(spark, path), keep=["position"]).columns == ["position", "p1", "p2"]


@pytest.mark.parametrize("rows", [None, 300])
def test_bucketed_writers_agree(spark, tmpdir_path, rows):
    pairs = spark.range(300).select(F.col("id").alias("p1"), (F.col("id") + 1).alias("p2"))
    TB.write_candidates(pairs, tmpdir_path + "/c", 11, rows)
    assert Counter(map(tuple, TB.read_candidates(spark, tmpdir_path + "/c").collect())) == Counter(
        (i, i + 1) for i in range(300))
    assert TB.read_candidates(spark, tmpdir_path + "/c", 4).count() == sum(i % 11 == 4 for i in range(300))


def test_vector_parts(spark, cells):
    v = ML.project(ML.pca_model(MK.hist_vectors(cells), 2), MK.hist_vectors(cells))
    assert v.select(F.size("pca")).distinct().first()[0] == 2
    assert vector_to_array is not None


def test_feature_vectors_meet_without_an_exchange_by_pair(spark):
    """Labels, 2-hop, projection and shares are bucketed by (p1, p2)."""
    from linkgraph.plans.queries import ML_STAGES
    from linkgraph.plans.views import Views
    from tests.conftest import SF_SMALL
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    v = Views(spark, SF_SMALL, stages=ML_STAGES - {"vectors"})
    plain = Views(spark, SF_SMALL, stages=ML_STAGES - {"vectors", "pairs"})
    for k, x in conf.items():
        spark.conf.set(k, x)
    try:
        plan = v.vectors._jdf.queryExecution().executedPlan().toString()
        joins = v.labelled.join(v.twohop, ["p1", "p2"], "left")._jdf.queryExecution().executedPlan().toString()
        other = plain.vectors._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
    assert "SortMergeJoin" in joins and "Exchange" not in joins
    assert "Exchange hashpartitioning(p1" in other


def test_bucketed_stages_are_dropped(spark):
    from linkgraph.sources import store
    df = store.materialize_bucketed(spark.range(20).select("id", (F.col("id") % 3).alias("k")), "b", ["k"], 4)
    table, path = df._stage_table, df._stage_path
    assert df.count() == 20 and spark.catalog.tableExists(table) and table in store._tables and path in store._stages
    store.drop_stage(df)
    assert not spark.catalog.tableExists(table) and not jobs.stage_exists(spark, path)
    assert table not in store._tables and path not in store._stages


def test_stages_of_a_block_are_freed(spark):
    from linkgraph.sources import store
    before, keep = set(store._stages), []
    with store.stages_freed(but=keep):
        a = store.materialize(spark.range(5), "a")
        b = store.materialize_bucketed(a.withColumn("k", F.col("id") % 2), "b", ["k"], 2)
        c = store.materialize(b.groupBy("k").count(), "c")
        keep.append(c)
    assert set(store._stages) - before == {c._stage_path} and b._stage_table not in store._tables
    assert c.count() == 2 and not jobs.stage_exists(spark, a._stage_path)
    with pytest.raises(ValueError), store.stages_freed(but=[]):
        d = store.materialize(spark.range(5), "d")
        raise ValueError
    assert d.count() == 5
    store.drop_stage(d)
