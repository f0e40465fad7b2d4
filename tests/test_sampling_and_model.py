"""Deterministic draws, splits, and the ML stages (M1-M4)."""

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from linkgraph.config import Params
from linkgraph.functions.hashing import hash_unit
from linkgraph.operators import model as ML
from linkgraph.operators import sampling as S


def pairs(spark, n=20000):
    return spark.range(n).select((F.col("id") * 7 % 15001).alias("p1"), (F.col("id") * 13 % 20011 + 1).alias("p2"),
                                 (F.col("id") % 5 == 0).cast("int").alias("label"))


def test_draws_are_deterministic_and_independent(spark):
    df = pairs(spark)
    u = df.select(hash_unit("p1", "p2", 1).alias("a"), hash_unit("p1", "p2", 3).alias("b")).toPandas()
    u2 = df.select(hash_unit("p1", "p2", 1).alias("a")).toPandas()
    assert (u["a"] == u2["a"]).all()
    assert abs(np.corrcoef(u["a"], u["b"])[0, 1]) < 0.05
    assert abs(((u["a"] < 0.15) & (u["b"] < 0.3)).mean() - 0.045) < 0.01


def test_split_is_a_partition(spark):
    p = Params()
    df = pairs(spark)
    train, valid = S.train_valid(df, p)
    data = S.training_data(df, p)
    assert train.count() + valid.count() == data.count()
    assert train.join(valid, ["p1", "p2"]).count() == 0
    # the hold-out never contains a training pair
    assert S.holdout(df, train, p).join(train, ["p1", "p2"]).count() == 0


def test_pca_and_lr(spark):
    rnd = np.random.default_rng(0)
    X = rnd.normal(size=(300, 4))
    y = (X[:, 0] + 0.5 * X[:, 1] + rnd.normal(scale=1.0, size=300) > 0).astype(float)
    rows = [(i, i + 1, float(y[i]), [float(v) for v in X[i]]) for i in range(300)]
    df = spark.createDataFrame(rows, "p1 BIGINT, p2 BIGINT, label DOUBLE, f ARRAY<DOUBLE>") \
        .select("p1", "p2", "label", array_to_vector("f").alias("features"))
    model = ML.fit(df, max_iter=200)
    lr = model.stages[-1]
    sd = X.std(axis=0, ddof=1)
    Z = X / sd
    w, b = lr.coefficients.toArray(), lr.intercept
    prob = 1 / (1 + np.exp(-(Z @ w + b)))
    grad = Z.T @ (prob - y) / len(y)
    assert np.abs(grad).max() < 1e-3 and abs((prob - y).mean()) < 1e-3
    s = ML.score(model, df).toPandas()
    assert s["score"].between(0, 1).all()
    # PCA: the first component explains the largest variance
    h = spark.createDataFrame([(i, i + 1, [float(v) for v in X[i]] + [0.0] * 248) for i in range(300)],
                              "p1 BIGINT, p2 BIGINT, hist ARRAY<DOUBLE>")
    proj = np.array([r["pca"] for r in ML.fit_pca(h, 3).collect()])
    var = proj.var(axis=0)
    assert var[0] >= var[1] >= var[2]


WIDTHS = {"baseline": 3, "extended": 30, "short": 31, "short_pca": 41, "production": 81, "holdout": 83}


def test_feature_sets_have_the_widths_of_the_jobs(spark):
    from dataclasses import replace

    from linkgraph.config import FIXTURE
    from linkgraph.operators.features import FEATURE_SETS
    from linkgraph.plans.views import Views
    from tests.conftest import SF_SMALL
    assert {k: v.width for k, v in FEATURE_SETS.items()} == WIDTHS
    base = Views(spark, SF_SMALL, FIXTURE, stages=Views.DEFAULT_STAGES | {"candidates", "labelled", "hist"})
    for name in ("baseline", "short_pca", "holdout"):
        v = Views(spark, SF_SMALL, replace(FIXTURE, feature_set=name, divide_type_counts=name != "holdout"), stages=frozenset())
        for part in ("edges", "kept", "candidates", "labelled", "hist"):  # one set of stage tables
            v.__dict__[part] = getattr(base, part)
        assert len(v.vectors.first()["features"].toArray()) == WIDTHS[name]


def test_edge_bits_in_the_vector(spark):
    feats = spark.createDataFrame([(1, 2, 1, 3, 4, 1)], "p1 BIGINT, p2 BIGINT, label INT, common_cnt BIGINT, "
                                  "age_gap BIGINT, same_sex INT")
    bits = spark.createDataFrame([(1, 2, "0" * 20 + "1")], "p1 BIGINT, p2 BIGINT, bits STRING")
    v = ML.full_features(feats, None, None, 0, ["common_cnt", "age_gap", "same_sex"], bits).first()["features"]
    assert list(v.toArray()) == [3.0, 4.0, 1.0] + [0.0] * 20 + [1.0]


def test_draws_take_any_bigint_and_are_jointly_uniform(spark):
    big = spark.createDataFrame([(2 ** 62 + 5, 2 ** 63 - 1), (4_000_000_000, 2 ** 32), (-3, -2 ** 63)],
                                "p1 BIGINT, p2 BIGINT")
    assert all(0 <= r[0] < 1 for r in big.select(hash_unit("p1", "p2", 2)).collect())
    df = spark.range(200_000).select((F.col("id") % 400).alias("p1"), (F.col("id") / 400).cast("bigint").alias("p2"))
    u = df.select(*[hash_unit("p1", "p2", s).alias(f"u{s}") for s in (1, 2, 3, 4)]).toPandas().to_numpy()
    cells = np.zeros(5 ** 4)
    np.add.at(cells, (u * 5).astype(int) @ np.array([125, 25, 5, 1]), 1)
    chi = ((cells - 320) ** 2 / 320).sum()
    assert abs(chi - 624) < 6 * np.sqrt(2 * 624)


def test_draw_sql_is_the_same_function(spark):
    import duckdb

    from linkgraph.functions.hashing import hash_unit_sql
    rows = [(1, 2), (-5, 7), (2 ** 62, 3), (4_000_000_000, 2 ** 32)]
    got = [r[0] for r in spark.createDataFrame(rows, "p1 BIGINT, p2 BIGINT").select(hash_unit("p1", "p2", 3)).collect()]
    vals = ", ".join(f"({a}, {b})" for a, b in rows)
    assert got == [r[0] for r in duckdb.sql(f"SELECT {hash_unit_sql('p1', 'p2', 3)} FROM (VALUES {vals}) t(p1, p2)").fetchall()]


def test_pca_follows_the_covariance(spark):
    """M1 on the fixture: components are eigenvectors of the covariance."""
    from pyspark.ml.feature import PCA

    from linkgraph.operators.masks import hist_vectors
    from linkgraph.plans.views import Views
    from tests.conftest import SF_SMALL
    v = Views(spark, SF_SMALL, stages=Views.DEFAULT_STAGES | {"hist"})
    x = hist_vectors(v.hist).select(array_to_vector("hist").alias("h"))
    pc = PCA(k=5, inputCol="h", outputCol="o").fit(x).pc.toArray()
    cov = np.cov(np.array([r["h"].toArray() for r in x.collect()]).T)
    top = np.linalg.eigh(cov)[0][::-1][:5]
    for i in range(5):
        assert np.allclose(cov @ pc[:, i], top[i] * pc[:, i], atol=1e-6)


def test_model_without_intercept(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(200, 2)) + 1
    y = (x[:, 0] + rnd.normal(size=200) > 1).astype(float)
    df = spark.createDataFrame([(i, i + 1, float(y[i]), [float(v) for v in x[i]]) for i in range(200)],
                               "p1 BIGINT, p2 BIGINT, label DOUBLE, f ARRAY<DOUBLE>") \
        .select("p1", "p2", "label", array_to_vector("f").alias("features"))
    m = ML.fit(df, fit_intercept=False)
    used, converged = ML.solver_state(m, 6000)
    assert m.stages[-1].intercept == 0 and 0 < used < 6000 and converged
