"""Spark ML stages of the pipeline.

Everything distributed is Spark ML: PCA and StandardScaler aggregate a
bounded summary (252 x 252 covariance, per-feature moments) with
treeAggregate, L-BFGS aggregates one gradient per iteration.  Feature
columns are joined in long form and only turned into vectors at the end.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, CountVectorizerModel, PCAModel, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgraph.functions.masks import MASK_BITS
from linkgraph.operators.features import FEATURE_COLS, FeatureSet
from linkgraph.sources.store import scratch

N_TYPES = MASK_BITS + 1  # 22 per-type counts; the last one stays 0 (X6)


def cell_vectors(hist: DataFrame, n_cells: int = 252) -> DataFrame:
    """S10 as (p1, p2, cells): one sparse vector of the histogram of each pair, as
    long as its set cells.

    A pair's cells, each repeated as often as it counts, are a bag of words over the
    fixed vocabulary 1..n_cells, which CountVectorizerModel turns into a vector in the
    JVM; no pair is widened to n_cells numbers."""
    words = F.array_repeat(F.col("cell").cast("string"), F.col("cnt").cast("int"))
    bags = hist.groupBy("p1", "p2").agg(F.flatten(F.collect_list(words)).alias("words"))
    counter = CountVectorizerModel.from_vocabulary([str(i) for i in range(1, n_cells + 1)], inputCol="words",
                                                   outputCol="cells")
    return counter.transform(bags).select("p1", "p2", "cells")


def _with_cells(vectors: DataFrame) -> DataFrame:
    return vectors if "cells" in vectors.columns else vectors.select("p1", "p2", array_to_vector("hist").alias("cells"))


def pca_model(vectors: DataFrame, k: int) -> PCAModel:
    """M1 fitted: the k leading components of the 252-cell histograms, given as
    `cell_vectors` or as the arrays of `masks.hist_vectors`."""
    return PCA(k=min(k, 252), inputCol="cells", outputCol="_pca").fit(_with_cells(vectors))


def project(model: PCAModel, vectors: DataFrame) -> DataFrame:
    """(p1, p2, pca ARRAY<DOUBLE>)."""
    return model.transform(_with_cells(vectors)).select("p1", "p2", vector_to_array("_pca").alias("pca"))


def fit_pca(vectors: DataFrame, k: int) -> DataFrame:
    """M1 + F14: the projection of the histograms on their own components.  The fit
    reads `vectors` several times, so it should be a written table."""
    return project(pca_model(vectors, k), vectors)


def cell_covariance(hist: DataFrame, n_cells: int = 252) -> DataFrame:
    """(x, y, cov) for all cells x <= y of the fixed grid: the covariance M1
    decomposes, over all pairs with a histogram.  A pair's unset cells are zeros,
    so cells that never meet have the covariance -sx * sy / (n (n - 1))."""
    n = hist.select("p1", "p2").distinct().agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = hist.groupBy("cell").agg(F.sum("cnt").cast("double").alias("s"))
    a = hist.select("p1", "p2", F.col("cell").alias("x"), F.col("cnt").alias("cx"))
    b = hist.select("p1", "p2", F.col("cell").alias("y"), F.col("cnt").alias("cy"))
    met = (a.join(b, ["p1", "p2"]).where("x <= y").groupBy("x", "y")
           .agg(F.sum(F.col("cx") * F.col("cy")).cast("double").alias("sxy")))
    x = hist.sparkSession.range(1, n_cells + 1).select(F.col("id").cast("int").alias("x"))
    grid = x.select("x", F.explode(F.sequence("x", F.lit(n_cells))).alias("y"))
    j = (grid.join(met, ["x", "y"], "left")
         .join(one.select(F.col("cell").alias("x"), F.col("s").alias("sx")), "x", "left")
         .join(one.select(F.col("cell").alias("y"), F.col("s").alias("sy")), "y", "left")).na.fill(0.0, ["sxy", "sx", "sy"])
    n = n.scalar()
    return j.select("x", "y", F.try_divide(F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), n), n - 1).alias("cov"))


def pca_certificate(hist: DataFrame, model: PCAModel, vectors: DataFrame, n_cells: int = 252) -> DataFrame:
    """What holds of a right projection whatever the signs of its components, as
    rows (part, i, value); every value but the moments should be 0:

    residual i      largest entry of C v - s v, for component v and the variance s of its
                    projected column: v is an eigenvector of the covariance C, s its eigenvalue
    orthonormal     largest entry of V'V - 1
    off_diagonal    largest covariance of two projected columns
    order           by how much a column varies more than the one before it
    leading         the k variances together against the k largest of all n_cells
    moment m        sum of the m-th powers of all n_cells variances, which is the trace of
                    C^m: with orthonormal eigenvectors no eigenvalue is missed or taken twice

    Only summaries of fixed size reach the driver: C, V and the moments."""
    k = model.pc.numCols
    c = np.zeros((n_cells + 1, n_cells + 1))
    for r in cell_covariance(hist, n_cells).collect():
        c[r["x"], r["y"]] = c[r["y"], r["x"]] = r["cov"] or 0.0
    c, v = c[1:, 1:], model.pc.toArray()
    cells = _with_cells(vectors)

    def variances(m: PCAModel, width: int) -> np.ndarray:
        got = m.transform(cells).agg(Summarizer.variance(F.col("_pca")).alias("v")).first()["v"]
        return got.toArray() if got is not None else np.zeros(width)

    s, every = variances(model, k), variances(pca_model(cells, n_cells), n_cells)
    corr = Correlation.corr(model.transform(cells), "_pca").first()[0].toArray()
    met = np.nan_to_num(corr) * np.sqrt(np.outer(s, s))
    np.fill_diagonal(met, 0.0)
    rows = [("residual", i + 1, float(np.abs(c @ v[:, i] - s[i] * v[:, i]).max())) for i in range(k)]
    rows += [("orthonormal", 0, float(np.abs(v.T @ v - np.eye(k)).max())),
             ("off_diagonal", 0, float(np.abs(met).max())),
             ("order", 0, float(max(0.0, np.diff(s).max(initial=0.0)))),
             ("leading", 0, float(abs(s.sum() - np.sort(every)[::-1][:k].sum())))]
    rows += [("moment", m, float((every ** m).sum())) for m in (1, 2, 3)]
    return hist.sparkSession.createDataFrame(rows, "part STRING, i INT, value DOUBLE")


def type_shares(diag: DataFrame, candidates: DataFrame, divide: bool = True) -> DataFrame:
    """J5 + F15: the 22 per-type common counts of each pair as an array,
    divided by max(1, common_cnt) (the production job's form)."""
    m = F.map_from_entries(F.collect_list(F.struct("type", F.col("cnt").cast("double"))))
    per = diag.groupBy("p1", "p2").agg(m.alias("_m"))
    j = candidates.select("p1", "p2", "common_cnt").join(per, ["p1", "p2"], "left")
    div = F.greatest(F.lit(1), F.col("common_cnt")).cast("double") if divide else F.lit(1.0)
    arr = F.transform(F.sequence(F.lit(0), F.lit(N_TYPES - 1)),
                      lambda i: F.coalesce(F.element_at(F.col("_m"), i), F.lit(0.0)) / div)
    return j.select("p1", "p2", arr.alias("type_shares"))


def feature_set_vectors(features: DataFrame, fs: FeatureSet, pca: DataFrame | None = None,
                        shares: DataFrame | None = None, edge_bits: DataFrame | None = None) -> DataFrame:
    """M5 for one of the job generations' feature sets."""
    return full_features(features, pca if fs.pca else None, shares if fs.type_counts else None, fs.pca,
                         list(fs.scalars), edge_bits if fs.edge_bits else None)


def full_features(features: DataFrame, pca: DataFrame | None, shares: DataFrame | None,
                  k: int, cols: list[str] | None = None,
                  edge_bits: DataFrame | None = None) -> DataFrame:
    """M5 + U2: scalar features, PCA projection (zeros when the pair has no
    histogram, J4), per-type shares (zeros, J5) and, when given, the 21 mask
    bits of the known edge (F13 / J3, zeros for non-edges; off by default:
    it leaks the label) as one vector column.  Missing parts default to zero
    vectors of their width (X10, array_repeat)."""
    df = features
    parts = [F.array(*[F.col(c).cast("double") for c in (cols or FEATURE_COLS)])]
    if edge_bits is not None:
        bits = F.transform(F.split(F.col("bits"), ""), lambda b: b.cast("double"))
        df = df.join(edge_bits.select("p1", "p2", bits.alias("_bits")), ["p1", "p2"], "left")
        parts.append(F.coalesce("_bits", F.array_repeat(F.lit(0.0), MASK_BITS)))
    if pca is not None:
        df = df.join(pca, ["p1", "p2"], "left")
        parts.append(F.coalesce("pca", F.array_repeat(F.lit(0.0), k)))
    if shares is not None:
        df = df.join(shares, ["p1", "p2"], "left")
        parts.append(F.coalesce("type_shares", F.array_repeat(F.lit(0.0), N_TYPES)))
    return df.select("p1", "p2", F.col("label").cast("double").alias("label"),
                     array_to_vector(F.concat(*parts)).alias("features"))


def link_model_stages(max_iter: int = 6000, fit_intercept: bool = True) -> Pipeline:
    """M2 + M3: unit-variance scaling without centring, fitted on the
    training rows only, then unregularised logistic regression (with an
    intercept or not).  Standardisation inside LR is off: the scaler already
    did it."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withStd=True, withMean=False)
    lr = LogisticRegression(featuresCol="scaled", labelCol="label", regParam=0.0,
                            elasticNetParam=0.0, fitIntercept=fit_intercept, standardization=False,
                            maxIter=max_iter, family="binomial")
    return Pipeline(stages=[scaler, lr])


# Training rows that one task of a gradient step should hold.
ROWS_PER_GRADIENT_TASK = 100_000


def reloaded(model: PipelineModel, path: str) -> PipelineModel:
    """K7: the model saved at `path` and loaded from there."""
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def fit(train: DataFrame, max_iter: int = 6000, fit_intercept: bool = True,
        rows: int | None = None, path: str | None = None) -> PipelineModel:
    """M2 + M3 fitted, saved at `path` (a scratch folder if not given) and loaded (K7).

    What scores is the stored model: one fresh from the solver also carries its training
    summary and with it the session, which is shipped to every task and can't be once
    the session has observed a query.  The solver runs a job per step, hundreds of them,
    whose cost on a small training set is the scheduling of its tasks; with `rows`, the
    set's size, it is read in no more tasks than ROWS_PER_GRADIENT_TASK asks for."""
    if rows is not None:
        train = train.coalesce(max(1, -(-rows // ROWS_PER_GRADIENT_TASK)))
    fitted = link_model_stages(max_iter, fit_intercept).fit(train)
    model = reloaded(fitted, path or scratch(train.sparkSession, "model"))
    model._iterations = int(fitted.stages[-1].summary.totalIterations)
    return model


def solver_state(model: PipelineModel, max_iter: int) -> tuple[int, bool]:
    """(iterations used, converged before the cap) of a model from `fit`."""
    return model._iterations, model._iterations < max_iter


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """M4: probability of the link, (p1, p2, label, score)."""
    out = model.transform(df)
    return out.select("p1", "p2", "label", vector_to_array("probability").getItem(1).alias("score"))


def coefficients(model: PipelineModel) -> DataFrame:
    """M3 output as rows: (term, value); term -1 is the intercept."""
    lr = model.stages[-1]
    # one value per feature: a bounded, model-sized table
    rows = [(-1, float(lr.intercept))] + [(i, float(c)) for i, c in enumerate(lr.coefficients.toArray())]
    return SparkSession.getActiveSession().createDataFrame(rows, "term INT, value DOUBLE")


def gradient(model: PipelineModel, train: DataFrame) -> DataFrame:
    """How far the fit is from its optimum: (term, gradient, observed), term -1 the
    intercept.  `gradient` is the derivative of the mean log loss by the term's
    coefficient, the mean of (probability - label) * scaled feature: all 0 at the
    optimum of an unregularised fit.  `observed` is the sum of label * feature, which
    the model's probabilities then reproduce.  One partial aggregate over the rows,
    one row a term."""
    out = model.transform(train)
    missing = vector_to_array("probability").getItem(1) - F.col("label")
    x, scaled = vector_to_array("features"), vector_to_array("scaled")
    terms = F.posexplode(F.arrays_zip(F.concat(F.array(F.lit(1.0)), x).alias("x"),
                                      F.concat(F.array(F.lit(1.0)), scaled).alias("scaled")))
    long = out.select("label", missing.alias("missing"), terms.alias("i", "f"))
    return long.groupBy((F.col("i") - 1).cast("int").alias("term")).agg(
        F.avg(F.col("missing") * F.col("f.scaled")).alias("gradient"),
        F.sum(F.col("label") * F.col("f.x")).alias("observed"))


def score_by_columns(model: PipelineModel, df: DataFrame) -> DataFrame:
    """M4 without Spark ML: (p1, p2, score) from the stored numbers of a pipeline
    (deviations, coefficients, intercept: one literal per feature)."""
    std, lr = model.stages[0].std.toArray(), model.stages[-1]
    weights = [float(c / d) if d else 0.0 for c, d in zip(lr.coefficients.toArray(), std, strict=True)]
    product = F.zip_with(vector_to_array("features"), F.array(*[F.lit(w) for w in weights]), lambda a, b: a * b)
    margin = F.aggregate(product, F.lit(0.0), lambda a, b: a + b) + F.lit(float(lr.intercept))
    return df.select("p1", "p2", (1 / (1 + F.exp(-margin))).alias("score"))
