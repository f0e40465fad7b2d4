"""End-to-end chain on the smallest fixture: written artifacts read back."""

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from linkgraph.config import FIXTURE
from linkgraph.operators import model as ML
from linkgraph.plans import jobs
from linkgraph.plans.views import Views
from linkgraph.sources import tables as TB
from linkgraph.sources import text as X
from tests.conftest import SF_SMALL


def test_run_writes_readable_artifacts(spark, tmpdir_path):
    v = Views(spark, SF_SMALL, stages=frozenset())
    out = tmpdir_path + "/run"
    report = jobs.run(spark, v.edges, v.profile, out, FIXTURE).first()
    assert report["pca_size"] == 47 and 0.0 <= report["auc"] <= 1.0
    assert report["train_rows"] == report["positives"] + report["negatives"]

    # K3 -> S14: ranked text lists parse back to the saved ranking
    ranked = spark.read.parquet(out + "/prediction_ranked")
    parsed = X.parse_ranked_lists(spark.read.text(out + "/prediction"))
    assert sorted(tuple(r) for r in parsed.collect()) == \
        sorted(tuple(r) for r in ranked.select("user_id", "rank", "candidate_id").where("user_id <> 0").collect())
    assert ranked.agg(F.max("rank")).first()[0] <= FIXTURE.top_k

    # K7: the saved model scores exactly like the fitted one
    model = PipelineModel.load(out + "/model")
    vs = spark.read.parquet(out + "/valid_scores")
    vecs = spark.read.parquet(out + "/vectors")
    again = ML.score(model, vecs.join(vs.select("p1", "p2"), ["p1", "p2"], "left_semi")) \
        .select("p1", "p2", F.col("score").alias("s_new"))
    old = vs.select("p1", "p2", F.col("score").alias("s_old"))
    diff = again.join(old, ["p1", "p2"]).select(F.max(F.abs(F.col("s_new") - F.col("s_old")))).first()[0]
    assert diff is not None and diff < 1e-12

    # K5 -> S13 and K8 -> S15
    proba = TB.read_probabilities(spark, out + "/validPrediction_proba")
    hold = spark.read.parquet(out + "/holdout")
    assert proba.count() == 2 * hold.count()
    truth = X.parse_pairs(spark.read.text(out + "/validPrediction_real"))
    assert truth.count() == hold.where("label = 1").count()

    # the hold-out lists are cut at the fitted threshold
    listed = X.parse_ranked_lists(spark.read.text(out + "/validPrediction"))
    low = listed.join(proba.withColumnRenamed("score", "s"), ["user_id", "candidate_id"]).where(
        F.col("s") < report["threshold"])
    assert listed.count() > 0 and low.count() == 0

    # K5 and the offline lists of the test group
    test = TB.read_probabilities(spark, out + "/prediction_proba")
    assert test.count() == 2 * spark.read.parquet(out + "/test_scores").count()
    offline = X.parse_ranked_lists(spark.read.text(out + "/prediction_offline"))
    exp = jobs.offline_lists(spark, out + "/prediction_proba", FIXTURE, FIXTURE.test_residue)
    assert sorted(tuple(r) for r in offline.collect()) == \
        sorted(tuple(r) for r in exp.select("user_id", "rank", "candidate_id").where("user_id <> 0").collect())

    # the report tells how the solver ended
    assert report["max_iter"] == 6000 and report["converged"] == (report["iterations"] < 6000)
    assert report["rejected_items"] == 0

    # K6: prediction / label files with the reference's file counts
    for part, files in (("training", 1), ("validation", 4), ("test", 8)):
        df = spark.read.parquet(f"{out}/Model_fin/{part}")
        assert df.columns == ["prediction", "label"]
        assert len(df.inputFiles()) <= files


def test_stage_reuse(spark, tmpdir_path):
    path = tmpdir_path + "/stage"
    first = jobs._save(spark.range(5), path, reuse=True)
    assert jobs.stage_exists(spark, path) and first.count() == 5
    # present and complete: read back, not recomputed from the new input
    assert jobs._save(spark.range(7), path, reuse=True).count() == 5
    assert jobs._save(spark.range(7), path, reuse=False).count() == 7
