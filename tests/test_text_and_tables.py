"""Native layouts: parse edge cases and round trips."""

from pyspark.sql import functions as F

from linkgraph.sources import tables as TB
from linkgraph.sources import text as X


def lines(spark, items):
    return spark.createDataFrame([(s,) for s in items], "value STRING")


def test_adjacency_parse(spark):
    df = lines(spark, ["7\t{(1,0),(2,5), (3,1048576)}", "8\t{(1,2)}", "8\t{(1,1)}", "x\t{(1,1)}"])
    got = sorted(tuple(r) for r in X.parse_adjacency(df).collect())
    assert got == [(7, 1, 0), (7, 2, 5), (7, 3, 1048576), (8, 1, 3)]


def test_adjacency_roundtrip_chunks(spark, tmpdir_path):
    edges = spark.range(0, 2500).select(F.lit(1).cast("bigint").alias("user_id"),
                                        F.col("id").alias("friend_id"), (F.col("id") % 3).alias("mask"))
    out = X.render_adjacency(edges, chunk_items=1000)
    assert out.count() >= 3  # a big list is cut into bounded lines
    X.write_lines(out, tmpdir_path + "/adj")
    back = X.read_adjacency(spark, tmpdir_path + "/adj", chunked=True)
    assert back.count() == 2500 and back.exceptAll(edges).count() == 0
    # the native layout has one line per user, whatever its length
    assert X.render_adjacency(edges).count() == 1
    assert X.parse_adjacency(X.render_adjacency(edges)).exceptAll(edges).count() == 0


def test_rejects_are_counted(spark):
    df = lines(spark, ["7\t{(1,0),(z,5),(3,?)}", "x\t{(1,1)}", "9"])
    assert tuple(X.adjacency_rejects(df).first()) == (5, 3, 1)
    assert X.parse_adjacency(df).count() == 2
    pairs = lines(spark, ["(1,2)", "(3,x)", "", "nothing"])
    assert tuple(X.line_rejects(pairs, X.parse_pairs(pairs)).first()) == (3, 2)


def test_checkpoint_folder_must_be_shared_off_local_masters():
    import pytest

    from linkgraph.session import ensure_checkpoint_dir

    class Context:
        master = "spark://elsewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_stage_tables_are_removed(spark):
    import os

    from linkgraph.sources.store import drop_stage, materialize
    df = materialize(spark.range(3), "drop-me")
    path = df._stage_path.removeprefix("file:")
    assert os.path.isdir(path) and df.count() == 3
    drop_stage(df)
    assert not os.path.exists(path)


def test_demography_six_and_seven_columns(spark, tmpdir_path):
    X.write_lines(lines(spark, ["1\t100\t\t2\t5\t6", "2\t100\t1980\t1\t5\t7\t3", ""]), tmpdir_path + "/d", gzip=False)
    got = {r["user_id"]: r for r in X.read_demography(spark, tmpdir_path + "/d").collect()}
    assert got[1]["birth_date"] is None and got[1]["login_region"] is None and got[1]["location_id"] == 6
    assert got[2]["birth_date"] == 1980 and got[2]["login_region"] == 3


def test_ranked_lists_parse(spark):
    df = lines(spark, ["5\t9\t8", "", "0\t1\t2", "6"])
    got = [tuple(r) for r in X.parse_ranked_lists(df).orderBy("user_id", "rank").collect()]
    assert got == [(5, 1, 9), (5, 2, 8)]


def test_twohop_and_pairs_text(spark):
    th = spark.createDataFrame([(1, 2, 3, 1, 0.5, 0.25)],
                               "p1 BIGINT, p2 BIGINT, max_common BIGINT, linked_pairs BIGINT, "
                               "max_ratio_maxdeg DOUBLE, max_ratio_mindeg DOUBLE")
    line = X.render_twohop(th).first()["value"]
    assert line == "((1,2),(3,1,0.5,0.25))"
    back = X.parse_twohop(X.render_twohop(th)).first()
    assert tuple(back) == (1, 2, 3.0, 1.0, 0.5, 0.25)
    pairs = spark.createDataFrame([(1, 2), (3, 4)], "p1 BIGINT, p2 BIGINT")
    assert [r["value"] for r in X.render_pairs(pairs).collect()] == ["(3,4)", "(1,2)"]
    assert sorted(tuple(r) for r in X.parse_pairs(X.render_pairs(pairs)).collect()) == [(1, 2), (3, 4)]


def test_candidate_buckets_and_older_hist_layout(spark, tmpdir_path):
    c = spark.createDataFrame([(33, 40, 2), (140, 150, 3), (1, 2, 9)], "p1 BIGINT, p2 BIGINT, common_cnt BIGINT")
    TB.write_candidates(c, tmpdir_path + "/c", 107)
    assert sorted(tuple(r) for r in TB.read_candidates(spark, tmpdir_path + "/c", bucket=33).collect()) == \
        [(33, 40, 2), (140, 150, 3)]
    old = spark.createDataFrame([((1, 2), [1, 0, 2])], "_1 STRUCT<_1: INT, _2: INT>, _2 ARRAY<SMALLINT>")
    old.write.parquet(tmpdir_path + "/h")
    r = TB.read_hist_vectors(spark, tmpdir_path + "/h").first()
    assert (r["p1"], r["p2"], r["hist"]) == (1, 2, [1.0, 0.0, 2.0])
