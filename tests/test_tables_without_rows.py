"""Stage tables without rows: written by buckets or partitions, read by their path."""

import pytest
from pyspark.sql import functions as F

from linkgraph.plans import jobs
from linkgraph.plans.queries import QUERIES
from linkgraph.sources import tables as TB

STATS = "p1 BIGINT, p2 BIGINT, max_common BIGINT, linked_pairs BIGINT, max_ratio_maxdeg DOUBLE, max_ratio_mindeg DOUBLE"


def test_pair_table_without_rows_is_read_by_its_path(spark, tmpdir_path):
    none = jobs._save_pairs(spark.createDataFrame([], STATS), tmpdir_path + "/none")
    back = spark.read.parquet(tmpdir_path + "/none")
    assert back.dtypes == none.dtypes == spark.createDataFrame([], STATS).dtypes and back.count() == 0
    assert jobs.stage_exists(spark, tmpdir_path + "/none")
    # it still meets a bucketed table by the pair
    some = jobs._save_pairs(spark.createDataFrame([(1, 2), (3, 4)], "p1 BIGINT, p2 BIGINT"), tmpdir_path + "/some")
    met = some.join(none, ["p1", "p2"], "left").select("p1", "p2", "max_common")
    assert sorted(map(tuple, met.collect())) == [(1, 2, None), (3, 4, None)]


def test_pair_table_with_rows_keeps_its_buckets(spark, tmpdir_path):
    some = jobs._save_pairs(spark.createDataFrame([(1, 2), (3, 4)], "p1 BIGINT, p2 BIGINT"), tmpdir_path + "/some")
    assert some._stage_table in {t.name for t in spark.catalog.listTables()}
    assert sorted(map(tuple, spark.read.parquet(tmpdir_path + "/some").collect())) == [(1, 2), (3, 4)]


@pytest.mark.parametrize("rows", [None, 0])
def test_candidates_without_rows_are_read_back(spark, tmpdir_path, rows):
    for schema in ("p1 BIGINT, p2 BIGINT, common_cnt BIGINT", "p1 BIGINT, p2 BIGINT, cell INT, cnt BIGINT"):
        none = spark.createDataFrame([], schema)
        TB.write_candidates(none, tmpdir_path + "/c", 11, rows)
        back = TB.read_candidates(spark, tmpdir_path + "/c")
        assert back.dtypes == none.dtypes and back.count() == 0
        assert TB.read_candidates(spark, tmpdir_path + "/c", 4).count() == 0


def test_job_twohop_where_no_pair_has_statistics(spark, tmpdir_path):
    """Friends are no users, but for one each that a single user names: candidates have
    common friends, none of whose pairs is a candidate."""
    friends = {u: {100 + (u * k + 7 * k * k) % 60 for k in range(1, 25)} for u in range(1, 41)}
    edges = [(u, f) for u, own in friends.items() for f in sorted(own)] + [(u, u + 1) for u in range(1, 40, 2)]
    spark.createDataFrame([(u, u) for u in friends], "o_orderkey BIGINT, o_custkey BIGINT").write.parquet(
        tmpdir_path + "/orders.parquet")
    spark.createDataFrame([(u, f, "A", float(f % 21)) for u, f in edges],
                          "l_orderkey BIGINT, l_partkey BIGINT, l_returnflag STRING, l_quantity DOUBLE").write.parquet(
        tmpdir_path + "/lineitem.parquet")
    spark.range(1, 41).select(F.col("id").alias("c_custkey"), (F.col("id") * 10).cast("double").alias("c_acctbal"),
                              F.lit("BUILDING").alias("c_mktsegment"), F.lit(1).alias("c_nationkey")).write.parquet(
        tmpdir_path + "/customer.parquet")
    spark.createDataFrame([(1, 1)], "n_nationkey INT, n_regionkey INT").write.parquet(tmpdir_path + "/nation.parquet")
    got = QUERIES["job_twohop"](spark, tmpdir_path)
    assert got.count() == 0
    assert got.columns == ["p1", "p2", "max_common", "linked_pairs", "max_ratio_maxdeg", "max_ratio_mindeg"]
    # the rest of the job is whole
    pairs = {(a, b) for a in friends for b in friends if a < b and len(friends[a] & friends[b]) > 1}
    found = QUERIES["job_candidates"](spark, tmpdir_path)
    assert {(r["p1"], r["p2"]) for r in found.collect()} == pairs
