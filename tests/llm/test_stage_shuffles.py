"""A stage table is read back from its files: the shuffles of its write need not stay."""

import time

from pyspark.sql import functions as F

from linkgraph.sources.store import drop_stage, materialize


def test_a_stage_leaves_no_shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {n for n in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in n and n.endswith(".data")}
    had = shuffles()
    df = spark.range(2000).groupBy(F.pmod("id", F.lit(700)).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    out = materialize(df, "freed")
    until = time.time() + 20
    while shuffles() - had and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - had
    assert out.agg(F.sum("n")).first()[0] == 2000
    drop_stage(out)
