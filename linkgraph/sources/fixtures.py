"""Graph views derived from the driver's TPC-H-like tables (FIXTURES.md B).

Users are customers, friends are part keys (same id space), an edge exists
when a customer ordered a part; its mask ORs one relation bit per line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgraph.functions.masks import MASK_BITS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def edges_from_orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """edges(user_id, friend_id, mask): one row per distinct (customer, part).

    Deduplicating with bit_or at ingest removes the duplicate-edge quirk of
    the reference (self pairs, double counts).  The aggregation is partial
    (map-side) first, so a customer with a huge share of lines is combined
    before the shuffle."""
    li = lineitem.select("l_orderkey", "l_partkey", "l_returnflag", "l_quantity")
    o = orders.select("o_orderkey", "o_custkey")
    bit = F.when(F.col("l_returnflag") == "N", F.lit(0).cast("bigint")).otherwise(
        F.pow(F.lit(2), F.pmod(F.floor("l_quantity").cast("int"), F.lit(MASK_BITS))).cast("bigint"))
    return (o.join(li, o.o_orderkey == li.l_orderkey)
            .groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("friend_id"))
            .agg(F.bit_or(bit).cast("bigint").alias("mask")))


def profile_from_customers(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """profile(user_id, birth_date, gender, location_id, login_region).

    The whole table; NULLs are kept, so the feature defaults are exercised.
    Customers without an order and friends that are no customers are unknown
    on one side of the joins."""
    c = customer.select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    n = nation.select("n_nationkey", "n_regionkey")
    return (c.join(n, c.c_nationkey == n.n_nationkey)
            .select(F.col("c_custkey").alias("user_id"),
                    F.when(F.col("c_acctbal") < 0, F.lit(None))
                     .otherwise(F.floor("c_acctbal")).cast("bigint").alias("birth_date"),
                    F.when(F.col("c_mktsegment") == "BUILDING", 1)
                     .when(F.col("c_mktsegment") == "MACHINERY", 2).otherwise(0).alias("gender"),
                    F.col("c_nationkey").alias("location_id"),
                    F.when(F.col("n_regionkey") == 0, F.lit(None))
                     .otherwise(F.col("n_regionkey")).cast("int").alias("login_region")))


class Fixture:
    """Lazy views of one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def edges(self) -> DataFrame:
        return edges_from_orders(self.table("orders"), self.table("lineitem"))

    def profile(self) -> DataFrame:
        return profile_from_customers(self.table("customer"), self.table("nation"))
