"""Connected components of an undirected edge table, as Spark joins.

Each round every vertex takes the neighbour (or itself) of smallest hashed id
as its parent, and edges move to the parents of their ends; edges inside one
parent go.  The hashed order makes a round shrink any graph, long paths too,
by a constant factor on average.  When no edge is left, the parents of later
rounds are looked up in those of earlier ones.  Rounds are written tables, so
a lost executor re-reads files; nothing of the graph reaches the driver but
row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.sources.store import drop_stage, materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for every id in the columns a, b of `edges` (bigint) the
    smallest id reachable.  Loops and repeated edges do no harm."""
    e = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                    .distinct(), "cc-edges")
    levels = []
    while not e.isEmpty():
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("id")))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("id"))
        m = both.groupBy("a").agg(best.alias("m")).select(F.col("a").alias("id"), F.least("m", own)["id"].alias("up"))
        m = materialize(m, "cc-parents")
        levels.append(m)
        moved = (e.join(m.select(F.col("id").alias("a"), F.col("up").alias("pa")), "a")
                 .join(m.select(F.col("id").alias("b"), F.col("up").alias("pb")), "b").where("pa <> pb"))
        new = materialize(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(),
                          "cc-edges")
        drop_stage(e)
        e = new
    if not levels:
        return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    root = levels[-1]
    for m in reversed(levels[:-1]):
        root = m.join(root.select(F.col("id").alias("up"), F.col("up").alias("upper")), "up", "left") \
            .select("id", F.coalesce("upper", "up").alias("up"))
    root = materialize(root, "cc-roots")
    for old in [e, *levels]:
        drop_stage(old)
    small = root.groupBy("up").agg(F.min("id").alias("component"))
    return root.join(small, "up").select("id", "component")
