"""Mixing sources to target weights (DataFrame functions only).

`source_targets` measures every source and shares a budget of words by
weight: a target stops at `max_repeat` times its source's size and the excess
goes to the others by weight until none is above.  `plan` turns each source's
repetition rate (target / size) into whole copies of every document:
floor(rate) plus one hash-seeded Bernoulli copy with the fraction as its
probability.  `emit` repeats the rows.

Sizes are counts of the words `[^\\x20\\x09-\\x0D]+`; a null text has size 0.
A null source is a source of its own and comes last; the empty string is an
ordinary source.  The draw hashes doc_id (null as ''), so repeated rows of
one document get the same number of copies, and reruns agree.  A source of
size 0 has target 0 and no copies.  An empty table gives an empty result.
All columns of the input are kept by `emit`, whatever their names.

Scale: per-source sums are partial aggregates.  The table of sources has one
row per source and is ordered by windows in one task (a list of sources, not
of documents).  It is broadcast only while it has at most `BROADCAST_ROWS`
rows of names of bounded length; beyond that a salted join spreads each
source's documents, so that a source holding a third of all rows does not
meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkgraph.sources.store import materialize

BROADCAST_ROWS = 10_000
BROADCAST_NAME_BYTES = 8 << 20
SALT = 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def uniform(doc_id: Column, seed: int) -> Column:
    """A draw in [0, 1): the first 52 bits of md5('<seed>:<doc_id>')."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5,
                   max_repeat: float = 2.0) -> DataFrame:
    """(source, source_size, target) from one (source, size) row per document.

    Sources in code point order, null last, take `weights` in turn.  With caps
    c and weights w the targets are min(c, level * w); the level is the first
    (T - caps before) / (weights from here on), in order of c / w, that is not
    above its own c / w."""
    t = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    t = t.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn + 1))
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    t = t.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / F.sum("w").over(onward))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("k", "level"))
    t = t.withColumn("k", F.row_number().over(by_ratio))
    t = t.withColumn("fit", F.min(fits).over(everything)["level"])
    target = F.coalesce(F.least("cap", F.col("fit") * F.col("w")), F.col("cap"))
    return t.select("source", "source_size", target.alias("target"))


def _with_targets(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """`sized` (columns key, salt, ...) with its source's columns."""
    seen = targets.agg(F.count(F.lit(1)).alias("n"),
                       F.coalesce(F.sum(F.octet_length("source")), F.lit(0)).alias("bytes")).first()
    right = targets.withColumnRenamed("source", "t_source")
    same = F.col("source").eqNullSafe(F.col("t_source"))
    if seen["n"] <= BROADCAST_ROWS and seen["bytes"] <= BROADCAST_NAME_BYTES:
        return sized.join(F.broadcast(right), same).drop("t_source")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    right = right.select("*", salts.alias("t_salt"))
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALT)).cast("int"))
    return salted.join(right, same & (F.col("salt") == F.col("t_salt"))).drop("salt", "t_salt", "t_source")


def plan(docs: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, max_repeat: float = 2.0,
         seed: int = 17) -> DataFrame:
    """One row per document: row (its columns), doc_id, source, size, source_size,
    target, rate, copies, taken."""
    sized = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    sized = sized.select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"),
                         n_words(F.col("row.text")).alias("size"))
    targets = materialize(source_targets(sized.select("source", "size"), weights, share, max_repeat),
                          "mix-targets")
    out = _with_targets(sized, targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = out.withColumn("rate", rate)
    whole = F.floor("rate")
    extra = (uniform(F.col("doc_id"), seed) < F.col("rate") - whole).cast("bigint")
    out = out.withColumn("copies", whole + extra)
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def emit(planned: DataFrame) -> DataFrame:
    """The mixed corpus: each document's row `copies` times."""
    times = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    return planned.select("row", times.alias("_copy")).select("row.*")
