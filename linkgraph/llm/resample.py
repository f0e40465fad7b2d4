"""Importance resampling towards a target text distribution.

Texts are bags of hashed word n-grams.  `bucket_counts` counts every bucket in the
corpus and in the target texts; a bucket's gain is the smoothed log ratio of the two,
in thousandths.  A document's weight is the floored mean gain of its features (one
array lookup a feature), its score adds Gumbel noise drawn from a hash of its id, so
that the highest scores are a sample without replacement by weight, the same in every
run.  `cut` finds how far the highest `percent` of the documents reaches by numeric
bisection: jobs that count exactly, over the written scores, what lies above trial
values, until one value is left; ties on it are cut the same way by doc_id, and full
ties by row.  The drawn rows alone are then range-partitioned by that order and numbered.

Rows: a null text has no features, weight 0; a null doc_id hashes as '' and comes
last among ties.  Rows that share a doc_id draw the same noise and are ranked each
for itself.  Empty tables give an empty result; with no target texts the gains are
those of t = T = 0.  Other columns are not looked at.  A text of any length is
handled whole, one at a time beside its chunk.

Scale: two scans of the texts, none shuffled; each task adds up one array of
`buckets` counts, and the driver holds the two arrays.  What is written per document
is five numbers.  A job of the bisection reads one narrow column, only between the
last two trial values; `PROBES` values a job make it four halvings.  No single task
sorts or holds more than a range of the drawn rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkgraph.llm.text import in_small_batches
from linkgraph.sources.store import materialize

BUCKETS = 10_000
SCALE = 1_000
PROBES = 15
ROWS_PER_RANGE = 100_000
MAX_RANGES = 10_000
LOCAL = 33  # bits of monotonically_increasing_id that number the rows of a partition

# Fixed byte classes: lower-case A-Z, then [\x00-\x2F\x3A-\x60\x7B-\x7F] separates.
_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80
                  else 0x20 for b in range(256))


def features(text: str | None, longest: int, buckets: int) -> tuple[int, np.ndarray]:
    """(number of words, bucket of each feature) of one text."""
    words = (text or "").encode().translate(_TO_WORDS).split()
    found = [np.fromiter(map(zlib.crc32, words), np.int64, len(words))]
    for n in range(2, longest + 1):
        runs = [b" ".join(words[i: i + n]) for i in range(len(words) - n + 1)]
        found.append(np.fromiter(map(zlib.crc32, runs), np.int64, len(runs)))
    return len(words), np.concatenate(found) % buckets


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in the column `text`: `buckets` numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                n += np.bincount(features(text.as_py(), longest, buckets)[1], minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    parts = in_small_batches(texts.select(texts["text"])).mapInArrow(run, "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of the smoothed bucket shares), in doubles."""
    b, all_source, all_target = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(SCALE * math.log((t + 1.0) * (all_source + b) / ((s + 1.0) * (all_target + b))))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, longest: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight), one row per document."""
    buckets = len(gains)
    own = in_small_batches(docs.select(docs["doc_id"], docs["text"]))
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                n, at = features(text.as_py(), longest, buckets)
                rows.append((n, len(at), int(gains[at].sum()) // len(at) if len(at) else 0))
            cols = np.array(rows, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols)],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    return own.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256('<seed>:<doc_id>')."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(float(-SCALE)) * F.log(-F.log(u))).cast("bigint")


def highest(rows: DataFrame, column: str, want: int) -> tuple[int, int]:
    """(v, n above v): the largest v of the BIGINT `column` with at least `want`
    rows at or above it, and how many lie above.  `rows` has at least `want` >= 1
    rows and is counted once a job."""
    ends = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    lo, hi, above = ends["lo"], ends["hi"], 0  # v is in lo .. hi, `above` rows exceed hi
    while lo < hi:
        step = -(-(hi - lo) // (PROBES + 1))
        trial = list(range(lo + step, hi + 1, step))
        inside = rows.where((F.col(column) >= lo + step) & (F.col(column) <= hi))
        counts = inside.agg(*[F.count(F.when(F.col(column) >= t, 1)).alias(f"n{i}") for i, t in enumerate(trial)]).first()
        n = [above + c for c in counts]
        met = [i for i in range(len(trial)) if n[i] >= want]
        if met:
            lo = trial[met[-1]]
        missed = [i for i in range(len(trial)) if n[i] < want]
        if missed:
            hi, above = trial[missed[0]] - 1, n[missed[0]]
    return lo, above


def cut(rows: DataFrame, order: list[str], want: int) -> Column:
    """A condition true for the `want` first rows by the BIGINT columns `order`, all
    descending; the last column is distinct.  `rows` is a written table."""
    if want <= 0:
        return F.lit(False)
    steps, tied = [], []
    for column in order:
        here = rows.where(reduce(lambda a, b: a & b, tied)) if tied else rows
        value, above = highest(here, column, want)
        steps.append(reduce(lambda a, b: a & b, [*tied, F.col(column) > value]))
        tied.append(F.col(column) == value)
        want -= above
    steps.append(reduce(lambda a, b: a & b, tied))
    return reduce(lambda a, b: a | b, steps)


def numbered(rows: DataFrame, order: list[str], total: int) -> DataFrame:
    """`rows` with `rank`, 1, 2, 3 ... by `order` (descending, no ties)."""
    ranges = max(1, min(MAX_RANGES, -(-total // ROWS_PER_RANGE)))
    by = [F.desc(c) for c in order]
    placed = rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    placed = materialize(placed.withColumn("_at", F.monotonically_increasing_id()), "resample-drawn")
    placed = placed.withColumn("_range", F.shiftright("_at", LOCAL))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    out = placed.join(F.broadcast(sizes), "_range")  # at most MAX_RANGES rows
    place = F.col("_at").bitwiseAND(F.lit((1 << LOCAL) - 1))
    return out.withColumn("rank", F.col("_before") + place + 1).drop("_at", "_range", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1,
             buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """Every document's doc_id, n_words, n_features, weight, score and rank: the
    floor(percent * N / 100) highest scores of the N documents with at least `least_words`
    words have ranks 1, 2, 3 ..., ties to the smaller doc_id; the others null."""
    gains = bucket_gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    scored = weighted(docs, gains, longest).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    # ~id falls where id rises; a null id comes last, as does a later row
    first = F.coalesce(F.bitwise_not(F.col("doc_id").cast("bigint")), F.lit(-(1 << 63)))
    scored = scored.withColumn("_id", first).withColumn("_row", F.bitwise_not(F.monotonically_increasing_id()))
    scored = materialize(scored, "resample-scores")
    order = ["score", "_id", "_row"]
    able = scored.where(F.col("n_words") >= least_words)
    want = percent * able.count() // 100
    chosen = (F.col("n_words") >= least_words) & cut(able, order, want)
    drawn = numbered(scored.where(chosen), order, want)
    rest = scored.where(~chosen).withColumn("rank", F.lit(None).cast("bigint"))
    out = drawn.unionByName(rest)
    return out.select("doc_id", "n_words", "n_features", "weight", "score", F.col("rank").cast("bigint").alias("rank"))


def drawn_documents(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """The drawn documents' rows (all columns) with `rank`, joined on doc_id, which
    must be distinct here."""
    ranks = ranked.where(F.col("rank").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("rank").alias("_rank"))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["doc_id"].alias("_own"))
    return rows.join(ranks, F.col("_own") == F.col("_id")).select("row", F.col("_rank").alias("rank"))
