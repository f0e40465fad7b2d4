"""Toxicity by non-negative positive-unlabelled (PU) learning.

Confirmed toxic texts are the positives; a sample of all training texts,
whatever their label, is the unlabelled set.  With the class prior p, losses
l(+), l(-) of a linear scorer and averages over the sets P and U, the risk is
    p * P[l(+)] + max(0, U[l(-)] - p * P[l(-)])
and a step that finds the second part negative climbs it instead, so the
unlabelled positives are not fitted as negatives.  The scorer reads word
presence (lower-cased words, hashed): every word in at least `LEAST` positives
that positives hold more often than the unlabelled by at least `Z` standard
errors.  There is no bound on the number of words; weights decay.

Scale: the classifier is fitted on the driver on a bounded sample
(`MAX_POSITIVE`, `MAX_UNLABELLED` texts, of which only hashed word numbers
travel); scoring is a map over all documents without a shuffle.

Defined results: null, empty and wordless texts have no features and get the
score of the bias alone; without any positive every score is 0; equal texts
have equal scores; repeated rows are scored each.  Other columns of the input
are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.llm.folds import thin
from linkgraph.llm.text import chunks, in_small_batches, words, ALNUM

MAX_POSITIVE = 4_000
MAX_UNLABELLED = 12_000
DIMS = 1 << 20
LEAST = 3  # positives that hold a feature
Z = 3.0


@dataclass
class Model:
    features: np.ndarray  # sorted hashed words
    weights: np.ndarray
    bias: float


def word_sets(buf, offs) -> tuple[np.ndarray, np.ndarray]:
    """(text, hashed word) pairs, each once, in order of text."""
    w = words(buf, offs, ALNUM, lower=True)
    key = np.unique(w.doc().astype(np.int64) * DIMS + (w.hash % np.uint64(DIMS)).astype(np.int64))
    return key // DIMS, key % DIMS


def _collect_sets(rows: DataFrame) -> list[np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in chunks(batches, "text"):
            d, h = word_sets(buf, offs)
            cut = np.searchsorted(d, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(
                pa.array(cut, pa.int32()), pa.array(h, pa.int32()))], names=["words"])
    got = rows.select("text").mapInArrow(run, "words array<int>").toArrow().column(0)
    sets = {np.asarray(x.values, np.int32).tobytes() for x in got}
    return [np.frombuffer(x, np.int32) for x in sorted(sets)]  # equal texts once


@dataclass
class Presence:
    """A 0/1 matrix with a last column of ones, by the places of its ones."""
    row: np.ndarray
    col: np.ndarray
    shape: tuple[int, int]

    @staticmethod
    def of(sets: list[np.ndarray], chosen: np.ndarray) -> Presence:
        size = np.array([len(x) for x in sets])
        word = np.concatenate(sets).astype(np.int64)
        row = np.repeat(np.arange(len(sets)), size)
        col = np.full(DIMS, -1)
        col[chosen] = np.arange(len(chosen))
        keep = col[word] >= 0
        return Presence(row[keep], col[word[keep]], (len(sets), len(chosen) + 1))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.shape[0]) + w[-1]

    def sums(self, g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.col, g[self.row], self.shape[1] - 1), g.sum())


def nnpu(p: Presence, u: Presence, prior: float, steps: int = 300, rate: float = 0.1,
         decay: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear scorer by full-batch Adam on the PU risk."""
    n_p, n_u = p.shape[0], u.shape[0]
    w = np.zeros(p.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    w[-1] = -2.0
    for t in range(1, steps + 1):
        fp, fu = p.dot(w), u.dot(w)
        sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        g_pos = p.sums(sp - 1) * (prior / n_p)          # of prior * P[l(+)]
        g_neg = u.sums(su) / n_u - p.sums(sp) * (prior / n_p)
        neg = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        g = g_pos + g_neg if neg >= 0 else -g_neg
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    if not positive or not unlabelled:
        return Model(np.zeros(0, np.int64), np.zeros(0), -np.inf)
    n_p, n_u = len(positive), len(unlabelled)
    df_p = np.bincount(np.concatenate(positive), minlength=DIMS)
    df_u = np.bincount(np.concatenate(unlabelled), minlength=DIMS)
    both = (df_p + df_u) / (n_p + n_u)
    error = np.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u))
    chosen = np.flatnonzero((df_p >= LEAST) & (df_p / n_p - df_u / n_u > Z * error))
    w, b = nnpu(Presence.of(positive, chosen), Presence.of(unlabelled, chosen), prior)
    return Model(chosen.astype(np.int64), w, b)


def learn(docs: DataFrame, labels: DataFrame, seed: int = 3) -> Model:
    """From training rows: docs (doc_id, text), labels (doc_id, toxic).  The
    class prior is the share of toxic rows among the labelled ones."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    n = known.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("toxic") == 1).alias("toxic")).first()
    if not n["toxic"]:
        return fit([], [], 0.0)
    text = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    ids = thin(known.where(F.col("toxic") == 1), n["toxic"], MAX_POSITIVE, seed).select("doc_id").distinct()
    pos = text.join(F.broadcast(ids), "doc_id", "left_semi")  # at most about MAX_POSITIVE ids
    unl = thin(text, docs.select("doc_id").count(), MAX_UNLABELLED, seed + 1)
    return fit(_collect_sets(pos), _collect_sets(unl), n["toxic"] / n["all"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """row (the document's columns), score double."""
    held = in_small_batches(docs).sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row.text").alias("_text"))
    schema = rows.select("row", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        dense = np.zeros(DIMS)
        dense[m.features] = m.weights
        for part, buf, offs in chunks(batches, "_text"):
            d, h = word_sets(buf, offs)
            f = np.bincount(d, dense[h], minlength=part.num_rows) + m.bias
            s = 1 / (1 + np.exp(-np.clip(f, -700, 700)))
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(s)], names=schema.names)

    return rows.mapInArrow(run, schema)
