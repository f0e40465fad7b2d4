"""Document quality by a linear-chain conditional random field over lines.

Every line with a word gets the label good or bad.  Its own features and
those of the lines before and after it (bucketed shape, repetition and
character shares) score the label; a 2x2 transition ties neighbours.  The
forward-backward marginals of good, weighted by line length, average into the
document's quality, which a monotone map fitted on the training documents
brings to a score with the decision at `DECISION`.

Training labels exist for documents only: at first every line takes its
document's label; then the lines of bad documents that the first model finds
clearly good become good (the worst line stays bad), and the field is fitted
again.

Scale: fitted on the driver on a bounded sample (`MAX_BAD`, `MAX_GOOD`
documents, of which only bucket numbers of lines travel); scoring is a map
over all documents without a shuffle.  Whole texts take part.

Defined results: a null text, or one without a word, has no line and scores
0; without training documents of both kinds every score is that of no
evidence (0.5); equal texts score equally.  Other columns of the input are
kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.llm.folds import thin
from linkgraph.llm.text import chunks, in_small_batches, prefix_hash, range_hash, words, SPACE

MAX_BAD = 4_000
MAX_GOOD = 8_000
DECISION = 0.7

# Fixed bucket edges of shares, and of counts of words and mean word length.
SHARE_EDGES = np.array([1e-9, 0.02, 0.05, 0.1, 0.2, 0.35, 0.6, 0.85])
COUNT_EDGES = np.array([2, 4, 8, 16, 32, 64, 128, 256])
LENGTH_EDGES = np.array([2, 3, 4, 5, 6, 8, 11, 16])
BUCKETS = 9

_B = np.arange(256)
_UPPER = (_B >= 0x41) & (_B <= 0x5A)
_LETTER = _UPPER | ((_B >= 0x61) & (_B <= 0x7A)) | (_B >= 0x80)
_DIGIT = (_B >= 0x30) & (_B <= 0x39)
_PLAIN = np.isin(_B, list(b".,;:'\"-()?"))
_SYMBOL = SPACE & ~_LETTER & ~_DIGIT & ~_PLAIN
FEATURES = ("symbols", "upper", "digits", "plain marks", "adjacent repeats", "known phrases", "distinct words",
            "short words", "words", "word length", "marked ends", "copied line")
K = len(FEATURES)


@dataclass
class Lines:
    first: np.ndarray    # document i has the lines first[i]:first[i + 1]
    size: np.ndarray     # bytes of each line
    bucket: np.ndarray   # (lines, K) bucket numbers


def lines(buf: np.ndarray, offs: np.ndarray) -> Lines:
    """The lines with a word, and their bucketed features."""
    n_docs = len(offs) - 1
    w = words(buf, offs, SPACE)
    if not len(w.start):
        return Lines(np.zeros(n_docs + 1, np.int64), np.zeros(0), np.zeros((0, K), np.uint8))
    brk = np.flatnonzero(buf == 0x0A)
    doc = w.doc()
    mark = np.searchsorted(brk, w.start) + doc  # grows by line and by document
    new = np.concatenate([[True], mark[1:] != mark[:-1]])
    at = np.flatnonzero(new)                    # first word of each line
    line = np.cumsum(new) - 1
    n = len(at)
    count = np.diff(np.append(at, len(mark)))
    start, end = w.start[at], w.end[at + count - 1]
    size = (end - start).astype(np.float64)

    def share(table: np.ndarray, of=None) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(table[buf])])
        return (c[end] - c[start]) / np.maximum(1, size if of is None else of)

    def mean(flag: np.ndarray) -> np.ndarray:
        return np.bincount(line, flag, minlength=n) / count

    letters = np.maximum(1, share(_LETTER) * size)
    same = np.zeros(len(mark), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & ~new[1:]
    # words that begin a 3-word phrase seen elsewhere in their document
    h = prefix_hash(w.hash)
    i = np.arange(max(0, len(mark) - 2))
    i = i[doc[i] == doc[i + 2]]
    phrase = range_hash(h, i, i + 3) + doc[i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, back, times = np.unique(phrase, return_inverse=True, return_counts=True)
    known = np.zeros(len(mark), bool)
    known[i] = times[back] > 1
    pair = np.unique(w.hash + line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)[1]
    distinct = np.bincount(line[pair], minlength=n) / count
    length = (w.end - w.start).astype(np.float64)
    ends = _SYMBOL[buf[w.end - 1]]
    whole = range_hash(h, at, at + count) + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, back, times = np.unique(whole, return_inverse=True, return_counts=True)
    columns = [np.digitize(x, SHARE_EDGES) for x in (
        share(_SYMBOL), share(_UPPER, letters), share(_DIGIT), share(_PLAIN), mean(same), mean(known), distinct,
        mean(length <= 3))]
    columns += [np.digitize(count, COUNT_EDGES), np.digitize(mean(length), LENGTH_EDGES),
                np.digitize(mean(ends), SHARE_EDGES), (times[back] > 1) * 1]
    docs_of = doc[at]
    return Lines(np.searchsorted(docs_of, np.arange(n_docs + 1)), size, np.stack(columns, 1).astype(np.uint8))


def indices(x: Lines) -> np.ndarray:
    """(lines, 3K) weight numbers: own, previous and next line (or none)."""
    own = x.bucket.astype(np.int64) + np.arange(K) * (BUCKETS + 1)
    none = BUCKETS + np.arange(K) * (BUCKETS + 1)
    prev, nxt = np.empty_like(own), np.empty_like(own)
    prev[1:], nxt[:-1] = own[:-1], own[1:]
    begin, stop = x.first[:-1], x.first[1:]
    some = stop > begin
    prev[begin[some]] = none
    nxt[stop[some] - 1] = none
    block = K * (BUCKETS + 1)
    return np.hstack([own, prev + block, nxt + 2 * block])


N_WEIGHTS = 3 * K * (BUCKETS + 1)


@dataclass
class Model:
    weights: np.ndarray   # of the label good
    start: float          # of good at the first line
    trans: np.ndarray     # 2x2 log potentials, [from, to], bad 0 and good 1
    cut: float = 0.5      # quality that maps to DECISION


def marginals(first: np.ndarray, emit: np.ndarray, start: float, trans: np.ndarray) \
        -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, expected transition counts, and the summed log
    partition, by forward-backward over all documents side by side."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    length, begin = length[order], first[:-1][order]
    n = len(emit)
    top = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(1, top + 1), side="right") if top else np.zeros(0, int)
    psi = np.exp(np.stack([np.zeros(n), np.clip(emit, -30, 30)], 1))
    t = np.exp(trans)
    alpha, beta, scale = np.ones((n, 2)), np.ones((n, 2)), np.ones(n)
    for k in range(top):
        at = begin[: active[k]] + k
        a = psi[at] * (np.array([1.0, np.exp(start)]) if k == 0 else alpha[at - 1] @ t)
        s = a.sum(1)
        alpha[at], scale[at] = a / s[:, None], s
    counts = np.zeros((2, 2))
    for k in range(top - 2, -1, -1):
        at = begin[: active[k + 1]] + k
        nxt = psi[at + 1] * beta[at + 1] / scale[at + 1][:, None]
        counts += alpha[at].T @ nxt * t
        beta[at] = nxt @ t.T
    good = alpha * beta
    return good[:, 1] / good.sum(1), counts, float(np.log(scale).sum())


def fit_field(x: Lines, label: np.ndarray, steps: int = 80, rate: float = 0.15, decay: float = 2e-4) -> Model:
    """Penalised maximum likelihood of line labels by full-batch Adam."""
    idx = indices(x)
    theta = np.zeros(N_WEIGHTS + 5)  # weights, start, transitions
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    has = x.first[:-1][np.diff(x.first) > 0]
    inner = np.ones(len(label), bool)
    inner[has] = False
    pair = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[pair - 1], label[pair]), 1)
    target = np.bincount(idx.ravel(), np.repeat(label, idx.shape[1]), minlength=N_WEIGHTS)
    for step in range(1, steps + 1):
        emit = theta[idx].sum(1)
        good, counts, _ = marginals(x.first, emit, theta[N_WEIGHTS], theta[-4:].reshape(2, 2))
        g = np.concatenate([np.bincount(idx.ravel(), np.repeat(good, idx.shape[1]), minlength=N_WEIGHTS) - target,
                            [good[has].sum() - label[has].sum()], (counts - seen).ravel()]) / max(1, len(label))
        g += decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Model(theta[:N_WEIGHTS], float(theta[N_WEIGHTS]), theta[-4:].reshape(2, 2))


def quality(model: Model, x: Lines) -> np.ndarray:
    """Length-weighted mean P(good) of each document (nan without a line)."""
    doc = np.repeat(np.arange(len(x.first) - 1), np.diff(x.first))
    if not len(doc):
        return np.full(len(x.first) - 1, np.nan)
    good = marginals(x.first, model.weights[indices(x)].sum(1), model.start, model.trans)[0]
    weight = np.bincount(doc, x.size, minlength=len(x.first) - 1)
    with np.errstate(invalid="ignore"):
        return np.bincount(doc, x.size * good, minlength=len(weight)) / weight


def fit(x: Lines, doc_label: np.ndarray) -> Model:
    doc = np.repeat(np.arange(len(doc_label)), np.diff(x.first))
    if not len(doc) or doc_label.min() == doc_label.max():
        return Model(np.zeros(N_WEIGHTS), 0.0, np.zeros((2, 2)))
    label = doc_label[doc]
    model = fit_field(x, label)
    good = marginals(x.first, model.weights[indices(x)].sum(1), model.start, model.trans)[0]
    worst = np.full(len(doc_label), np.inf)
    np.minimum.at(worst, doc, good)
    label = np.where((label == 0) & (good > 0.8) & (good > worst[doc]), 1, label)
    model = fit_field(x, label)
    q = quality(model, x)
    use = ~np.isnan(q)
    q, y = q[use], doc_label[use]
    order = np.argsort(q, kind="stable")
    q, y = q[order], y[order]
    # right decisions when the cut lies just above q[i]
    right = np.cumsum(y == 0) + (y == 1).sum() - np.cumsum(y == 1)
    right = np.where(np.append(q[1:] != q[:-1], True), right, -1)
    i = int(right.argmax())
    model.cut = float((q[i] + q[min(i + 1, len(q) - 1)]) / 2)
    return model


def to_score(model: Model, q: np.ndarray) -> np.ndarray:
    cut = min(max(model.cut, 1e-6), 1 - 1e-6)
    low = DECISION * q / cut
    high = DECISION + (1 - DECISION) * (q - cut) / (1 - cut)
    return np.where(np.isnan(q), 0.0, np.clip(np.where(q < cut, np.minimum(low, DECISION - 1e-9), high), 0, 1))


def learn(docs: DataFrame, labels: DataFrame, seed: int = 6) -> Model:
    """From training rows: docs (doc_id, text), labels (doc_id, quality)."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    n = known.agg(F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality") == 1).alias("good"))
    n = n.first()
    ids = thin(known.where("quality = 0"), n["bad"], MAX_BAD, seed).unionByName(
        thin(known.where("quality = 1"), n["good"], MAX_GOOD, seed))
    ids = ids.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))  # at most about the two bounds
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(ids), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in chunks(batches, "text"):
            x = lines(buf, offs)
            cut = pa.array(x.first, pa.int32())
            wide = pa.array(x.first * K, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("label"), pa.ListArray.from_arrays(cut, pa.array(x.size)),
                 pa.ListArray.from_arrays(wide, pa.array(x.bucket.ravel().astype(np.int8)))],
                names=["doc_id", "label", "size", "bucket"])

    got = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "label", "text").mapInArrow(
        run, "doc_id string, label int, size array<double>, bucket array<byte>").orderBy("doc_id", "size").toArrow()
    size, bucket = got.column("size").combine_chunks(), got.column("bucket").combine_chunks()
    first = np.concatenate([[0], np.cumsum(np.asarray(size.value_lengths(), np.int64))])
    flat = np.asarray(bucket.flatten(), np.uint8).reshape(-1, K)
    return fit(Lines(first, np.asarray(size.flatten(), np.float64), flat),
               np.asarray(got.column("label").combine_chunks(), np.int64)) if len(got) else \
        Model(np.zeros(N_WEIGHTS), 0.0, np.zeros((2, 2)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """row (the document's columns), score double."""
    held = in_small_batches(docs).sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row.text").alias("_text"))
    schema = rows.select("row", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for part, buf, offs in chunks(batches, "_text"):
            s = to_score(m, quality(m, lines(buf, offs)))
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(s)], names=schema.names)

    return rows.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents at or above the decision, with their own columns."""
    return score(docs, model).where(F.col("score") >= DECISION).select("row.*")
