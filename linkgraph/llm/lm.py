"""Language-model scoring with a log-bilinear model trained by noise-contrastive
estimation (NCE).

Tokens are the lower-cased (A-Z) words `[^\\x20\\x09-\\x0D]+` of a text, then
one end.  Each token has a class: the `TOP` most frequent training tokens and
the end are classes of their own, any other token falls into one of `SUFFIXES`
classes by its last two bytes.  The model gives the class from the two tokens
before it,
    p(class | c1, c2) = exp((r1[c1] + r2[c2]) . q[class] + b[class]) / Z(c1, c2),
and a token in a shared class gets the discounted share (c - d) / n of its
class, an unknown token the mass that the discounts of its class have freed.
Z comes from one product of two matrices for all contexts, so probabilities
over all known tokens and one unknown token for each class sum to 1.

Counts of tokens and of class trigrams are taken over all training texts
(partial sums in each task, then a shuffle by key).  NCE runs over the whole
trigram table in `WORKERS` partitions, each from the parameters so far; their
results are averaged on the driver (`WORKERS` small matrices a round).

Scale: a task holds the table of tokens with at least `tau` occurrences, tau
chosen so that at most `TABLE` tokens qualify; the counts of rarer tokens come
by a join on the token, per document and distinct token.  Nothing that grows
with the corpus is collected or broadcast.

Defined results: a null or empty text is just the end token; repeated rows are
scored each; without training texts every token is unknown (base 0).  Columns
of the input are kept in `row`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.llm.text import SPACE, Words, chunks, in_small_batches, mix, words
from linkgraph.sources.store import materialize

TOP = 768            # tokens with a class of their own
CONTEXT = 128        # of these, the ones that keep their identity as context
SUFFIXES = 64
DIM = 32
TABLE = 1 << 18
WORKERS = 12
ROUNDS = 4
BATCH = 512
NOISE = 256
END = np.uint64(1)   # hash of the end token
CLASSES = TOP + SUFFIXES + 1
CONTEXTS = CONTEXT + SUFFIXES + 1  # the last one stands before the text
FLUSH = 3 << 20


def stream(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, suffix class, first token of each text) with one end per text."""
    w: Words = words(buf, offs, SPACE, lower=True)
    n = len(offs) - 1
    place = np.arange(len(w.hash)) + w.doc()
    h = np.full(len(w.hash) + n, END, np.uint64)
    h[place] = w.hash
    suffix = np.zeros(len(h), np.int64)
    if len(w.hash):
        last = w.buf[w.end - 1].astype(np.uint64)
        second = np.where(w.end - w.start > 1, w.buf[np.maximum(w.end - 2, 0)], 0).astype(np.uint64)
        suffix[place] = (mix(last * np.uint64(256) + second + np.uint64(1)) % np.uint64(SUFFIXES)).astype(np.int64)
    return h, suffix, w.first + np.arange(n + 1)


def _sums(pending: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate([x for x, _ in pending])
    n = np.concatenate([x for _, x in pending])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[head], np.add.reduceat(n, head) if len(key) else n


def counted(rows: DataFrame, keys, broadcast=None) -> DataFrame:
    """(key long, n long): how often `keys(buf, offs, held)` has each key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = broadcast.value if broadcast is not None else None
        pending, size = [], 0

        def out(key, n):
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])
        for _, buf, offs in chunks(batches, "text"):
            key, n = np.unique(keys(buf, offs, held), return_counts=True)
            pending.append((key.astype(np.uint64), n.astype(np.int64)))
            size += len(key)
            if size > FLUSH:
                pending = [_sums(pending)]
                size = len(pending[0][0])
                if size > FLUSH // 2:
                    yield out(*pending[0])
                    pending, size = [], 0
        if pending:
            yield out(*_sums(pending))
    return rows.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def token_keys(buf, offs, _):
    """The token's hash, its lowest bits replaced by the suffix class."""
    h, suffix, _ = stream(buf, offs)
    return tagged(h, suffix)


def tagged(h: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    return (h & ~np.uint64(SUFFIXES - 1)) | suffix.astype(np.uint64)


END_KEY = int(tagged(np.array([END]), np.array([0]))[0])


@dataclass
class Vocabulary:
    keys: np.ndarray       # sorted keys of the frequent tokens
    count: np.ndarray
    klass: np.ndarray      # class of each
    tau: int               # they are all tokens with at least tau occurrences
    tokens: int            # N
    types: int             # V
    mass: np.ndarray       # occurrences of each class
    kinds: np.ndarray      # distinct tokens of each suffix class
    discount: float

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, or 0 if not in the table; class) of each key."""
        klass = TOP + (key & np.uint64(SUFFIXES - 1)).astype(np.int64)
        if not len(self.keys):
            klass[key == np.uint64(END_KEY)] = CLASSES - 1
            return np.zeros(len(key), np.int64), klass
        uniq, back = np.unique(key, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, uniq), len(self.keys) - 1)
        there = self.keys[at] == uniq
        count = np.where(there, self.count[at], 0)[back]
        known = there[back]
        klass[known] = self.klass[at][back][known]
        klass[key == np.uint64(END_KEY)] = CLASSES - 1
        return count, klass

    def within(self, count: np.ndarray, klass: np.ndarray) -> np.ndarray:
        """ln of a token's share of its class."""
        n = self.mass[klass]
        share = np.where(count > 0, count - self.discount, self.discount * self.kinds[klass])
        shared = (klass >= TOP) & (klass < CLASSES - 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.log(share / n)
        return np.where(shared & (n > 0), out, 0.0)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (self.tokens + 0.1 * (self.types + 1)))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From the (key, n) table of the training tokens."""
    bucket = F.floor(F.log2("n") * 8).cast("int")
    hist = counts.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("low"))
    tau, room = 1, TABLE
    for r in sorted(hist.collect(), key=lambda r: -r["b"]):  # at most 8 * 64 rows
        if r["k"] > room:
            break
        room -= r["k"]
        tau = r["low"]
    else:
        tau = 1
    per = counts.groupBy(F.col("key").bitwiseAND(F.lit(SUFFIXES - 1)).alias("s")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.count_if(F.col("n") == 1).alias("n1"),
        F.count_if(F.col("n") == 2).alias("n2")).collect()
    got = counts.where(F.col("n") >= tau).toArrow()  # at most TABLE rows
    key = np.asarray(got.column("key").combine_chunks(), np.int64).view(np.uint64)
    n = np.asarray(got.column("n").combine_chunks(), np.int64)
    order = np.argsort(key)
    key, n = key[order], n[order]
    suffix = (key & np.uint64(SUFFIXES - 1)).astype(np.int64)
    klass = TOP + suffix
    end = key == np.uint64(END_KEY)
    rank = np.lexsort((key, -n))
    rank = rank[~end[rank]][:TOP]
    klass[rank] = np.arange(len(rank))
    klass[end] = CLASSES - 1
    mass, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in per:
        mass[TOP + r["s"]], kinds[TOP + r["s"]] = r["n"], r["k"]
    own = np.append(rank, np.flatnonzero(end))
    np.subtract.at(mass, TOP + suffix[own], n[own])
    np.subtract.at(kinds, TOP + suffix[own], 1)
    mass[klass[own]] = n[own]
    n1, n2 = sum(r["n1"] for r in per), sum(r["n2"] for r in per)
    discount = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5
    return Vocabulary(key, n, klass, int(tau), int(sum(r["n"] for r in per)), int(sum(r["k"] for r in per)),
                      mass, kinds, discount)


def context_classes(key: np.ndarray, klass: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(c1, c2) of every token; a frequent token beyond CONTEXT counts by suffix."""
    suffix = (key & np.uint64(SUFFIXES - 1)).astype(np.int64)
    own = np.where(klass < CONTEXT, klass, CONTEXT + suffix)
    c1, c2 = np.full(len(own), CONTEXTS - 1), np.full(len(own), CONTEXTS - 1)
    place = np.arange(len(own)) - np.repeat(first[:-1], np.diff(first))
    c1[1:] = np.where(place[1:] >= 1, own[:-1], CONTEXTS - 1)
    c2[2:] = np.where(place[2:] >= 2, own[:-2], CONTEXTS - 1)
    return c1, c2


def trigram_keys(buf, offs, vocab: Vocabulary):
    h, suffix, first = stream(buf, offs)
    key = tagged(h, suffix)
    _, klass = vocab.find(key)
    c1, c2 = context_classes(key, klass, first)
    return (c2 * CONTEXTS + c1) * CLASSES + klass


@dataclass
class Parameters:
    r1: np.ndarray
    r2: np.ndarray
    q: np.ndarray
    b: np.ndarray

    def pack(self) -> bytes:
        return b"".join(x.astype(np.float32).tobytes() for x in (self.r1, self.r2, self.q, self.b))

    @staticmethod
    def unpack(data: bytes) -> Parameters:
        x = np.frombuffer(data, np.float32).astype(np.float64)
        cut = np.cumsum([CONTEXTS * DIM, CONTEXTS * DIM, CLASSES * DIM])
        r1, r2, q, b = np.split(x, cut)
        return Parameters(r1.reshape(-1, DIM), r2.reshape(-1, DIM), q.reshape(-1, DIM), b)


def start(vocab: Vocabulary, seed: int) -> Parameters:
    rng = np.random.default_rng(seed)
    b = np.log((vocab.mass + 0.5) / (vocab.mass.sum() + 0.5 * CLASSES))
    return Parameters(*(rng.normal(0, 0.1, (n, DIM)) for n in (CONTEXTS, CONTEXTS, CLASSES)), b)


class Nce:
    """Minibatch NCE with Adagrad; noise words are shared by a minibatch."""

    def __init__(self, p: Parameters, noise: np.ndarray, seed: int, rate: float = 0.3):
        self.p = Parameters(*(x.copy() for x in (p.r1, p.r2, p.q, p.b)))
        self.past = [np.full(x.shape, 1e-4) for x in (p.r1, p.r2, p.q, p.b)]
        self.rng, self.rate = np.random.default_rng(seed), rate
        self.log_kq = np.log(NOISE * noise)
        self.cum = np.cumsum(noise)

    def step(self, c2: np.ndarray, c1: np.ndarray, w: np.ndarray, n: np.ndarray) -> None:
        p = self.p
        weight = n / n.sum()
        x = p.r1[c1] + p.r2[c2]
        drawn = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE)), CLASSES - 1)
        true = (x * p.q[w]).sum(1) + p.b[w] - self.log_kq[w]
        false = x @ p.q[drawn].T + p.b[drawn] - self.log_kq[drawn]
        gt = -weight / (1 + np.exp(np.clip(true, -50, 50)))               # -(1 - sigmoid)
        gf = weight[:, None] / (1 + np.exp(-np.clip(false, -50, 50)))
        gx = gt[:, None] * p.q[w] + gf @ p.q[drawn]
        grads = [np.zeros_like(x) for x in (p.r1, p.r2, p.q, p.b)]
        np.add.at(grads[0], c1, gx)
        np.add.at(grads[1], c2, gx)
        np.add.at(grads[2], w, gt[:, None] * x)
        np.add.at(grads[2], drawn, gf.T @ x)
        np.add.at(grads[3], w, gt)
        np.add.at(grads[3], drawn, gf.sum(0))
        for value, g, past in zip((p.r1, p.r2, p.q, p.b), grads, self.past, strict=True):
            past += g * g
            value -= self.rate * g / np.sqrt(past)


def train(trigrams: DataFrame, vocab: Vocabulary, seed: int = 1) -> Parameters:
    """NCE over the whole (key, n) table, dealt over WORKERS partitions."""
    spark = trigrams.sparkSession
    params = start(vocab, seed)
    noise = (vocab.mass + 0.5) / (vocab.mass + 0.5).sum()
    for k in range(ROUNDS):
        held = spark.sparkContext.broadcast((params.pack(), noise))
        rate = 0.3 / (1 + k)

        def run(batches: Iterator[pa.RecordBatch], held=held, k=k, rate=rate) -> Iterator[pa.RecordBatch]:
            packed, q = held.value
            nce, total, steps = Nce(Parameters.unpack(packed), q, seed + k, rate), 0, 0
            for batch in batches:
                key = np.asarray(batch.column("key"), np.int64)
                n = np.asarray(batch.column("n"), np.float64)
                total += n.sum()
                for i in range(0, len(key), BATCH):
                    x = key[i: i + BATCH]
                    ctx = x // CLASSES
                    nce.step(ctx // CONTEXTS, ctx % CONTEXTS, x % CLASSES, n[i: i + BATCH])
                    steps += 1
            if steps:
                yield pa.RecordBatch.from_arrays([pa.array([nce.p.pack()], pa.binary()),
                                                  pa.array([float(total)])], names=["p", "n"])
        got = trigrams.mapInArrow(run, "p binary, n double").collect()  # WORKERS rows of fixed size
        if not got:
            return params
        got = sorted(got, key=lambda r: (r["n"], bytes(r["p"])))
        share = np.array([r["n"] for r in got]) / sum(r["n"] for r in got)
        flat = sum(s * np.frombuffer(bytes(r["p"]), np.float32).astype(np.float64)
                   for s, r in zip(share, got, strict=True))
        params = Parameters.unpack(flat.astype(np.float32).tobytes())
    return params


@dataclass
class Model:
    """Three tables: ln p(class | c1, c2) = s1[c1, class] + s2[c2, class] - z[c2, c1]."""
    vocab: Vocabulary
    s1: np.ndarray
    s2: np.ndarray
    z: np.ndarray

    def class_ln(self, c1, c2, klass) -> np.ndarray:
        return self.s1[c1, klass] + self.s2[c2, klass] - self.z[c2, c1]


def normalised(params: Parameters, vocab: Vocabulary) -> Model:
    s1 = params.r1 @ params.q.T
    s2 = params.r2 @ params.q.T + params.b
    top1, top2 = s1.max(1, keepdims=True), s2.max(1, keepdims=True)
    z = np.log(np.exp(s2 - top2) @ np.exp(s1 - top1).T) + top2 + top1.T
    return Model(vocab, s1, s2, z)


def learn(docs: DataFrame, seed: int = 1) -> tuple[Model, DataFrame]:
    """(model, counts table (key, n)) from all training texts."""
    spark = in_small_batches(docs).sparkSession
    text = docs.select("text")
    counts = materialize(counted(text, token_keys), "lm-counts")
    vocab = vocabulary(counts)
    held = spark.sparkContext.broadcast(vocab)
    tri = counted(text, trigram_keys, held)
    tri = materialize(tri.repartition(WORKERS, F.xxhash64("key")).sortWithinPartitions(F.xxhash64("key", F.lit(5))),
                      "lm-trigrams")
    tri = tri.coalesce(WORKERS)
    return normalised(train(tri, vocab, seed), vocab), counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """row (the document's columns), n_tokens, n_known, base_score, score."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
                       F.monotonically_increasing_id().alias("rid"))
    rows = rows.select("row", "rid", F.col("row.text").alias("_text"))
    if "text" in docs.columns:
        rows = rows.withColumn("row", F.col("row").dropFields("text") if len(docs.columns) > 1 else F.col("row"))
    schema = rows.select("row", "rid", F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"),
                         F.lit(0.0).alias("base"), F.lit(0.0).alias("ln"),
                         F.array().cast("array<bigint>").alias("rare"),
                         F.array().cast("array<int>").alias("times")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        v = m.vocab
        for part, buf, offs in chunks(batches, "_text"):
            h, suffix, first = stream(buf, offs)
            key = tagged(h, suffix)
            count, klass = v.find(key)
            c1, c2 = context_classes(key, klass, first)
            doc = np.repeat(np.arange(part.num_rows), np.diff(first))
            ln = m.class_ln(c1, c2, klass)
            seen = count > 0
            ln[seen] += v.within(count[seen], klass[seen])
            base = np.bincount(doc[seen], v.base(count[seen]), minlength=part.num_rows)
            # the others, once for each text
            rare_doc, rare_key = doc[~seen], key[~seen]
            order = np.lexsort((rare_key, rare_doc))
            rare_doc, rare_key = rare_doc[order], rare_key[order]
            head = np.ones(len(order), bool)
            head[1:] = (rare_key[1:] != rare_key[:-1]) | (rare_doc[1:] != rare_doc[:-1])
            at = np.flatnonzero(head)
            cut = pa.array(np.searchsorted(rare_doc[at], np.arange(part.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("rid"), pa.array(np.diff(first)),
                 pa.array(np.bincount(doc[seen], minlength=part.num_rows)), pa.array(base),
                 pa.array(np.bincount(doc, ln, minlength=part.num_rows)),
                 pa.ListArray.from_arrays(cut, pa.array(rare_key[at].view(np.int64))),
                 pa.ListArray.from_arrays(cut, pa.array(np.diff(np.append(at, len(order))), pa.int32()))],
                names=schema.names)

    parts = materialize(rows.mapInArrow(run, schema), "lm-parts")
    v = model.vocab
    rare = parts.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("t"))
    rare = rare.select("rid", F.col("t.rare").alias("key"), F.col("t.times").alias("times"))
    n = F.coalesce("n", F.lit(0)).cast("double")
    # the class statistics of the suffix classes, as small literals
    mass = F.array(*[F.lit(float(x)) for x in v.mass[TOP: TOP + SUFFIXES]])
    freed = F.array(*[F.lit(float(v.discount * x)) for x in v.kinds[TOP: TOP + SUFFIXES]])
    s = (F.col("key").bitwiseAND(F.lit(SUFFIXES - 1)) + 1).cast("int")
    of = F.element_at(mass, s)
    share = F.when(n > 0, n - F.lit(v.discount)).otherwise(F.element_at(freed, s))
    within = F.when((of > 0) & (share > 0), F.ln(share / of)).otherwise(F.lit(0.0))
    base = F.log10((n + 0.1) / F.lit(v.tokens + 0.1 * (v.types + 1)))
    per = (rare.join(counts.where(F.col("n") < v.tau), "key", "left")
           .groupBy("rid").agg(F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("r_known"),
                               F.sum(base * F.col("times")).alias("r_base"),
                               F.sum(within * F.col("times")).alias("r_ln")))
    zero = F.lit(0.0)
    return parts.join(per, "rid", "left").select(
        "row", "n_tokens", (F.col("n_known") + F.coalesce("r_known", F.lit(0))).cast("bigint").alias("n_known"),
        (F.col("base") + F.coalesce("r_base", zero)).alias("base_score"),
        ((F.col("ln") + F.coalesce("r_ln", zero)) / F.lit(float(np.log(10)))).alias("score"))
