"""Dedup of repeated byte strings by distributed prefix doubling.

A byte covered by a string of `window` bytes that also starts anywhere else
(same document included) goes; strings are judged on the input and never cross
documents.

A pair of ranks for every byte of a corpus is many times its size (rounds over the
bytes of all shared segments were built and measured, see README).  So a place
stands for a block of windows that overlap, and its string grows at both ends:

* Every window has an anchor chosen by content (see `repeats`).  A block of size c
  holds the windows that begin i c to i c + c - 1 bytes before one anchor, for some
  i, as far as they are there.  Its core, the bytes that all of them share, has
  `window` + 1 - c bytes; its content is all their bytes.
* The first round has the windows of one anchor as block and the anchor as core.  In
  each further round blocks are cut into `RATIO` smaller ones, so the cores grow, up to
  single windows, which are their own cores.
* In a round Spark sorts, by range, the pairs (rank of the core so far, name of the
  longer core) and within these the contents; equal pairs get one new rank.  A core
  that occurs once leaves: all windows of its block are unique.  A content that occurs
  twice leaves as well, past the threshold: all windows of it are repeated; one of
  these goes on for the others if other contents have its core.

Ranks are numbers of distinct pairs in sorted order.  A pair with very many places
may go on over several tasks; its rank is that of the first, which the driver
learns from at most two rows a task.

Equal texts are one text here, with the number of its rows; every window of a text
with two rows is repeated.  Windows of one repeated word are segments of one
window.

Defined results: a null or empty text has no bytes and keeps none; texts
shorter than a window keep all; all rows of repeated texts lose every byte
(from a window's length on); an empty table gives an empty result.  Texts are
known by 128 bits; anchors, cores and contents are named by 64-bit hashes of their
bytes.  The kept bytes of a text
need not be valid UTF-8; `kept` is binary.  Other columns stay untouched, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.llm.repeats import byte_units, covered, distinct_texts, first_of_equals, segments, text_key
from linkgraph.llm.text import chunks, prefix_hash, range_hash, spread
from linkgraph.sources.store import drop_stage, materialize, stages_freed

GRAM = 200
RATIO = 4
ROWS = 1 << 16  # rows that a task looks at together
STRETCH = 1 << 16  # bytes of a text whose runs are looked for together
PAIRS = "x long, y long, w long, j long, at long, n long, a long"


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in larger tables."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def column(t: pa.Table, name: str) -> np.ndarray:
    return np.asarray(t.column(name), np.int64)


def named(x, y, w, j, at, n, a) -> pa.RecordBatch:
    x, y, w = (v.view(np.int64) if v.dtype == np.uint64 else v for v in (x, y, w))
    return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in (x, y, w, j, at, n, a)],
                                      names=["x", "y", "w", "j", "at", "n", "a"])


def anchored(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """The first round's pairs: the n windows from window `at` of the text j that share
    the anchor x at byte a, with their content w; y is 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in chunks(batches, "text"):
            u = byte_units(buf, offs, gram)
            s = segments(u, window, gram)
            # of equal flat windows in one text, the first one stands for all (see `covered`)
            own = np.flatnonzero(s.solo)
            keep = np.ones(len(s.key), bool)
            keep[own] = first_of_equals(s.doc[own], s.key[own]) == np.arange(len(own))
            doc, start, count = s.doc[keep], s.start[keep], s.count[keep]
            base = u.first[doc] + start
            j = np.asarray(part.column("j"), np.int64)[doc]
            yield named(s.key[keep], np.zeros(len(doc), np.int64),
                        range_hash(u.hash, base, base + count + window - 1), j, start, count, s.anchor[keep])
    return texts.select("j", "text").mapInArrow(run, PAIRS)


def grown(texts: DataFrame, go: DataFrame, window: int, size: int) -> DataFrame:
    """The pairs of a round: the blocks `go` (rank, j, at, n, a) cut into blocks of
    `size` windows, with the rank so far x, the name y of the longer core and w of the
    content."""
    per = go.groupBy("j").agg(F.collect_list(F.struct("rank", "at", "n", "a")).alias("s"))  # bounded by the text's length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in chunks(batches, "text"):
            h = prefix_hash(buf.astype(np.uint16) + np.uint16(1))
            want = part.column("s")
            doc = np.repeat(np.arange(part.num_rows), np.asarray(want.value_lengths(), np.int64))
            rank, at, n, a = (np.asarray(want.flatten().field(c), np.int64) for c in ("rank", "at", "n", "a"))
            low = (a - at - n + 1) // size
            many = (a - at) // size - low + 1
            i, of = spread(low, many), np.repeat(np.arange(len(at)), many)
            doc, rank, at, n, a = (v[of] for v in (doc, rank, at, n, a))
            start = np.maximum(at, a - size * i - size + 1)
            n = np.minimum(at + n - 1, a - size * i) - start + 1
            base, core = offs[doc] + start, offs[doc] + a - size * i
            yield named(rank, range_hash(h, core, core + window + 1 - size),
                        range_hash(h, base, base + n + window - 1), np.asarray(part.column("j"), np.int64)[doc],
                        start, n, a)
    return texts.select("j", "text").join(per, "j").mapInArrow(run, PAIRS)


def reranked(pairs: DataFrame) -> DataFrame:
    """(j, at, n, a, rank, whole, go): the blocks whose content has an equal (whole), and
    one block of each content whose core (x, y) has several (go), with the core's rank."""
    order = ["x", "y", "w", "j", "at"]
    dealt = pairs.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(t, rank, whole, go, edge):
            some = np.flatnonzero(whole | go | edge)
            hide = ~edge[some]
            ends = [pa.array(column(t, c)[some], mask=hide) for c in ("x", "y", "w")]
            return pa.RecordBatch.from_arrays(
                [pa.array(column(t, c)[some]) for c in ("j", "at", "n", "a")]
                + [pa.array(v[some]) for v in (rank, whole, go)] + ends,
                names=["j", "at", "n", "a", "rank", "whole", "go", "x", "y", "w"])
        number, held, alike, leads, begins = TaskContext.get().partitionId() << 40, None, False, True, True
        for t in gathered(batches):
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            x, y, w = (column(t, c) for c in ("x", "y", "w"))
            core = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
            same = core & (w[1:] == w[:-1])
            rank = number + np.append(0, np.cumsum(~core))
            group = np.maximum.accumulate(np.where(np.append(True, ~same), np.arange(len(x)), 0))
            lead = np.append(leads, ~core)[group]  # the row's content is the first of its core
            before = np.append(alike, same)
            whole = before[:-1] | same
            go = (~before[:-1] & ~lead[:-1]) | (~same & core & lead[:-1])
            edge = np.zeros(len(same), bool)
            edge[:1] = begins
            yield out(t.slice(0, len(same)), rank[:-1], whole, go, edge)
            begins &= len(same) == 0
            held, number, alike, leads = t.slice(len(same)), int(rank[-1]), bool(before[-1]), bool(lead[-1])
        if held is not None:
            yield out(held, np.array([number]), np.array([alike]), np.array([not alike and not leads]),
                      np.array([True]))
    ranked = materialize(dealt.mapInArrow(run, "j long, at long, n long, a long, rank long, whole boolean, go boolean, "
                                               "x long, y long, w long"), "ranks")
    # what goes on in the next task is seen at the edges, at most two rows a task
    head: dict[int, int] = {}
    twice: list[tuple[int, int]] = []
    last = None
    for r in ranked.where("x is not null").select("rank", "x", "y", "w", "j", "at").orderBy("rank", "w", "j", "at") \
            .toLocalIterator():
        if last is not None and (r["x"], r["y"]) == (last["x"], last["y"]):
            head[r["rank"]] = head.setdefault(last["rank"], last["rank"])
            if r["w"] == last["w"]:
                twice += [(e["j"], e["at"]) for e in (last, r)]
        last = r
    spark = ranked.sparkSession
    over = spark.createDataFrame(list(head.items()), "rank long, head long")
    equal = spark.createDataFrame(sorted(set(twice)), "j long, at long").withColumn("equal", F.lit(True))
    # only the rows at the edges are looked up by place
    edges = ranked.where("x is not null").join(F.broadcast(equal), ["j", "at"], "left")
    marked = edges.unionByName(ranked.where("x is null").withColumn("equal", F.lit(None).cast("boolean")))
    # an edge goes on if its core goes on beyond it
    out = marked.join(F.broadcast(over), "rank", "left").select(
        "j", "at", "n", "a", F.coalesce("head", "rank").alias("rank"),
        (F.col("whole") | F.col("equal").isNotNull()).alias("whole"),
        (F.col("go") | (F.col("x").isNotNull() & F.col("head").isNotNull())).alias("go"))
    out._stage_path = ranked._stage_path
    return out


def runs_of(left: DataFrame) -> DataFrame:
    """(j, at, n): the places (j, at) as runs of n neighbours."""
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.select("j", "at").repartition(n, "j", F.floor(F.col("at") / STRETCH)).sortWithinPartitions("j", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches):
            j, at = column(t, "j"), column(t, "at")
            head = np.flatnonzero(np.append(True, (j[1:] != j[:-1]) | (at[1:] != at[:-1] + 1)))
            yield pa.RecordBatch.from_arrays([pa.array(j[head]), pa.array(at[head]),
                                              pa.array(np.diff(np.append(head, len(j))))], names=["j", "at", "n"])
    return dealt.mapInArrow(run, "j long, at long, n long")


def sizes(window: int, gram: int) -> list[int]:
    """Block sizes of the rounds after the first: powers of RATIO below the number of
    windows that one anchor can have, down to 1."""
    out = [1]
    while out[0] * RATIO < window - gram + 1:
        out.insert(0, out[0] * RATIO)
    return out


def repeated_spans(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(j, spans array<struct<at, n>>): runs of n repeated windows from window `at`."""
    pairs = materialize(anchored(texts, window, gram), "doubling-pairs")
    ranks = reranked(pairs)
    spans = ranks.where("whole").select("j", "at", "n")
    for size in sizes(window, gram):
        drop_stage(pairs)
        pairs = materialize(grown(texts, ranks.where("go"), window, size), "doubling-pairs")
        ranks = reranked(pairs)
        found = ranks.where("whole").select("j", "at", "n")
        spans = spans.unionByName(runs_of(found) if size == 1 else found)
    drop_stage(pairs)
    return spans.groupBy("j").agg(F.collect_list(F.struct("at", "n")).alias("spans"))


def dedup(docs: DataFrame, window: int = 400, gram: int = GRAM, with_bytes: bool = False) -> DataFrame:
    """(k, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for each distinct text,
    k being `text_key` of it.  Its own stage tables are gone when it returns."""
    if gram > window:
        raise ValueError("an anchor must fit into a window")
    schema = "k binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", kept binary" if with_bytes else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in chunks(batches, "text"):
            u = byte_units(buf, offs, gram)
            gone = covered(u, window, gram, np.asarray(part.column("m")), part.column("spans"))
            removed = np.diff(np.append(0, np.cumsum(gone))[offs])
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = offs[:-1][np.diff(offs) > 0]
            begins[inner] = gone[inner]  # a run ends with its text
            runs = np.diff(np.append(0, np.cumsum(begins))[offs])
            left = buf[~gone].tobytes()
            cut = (offs - np.append(0, np.cumsum(gone))[offs]).tolist()
            kept = [left[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            cols = [part.column("k"), pa.array(np.diff(offs)), pa.array(removed), pa.array(runs),
                    pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
            names = ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_bytes:
                cols.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    done = []
    with stages_freed(but=done):
        texts = distinct_texts(docs.select("doc_id", "text"))
        spans = repeated_spans(texts, window, gram)
        out = texts.select("j", "k", "m", "text").join(spans, "j", "left").select("k", "m", "text", "spans")
        done.append(materialize(out.mapInArrow(run, schema), "dedup-bytes"))
    return done[0]


def per_document(docs: DataFrame, window: int = 400, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    done = dedup(docs, window, gram)
    return docs.select("doc_id", text_key(F.col("text")).alias("k")).join(done, "k").drop("k")
