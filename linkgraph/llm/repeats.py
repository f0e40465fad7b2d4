"""Which windows of a corpus occur more than once: the frame of op2's shards.  The
byte dedup by prefix doubling shares the texts, the segments and `covered`, and
makes its own rounds.

A text is a row of units (words or bytes).  Every window of `window` units has
an anchor, the smallest-hash gram of `gram` units in it (leftmost of equals),
so equal windows have equal anchors at equal places.  Consecutive windows with
one anchor form a segment.  Segments whose anchor gram occurs nowhere else
hold no repeated window and are left out early; the others meet by anchor in
shards, where the operator's own method decides each window exactly.

Grams that repeat one word come last in the order, or a run of one word would
give an anchor at every place.  A window of nothing but such grams, and the
windows of anchors with more than `HOT` occurrences (a passage that very many
documents hold), count by the hash of their whole content instead, which
spreads them over all tasks; equal ones of one chunk of texts meet there and
send one of them on.

Equal texts are one text here, with the number of its rows; every window of a
text with two rows is repeated.  Texts are dealt once, by a row identity, into
a bucketed table, so that the two later passes over them join without another
shuffle of the texts.  Anchors are sorted by range, so that no task holds a
hot anchor alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkgraph.llm.text import SPACE, Words, chunks, in_small_batches, prefix_hash, range_hash, spread, words
from linkgraph.sources.store import drop_stage, materialize, materialize_bucketed

HOT = 256
SHARD_BYTES = 2 << 20
SEGMENT, SOLO, SPAN = 0, 1, 2  # kinds of pieces
PERIODIC = np.uint64(1 << 63)


@dataclass
class Units:
    """The units of a chunk of texts."""
    first: np.ndarray          # text i has the units first[i]:first[i + 1]
    hash: np.ndarray           # prefix hash over all units
    flat: np.ndarray           # per gram start: whether the gram only repeats one word
    begin: np.ndarray | None   # first and after-last byte of each unit (None: units are bytes)
    end: np.ndarray | None


def _runs(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(begin, number): the first word of each run of equal words in a text, and
    for each word the number of its run."""
    doc = w.doc()
    new = np.ones(len(w.hash), bool)
    new[1:] = (w.hash[1:] != w.hash[:-1]) | (doc[1:] != doc[:-1])
    return np.flatnonzero(new), np.cumsum(new) - 1


def word_units(buf: np.ndarray, offs: np.ndarray, gram: int) -> Units:
    """A gram of words is flat if all are equal."""
    w = words(buf, offs, SPACE)
    begin, number = _runs(w)
    stop = np.append(begin[1:], len(w.hash))
    flat = stop[number] - np.arange(len(w.hash)) >= gram
    return Units(w.first, prefix_hash(w.hash), flat, w.start, w.end)


def byte_units(buf: np.ndarray, offs: np.ndarray, gram: int) -> Units:
    """A gram of bytes is flat if the words wholly inside it (after its first
    separator and before its last one) are two or more and all equal."""
    w = words(buf, offs, SPACE)
    flat = np.zeros(len(buf), bool)
    if len(w.hash):
        begin, number = _runs(w)
        stop = np.append(begin[1:], len(w.hash))
        doc = w.doc()[begin]
        # such a gram begins in the word before a run or later, and ends in the word after it or earlier
        low = np.where(begin > w.first[doc], w.start[np.maximum(begin - 1, 0)], offs[doc])
        high = np.where(stop < w.first[doc + 1], w.end[np.minimum(stop, len(w.hash) - 1)], offs[doc + 1])
        runs = np.flatnonzero((stop - begin > 1) & (high - low >= gram))
        if len(runs):
            q = spread(low[runs], high[runs] - gram + 1 - low[runs])
            a = np.searchsorted(w.start, q, side="right")
            b = np.searchsorted(w.end, q + gram) - 1
            inside = b > a
            a, b = np.minimum(a, len(number) - 1), np.maximum(b, 0)
            flat[q] |= inside & (number[a] == number[b])
    return Units(offs, prefix_hash(buf.astype(np.uint16) + np.uint16(1)), flat, None, None)


@dataclass
class Segments:
    doc: np.ndarray
    start: np.ndarray    # first window, counted in its text
    count: np.ndarray    # windows
    key: np.ndarray      # hash of the anchor gram, or of the whole window
    solo: np.ndarray     # the key is of a whole window
    anchor: np.ndarray   # place of the anchor, counted in its text (of a solo one: its first window)


def segments(u: Units, window: int, gram: int) -> Segments:
    width = window - gram + 1
    size = np.diff(u.first)
    n_win = np.maximum(size - window + 1, 0)
    start = spread(u.first[:-1], n_win)     # unit index of each window
    doc = np.repeat(np.arange(len(size)), n_win)
    total = len(u.hash) - 1
    if not len(start):
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none.astype(np.uint64), none.astype(bool), none)
    at = np.arange(max(0, total - gram + 1))
    g = range_hash(u.hash, at, at + gram)
    order = (g >> np.uint64(33) << np.uint64(32)) | at.astype(np.uint64)  # hash, then place
    order[u.flat[: len(at)]] |= PERIODIC
    low, reach = order, 1
    while reach * 2 <= width:
        low = np.minimum(low[: len(low) - reach], low[reach:])
        reach *= 2
    best = np.minimum(low[start], low[start + width - reach])
    anchor = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    flat = best >= PERIODIC
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | flat[1:] | flat[:-1]
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(start)))
    key, solo = g[anchor[head]], flat[head]
    own = np.flatnonzero(solo)
    key[own] = range_hash(u.hash, start[head[own]], start[head[own]] + window)
    place = np.where(solo, start[head], anchor[head]) - u.first[doc[head]]
    return Segments(doc[head], start[head] - u.first[doc[head]], count, key, solo, place)


def first_of_equals(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Index of the first of the equal (doc, key) for each, itself included."""
    order = np.lexsort((np.arange(len(key)), key, doc))
    new = np.ones(len(key), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    out = np.empty(len(key), np.int64)
    out[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def text_key(text: Column) -> Column:
    """128 bits that stand for the whole text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(j, k, m, text): one row of each text, bucketed by j; k is the hash of the
    text, m the number of its rows."""
    spark = in_small_batches(docs).sparkSession
    rows = docs.select(text_key(F.col("text")).alias("k"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    j = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "k")
    rows = rows.select(j.alias("j"), "k", "text")
    # texts whose j agree by chance stay two rows, told apart by k
    reps = rows.select("j", "k").groupBy("k").agg(F.min("j").alias("j"), F.count(F.lit(1)).alias("m"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = rows.repartition(n, "j").join(reps, ["j", "k"]).dropDuplicates(["j", "k"])
    return materialize_bucketed(one.select("j", "k", "m", "text"), "texts", ["j"], n)


def several(rows: DataFrame) -> DataFrame:
    """The distinct (key, j, at, solo) rows whose key has two of them or more (and
    some rows at the edges of partitions, which do no harm)."""
    order = ["key", "j", "at"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, begins, alike = None, True, False
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            if last is not None:
                t = pa.concat_tables([last, t])
            key, j, at = (np.asarray(t.column(c), np.int64) for c in order)
            same = key[1:] == key[:-1]
            new = np.append(True, ~(same & (j[1:] == j[:-1]) & (at[1:] == at[:-1])))
            t = t.filter(pa.array(new))
            key = key[new]
            same = np.append(alike, key[1:] == key[:-1])
            keep = same[:-1] | same[1:]
            if begins and len(keep):
                keep[0], begins = True, False
            if len(keep):
                yield from t.slice(0, len(keep)).filter(pa.array(keep)).to_batches()
            last, alike = t.slice(len(key) - 1), bool(same[-1])
        if last is not None:
            yield from last.to_batches()
    return dealt.mapInArrow(run, rows.schema)


Units_of = Callable[[np.ndarray, np.ndarray, int], Units]
Shard = Callable[[np.ndarray, np.ndarray, np.ndarray, list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]


def repeated_spans(texts: DataFrame, units: Units_of, window: int, gram: int, shard: Shard) -> DataFrame:
    """(j, spans array<struct<at, n>>): runs of n repeated windows from window
    `at` of the text j.  `shard` gets (key, j, at) and the content of segments
    sorted by key, with whole keys, and gives (row, first window, windows)."""
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in chunks(batches, "text"):
            s = segments(units(buf, offs, gram), window, gram)
            # of equal flat windows in one text, the first one stands for all
            own = np.flatnonzero(s.solo)
            keep = np.ones(len(s.key), bool)
            keep[own] = first_of_equals(s.doc[own], s.key[own]) == np.arange(len(own))
            j = np.asarray(part.column("j"), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.key[keep].view(np.int64)), pa.array(j[s.doc[keep]]),
                 pa.array(s.start[keep].astype(np.int64)), pa.array(s.solo[keep])],
                names=["key", "j", "at", "solo"])

    rows = texts.select("j", "text").mapInArrow(anchors, "key long, j long, at long, solo boolean")
    found = materialize(several(rows), "repeat-anchors")
    hot = found.where("not solo").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    placed = found.where("not solo").join(hot, "key").select("j", F.struct("at", (F.col("n") > HOT).alias("hot")).alias("s"))
    per = placed.groupBy("j").agg(F.sort_array(F.collect_list("s")).alias("s"))  # bounded by the text's length
    per = per.select("j", F.col("s.at").alias("at"), F.col("s.hot").alias("hot"))

    names = ["key", "j", "at", "kind", "n", "content"]

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in chunks(batches, "text"):
            u = units(buf, offs, gram)
            s = segments(u, window, gram)
            j = np.asarray(part.column("j"), np.int64)
            want = part.column("at")
            at = np.asarray(want.flatten(), np.int64)
            is_hot = np.asarray(part.column("hot").flatten(), bool)
            doc = np.repeat(np.arange(len(j)), np.asarray(want.value_lengths(), np.int64))
            # segments are in order of (doc, start), and so are the wanted ones
            code = s.doc.astype(np.int64) * (1 << 40) + s.start
            mine = np.searchsorted(code, doc * (1 << 40) + at)
            base = u.first[s.doc[mine]] + s.start[mine]
            seg = mine[~is_hot]
            b0, b1 = base[~is_hot], base[~is_hot] + s.count[seg] + window - 1
            if u.begin is not None:
                b0, b1 = u.begin[b0], u.end[b1 - 1]
            data = buf.tobytes()
            body = [data[x:y] for x, y in zip(b0.tolist(), b1.tolist(), strict=True)]

            def out(key, who, first, kind, n, body, j=j):
                return pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(j[who]), pa.array(first.astype(np.int64)),
                     pa.array(np.full(len(key), kind, np.int32)), pa.array(n.astype(np.int64)), body], names=names)
            yield out(s.key[seg], s.doc[seg], s.start[seg], SEGMENT, s.count[seg], pa.array(body, pa.binary()))
            seg, base = mine[is_hot], base[is_hot]
            if not len(seg):
                continue
            win = spread(base, s.count[seg])
            who = np.repeat(s.doc[seg], s.count[seg])
            h = range_hash(u.hash, win, win + window)
            _, one, back, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            # one of equal windows goes on to meet those of other chunks
            yield out(h[one], who[one], win[one] - u.first[who[one]], SOLO, np.ones(len(one)),
                      pa.nulls(len(one), pa.binary()))
            # those that are equal here are repeated: their runs are decided
            hit = np.flatnonzero(times[back] > 1)
            new = np.ones(len(hit), bool)
            new[1:] = (win[hit][1:] != win[hit][:-1] + 1) | (who[hit][1:] != who[hit][:-1])
            head = np.flatnonzero(new)
            yield out(h[hit][head], who[hit][head], win[hit][head] - u.first[who[hit][head]], SPAN,
                      np.diff(np.append(head, len(hit))), pa.nulls(len(head), pa.binary()))

    pieces = texts.select("j", "text").join(per, "j").mapInArrow(
        contents, "key long, j long, at long, kind int, n long, content binary")
    pieces = materialize(pieces, "repeat-pieces")
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.where(F.col("kind") == SEGMENT).select("key", "j", "at", "content").repartition(n, "key") \
        .sortWithinPartitions("key", "j", "at")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            rest = t if rest is None else pa.concat_tables([rest, t])
            if rest.nbytes < SHARD_BYTES:
                continue
            key = np.asarray(rest.column("key"), np.int64)
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if cut:
                yield decided(rest.slice(0, cut))
                rest = rest.slice(cut)
        if rest is not None and rest.num_rows:
            yield decided(rest)

    def decided(t: pa.Table) -> pa.RecordBatch:
        key, j, at = (np.asarray(t.column(c), np.int64) for c in ("key", "j", "at"))
        new = np.append(True, (key[1:] != key[:-1]) | (j[1:] != j[:-1]) | (at[1:] != at[:-1]))
        t = t.filter(pa.array(new))
        key, j, at = key[new], j[new], at[new]
        row, first, count = shard(key, j, at, t.column("content").to_pylist())
        return pa.RecordBatch.from_arrays([pa.array(j[row]), pa.array(at[row] + first), pa.array(count)],
                                          names=["j", "at", "n"])

    spans = dealt.mapInArrow(decide, "j long, at long, n long")
    whole = several(pieces.where(F.col("kind") == SOLO).select("key", "j", "at", F.lit(True).alias("solo")))
    whole = materialize(whole.unionByName(found.where("solo")), "repeat-whole")
    drop_stage(found)
    more = whole.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    solo = whole.join(more, "key").select("j", "at", F.lit(1).cast("long").alias("n"))
    here = pieces.where(F.col("kind") == SPAN).select("j", "at", "n")
    every = materialize(spans.unionByName(solo).unionByName(here), "repeat-spans")
    drop_stage(pieces)
    drop_stage(whole)
    return every.groupBy("j").agg(F.collect_list(F.struct("at", "n")).alias("spans"))


def covered(u: Units, window: int, gram: int, m: np.ndarray, spans: pa.Array) -> np.ndarray:
    """Whether each unit of the chunk lies in a repeated window."""
    total = len(u.hash) - 1
    edge = np.zeros(total + 1, np.int32)
    flat = spans.flatten()
    if len(flat):
        doc = np.repeat(np.arange(len(spans)), np.asarray(spans.value_lengths().fill_null(0), np.int64))
        at, n = (np.asarray(flat.field(x), np.int64) for x in ("at", "n"))
        np.add.at(edge, u.first[doc] + at, 1)
        np.add.at(edge, u.first[doc] + at + n + window - 1, -1)
    # every window of a text with copies
    size = np.diff(u.first)
    copies = np.flatnonzero((m > 1) & (size >= window))
    np.add.at(edge, u.first[copies], 1)
    np.add.at(edge, u.first[copies + 1], -1)
    # flat windows that occur twice in one text
    if u.flat.any():
        s = segments(u, window, gram)
        own = np.flatnonzero(s.solo)
        rep = first_of_equals(s.doc[own], s.key[own])
        twice = own[np.bincount(rep, minlength=len(own))[rep] > 1]
        np.add.at(edge, u.first[s.doc[twice]] + s.start[twice], 1)
        np.add.at(edge, u.first[s.doc[twice]] + s.start[twice] + window, -1)
    return np.cumsum(edge[:-1]) > 0
