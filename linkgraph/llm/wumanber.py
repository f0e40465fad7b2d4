"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of `width` consecutive words of every benchmark
item (an item with fewer words, but not none, is one shorter window).  Texts
and items are lower-cased (A-Z) and cut into words
`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`.  Words are numbered by the vocabulary
of the patterns; a document word outside it is -1 and matches nothing.

For the patterns of one length m, blocks are B = min(3, m) words.  A hashed
shift table gives how far a search position may move on for the block that
ends there (m - B + 1 where no pattern has it, less where one does, 0 where
one ends with it).  At shift 0 the suffix bucket of the block selects the
patterns, and direct comparison word by word confirms them.  Many search
positions of a batch advance side by side, as numpy vectors.

Scale: documents are only scanned, never shuffled.  The patterns are built in
blocks of at most `BLOCK_WORDS` item words, so what a task holds is bounded
whatever the benchmark's size; a further block is one more scan of all the
documents, over a written table.  No document is cut: windows may lie
anywhere in whole texts.

Defined results: a null text or item has no words; an empty table of items
hits nothing; repeated items or rows count by their own ids (a null item id
counts as the empty string); equal windows of several items count for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.llm.text import ALNUM, chunks, in_small_batches, mix, raw, spread, words
from linkgraph.sources.store import materialize

BLOCK_WORDS = 1 << 20
TABLE_BITS = 20
STRIDE = 128


class Length:
    """Shift table, suffix buckets and patterns of one pattern length."""

    def __init__(self, patterns: np.ndarray, items: list[np.ndarray]):
        n, m = patterns.shape
        self.m, self.b = m, min(3, m)
        self.patterns = patterns
        self.item_first = np.concatenate([[0], np.cumsum([len(x) for x in items])])
        self.items = np.concatenate(items)
        self.shift = np.full(1 << TABLE_BITS, m - self.b + 1, np.int16)
        for last in range(self.b - 1, m):
            slot = self.slot([patterns[:, last - k] for k in range(self.b - 1, -1, -1)])
            np.minimum.at(self.shift, slot, np.int16(m - 1 - last))
        suffix = self.slot([patterns[:, m - 1 - k] for k in range(self.b - 1, -1, -1)])
        self.order = np.argsort(suffix, kind="stable")
        self.bucket = suffix[self.order]

    @staticmethod
    def slot(block: list[np.ndarray]) -> np.ndarray:
        code = np.zeros(len(block[0]), np.uint64)
        for x in block:
            code = mix(code + x.astype(np.int64).astype(np.uint64))
        return (code >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last word, pattern) of every occurrence in `ids`."""
        m, b = self.m, self.b
        if len(ids) < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(m - 1, len(ids), STRIDE)
        stop = np.minimum(at + STRIDE, len(ids))
        found = []
        while len(at):
            slot = self.slot([ids[at - k] for k in range(b - 1, -1, -1)])
            move = self.shift[slot]
            hit = move == 0
            if hit.any():
                found.append((at[hit], slot[hit]))
            at = at + np.maximum(move, 1)
            go = at < stop
            at, stop = at[go], stop[go]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pos, slot = (np.concatenate(x) for x in zip(*found, strict=True))
        lo = np.searchsorted(self.bucket, slot)
        n = np.searchsorted(self.bucket, slot, side="right") - lo
        who = self.order[spread(lo, n)]
        pos = np.repeat(pos, n)
        for k in range(m):  # direct comparison, first words first
            same = ids[pos - m + 1 + k] == self.patterns[who, k]
            pos, who = pos[same], who[same]
        return pos, who


class Patterns:
    """Everything a task needs of one block of items."""

    def __init__(self, texts: list[bytes], names: list[str], width: int):
        buf, offs = raw(pa.array(texts, pa.large_binary()))
        w = words(buf, offs, ALNUM, lower=True)
        self.names = names
        self.vocab, ids = np.unique(w.hash, return_inverse=True)
        wins: dict[int, dict[tuple, list[int]]] = {}
        for i in range(len(texts)):
            own = ids[w.first[i]: w.first[i + 1]].tolist()
            m = min(width, len(own))
            for j in range(len(own) - m + 1) if m else ():
                wins.setdefault(m, {}).setdefault(tuple(own[j: j + m]), []).append(i)
        self.lengths = [Length(np.array(list(p), np.int64), [np.unique(x) for x in p.values()])
                        for _, p in sorted(wins.items())]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocab):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
        return np.where(self.vocab[at] == hashes, at, -1)


def _blocks(benchmark: DataFrame, width: int) -> Iterator[Patterns]:
    """Benchmark items in blocks of bounded size, read one partition at a time."""
    texts, names, size = [], [], 0
    for r in benchmark.where(F.col("text").isNotNull()) \
            .select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("n"), "text").toLocalIterator():
        b = r["text"].encode()
        if texts and size + len(b) // 4 > BLOCK_WORDS:
            yield Patterns(texts, names, width)
            texts, names, size = [], [], 0
        texts.append(b)
        names.append(r["n"])
        size += len(b) // 4 + 1
    yield Patterns(texts, names, width)


def scan(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """docs (a `text` column and any others) plus n_words long, spans
    array<int> (first, after-last word of each maximal run of hit words) and
    items array<string> (ids of the items with occurring windows)."""
    spark = in_small_batches(docs).sparkSession
    out = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), F.lit(None).cast("long")
                      .alias("_wm_words"), F.array().cast("array<int>").alias("_wm_spans"),
                      F.array().cast("array<string>").alias("_wm_items"))
    schema = out.schema
    for k, block in enumerate(_blocks(benchmark, width)):
        if k:
            out = materialize(out, "decontaminate")
        held = spark.sparkContext.broadcast(block)
        out = out.withColumn("_wm_text", F.col("_row.text")).mapInArrow(_scanner(held, schema.names), schema)
    return out


def _scanner(held, names: list[str]):
    def scanner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        for rows, buf, offs in chunks(batches, "_wm_text"):
            w = words(buf, offs, ALNUM, lower=True)
            n = len(w.first) - 1
            # one -1 between texts, so that no window crosses them
            place = np.arange(len(w.hash)) + w.doc()
            ids = np.full(len(w.hash) + n, -1, np.int64)
            ids[place] = block.ids(w.hash)
            owner = np.repeat(np.arange(n), np.diff(w.first) + 1)
            begin = w.first[:-1] + np.arange(n)
            cover = np.zeros(len(ids) + 1, np.int32)
            pairs = []
            for length in block.lengths:
                last, who = length.search(ids)
                np.add.at(cover, last - length.m + 1, 1)
                np.add.at(cover, last + 1, -1)
                many = np.diff(length.item_first)[who]
                item = length.items[spread(length.item_first[who], many)]
                pairs.append(np.unique(np.repeat(owner[last], many) * len(block.names) + item))
            for a, k in zip(rows.column("_wm_spans").to_pylist(), range(n), strict=True):
                for x, y in zip(a[::2], a[1::2], strict=True):  # of earlier blocks
                    cover[begin[k] + x] += 1
                    cover[begin[k] + y] -= 1
            hit = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
            first, after = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(~hit[1:] & hit[:-1])
            whose = owner[first] if len(first) else first
            ends = np.stack([first - begin[whose], after - begin[whose]], 1).astype(np.int32).ravel()
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(whose, np.arange(n + 1)) * 2, pa.int32()),
                                             pa.array(ends, pa.int32()))
            new: dict[int, set] = {}
            for p in pairs:
                for d, i in zip((p // max(1, len(block.names))).tolist(), (p % max(1, len(block.names))).tolist(),
                                strict=True):
                    new.setdefault(d, set()).add(block.names[i])
            items = [sorted({*a, *new[k]}) if k in new else a
                     for k, a in enumerate(rows.column("_wm_items").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [rows.column("_row"), pa.array(np.diff(w.first), pa.int64()), spans,
                 pa.array(items, pa.list_(pa.string()))], names=names)
    return scanner


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """One row per document: row (its columns), n_words, n_hit, items, spans."""
    s = scan(docs, benchmark, width)
    n_hit = F.aggregate(F.transform("_wm_spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)),
                        F.lit(0).cast("bigint"), lambda a, x: a + x)
    return s.select(F.col("_row").alias("row"), F.coalesce("_wm_words", F.lit(0).cast("bigint")).alias("n_words"),
                    n_hit.alias("n_hit"), F.col("_wm_items").alias("items"), F.col("_wm_spans").alias("spans"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The documents without any hit word, with their own columns."""
    return contamination(docs, benchmark, width).where("n_hit = 0").select("row.*")
