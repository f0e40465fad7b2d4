"""Substring dedup by compressed FM-indexes over shards.

`repeats` brings the text segments that may hold a repeated window of words
together by anchor.  A shard builds an FM-index over its distinct segments:
the Burrows-Wheeler transform of their word numbers, held in a wavelet tree of
bit-packed levels with block counts.  Every segment is then streamed against
the index: backward search extends a match word by word to the left while it
occurs at least twice (copies of a segment count), which gives its matching
statistics, and the stretches of at least `window` words are reported.  All
segments of a shard search side by side as numpy vectors.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged.  A word covered by a window whose
word sequence also starts anywhere else (same document included) goes; windows
are judged on the input.

Defined results: a null, empty or wordless text has no words and keeps the
empty string; texts shorter than a window keep all; all rows of repeated texts
lose every word (from a window's length on); an empty table gives an empty
result.  Word identity is a 64-bit hash.  Other columns of the input stay
untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.llm.repeats import covered, distinct_texts, repeated_spans, text_key, word_units
from linkgraph.llm.text import chunks, prefix_hash, range_hash, raw, words
from linkgraph.sources.store import materialize, stages_freed

GRAM = 18
SHARD_WORDS = 300_000


class WaveletTree:
    """Rank queries over symbols below 2**levels, in bit-packed levels."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        x = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (x >> level & 1).astype(bool)
            packed = np.zeros((len(x) // 64 + 1) * 8, np.uint8)
            p = np.packbits(bit, bitorder="little")
            packed[: len(p)] = p
            packed = packed.view(np.uint64)
            self.bits.append(packed)
            self.before.append(np.append(0, np.cumsum(np.bitwise_count(packed).astype(np.int64)))[:-1])
            self.zeros.append(int(len(x) - bit.sum()))
            x = np.concatenate([x[~bit], x[bit]])
        self.origin = self._place(np.arange(sigma), np.zeros(sigma, np.int64))

    def _place(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            block = i >> 6
            low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[k][block] + np.bitwise_count(self.bits[k][block] & low)
            i = np.where(symbol >> level & 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of the first i symbols are `symbol`."""
        return self._place(symbol, i) - self.origin[symbol]


class FmIndex:
    """Over sequences of symbols >= 2, joined by 0; symbol 1 matches nothing."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        n = len(text)
        _, rank = np.unique(text, return_inverse=True)
        k = 1
        while True:  # sort the suffixes by their first 2k symbols
            nxt = np.zeros(n, np.int64)
            nxt[: n - k] = rank[k:] + 1
            key = rank * np.int64(n + 1) + nxt
            order = np.argsort(key, kind="stable")
            new = np.append(False, key[order][1:] != key[order][:-1])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            k *= 2
            if k > depth or rank[order[-1]] == n - 1:
                break
        self.below = np.append(0, np.cumsum(np.bincount(text, minlength=sigma)))
        self.tree = WaveletTree(text[order - 1], sigma)
        self.n = n

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix intervals after one more symbol on the left."""
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        lo, hi = self.below[symbol] + both[: len(symbol)], self.below[symbol] + both[len(symbol):]
        return lo, np.where(symbol == 1, lo, hi)


def stretches(index: FmIndex, text: np.ndarray, begin: np.ndarray, size: np.ndarray, copies: np.ndarray,
              window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, end) of matches of at least `window` symbols that occur
    twice: every repeated window of the segments lies in one of them."""
    seg = np.arange(len(begin))
    end, at = size.copy(), size.copy()
    lo, hi = np.zeros(len(seg), np.int64), np.full(len(seg), index.n)
    # a probe asks whether a short match fails at the same place; `back` is where to go on if not
    back = np.full(len(seg), -1)
    fail = np.zeros(len(seg), np.int64)
    out = []
    while len(seg):
        more = at > 0
        symbol = text[begin[seg] + np.maximum(at, 1) - 1]
        nlo, nhi = index.extend(symbol, lo, hi)
        least = np.where(copies[seg] > 1, 1, 2)
        grow = more & (nhi - nlo >= least)
        at = np.where(grow, at - 1, at)
        lo, hi = np.where(grow, nlo, lo), np.where(grow, nhi, hi)
        stop = ~grow
        if not stop.any():
            continue
        probe = stop & (back >= 0)
        # the probe failed at or after the same place: nothing from its end on can be repeated
        same = probe & (at >= fail)
        full = stop & ~probe & (end - at >= window)
        out.append(np.stack([seg[full], at[full], end[full]], 1))
        short = stop & ~probe & ~full
        nxt = end.copy()
        nxt[full] = at[full] + window - 1
        nxt[full & (at == 0)] = 0
        nxt[same] = end[same] - 1
        other = probe & ~same
        nxt[other] = back[other]
        try_ = np.minimum(end - 1, at + 4)
        useful = short & (at + 4 < end - 1)
        fail = np.where(short, at, fail)
        back = np.where(useful, end - 1, np.where(stop, -1, back))
        nxt[short] = end[short] - 1
        nxt[useful] = try_[useful]
        end = np.where(stop, nxt, end)
        at = np.where(stop, end, at)
        lo, hi = np.where(stop, 0, lo), np.where(stop, index.n, hi)
        # a window must end where the search goes on, or at the place kept for a probe
        live = np.maximum(end, back) >= window
        seg, end, at, lo, hi, back, fail = (x[live] for x in (seg, end, at, lo, hi, back, fail))
    got = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
    return got[:, 0], got[:, 1], got[:, 2]


def search_shard(window: int):
    def shard(key: np.ndarray, j: np.ndarray, at: np.ndarray, content: list[bytes]):
        rows, starts, counts = [], [], []
        buf, offs = raw(pa.array(content, pa.large_binary()))
        w = words(buf, offs)
        # distinct segments, in order of key
        whole = range_hash(prefix_hash(w.hash), w.first[:-1], w.first[1:])
        _, one, back, copies = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(one, kind="stable")
        place = np.empty(len(one), np.int64)
        place[order] = np.arange(len(one))
        one, copies, back = one[order], copies[order], place[back]
        size = np.diff(w.first)[one]
        cuts = [0]
        total = 0
        for i, n in enumerate(size.tolist()):  # whole keys in each index
            total += n
            if total > SHARD_WORDS and key[one[i]] != key[one[i - 1]]:
                cuts.append(i)
                total = n
        cuts.append(len(one))
        # rows of each distinct segment
        rows_of = np.argsort(back, kind="stable")
        first_row = np.searchsorted(back[rows_of], np.arange(len(one) + 1))
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if x == y:
                continue
            n = size[x:y]
            begin = np.cumsum(n + 1) - (n + 1)
            text = np.zeros(int((n + 1).sum()), np.int64)
            from_ = np.repeat(w.first[one[x:y]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            uniq, ids, times = np.unique(w.hash[from_], return_inverse=True, return_counts=True)
            many = np.repeat(copies[x:y], n)
            useful = (times > 1) | (np.bincount(ids, many, minlength=len(uniq)) > 1)
            number = np.where(useful, np.cumsum(useful) + 1, 1)
            text[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] = number[ids]
            index = FmIndex(text, int(useful.sum()) + 2, int(n.max()) + 1)
            s, a, b = stretches(index, text, begin, n, copies[x:y], window)
            s = s + x
            many = np.diff(first_row)[s]
            rows.append(rows_of[np.repeat(first_row[s] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))])
            starts.append(np.repeat(a, many))
            counts.append(np.repeat(b - a - window + 1, many))
        none = np.zeros(0, np.int64)
        return (np.concatenate(rows or [none]), np.concatenate(starts or [none]), np.concatenate(counts or [none]))
    return shard


def dedup(docs: DataFrame, window: int = 35, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """(k, n_words, n_removed, kept_sha256[, kept]) for each distinct text, k being
    `text_key` of it; kept has the words left, joined by one space, of texts that
    lose words (null otherwise).  Its own stage tables are gone when it returns."""
    schema = "k binary, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in chunks(batches, "text"):
            u = word_units(buf, offs, gram)
            gone = covered(u, window, gram, np.asarray(part.column("m")), part.column("spans"))
            data = buf.tobytes()
            removed = np.diff(np.append(0, np.cumsum(gone))[u.first])
            digest, kept = [], []
            first = u.first.tolist()
            for i in range(part.num_rows):
                if removed[i]:
                    left = np.flatnonzero(~gone[first[i]: first[i + 1]]) + first[i]
                    body = b" ".join([data[a:b] for a, b in zip(u.begin[left].tolist(), u.end[left].tolist(),
                                                                strict=True)])
                else:
                    body = b" ".join(data[offs[i]: offs[i + 1]].split())
                digest.append(hashlib.sha256(body).hexdigest())
                kept.append(body if removed[i] else None)
            cols = [part.column("k"), pa.array(np.diff(u.first).astype(np.int64)), pa.array(removed), pa.array(digest)]
            names = ["k", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols.append(pa.array(kept, pa.binary()).cast(pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    done = []
    with stages_freed(but=done):
        texts = distinct_texts(docs.select("doc_id", "text"))
        spans = repeated_spans(texts, word_units, window, gram, search_shard(window))
        out = texts.select("j", "k", "m", "text").join(spans, "j", "left").select("k", "m", "text", "spans")
        done.append(materialize(out.mapInArrow(run, schema), "dedup-words"))
    return done[0]


def per_document(docs: DataFrame, window: int = 35, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row."""
    done = dedup(docs, window, gram)
    return docs.select("doc_id", text_key(F.col("text")).alias("k")).join(done, "k").drop("k")


def without_repeats(docs: DataFrame, window: int = 35, gram: int = GRAM) -> DataFrame:
    """The rows of docs; a text that loses words becomes its kept words joined by
    one space, any other text stays as it is."""
    done = dedup(docs, window, gram, with_text=True).where("n_removed > 0").select("k", "kept")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    rows = rows.withColumn("k", text_key(F.col("row.text"))).join(done, "k", "left")
    text = F.coalesce("kept", F.col("row.text"))
    return rows.withColumn("row", F.col("row").withField("text", text)).select("row.*")
