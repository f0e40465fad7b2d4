"""N-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct shingles (`width` lower-cased
words `[^\\x20\\x09-\\x0D]+`; a shorter text is one shingle).  Two documents
link when percent(intersection) >= threshold% of the union, which bounds the
symmetric difference of a set of n shingles and a larger one by
d(n) = floor(n (100 - t) / t).

A parity sketch flips one bit for every shingle (XOR), so the Hamming distance
of two sketches never exceeds the symmetric difference.  Sizes fall into bands
[lo, 1.5 lo); a document takes part in its own band's sketch and, if it can
link into the next band, in that one too.  A band's sketch has more than d
pieces of `PIECE_BITS` bits each; by the pigeonhole principle two linked
documents agree in a whole piece, and that piece (as a 64-bit digest of its
bits) is the join key.  Pieces of fewer than `least` shingles say little and
are skipped: each document gives its first pieces until d + 1 have enough
shingles, so at least one of them agrees.  A document that runs out of such
pieces gives all it has and takes part again with another hash; after `LEVELS`
hashes it gives every piece.

Documents with one set are one node.  The keys are sorted by range, so a key
with a third of all rows spreads over tasks.  Most shared keys hold a few nodes
only (`WHOLE` at most, all seen in one task): these are compared once, whole, at
the end.  Under the others, in each of a few rounds every node meets, under each
key, the node that shares most keys with others (the original
of a group of edited copies shares all it has, a copy loses some by each edit)
and a few neighbours; the partners met under most keys are verified.  That joins
groups of copies without all their pairs.  Only those of these keys that still
hold two components after that are searched further, for pairs of different
components, in blocks of `BLOCK` nodes at most.  Every link between components is found that
way, so components are exact; pairs inside a component need no check.  Rows under
a key carry a brief whole-document sketch (in the block search the full one up to
`BRIEF_BITS`), and a pair leaves a task only if its
sizes and the Hamming distance of these sketches allow a link.  In the block search
rows also name the node's `EARLIER` open keys before theirs, and a pair that has met
under one of these does not leave again.  It then passes
the Hamming bound of the full sketches and is verified on the sets.

Defined results: a null, empty or wordless text has an empty set and is its
own component; equal sets link whatever their size; repeated rows belong to
the component of their text; an empty table gives an empty result.  Columns of
the input stay apart from those added (`row`), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkgraph.llm.components import components
from linkgraph.llm.text import (SPACE, chunks, in_small_batches, mix, ngram_hash, prefix_hash, range_hash, spread,
                                words)
from linkgraph.sources.store import drop_stage, materialize, stages_freed

PIECE_BITS = 512
LEVELS = 8
BLOCK = 1024
WHOLE = 8
SMALL_GROUP = 32
BROADCAST_IDS = 500_000
ROUNDS = 2
TRIES = 4
NEIGHBOURS = 4
BRIEF_BITS = 4096
EARLIER = 8
FLUSH = 100_000


def bands(t: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lo, pieces, least) of each size band for threshold t%, past size `top`."""
    lo = [1]
    while len(lo) < 2 or lo[-2] <= top:
        lo.append(max(lo[-1] + 1, lo[-1] * 3 // 2))
    lo = np.array(lo, np.int64)
    d = (np.append(lo[1:], lo[-1] * 3 // 2) - 1) * (100 - t) // t
    many = d >= 8
    return lo, np.where(many, (d + 1) * 3 // 2, d + 2), np.where(many, 2, 1)


def sets(buf: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, hashes): the sorted distinct shingles of every text."""
    w = words(buf, offs, SPACE, lower=True)
    n = len(offs) - 1
    start, h = ngram_hash(w, width)
    count = np.diff(w.first)
    doc = np.repeat(np.arange(n), np.maximum(count - width + 1, 0))
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        whole = range_hash(prefix_hash(w.hash), w.first[short], w.first[short + 1])
        doc, h = np.append(doc, short), np.append(h, whole)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[new], h[new]
    return np.searchsorted(doc, np.arange(n + 1)), h


def nodes(first: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A 64-bit identity of each set (0 for an empty one)."""
    out = np.zeros(len(first) - 1, np.uint64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        one = np.add.reduceat(mix(h + np.uint64(0x632BE59BD9B4E019)), first[some])
        two = np.bitwise_xor.reduceat(mix(h ^ np.uint64(0xD6E8FEB86659FD93)), first[some])
        out[some] = mix(one + mix(two + np.diff(first)[some].astype(np.uint64)))
    return out


def keys_of(first: np.ndarray, h: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, join key) of every piece that is given, in order of document."""
    lo, pieces, least = bands(t, int(np.diff(first).max(initial=1)))
    size = np.diff(first)
    out_doc, out_key = [], []
    own = np.searchsorted(lo, size, side="right") - 1
    up = np.minimum(own + 1, len(lo) - 1)
    d = size * (100 - t) // t
    for scheme, member in ((own, d > 0), (up, (d > 0) & (100 * size >= t * lo[up]))):
        who = np.flatnonzero(member)
        for level in range(LEVELS):
            if not len(who):
                break
            s, n = scheme[who], size[who]
            m = pieces[s]
            base = np.cumsum(m) - m
            pos = spread(first[who], n)
            mine = np.repeat(np.arange(len(who)), n)
            salt = mix((s * 64 + level).astype(np.uint64) + np.uint64(0x51ED27))
            g = mix(h[pos] ^ salt[mine])
            piece = ((g >> np.uint64(32)) * m[mine].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            cell = base[mine] + piece
            cells = int(m.sum())
            count = np.bincount(cell, minlength=cells)
            digest = np.zeros(cells, np.uint64)  # XOR over the flipped bits of the piece: equal bits cancel
            bit = g % np.uint64(PIECE_BITS)
            np.bitwise_xor.at(digest, cell, mix(bit + np.uint64(0x2545F491)))
            owner = np.repeat(np.arange(len(who)), m)
            good = count >= least[s][owner]
            upto = np.cumsum(good)
            upto -= (upto[base] - good[base])[owner]
            need = (n * (100 - t) // t + 1)
            bad = np.bincount(owner, good, minlength=len(who)) < need
            give = good & (upto <= need[owner])
            if level == LEVELS - 1:
                give |= bad[owner]
            at = np.flatnonzero(give)
            within = (at - base[owner[at]]).astype(np.uint64)
            key = mix(digest[at] + mix(salt[owner[at]] + within))
            out_doc.append(who[owner[at]])
            out_key.append(key)
            who = who[bad]
    if not out_doc:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc, key = np.concatenate(out_doc), np.concatenate(out_key)
    order = np.argsort(doc, kind="stable")
    return doc[order], key[order]


def sketch_bits(n: np.ndarray) -> np.ndarray:
    """Bits of a whole-document sketch: a power of two of at least 4n, 64 at least."""
    return 1 << np.maximum(6, np.ceil(np.log2(np.maximum(n, 1) * 4.0)).astype(np.int64))


def brief_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the sketch that travels with the keys: a quarter, 4096 at most, so
    that the many keys of a long text stay narrow."""
    return np.clip(sketch_bits(n) // 4, 64, BRIEF_BITS)


def sketches(first: np.ndarray, h: np.ndarray, bits_of=sketch_bits) -> list[bytes]:
    n = np.diff(first)
    bits = bits_of(n)
    size = bits // 64
    base = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint64)
    doc = np.repeat(np.arange(len(n)), n)
    bit = (mix(h + np.uint64(0xA0761D64)) & (bits[doc] - 1).astype(np.uint64)).astype(np.int64)
    np.bitwise_xor.at(out, base[doc] + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    data, cut = out.tobytes(), (np.append(base, size.sum()) * 8).tolist()
    return [data[cut[i]: cut[i + 1]] for i in range(len(n))]


def fold(x: np.ndarray, words_: int) -> np.ndarray:
    """The sketch in fewer bits: parity of the bits that share a place."""
    while x.shape[-1] > words_:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def hamming_bound(na, nb, t: int):
    return (na + nb) * (100 - t) // (100 + t)


class Rows:
    """Nodes of a batch with their brief sketches, for comparisons of many pairs at once."""

    def __init__(self, tab: pa.Table, t: int):
        tab = tab.combine_chunks()
        self.key, self.node, self.comp, self.n = (np.asarray(tab.column(c), np.int64)
                                                  for c in ("key", "node", "comp", "n"))
        raw = tab.column("sketch").to_pylist()
        self.words = np.array([len(x) // 8 for x in raw], np.int64)
        self.at = np.cumsum(self.words) - self.words
        self.flat = np.frombuffer(b"".join(raw), np.uint64)
        self.t = t

    def _folded(self, i: np.ndarray, w: int) -> np.ndarray:
        place = self.at[i][:, None] + np.arange(w)
        x = self.flat[place]
        wide = np.flatnonzero(self.words[i] > w)  # twice as wide: sizes differ by less than a factor of 2
        x[wide] ^= self.flat[place[wide] + w]
        return x

    def may_link(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of rows (a, b) of different components that pass the bounds."""
        na, nb = self.n[a], self.n[b]
        ok = (self.comp[a] != self.comp[b]) & (100 * np.minimum(na, nb) >= self.t * np.maximum(na, nb))
        a, b = a[ok], b[ok]
        most = hamming_bound(self.n[a], self.n[b], self.t)
        least = np.minimum(self.words[a], self.words[b])
        near_ = np.zeros(len(a), bool)
        for w in np.unique(least).tolist():
            q = np.flatnonzero(least == w)
            far = np.bitwise_count(self._folded(a[q], w) ^ self._folded(b[q], w)).sum(1)
            near_[q] = far <= most[q]
        return a[near_], b[near_]


def described(docs: DataFrame, width: int, t: int) -> DataFrame:
    """(doc_id, n, node, keys, sketch, brief) for every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in chunks(batches, "text"):
            first, h = sets(buf, offs, width)
            doc, key = keys_of(first, h, t)
            cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(first)), pa.array(nodes(first, h).view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(key.view(np.int64))),
                 pa.array(sketches(first, h), pa.binary()),
                 pa.array(sketches(first, h, brief_bits), pa.binary())],
                names=["doc_id", "n", "node", "keys", "sketch", "brief"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n long, node long, keys array<bigint>, sketch binary, brief binary")


def shared(rows: DataFrame) -> DataFrame:
    """The distinct (key, node, few) whose key more than one node holds; few: the key
    holds `WHOLE` nodes at most.  Rows at a partition's edge are kept in any case, and
    are not few, as the next partition may go on with their key."""
    dealt = rows.select("key", "node").repartitionByRange("key", "node").sortWithinPartitions("key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key, node, few):
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(few)], names=["key", "node", "few"])
        wait = None  # rows of the last key that have not left: its last row at least
        many = True  # whether that key is known to hold more (or began the partition)
        for batch in batches:
            key, node = (np.asarray(batch.column(c), np.int64) for c in ("key", "node"))
            if not len(key):
                continue
            if wait is not None:
                key, node = np.append(wait[0], key), np.append(wait[1], node)
            new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
            key, node = key[new], node[new]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(first, len(key)))
            big = size > WHOLE
            big[0] |= many
            many = bool(big[-1])
            stay = len(key) - 1 if many else int(first[-1])
            keep = np.repeat(big | (size > 1), size)[:stay]
            if keep.any():
                yield out(key[:stay][keep], node[:stay][keep], ~np.repeat(big, size)[:stay][keep])
            wait = key[stay:], node[stay:]
        if wait is not None:
            yield out(*wait, np.zeros(len(wait[0]), bool))
    return dealt.mapInArrow(run, "key long, node long, few boolean")


def placed(members: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, node, comp): members with the component of each node, itself if it has no link."""
    m = members.join(comp.withColumnRenamed("id", "node"), "node", "left")
    return m.select("key", "node", F.coalesce("component", "node").alias("comp"))


def still_open(members: DataFrame, comp: DataFrame) -> DataFrame:
    """The (key, node) whose key holds two components."""
    m = placed(members, comp)
    seen = m.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y")
    return members.join(seen.select("key"), "key", "left_semi")


def partners(members: DataFrame, comp: DataFrame, info: DataFrame, t: int, turn: int) -> DataFrame:
    """(a, b): for each node b at most TRIES nodes a of other components to verify.

    Under every key the nodes are ordered by a min-hash of their shared keys, so
    similar ones stand together, in the first turn by the number of their shared
    keys before that.  A node's candidates are the first of the key (in its task)
    and those just before it that may link; the ones met under most keys are taken."""
    held = F.count(F.lit(1)) if turn == 0 else F.lit(0)
    sign = members.groupBy("node").agg((-held).alias("held"), F.min(F.xxhash64(F.lit(turn), "key")).alias("sign"))
    about = sign.join(comp.withColumnRenamed("id", "node"), "node", "left").join(info, "node") \
        .select("node", "held", "sign", F.coalesce("component", "node").alias("comp"), "n",
                F.col("brief").alias("sketch"))
    order = ["key", "held", "sign", "node"]
    dealt = members.join(about, "node").select(*order, "comp", "n", "sketch") \
        .repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # of the last key: its first row and the last NEIGHBOURS rows
        for batch in batches:
            if not batch.num_rows:
                continue
            tab = pa.Table.from_batches([batch])
            old = 0 if rest is None else rest.num_rows
            tab = tab if rest is None else pa.concat_tables([rest, tab])
            rows = Rows(tab, t)
            new = np.arange(old, tab.num_rows)
            first = np.flatnonzero(np.append(True, rows.key[1:] != rows.key[:-1]))
            hub = first[np.searchsorted(first, new, side="right") - 1]
            a, b = [hub[new - hub > NEIGHBOURS]], [new[new - hub > NEIGHBOURS]]
            for step in range(1, NEIGHBOURS + 1):
                some = new[new - hub >= step]
                a.append(some - step)
                b.append(some)
            a, b = rows.may_link(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(rows.node[a]), pa.array(rows.node[b])], names=["a", "b"])
            start, end = int(first[-1]), tab.num_rows
            rest = tab.take(np.unique(np.append(start, np.arange(max(start, end - NEIGHBOURS), end))))
    met = dealt.mapInArrow(run, "a long, b long").groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"))
    best = Window.partitionBy("b").orderBy(F.desc("met"), "a")
    return met.withColumn("k", F.row_number().over(best)).where(F.col("k") <= TRIES).select("a", "b")


def near(pairs: DataFrame, info: DataFrame, t: int) -> DataFrame:
    """(a, b, distance) of the pairs whose sketches allow a link."""
    both = (pairs.join(info.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
            .join(info.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
            .where(100 * F.least("na", "nb") >= t * F.greatest("na", "nb")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (np.asarray(batch.column(c), np.int64) for c in ("na", "nb"))
            far = np.zeros(len(na), np.int64)
            for i, (x, y) in enumerate(zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(),
                                           strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                w = min(len(x), len(y))
                far[i] = np.bitwise_count(fold(x, w) ^ fold(y, w)).sum()
            ok = np.flatnonzero(far <= hamming_bound(na, nb, t))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(ok)), batch.column("b").take(pa.array(ok)),
                                              pa.array(far[ok])], names=["a", "b", "distance"])
    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long, distance long")


def verified(pairs: DataFrame, info: DataFrame, docs: DataFrame, width: int, t: int) -> DataFrame:
    """The pairs (a, b) whose sets really link."""
    links = []
    with stages_freed(but=links):
        links.append(_verified(pairs, info, docs, width, t))
    return links[0]


def _verified(pairs: DataFrame, info: DataFrame, docs: DataFrame, width: int, t: int) -> DataFrame:
    pairs = materialize(pairs.select("a", "b"), "jaccard-pairs")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    ids = materialize(info.join(wanted, "node", "left_semi").select("doc_id").distinct(), "jaccard-ids")
    small = ids.count() <= BROADCAST_IDS
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, buf, offs in chunks(batches, "text"):
            first, h = sets(buf, offs, width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes(first, h).view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(h.view(np.int64)))],
                names=["node", "set"])
    s = materialize(texts.mapInArrow(run, "node long, set array<bigint>"), "jaccard-sets").dropDuplicates(["node"])
    both = (pairs.join(s.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
            .join(s.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = batch.column("sa"), batch.column("sb")
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.asarray(c[i].values, np.int64).view(np.uint64) for c in (sa, sb))
                one = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * one >= t * (len(x) + len(y) - one)
            at = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)],
                                             names=["a", "b"])
    return materialize(both.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long"), "jaccard-links")


def crossing(members: DataFrame, few: DataFrame, comp: DataFrame, info: DataFrame, t: int) -> DataFrame:
    """Distinct (a, b) of different components under one key that may link; the keys
    of `few` hold `WHOLE` nodes at most and need no search for those still open."""
    m = materialize(placed(members, comp), "jaccard-placed")
    seen = m.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("size"))
    open_ = m.join(seen.where("x <> y").select("key", "size"), "key")
    # a pair meets under many open keys: rows name the node's keys just before theirs
    before = Window.partitionBy("node").orderBy("key").rowsBetween(-EARLIER, -1)
    open_ = open_.withColumn("before", F.collect_list("key").over(before))
    brief = F.col("brief").alias("sketch")
    wide = F.when(F.length("sketch") <= BRIEF_BITS // 8, F.col("sketch")).otherwise(F.col("brief")).alias("sketch")
    open_ = open_.join(info.select("node", "n", wide), "node")
    rest = (placed(few, comp).withColumn("size", F.lit(WHOLE).cast("long"))
            .withColumn("before", F.array().cast("array<bigint>")).join(info.select("node", "n", brief), "node"))
    # rows meet in pairs of blocks; a group of up to BLOCK nodes is one
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    met = open_.unionByName(rest).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own",
                     "node", "comp", "n", "sketch", "before")
    order = ["key", "i", "j"]
    dealt = met.repartition(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, found = None, []

        def gather(pairs):
            """A pair of nodes meets under many keys: once in each flush is enough."""
            if pairs is not None:
                found.append(pairs)
            if found and (pairs is None or sum(len(x) for x in found) > FLUSH):
                got = np.unique(np.concatenate(found), axis=0)
                found.clear()
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

        def groups(tab: pa.Table, cut: np.ndarray):
            """Small groups of a batch are compared together, a large one by itself."""
            size = np.diff(cut)
            few = np.flatnonzero(np.repeat(size <= SMALL_GROUP, size))
            if len(few):
                yield from gather(compared_small(tab.take(few), t))
            for g in np.flatnonzero(size > SMALL_GROUP).tolist():
                yield from gather(compared(tab.slice(int(cut[g]), int(size[g])), t))
        for batch in batches:
            tab = pa.Table.from_batches([batch])
            rest = tab if rest is None else pa.concat_tables([rest, tab])
            key, i, j = (np.asarray(rest.column(c)) for c in order)
            cut = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            if len(cut):
                yield from groups(rest, np.append(0, cut))
                rest = rest.slice(int(cut[-1]))
        if rest is not None and rest.num_rows:
            yield from groups(rest, np.array([0, rest.num_rows]))
        yield from gather(None)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def first_met(rows: pa.Table, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs of rows (a, b) as sorted nodes, without those known to have met under an
    earlier key: the first key of a pair always gives it.  Rows that name no earlier
    keys give all their pairs."""
    node = np.asarray(rows.column("node"), np.int64)
    if "before" in rows.column_names:
        before = rows.column("before").combine_chunks()
        there = np.arange(EARLIER) < np.asarray(before.value_lengths(), np.int64)[:, None]
        keys = np.zeros(there.shape, np.int64)
        keys[there] = np.asarray(before.flatten(), np.int64)
        new = np.ones(len(a), bool)
        both = np.flatnonzero(there[a, 0] & there[b, 0])
        for lo in range(0, len(both), FLUSH):
            p = both[lo: lo + FLUSH]
            x, y = a[p], b[p]
            for k in range(EARLIER):
                new[p] &= ~(there[x, k] & ((keys[x, k][:, None] == keys[y]) & there[y]).any(1))
        a, b = a[new], b[new]
    return np.sort(np.stack([node[a], node[b]], 1), axis=1)


def compared_small(tab: pa.Table, t: int) -> np.ndarray:
    """Pairs of rows with one key, at most SMALL_GROUP rows apart, that pass the bounds."""
    rows = Rows(tab, t)
    out = []
    for step in range(1, SMALL_GROUP):
        a = np.flatnonzero(rows.key[step:] == rows.key[:-step])
        if not len(a):
            break
        a, b = rows.may_link(a, a + step)
        out.append(np.stack([a, b]))
    return first_met(tab, *np.concatenate(out, axis=1)) if out else np.zeros((0, 2), np.int64)


def compared(rows: pa.Table, t: int) -> np.ndarray:
    """Pairs of one pair of blocks (i, j) that pass the size and Hamming bounds."""
    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    own, comp, n = (np.asarray(rows.column(c)) for c in ("own", "comp", "n"))
    raw = rows.column("sketch").to_pylist()
    out = []
    # sketches of one size class are compared at their full width, others folded
    by_width: dict[int, np.ndarray] = {}
    size = np.array([len(x) // 8 for x in raw])
    for w in np.unique(size).tolist():
        at = np.flatnonzero(size >= w)
        at = at[size[at] <= 2 * w]
        by_width[w] = at
    for w, at in by_width.items():
        x = np.stack([fold(np.frombuffer(raw[k], np.uint64), w) for k in at])
        left = np.flatnonzero(own[at] == i)
        right = np.flatnonzero(own[at] == j)
        for p in left.tolist():
            q = right[right > p] if i == j else right
            q = q[(size[at[q]] == w) | (size[at[p]] == w)]
            q = q[comp[at[q]] != comp[at[p]]]
            lo, hi = np.minimum(n[at[q]], n[at[p]]), np.maximum(n[at[q]], n[at[p]])
            q = q[100 * lo >= t * hi]
            if len(q):
                far = np.bitwise_count(x[q] ^ x[p]).sum(1)
                q = q[far <= hamming_bound(n[at[q]], n[at[p]], t)]
                out.append(np.stack([np.full(len(q), at[p]), at[q]]))
    return first_met(rows, *np.concatenate(out, axis=1)) if out else np.zeros((0, 2), np.int64)


def _labelled(docs: DataFrame, width: int, t: int) -> DataFrame:
    """(doc_id, n, c): every row with its component's least node (null: no words)."""
    all_ = materialize(described(docs, width, t), "jaccard-docs")
    pieces = all_.where("doc_id is not null").select("node", F.explode("keys").alias("key"))
    met = materialize(shared(pieces), "jaccard-members")
    few, members = met.where("few").select("key", "node"), met.where("not few").select("key", "node")
    held = met.select("node").distinct()
    info = materialize(all_.where("doc_id is not null").select("node", "n", "sketch", "brief", "doc_id")
                       .join(held, "node", "left_semi").dropDuplicates(["node"]), "jaccard-info")
    own = materialize(all_.select("doc_id", "n", "node"), "jaccard-nodes")
    drop_stage(all_)
    links = docs.sparkSession.createDataFrame([], "a long, b long")
    comp = components(links)
    for turn in range(ROUNDS):
        if turn:
            left = materialize(still_open(members, comp), "jaccard-left")
            drop_stage(members)
            members = left
        found = verified(near(partners(members, comp, info, t, turn), info, t), info, docs, width, t)
        if found.isEmpty():
            break
        links = links.unionByName(found)
        comp = components(links)
    more = near(crossing(members, few, comp, info, t), info, t)
    links = links.unionByName(verified(more, info, docs, width, t))
    comp = components(links).withColumnRenamed("id", "node")
    node_comp = F.when(F.col("n") > 0, F.coalesce("component", "node"))
    return materialize(own.join(comp, "node", "left").select("doc_id", "n", node_comp.alias("c")), "jaccard-labels")


def joined(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text)."""
    t = threshold
    if not 67 <= t <= 100:
        raise ValueError("the bands serve thresholds from 67 to 100 percent")
    docs = in_small_batches(docs).select("doc_id", "text")
    kept = []
    with stages_freed(but=kept):
        kept.append(_labelled(docs, width, t))
    labelled = kept[0]
    small = labelled.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("component"))
    return labelled.join(small, "c", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """One document of every group (the smallest doc_id; of repeated rows of it
    the first by content), with its own columns.  Rows without a doc_id stay."""
    kept = joined(docs, width, threshold).where(F.col("doc_id") == F.col("component_id"))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    one = rows.join(kept.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("k", F.row_number().over(order))
    return one.where("k = 1").select("row.*").unionByName(docs.where(docs["doc_id"].isNull()))
