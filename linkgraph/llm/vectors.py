"""Near-duplicate vectors by sorted projection passes.

Each of `passes` passes concatenates the signs of `BITS` random projections of
every vector and orders the vectors lexicographically by them (within equal
label and dimension; equal signs by a hash that differs from pass to pass).
Every vector is compared with its next `window` neighbours in that order, and
further as long as one of the last `window` of them linked, so dense groups
are not cut off at the window.  Pairs with a cosine (double precision) of at
least `threshold` are links; the links of all passes are united.

Copies of one vector (equal label and components) are one class: its smallest
vec_id takes part and carries the number of copies.  Classes whose directions
are at most `SPREAD` apart (scaled copies, rounding noise) form a cell with one
class as its head: they link with each other, and only heads take part in the
passes.  Two heads whose cosine is further than `SLACK` from the threshold
decide for all members of their cells; else the members are compared.

Scale: the order of all passes is one range shuffle of narrow rows, so a label
with a third of all rows spreads over many tasks.  Blocks of equal size (by
rows and bytes, so the same for any number of partitions) are compared inside;
rows whose run has not ended at their block's end are carried to the next
block, and on as long as they link, so the result does not depend on the
blocks.  A pass is approximate (recall is measured in the tests against all
pairs).  Links between different cells are listed one by one: a group of g
cells that all link makes g * (g - 1) / 2 rows, in each pass that finds them.

Defined results: vectors that are null, empty or zero, that hold null or
non-finite components, or have a null label link with nothing and are their
own component; repeated rows of one vec_id are rows of one class; an empty
table gives no links.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.llm.components import components
from linkgraph.sources.store import materialize

BITS = 48
PASSES = 24
WINDOW = 32
PART_ROWS = 50_000
PART_BYTES = 64 << 20
BLOCKS = 64  # of a small table
EMIT = 1 << 16
SPREAD = 1e-6
SLACK = 4 * SPREAD
GRID = 1 << 14


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: vec_id, rep; classes: rep, copies, label, embedding)."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0),
                        F.lit(False))
    rows = vectors.select("vec_id", "label", F.transform(e, lambda x: x.cast("double") + 0.0).alias("embedding"),
                          usable.alias("ok")).where("vec_id is not null and ok")
    keyed = rows.select("vec_id", "label", "embedding", F.xxhash64("label", "embedding").alias("k1"),
                        F.xxhash64(F.lit(7), "embedding", "label").alias("k2"))
    found = materialize(keyed.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"),
                                                      F.count_distinct("vec_id").alias("copies")), "vector-classes")
    members = keyed.select("vec_id", "k1", "k2").join(found, ["k1", "k2"]).select("vec_id", "rep").distinct()
    reps = keyed.join(found.select("k1", "k2", F.col("rep").alias("vec_id"), "copies"), ["k1", "k2", "vec_id"])
    reps = reps.dropDuplicates(["vec_id", "k1", "k2"])
    return members, reps.select(F.col("vec_id").alias("rep"), "copies", "label", "embedding")


def units(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, their unit vectors) for each dimension in a list column."""
    dims = np.asarray(col.value_lengths(), np.int64)
    flat = np.asarray(col.flatten(), np.float64)
    first = np.cumsum(dims) - dims
    for d in np.unique(dims).tolist():
        who = np.flatnonzero(dims == d)
        x = flat[first[who][:, None] + np.arange(d)]
        x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
        yield d, who, x / np.sqrt((x * x).sum(1, keepdims=True))


def cells(reps: DataFrame) -> DataFrame:
    """(rep, copies, cell): classes of one direction, by the smallest rep among them."""
    def directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit: list[bytes] = [b""] * batch.num_rows
            grid: list[bytes] = [b""] * batch.num_rows
            for _, who, x in units(batch.column("embedding")):
                for k, v, g in zip(who.tolist(), x, np.rint(x * GRID).astype(np.int32), strict=True):
                    unit[k], grid[k] = v.tobytes(), g.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("copies"), batch.column("label"), pa.array(unit, pa.binary()),
                 pa.array(grid, pa.binary())], names=["rep", "copies", "label", "unit", "grid"])

    rows = reps.select("rep", "copies", F.col("label").cast("string").alias("label"), "embedding").mapInArrow(
        directions, "rep long, copies long, label string, unit binary, grid binary")
    rows = materialize(rows.select("rep", "copies", "label", "unit", F.length("grid").alias("dim"),
                                   F.xxhash64("grid").alias("key")), "vector-units")
    head = F.min(F.struct("rep", "unit")).alias("head")
    shared = (rows.groupBy("label", "dim", "key").agg(head, F.count("*").alias("n")).where("n > 1")
              .select("label", "dim", "key", F.col("head.rep").alias("head"), F.col("head.unit").alias("at")))
    rows = rows.join(shared, ["label", "dim", "key"], "left").select("rep", "copies", "unit", "head", "at")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("rep").to_pylist()
            for k, (u, h, v) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("unit", "head", "at")),
                                              strict=True)):
                if h is not None and np.linalg.norm(np.frombuffer(u) - np.frombuffer(v)) <= SPREAD:
                    cell[k] = h
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("copies"),
                                              pa.array(cell, pa.int64())], names=["rep", "copies", "cell"])

    return materialize(rows.mapInArrow(near, "rep long, copies long, cell long"), "vector-cells")


def with_codes(reps: DataFrame, passes: int, seed: int) -> DataFrame:
    """(rep, label, dim, vec, codes), a code for each pass; vec is the unit vector as bytes."""
    rows = reps.select("rep", F.col("label").cast("string").alias("label"), "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weight = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            dims = np.asarray(batch.column("embedding").value_lengths(), np.int64)
            codes = np.zeros((len(dims), passes), np.int64)
            packed: list[bytes] = [b""] * len(dims)
            for d, who, x in units(batch.column("embedding")):
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).normal(size=(d, passes * BITS))
                for i in range(0, len(who), 1024):
                    signs = (x[i: i + 1024] @ planes[d] > 0).reshape(-1, passes, BITS)
                    codes[who[i: i + 1024]] = signs @ weight
                for k, v in zip(who.tolist(), x, strict=True):
                    packed[k] = v.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("label"), pa.array(dims.astype(np.int32)),
                 pa.array(packed, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(dims) + 1) * passes, pa.int32()),
                                          pa.array(codes.ravel()))], names=["rep", "label", "dim", "vec", "codes"])

    out = rows.mapInArrow(run, "rep long, label string, dim int, vec binary, codes array<bigint>")
    return materialize(out, "vector-codes")


def alike(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (x[i], y[j]), which have a cosine of at least `least`, and the cosines of these."""
    ok, cos = [np.zeros(0, np.int64)], [np.zeros(0)]
    for k in range(0, len(i), 8192):
        c = np.einsum("ij,ij->i", x[i[k: k + 8192]], y[j[k: k + 8192]])
        at = np.flatnonzero(c >= least)
        ok.append(at + k)
        cos.append(c[at])
    return np.concatenate(ok), np.concatenate(cos)


def inside(rep: np.ndarray, x: np.ndarray, window: int, least: float, open_: list) -> Iterator[tuple]:
    """(rep, rep, cosine) of the links among rows in order.  `open_` gets the rows
    whose run has not ended at the last row, and the comparisons since their last link."""
    n = len(rep)
    low = x.astype(np.float32)
    live = np.arange(n)
    last = np.zeros(n, np.int64)  # distance of the last link, or of the start
    d = 1
    while len(live):
        end = live[live + d >= n]
        open_.append((rep[end], d - 1 - last[end]))
        live = live[live + d < n]
        for i in range(0, len(live), 8192):
            a = live[i: i + 8192]
            near = a[np.einsum("ij,ij->i", low[a], low[a + d]) >= least - 1e-4]
            ok, cos = alike(x, x, near, near + d, least)
            near = near[ok]
            last[near] = d
            yield rep[near], rep[near + d], cos
        d += 1
        live = live[d - last[live] <= window]


def onward(rep: np.ndarray, since: np.ndarray, x: np.ndarray, rep2: np.ndarray, y: np.ndarray, window: int,
           least: float, open_: list) -> Iterator[tuple]:
    """The same for carried rows `rep`, which go on with the rows `rep2` in order."""
    low, low2 = x.astype(np.float32), y.astype(np.float32)
    since = since.copy()
    live = np.arange(len(rep))
    for at in range(0, len(rep2), 64):
        for i in range(0, len(live), 1024):
            who = live[i: i + 1024]
            r, c = np.nonzero(low[who] @ low2[at: at + 64].T >= least - 1e-4)
            ok, cos = alike(x, y, who[r], at + c, least)
            r, c = r[ok], c[ok]
            link = np.zeros((len(who), min(64, len(rep2) - at)), bool)
            link[r, c] = True
            met, gap = np.zeros_like(link), since[who]
            for k in range(link.shape[1]):
                met[:, k] = gap < window
                gap = np.where(gap < window, np.where(link[:, k], 0, gap + 1), gap)
            since[who] = gap
            ok = met[r, c]
            yield rep[who[r[ok]]], rep2[at + c[ok]], cos[ok]
        live = live[since[live] < window]
    open_.append((rep[live], since[live]))


def batches_of(found: Iterator[tuple], sure: float) -> Iterator[pa.RecordBatch]:
    """Link rows in batches of about EMIT."""
    held, n = [], 0

    def batch() -> pa.RecordBatch:
        a, b, cos = (np.concatenate(x) for x in zip(*held, strict=True))
        none = [pa.nulls(len(a), t) for t in (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)),
                                           pa.array(cos >= sure), *none], names=FIELDS)

    for x in found:
        if len(x[0]):
            held.append(x)
            n += len(x[0])
        if n >= EMIT:
            yield batch()
            held, n = [], 0
    if held:
        yield batch()


def carried(piece: int, key: tuple, open_: list) -> pa.RecordBatch:
    """Rows that go on in a piece."""
    rep, since = (np.concatenate(x) for x in zip(*open_, strict=True))
    k = len(rep)
    none = [pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.bool_())]
    return pa.RecordBatch.from_arrays(
        [*none, pa.array([piece] * k, pa.int64()), pa.array([key[0]] * k, pa.int32()),
         pa.array([key[1]] * k, pa.string()), pa.array([key[2]] * k, pa.int32()), pa.array(rep, pa.int64()),
         pa.array(since, pa.int64())], names=FIELDS)


FIELDS = ["a", "b", "sure", "piece", "pass", "label", "dim", "rep", "since"]
SCHEMA = ("a long, b long, sure boolean, piece long, pass int, label string, dim int, rep long, since long")


def passes_of(reps: DataFrame, threshold: float, slack: float, passes: int, window: int, seed: int) -> DataFrame:
    """Distinct (a, b, sure), a < b, of the classes with a cosine of at least
    threshold - slack; sure from threshold + slack on."""
    codes = with_codes(reps, passes, seed)
    vecs = codes.select("rep", "vec")
    n, widest = codes.agg(F.count("*"), F.max("dim")).first()
    n *= passes
    size = max(8 * window, min(PART_ROWS, PART_BYTES // (8 * (widest or 1)), -(-n // BLOCKS)))
    first_piece = 2 * window  # most runs end there, so the rest of a block is read for few
    least = threshold - slack
    rows = codes.select("rep", "label", "dim", F.posexplode("codes").alias("pass", "code"))
    rows = rows.withColumn("tie", F.xxhash64(F.lit(seed), "pass", "rep"))
    order = ["pass", "label", "dim", "code", "tie", "rep"]
    rows = rows.repartitionByRange(max(1, -(-n // size)), *order).sortWithinPartitions(*order)
    rows = rows.select("pass", "label", "dim", "rep", F.spark_partition_id().alias("part"),
                       (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("seq"))
    rows = materialize(rows, "vector-order")
    start, starts = 0, []  # a number for each partition
    for r in sorted(rows.groupBy("part").count().collect()):
        starts.append((r["part"], start))
        start += r["count"]
    starts = reps.sparkSession.createDataFrame(starts, "part int, start long")
    rows = rows.join(F.broadcast(starts), "part").withColumn("pos", F.col("start") + F.col("seq"))
    block, late = F.floor(F.col("pos") / F.lit(size)), F.col("pos") % F.lit(size) >= first_piece
    rows = rows.select("pass", "label", "dim", "rep", "pos", block.alias("block"),
                       (2 * block + late.cast("long")).alias("piece"))

    def matrix(t: pa.Table, dim: int) -> np.ndarray:
        return np.frombuffer(b"".join(t.column("vec").to_pylist()), np.float64).reshape(t.num_rows, dim)

    def in_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("pos")
        key = list(zip(*(t.column(c).to_pylist() for c in ("pass", "label", "dim")), strict=True))
        cuts = [0, *[i for i in range(1, len(key)) if key[i] != key[i - 1]], len(key)]
        rep = np.asarray(t.column("rep"))
        open_: list = []

        def found() -> Iterator[tuple]:
            for i, j in itertools.pairwise(cuts):
                open_.clear()  # only the last group can go on
                yield from inside(rep[i:j], matrix(t.slice(i, j - i), key[i][2]), window, least, open_)

        yield from batches_of(found(), threshold + slack)
        yield carried(2 * t.column("block")[0].as_py() + 2, key[-1], open_)

    def in_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("pos")
        k = int((np.asarray(t.column("pos")) < 0).sum())
        if k == t.num_rows:  # the group has no row there
            return
        key = tuple(t.column(c)[0].as_py() for c in ("pass", "label", "dim"))
        mine, there = t.slice(0, k), t.slice(k)
        open_: list = []
        yield from batches_of(onward(np.asarray(mine.column("rep")), np.asarray(mine.column("since")),
                                     matrix(mine, key[2]), np.asarray(there.column("rep")), matrix(there, key[2]),
                                     window, least, open_), threshold + slack)
        yield carried(t.column("piece")[0].as_py() + 1, key, open_)

    step = materialize(rows.join(vecs, "rep").groupBy("block").applyInArrow(in_block, SCHEMA), "vector-pairs")
    pairs, group = step, ["piece", "pass", "label", "dim"]
    while not (going := step.where("piece is not null")).isEmpty():
        met = rows.join(F.broadcast(going.select(*group).distinct()), group, "left_semi")
        both = going.select(*group, "rep", "since", F.lit(-1).cast("long").alias("pos")).unionByName(
            met.select(*group, "rep", F.lit(0).cast("long").alias("since"), "pos"))
        step = materialize(both.join(vecs, "rep").groupBy("piece").applyInArrow(in_piece, SCHEMA), "vector-pairs")
        pairs = pairs.unionByName(step)
    return pairs.where("a is not null").select("a", "b", "sure").distinct()


def links(reps: DataFrame, threshold: float, passes: int = PASSES, window: int = WINDOW, seed: int = 4) -> DataFrame:
    """Distinct (a, b), a < b, of the linked classes."""
    return passes_of(reps, threshold, 0.0, passes, window, seed).select("a", "b")


def exact(unsure: DataFrame, cell: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b, cell_a, cell_b) of the linked classes in pairs of cells."""
    rows = cell.join(reps.select("rep", "embedding"), "rep").select("rep", "cell", "embedding")
    both = (unsure.select(F.col("a").alias("cell_a"), F.col("b").alias("cell_b"))
            .join(rows.select(F.col("cell").alias("cell_a"), F.col("rep").alias("a"), F.col("embedding").alias("x")),
                  "cell_a")
            .join(rows.select(F.col("cell").alias("cell_b"), F.col("rep").alias("b"), F.col("embedding").alias("y")),
                  "cell_b").select("a", "b", "cell_a", "cell_b", "x", "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for (_, who, x), (_, _, y) in zip(units(batch.column("x")), units(batch.column("y")), strict=True):
                keep[who] = np.einsum("ij,ij->i", x, y) >= threshold
            yield batch.select(["a", "b", "cell_a", "cell_b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long, cell_a long, cell_b long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, passes: int = PASSES,
                    window: int = WINDOW) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `vectors`."""
    members, reps = classes(vectors)
    reps = materialize(reps, "vector-reps")
    if threshold + SLACK < 1:
        cell, slack = cells(reps), SLACK
    else:  # members of a cell need not link
        cell, slack = reps.select("rep", "copies", F.col("rep").alias("cell")), 0.0
    whole = cell.groupBy("cell").agg(F.sum("copies").alias("size"))
    heads = reps.join(cell.where("rep = cell").select("rep"), "rep", "left_semi")
    pairs = materialize(passes_of(heads, threshold, slack, passes, window, 4), "vector-links")
    single = materialize(exact(pairs.where("not sure"), cell, reps, threshold), "vector-exact")

    def others(pairs: DataFrame, counts: DataFrame, name: str) -> DataFrame:
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        return both.join(counts.toDF("b", "k"), "b").groupBy("a").agg(F.sum("k").alias(f"n_{name}")) \
            .withColumnRenamed("a", name)

    edges = pairs.where("sure").select("a", "b").unionByName(
        single.select(F.col("cell_a").alias("a"), F.col("cell_b").alias("b")).distinct())
    comp = components(edges).withColumnRenamed("id", "cell")
    per_cell = whole.join(others(pairs.where("sure"), whole, "cell"), "cell", "left").join(comp, "cell", "left")
    n = F.coalesce("n_cell", F.lit(0)) + F.coalesce("n_rep", F.lit(0)) + F.col("size") - 1
    info = (cell.join(per_cell, "cell").join(others(single, cell.select("rep", "copies"), "rep"), "rep", "left")
            .select("rep", n.alias("n"), F.coalesce("component", "cell").alias("component")))
    known = members.join(info, "rep").select("vec_id", "n", "component")
    component = F.coalesce("component", "vec_id")
    return vectors.select("vec_id").join(known, "vec_id", "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"))
