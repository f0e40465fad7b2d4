"""Filter interaction audit: what each filter removes in every order of the filters.

Each document's failures are a bit mask.  All that the audit asks depends only on
how many documents of a part (a language) have which mask, so the corpus is
reduced to one row per part and mask.  The filters' orders are the paths through
the lattice of sets of filters already applied: a state is a set, an edge adds one
filter.  `lattice` counts the orders that reach every state (forward) and that
leave it to the full set (backward); an edge lies on reach * leave orders.  What an
edge removes is computed once and serves all orders through it: the step of each
order is read from its edge, and a filter's Shapley sum weights its edges' removals
by their numbers of orders.

Rows: a null text is the empty text, a null language the part ''; every row of
`documents` counts, repeated ones too.  A document repeats another when its text
equals that of any smaller doc_id, so rows that share the smallest doc_id of a text
are all first; a null doc_id is neither smaller than others nor ever a repeat.
Several label rows of one doc_id: good (toxic) if any says so; null labels say no.
Empty tables give an empty result, other columns are not looked at.  Texts of any
length are handled whole, one row at a time, on the JVM.

Scale: texts are read once and shuffled never; their SHA-256 stands for them.
Repeats need no join: per text the rows of each (part, label) class are counted with
partial sums, with their smallest doc_id, so a text that a third of all rows share is
some rows after the first shuffle's map side.  The lattice works on at most 2^n
masks a part.  `filter_order` lists n! orders, so n is meant to stay small.
"""

from __future__ import annotations

import json
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = r"[^\x20\x09-\x0D]+"


def text_filters(text: Column) -> list[tuple[str, Column]]:
    """The four filters of one text, as (letter, does it fail): few words, few
    distinct words, many capital letters, markup characters."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return [("A", n < 100),
            ("B", F.lit(100) * distinct < F.lit(80) * n),
            ("C", F.lit(100) * capitals > F.lit(10) * F.length(text)),
            ("D", text.rlike("[#$%&*|]"))]


def lattice(names: str) -> list[dict]:
    """The edges of the subset lattice of `names` (one letter a filter).

    reach[s] and leave[s] are counted edge by edge over the states in order of size,
    never by listing orders; the orders through an edge, which the result's rows are
    named by, are put together from the same forward and backward passes."""
    n, full = len(names), (1 << len(names)) - 1
    states = sorted(range(full + 1), key=lambda s: s.bit_count())
    reach, before = {0: 1}, {0: [""]}
    for s in states:
        for i in range(n):
            if not s >> i & 1:
                t = s | 1 << i
                reach[t] = reach.get(t, 0) + reach[s]
                before.setdefault(t, []).extend(b + names[i] for b in before[s])
    leave, after = {full: 1}, {full: [""]}
    for s in reversed(states[:-1]):
        onward = [i for i in range(n) if not s >> i & 1]
        leave[s] = sum(leave[s | 1 << i] for i in onward)
        after[s] = list(chain.from_iterable([names[i] + a for a in after[s | 1 << i]] for i in onward))
    return [{"state": s, "bit": 1 << i, "name": names[i], "step": s.bit_count() + 1,
             "paths": reach[s] * leave[s | 1 << i],
             "orders": [b + names[i] + a for b in before[s] for a in after[s | 1 << i]]}
            for s in states for i in range(n) if not s >> i & 1]


EDGE = "array<struct<state:int,bit:int,name:string,step:int,paths:bigint,orders:array<string>>>"


def masks(docs: DataFrame, labels: DataFrame, filters=text_filters, repeat: str = "E") -> tuple[str, DataFrame]:
    """(letters, (part, mask, n, n_good, n_toxic)): documents by their failures.
    Bit i of the mask is the i-th letter; `repeat`, the last, marks repeats."""
    named = filters(F.col("text"))
    bits = [F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, fails) in enumerate(named)]
    own = docs.select(docs["doc_id"], F.coalesce(docs["lang"], F.lit("")).alias("part"),
                      F.coalesce(docs["text"], F.lit("")).alias("text"))
    own = own.select("doc_id", "part", sum(bits[1:], bits[0]).alias("mask"),
                     F.unhex(F.sha2(F.col("text"), 256)).alias("digest"))
    rows = own.groupBy("digest", "mask", "part", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    says = [F.max(F.coalesce(labels[c] == 1, F.lit(False))).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))]
    rows = rows.join(labels.groupBy("doc_id").agg(*says), "doc_id", "left")
    rows = rows.na.fill(False, ["good", "toxic"])
    # the rows of one text and class: how many, and those of the smallest doc_id
    known = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "c"))
    nameless = F.when(F.col("doc_id").isNull(), F.col("c")).otherwise(F.lit(0))
    same = rows.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.sum("c").alias("n"), F.min(known).alias("first"), F.sum(nameless).alias("nameless"))
    lowest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    same = same.withColumn("lowest", lowest)
    firsts = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("lowest"), F.col("first.c")).otherwise(F.lit(0))
    last = F.lit(1 << len(named))
    both = F.explode(F.array(F.struct(F.col("mask"), firsts.alias("n")),
                             F.struct((F.col("mask") + last).alias("mask"), (F.col("n") - firsts).alias("n"))))
    split = same.select("part", "good", "toxic", both.alias("x"))
    out = split.groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.sum("x.n").alias("n"), F.sum(F.when(F.col("good"), F.col("x.n")).otherwise(F.lit(0))).alias("n_good"),
        F.sum(F.when(F.col("toxic"), F.col("x.n")).otherwise(F.lit(0))).alias("n_toxic"))
    return "".join(name for name, _ in named) + repeat, out


def edge_counts(letters: str, counted: DataFrame) -> DataFrame:
    """One row per part and lattice edge: what the edge keeps, removes and finds
    already removed, and its filter's Shapley sum."""
    edges = F.from_json(F.lit(json.dumps(lattice(letters))), EDGE)
    rows = counted.select("*", F.explode(edges).alias("e"))
    fails = F.col("mask").bitwiseAND(F.col("e.bit")) != 0
    reached = F.col("mask").bitwiseAND(F.col("e.state")) == 0

    def total(condition: Column, column: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(column)).otherwise(F.lit(0))).cast("bigint")

    # an edge is named by its state and bit; the other fields follow from them
    out = rows.groupBy("part", F.col("e.state").alias("state"), F.col("e.bit").alias("bit")).agg(
        F.first("e").alias("e"), total(reached & ~fails).alias("kept"), total(reached & fails).alias("removed"),
        total(fails & ~reached).alias("redundant"), total(F.col("mask") == F.col("e.bit")).alias("unique_fails"),
        total(reached & fails, "n_good").alias("good_lost"), total(reached & fails, "n_toxic").alias("toxic_lost"))
    weighted = F.sum(F.col("removed") * F.col("e.paths")).over(Window.partitionBy("part", "bit"))
    return out.withColumn("shapley", weighted.cast("bigint"))


def audit(docs: DataFrame, labels: DataFrame, filters=text_filters, repeat: str = "E") -> DataFrame:
    """One row per part, filter order and step: part, filter_order, step, filter,
    kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (the
    filter's removals summed over all orders)."""
    edges = edge_counts(*masks(docs, labels, filters, repeat))
    return edges.select("part", F.explode("e.orders").alias("filter_order"), F.col("e.step").alias("step"),
                        F.col("e.name").alias("filter"), "kept", "removed", "redundant", "unique_fails",
                        "good_lost", "toxic_lost", "shapley")
