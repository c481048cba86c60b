"""MinHash near-duplicates with tensored banding.

A table key is a pair of sub-keys, one from each of two small collections, so ``per_side`` squared
tables need only ``2 * per_side * rows`` minhashes instead of ``per_side ** 2 * 2 * rows``. A pair of
documents with similarity ``s`` meets in some table with probability
``(1 - (1 - s ** rows) ** per_side) ** 2``: 0.9995 at 0.8 and more than 0.9999 from 0.85 on with the
values used here, and pairs that do not meet in one need not be compared.

Steps, all between Spark shuffles:

1. One pass over the texts gives each document its set size, set fingerprint and sub-keys. Documents
   with equal sets form a class; from here on a class is one node, named by its smallest doc_id, so
   thousands of copies cost one row.
2. Sub-keys that no second class has are dropped; most documents end here.
3. Rounds: each document is verified against a pivot of its sub-keys, on the full sets. Two documents
   meet in a table if they share a sub-key of each collection, so the tables themselves are never formed:
   a document has a row for each sub-key in which several components still meet, at most ``2 * per_side``,
   and a group of near copies soon has none. Those documents are tried against the pivots of their
   sub-keys, and the rest against all members of other components that a prefix filter, which is
   exact, does not rule out. No link between components is lost.

Defined cases: NULL and empty texts and texts without words have an empty set and are linked with
nothing; with fewer words than a shingle the whole sequence is the only one. Rows with one doc_id are one
document and stay or go together. Rows without doc_id are named by their texts, after all ids; a
component of such rows only has a NULL id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outlay.llm.common import materialise
from outlay.llm.components import components
from outlay.llm.shingles import MULTIPLIER, WordHashes, as_signed, mix, shingle_set, words_of

NAMELESS = 1 << 62  # names of documents without an id begin here


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * MULTIPLIER) | np.uint64(1)


def minima(x: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The minhashes of a set, in blocks, so that a very long text needs no large matrix."""
    step = max(1, 2_000_000 // len(multipliers))
    blocks = [(multipliers[:, None] * x[None, i : i + step]).min(axis=1) for i in range(0, len(x), step)]
    return np.minimum.reduce(blocks)


def signatures(docs: DataFrame, k: int, per_side: int, rows: int) -> DataFrame:
    """``doc_id, n_shingles, cls, keys`` of every row; ``cls`` names the set, ``keys`` are NULL if it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, mult = WordHashes(), _multipliers(2 * per_side * rows)
        slots = np.arange(1, 2 * per_side + 1, dtype=np.uint64)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                size, cls, keys = [], [], []
                for text in part.column("text"):
                    x = shingle_set(words_of(text.as_py()), k, hashes)
                    size.append(len(x))
                    if not len(x):
                        cls.append(None)
                        keys.append(None)
                        continue
                    total = np.array([x.sum(), (mix(x) * MULTIPLIER).sum(), len(x)], np.uint64)
                    cls.append(int(as_signed(mix(mix(mix(total[:1]) + total[1:2]) + total[2:]))[0]))
                    low = minima(x, mult).reshape(2 * per_side, rows)
                    key = slots.copy()
                    for j in range(rows):
                        key = mix(key * MULTIPLIER + low[:, j])
                    keys.append(as_signed(key))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(size, pa.int64()), pa.array(cls, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "cls", "keys"],
                )

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, cls bigint, keys array<bigint>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """``node, n, items``: the sorted hashes of a document's shingles as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sets = [shingle_set(words_of(t.as_py()), k, hashes) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "n", "items"])

    return docs.mapInArrow(run, "node bigint, n bigint, items binary")


@F.pandas_udf(T.LongType())
def common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Size of the intersection of two sorted sets."""

    def one(x: bytes, y: bytes) -> int:
        x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        return int((y[at] == x).sum()) if len(y) else 0

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="int64")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, linked`` of the pairs, by the exact similarity of their full sets."""
    left = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("items").alias("xb"))
    right = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("items").alias("xa"))
    # The smaller set has to hold enough of the larger one for its size alone.
    possible = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    both = pairs.join(left, "b").join(right, "a")
    inter = F.when(possible, common("xa", "xb")).otherwise(F.lit(0))
    return both.select("a", "b", inter.alias("i"), "na", "nb").select("a", "b", (100 * F.col("i") >= percent * (F.col("na") + F.col("nb") - F.col("i"))).alias("linked"))


def shared_keys(classes: DataFrame, per_side: int) -> DataFrame:
    """``node, slot, key`` of the sub-keys with several classes, of nodes that have such on both sides.

    Only these nodes can meet another one in a table.
    """
    keys = classes.select("node", F.posexplode("keys").alias("slot", "key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return on_both_sides(keys.join(shared, "key"), per_side)


def on_both_sides(alive: DataFrame, per_side: int) -> DataFrame:
    """The rows of nodes that have sub-keys from both collections, and so can meet another one in a table."""
    sides = alive.groupBy("node").agg(F.min("slot").alias("first"), F.max("slot").alias("last"))
    return alive.join(sides.where((F.col("first") < per_side) & (F.col("last") >= per_side)).select("node"), "node")


def open_keys(keys: DataFrame, found: DataFrame, per_side: int) -> DataFrame:
    """``node, slot, key, component`` of the sub-keys that hold several of the components ``found``.

    The members of a table share both its sub-keys, so two components that meet in a table meet in two of
    these sub-keys. A node has at most ``2 * per_side`` rows here, and ``per_side ** 2`` tables.
    """
    named = materialise(keys.join(found, "node", "left").select("node", "slot", "key", F.coalesce("component", "node").alias("component")), "named")
    several = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    return materialise(on_both_sides(named.join(several, "key"), per_side), "open")


def set_items(sets: DataFrame) -> DataFrame:
    """``node, item`` for every shingle of every set."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                found = [np.frombuffer(x.as_py(), np.int64) for x in part.column("items")]
                nodes = np.repeat(part.column("node").to_numpy(zero_copy_only=False), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate([np.empty(0, np.int64), *found]))], ["node", "item"])

    return sets.mapInArrow(items, "node bigint, item bigint")


def within_reach(sets: DataFrame, percent: int) -> DataFrame:
    """``node, n`` of the sets that have enough shingles in common with others to have a link at all."""
    single = set_items(sets).groupBy("item").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    alone = single.groupBy("node").agg(F.count("*").alias("alone"))
    return sets.join(alone, "node", "left").where(100 * (F.col("n") - F.coalesce("alone", F.lit(0))) >= percent * F.col("n")).select("node", "n")


def prefix_pairs(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """``a, b``: the pairs of different components that the prefix filter lets pass, among them all links.

    Shingles are ordered by rarity. Linked sets have their first common shingle early in both: behind it
    there must be room for the overlap that a link needs. ``labels`` has ``node, component, stranger``;
    one node of a pair is a stranger. Rare shingles come first, so a common passage gives no pairs.
    """
    rows = materialise(set_items(sets), "items")
    shared = rows.groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
    known = rows.join(shared, "item")
    sizes = sets.select("node", "n").join(known.groupBy("node").agg(F.count("*").alias("m")), "node")
    order = W.partitionBy("node").orderBy("df", "item")
    placed = known.withColumn("i", F.row_number().over(order)).join(sizes, "node").withColumn("at", F.col("n") - F.col("m") + F.col("i"))
    prefix = placed.where(100 * (F.col("at") - 1) <= (100 - percent) * F.col("n")).join(labels, "node")
    prefix = materialise(prefix.select("node", "item", "n", "at", "component", "stranger"), "prefixes")
    x = prefix.where("stranger").select("item", *[F.col(c).alias(f"{c}_x") for c in ("node", "n", "at", "component")])
    y = prefix.select("item", *[F.col(c).alias(f"{c}_y") for c in ("node", "n", "at", "component")])
    most = 1 + F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    met = x.join(y, "item").where("component_x <> component_y").where((100 + percent) * most >= percent * (F.col("n_x") + F.col("n_y")))
    return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def near_links(keys: DataFrame, sets: DataFrame, percent: int, per_side: int) -> DataFrame:
    """``a, b``: verified links that connect whatever the links within the tables connect.

    The pivot of a sub-key is its member with the most of them. Round 1 tries each node against the best
    pivot of its sub-keys; a group of near copies is connected after it, and so has no open sub-key.
    Round 2 tries the members of open sub-keys against the pivots they are not connected with yet. Round 3
    tries what is left between different components, of sub-keys that still have several, as far as exact
    bounds allow a link.
    """

    def ranked_pivots(rows: DataFrame, *more: str) -> DataFrame:
        # A node that meets others at many places is close to many, as the origin of a group of copies is.
        degree = rows.groupBy("node").agg(F.count("*").alias("degree"))
        ranked = rows.join(degree, "node").withColumn("rank", F.struct("degree", (-F.col("node")).alias("low"), *more))
        return ranked.groupBy("key").agg(F.max("rank").alias("rank"))

    def ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
        return pairs.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()

    best = keys.join(ranked_pivots(keys), "key").groupBy("node").agg(F.max("rank").alias("rank"))
    done = materialise(verified(ordered(best.select("node", (-F.col("rank.low")).alias("pivot")), "node", "pivot"), sets, percent), "verified")
    links = done.where("linked").select("a", "b")

    open_ = open_keys(keys, components(links), per_side)
    pivots = ranked_pivots(open_, "component").select("key", (-F.col("rank.low")).alias("pivot"), F.col("rank.component").alias("own"))
    tried = ordered(open_.join(pivots, "key").where("component <> own"), "node", "pivot")
    more = materialise(verified(tried.join(done, ["a", "b"], "left_anti"), sets, percent), "verified")
    links, done = links.union(more.where("linked").select("a", "b")), done.union(more).select("a", "b")

    open_ = open_keys(open_.drop("component"), components(links), per_side)
    largest = open_.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("component", "n").alias("largest"))
    # One node of a pair lies outside a sub-key's largest component; a sub-key of near copies has few of those.
    labels = open_.join(largest, "key").groupBy("node", "component").agg(F.max(F.col("component") != F.col("largest")).alias("stranger"))
    labels = materialise(labels, "labels")
    able = materialise(within_reach(sets.join(labels.select("node"), "node", "left_semi"), percent), "able")
    left = prefix_pairs(sets.join(able.select("node"), "node", "left_semi"), labels, percent)
    rest = materialise(verified(left.join(done, ["a", "b"], "left_anti"), sets, percent), "verified")
    return links.union(rest.where("linked").select("a", "b"))


def identity() -> Column:
    """The doc_id; for a row without one a number beyond all ids that its text decides."""
    hashed = F.shiftrightunsigned(F.xxhash64("text"), 3) + NAMELESS
    return F.coalesce(F.col("doc_id").cast("bigint"), hashed).alias("doc_id")


def grouped(docs: DataFrame, k: int, percent: int, per_side: int, rows: int) -> DataFrame:
    """``doc_id, n_shingles, component`` of every row of ``docs``, whose ids are not NULL."""
    signed = materialise(signatures(docs, k, per_side, rows), "signatures")
    named = signed.where("cls is not null")
    classes = materialise(named.groupBy("cls").agg(F.min("doc_id").alias("node")), "classes")
    firsts = named.join(classes, "cls").where("doc_id = node")
    # One row for each class, also where a document is repeated.
    firsts = firsts.groupBy("cls", "node").agg(F.any_value("keys").alias("keys"))
    keys = materialise(shared_keys(firsts, per_side), "keys")
    wanted = materialise(keys.select("node").distinct(), "wanted")
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(wanted, "node", "left_semi")
    sets = materialise(shingle_sets(texts, k), "sets")
    found = materialise(components(near_links(keys, sets, percent, per_side)), "components")
    # Classes that share a doc_id are one document, and so one node.
    by_class = classes.join(found, "node", "left").select("cls", F.coalesce("component", "node").alias("component"))
    out = signed.drop("keys").join(by_class, "cls", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, per_side: int = 16, rows: int = 4) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs`` (``doc_id, text``).

    Linked: at least ``percent`` per cent of the union of the two shingle sets is in both. The component
    is named by the smallest doc_id that links reach, and that document is kept.
    """
    out = grouped(docs.select(identity(), F.col("text").cast("string")), k, percent, per_side, rows)
    named = [F.when(F.col(c) < NAMELESS, F.col(c)).alias(n) for c, n in (("doc_id", "doc_id"), ("component", "component_id"))]
    return out.select(named[0], "n_shingles", named[1], (F.col("doc_id") == F.col("component")).alias("kept"))


def keep_firsts(docs: DataFrame, k: int = 5, percent: int = 80, per_side: int = 16, rows: int = 4) -> DataFrame:
    """``docs`` without the documents that have a near copy with a smaller id in their component."""
    out = grouped(docs.select(identity(), F.col("text").cast("string")), k, percent, per_side, rows)
    gone = materialise(out.where("doc_id <> component").select(F.col("doc_id").alias("__id")).distinct(), "near-copies")
    return docs.withColumn("__id", identity()).join(gone, "__id", "left_anti").select(*docs.columns)
