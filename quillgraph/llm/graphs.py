"""Connected components over edge tables, and union-find inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import spread_lookup
from .storage import Scratch


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' component, by repeated minima."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        apart = low != high
        a, b = a[apart], b[apart]
        if not len(a):
            break
        np.minimum.at(root, high[apart], low[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


#: Edges of a graph that one task joins by itself; larger ones go by rounds.
ONE_TASK = 1 << 16


def _join_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if parts:
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = forest(len(nodes), at[: len(a)], at[len(a) :])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of every node of edges (a, b), longs: root is the component's smallest node.

    Alternates large and small stars, each a minimum by node and a lookup of
    it, until nothing changes.  The minima are combined before the shuffle and
    a hot node's edges are looked up in a broadcast, so no task gets a whole
    component.  Every round is written to the shared folder.  A graph of at
    most ONE_TASK edges, counted first, is joined by one task instead.
    """

    def told(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def with_least(df: DataFrame, n: int) -> DataFrame:
        low = df.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("__c"))
        return spread_lookup(df, low, "a", "__c", n)

    now = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    before, k = told(now), 0
    if before[0] <= ONE_TASK:
        return scratch.keep(now.coalesce(1).mapInArrow(_join_all, "node long, root long"), f"{name}-joined")
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both, 2 * before[0]).filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        each = with_least(large, before[0])  # at most as many edges as before: an edge gives one
        # every node but the smallest has an edge to its least neighbour here; the others' go to that neighbour
        small = each.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        k += 1
        now = scratch.keep(small, f"{name}-{k}")
        after = told(now)
        scratch.drop(f"{name}-{k - 1}")
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
