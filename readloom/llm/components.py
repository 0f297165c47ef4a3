"""Connected components of a graph held in a DataFrame: alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import discard, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b), longs, but the roots themselves; root: the smallest node reachable.

    Each round hangs larger neighbours, then smaller ones, on the smallest node in sight, until nothing changes. A round
    shuffles the edges a few times and writes them to the shared folder; nothing but two sums reaches the driver. Nodes
    with very many neighbours meet only in a min(), combined before the shuffle, and in joins that may be split when skewed.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = now.union(now.select("v", "u"))
        # least tables are written, so that both sides of the joins are plain shuffles, which Spark splits when skewed
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = materialise(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        lower = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower)
        after = materialise(small.distinct(), "edges")
        for done in (now, least, large, lower):
            discard(done)
        now = after


def roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    found = parent[at]
    while True:
        up = parent[found]
        if np.array_equal(up, found):
            return found
        found = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i] for all i, in place; a set's root is its smallest member."""
    while len(a):
        a, b = roots(parent, a), roots(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
