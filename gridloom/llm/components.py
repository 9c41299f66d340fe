"""Connected components of a distributed graph, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialise, release, small_or_shuffled


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches by the edges."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        different = root[i] != root[j]
        i, j = np.concatenate([i[different], root[i[different]]]), np.concatenate([j[different], root[j[different]]])
    return root


def _star_ends(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b) with the least of a and all its partners, and the table of these to release. The minimum is combined before
    the shuffle, written, and joined back, so that a node with many partners is no group in one task: adaptive execution
    splits only joins whose sides are plain shuffles."""
    least = materialise(pairs.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least")), "least")
    return pairs.join(small_or_shuffled(least), "a"), least


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node is either a root or has a single edge, to a root."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("root"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("root")))
    roles = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("root").alias("root"))
    return roles.filter(F.col("child") + F.col("root") > 1).filter("child > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of all nodes that stand in ``edges`` (columns u and v); the component is its least node.

    Loops, repeated edges and both directions are allowed; edges with a null end are left out. The result
    is a materialised table. Rounds grow with the logarithm of the longest path; edges that are stars
    already take none.
    """
    forward = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = materialise(forward.filter(edges["u"].isNotNull() & edges["v"].isNotNull() & (F.col("u") != F.col("v"))).distinct(), "edges")
    while not _is_forest_of_stars(now):
        both = now.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(now.select(F.col("v").alias("a"), F.col("u").alias("b")))
        ends, first = _star_ends(both)
        large = materialise(ends.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a > b").distinct(), "large")
        small, second = _star_ends(large)
        linked = small.select(F.col("b").alias("u"), F.col("least").alias("v")).unionByName(small.select(F.col("a").alias("u"), F.col("least").alias("v")))
        after = materialise(linked.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        release(now, first, second, large)
        now = after
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
