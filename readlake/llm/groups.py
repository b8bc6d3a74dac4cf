"""Joins of rows with one row per group, and connected components, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.llm._shared import Scratch

#: Groups with over a thousandth of all rows are a thousand at most, and are joined by broadcast.
HEAVY_PART = 1000


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, n: int) -> DataFrame:
    """Inner join of rows with groups (one row for each key, whose column size counts its rows) when a key may hold most rows."""
    heavy = F.col(size) > max(HEAVY_PART, n // HEAVY_PART)
    in_heavy = rows.join(F.broadcast(groups.where(heavy)), key)
    rest = rows.join(F.broadcast(groups.where(heavy).select(key)), key, "left_anti")
    return in_heavy.unionByName(rest.join(groups.where(~heavy), key))


def _star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    return scratch.table(edges.where("u != v").distinct(), name)


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root): root is the smallest node connected with node by links (u, v); nodes without links are left out.

    Alternating large and small stars: every node hands its larger neighbours, then itself and its smaller neighbours, to the
    smallest it knows.  The number of rounds grows with the logarithm of the longest path.
    """
    edges = _star(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), scratch, f"{name}-0")
    before, k = None, 0
    while True:
        k += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _star(large, scratch, f"{name}-{k}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        edges = _star(small, scratch, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}"), scratch.drop(f"{name}-{k}-large")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == before:
            roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        before = tuple(now)
