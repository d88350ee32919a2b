"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of `links` (a, b): the smallest node it can reach.

    Each round ties a node's neighbours to the smallest of them, first the larger neighbours, then
    the smaller ones, until only stars around the smallest nodes are left. The number of rounds
    grows with the logarithm of the longest path, and no round makes more rows than it is given
    links and nodes. Links of a node to itself add nothing.
    """
    edges = cut_lineage(_clean(links.select("a", "b")))
    state = _state(edges)
    while True:
        edges = cut_lineage(_clean(_small_star(_large_star(edges))))
        now = _state(edges)
        if now == state:
            break
        state = now
    # a star's centre is the smallest node; larger ends point to it
    stars = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component"))
    centres = stars.select(F.col("component").alias("node"), "component").distinct()
    return stars.unionByName(centres)


def _clean(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("at")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    tied = both.join(least, F.col("a") == F.col("at"))
    larger = tied.filter(F.col("b") > F.col("a"))
    return larger.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("m"))
    tied = edges.join(least, F.col("a") == F.col("at"))
    return tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        least.select(F.col("at").alias("a"), F.col("m").alias("b"))
    )
