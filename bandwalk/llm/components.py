"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bandwalk.session import settled


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``links``; component is the smallest node reached.

    Alternating large-star and small-star steps: each replaces a node's links by links to
    its smallest neighbour, which halves distances and never makes more links than there
    were. A step is one grouped minimum and one join on the node; a node with very many links
    is a skewed join key, which adaptive execution splits. Every step is written to the
    shared folder. The driver reads two numbers per step and stops when they stay the same.

    Null ends and links of a node to itself are dropped; repeated links count once.
    """
    edges = settled(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    )
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low"))
        # large star: larger neighbours hang on the smallest of the node and its neighbours
        edges = settled(
            both.filter("v > u").join(low, "u")
            .select(F.col("v").alias("u"), F.least("low", "u").alias("v")).distinct()
        )
        # small star: smaller neighbours, and the node itself, hang on the smallest
        low = edges.groupBy("u").agg(F.min("v").alias("low"))
        edges = settled(
            edges.join(low, "u").select(F.explode(F.array("v", "u")).alias("u"), F.col("low").alias("v"))
            .filter("u <> v").distinct()
        )
        new = _state(edges)
        if new == state:
            break
        state = new
    roots = edges.select(F.col("v").alias("u"), "v")
    return edges.union(roots).distinct().select(F.col("u").alias("node"), F.col("v").alias("component"))


def _state(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]
