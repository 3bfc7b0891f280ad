"""Connected components of an edge list by alternating large-star and small-star steps.

Both steps are a grouped minimum and an equi-join, so no vertex's neighbours, no component and
no edge list ever meets in one task or on the driver.  Each round is written to the
shared folder; a lost executor costs a re-read of the last round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiframe.llm.shared import Stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(vertex, component)`` of every vertex that has an edge; ``component`` is the smallest vertex.

    Loops, nulls and repeated edges count for nothing.  An empty edge list gives an empty frame.
    """
    links = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    held, before = Stored(links, "links"), None
    while (state := _state(held.frame)) != before:
        before, old = state, held
        held = Stored(_small_star(_large_star(held.frame)), "links")
        old.drop()
    return held.frame.select(F.col("hi").alias("vertex"), F.col("lo").alias("component")).union(
        held.frame.select(F.col("lo").alias("vertex"), F.col("lo").alias("component")).distinct())


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")),
                           F.sum(F.xxhash64("lo", "hi") % 1_000_003)).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is linked to the vertex's smallest neighbour."""
    smallest = (
        links.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        .union(links.select(F.col("lo").alias("u"), F.col("lo").alias("v")))
        .groupBy("u").agg(F.min("v").alias("least"))
    )
    return links.join(smallest, F.col("lo") == F.col("u")).select(
        "hi", F.col("least").alias("lo")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a vertex, and the vertex, are linked to the smallest of them."""
    smallest = links.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("least"))
    moved = links.join(smallest, F.col("hi") == F.col("u")).filter(F.col("lo") != F.col("least")).select(
        F.col("lo").alias("hi"), F.col("least").alias("lo"))
    return moved.union(smallest.select(F.col("u").alias("hi"), F.col("least").alias("lo"))).distinct()
