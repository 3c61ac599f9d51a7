"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perchero.llm.common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) to (node, component): the smallest node of its component, for every node named.

    Loops and repeated edges are allowed; edges with a null end are left out. Every round is two
    grouped minima with joins on the node and shrinks path lengths exponentially; its result is
    stored, so neither the plan nor a lost executor's work grows with the rounds.
    """
    u, v = F.col("u"), F.col("v")
    links = edges.select(F.greatest(u, v).alias("x"), F.least(u, v).alias("y")).where(
        u.isNotNull() & v.isNotNull()).distinct()
    links = stored(links, "links")
    state = _state(links)
    while True:
        both = links.union(links.select("y", "x")).where("x <> y")
        low = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        large = large.union(links.where("x = y")).distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").select(
            F.explode(F.array(F.struct("x", F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e"))
        after = stored(small.select("e.*").distinct(), "links")
        changed = _state(after)
        discard(links)
        links, before, state = after, state, changed
        if changed == before:
            break
    return links.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("component"))


def _state(links: DataFrame) -> tuple:
    """A fingerprint of the proper edges (two fixed-size numbers)."""
    row = links.where("x <> y").agg(
        F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(20,0)"))).collect()[0]
    return row[0], row[1]
