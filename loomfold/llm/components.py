"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b); component is the smallest node.

    Each step joins edges with one minimum for each node, so a hot node costs
    its rows, which AQE may split, and never a group in memory. Steps keep what is
    connected, so they end once every node but a component's smallest has one edge,
    to that one; the edges' numbers by node are summed before the shuffle.

    Nulls and edges from a node to itself join nothing, repeated edges count once,
    and no edges give no rows. Only a and b are read.
    """

    def star(table: DataFrame, larger: bool) -> DataFrame:
        if larger:
            table = table.union(table.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = table.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        joined = table.join(least, "a")
        if larger:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.union(least.select("a", F.col("m").alias("b"))).where("a != b")

    def all_stars(table: DataFrame) -> bool:
        ends = F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))
        counts = table.select(F.explode(ends).alias("end")).groupBy("end.node").agg(F.sum("end.up").alias("up"), F.count("*").alias("n"))
        return counts.where("up > 0 and n > 1").isEmpty()

    # every edge runs from its larger node to its smaller one
    state = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    while True:
        before, half = state, materialize(star(state, True).distinct(), name)
        state = materialize(star(half, False).distinct(), name)
        discard(before, half)
        if all_stars(state):
            break
    members = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = materialize(members.union(state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), name)
    discard(state)
    return out
