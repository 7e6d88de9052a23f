"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is two aggregates and a join on (node, node) rows; every round is a
written table, so lineage stays short and a lost executor costs one round at
most. A hub's edges are grouped with map-side minimum and joined back by a
plain equi-join, which AQE splits when the hub is hot. No edge list, label or
component ever reaches the driver: only two numbers per round do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finledger.llm._common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b): links every neighbour (large: the greater ones, else: the smaller ones) to the least known node."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where(F.col("b") < F.col("a"))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), F.least("a", "_m").alias("m"))
    j = both.join(least, F.col("a") == F.col("_a"))
    if large:
        out = j.where(F.col("b") > F.col("a")).select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:
        out = j.select(F.col("b").alias("x"), F.col("m").alias("y")).union(least.select(F.col("_a").alias("x"), F.col("m").alias("y")))
    return out.where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs, any direction -> (node, label): the least node of each component.

    Isolated nodes do not appear; self-loops and repeated edges are harmless;
    an empty table gives an empty result. Ends when a round changes nothing
    (O(log^2 n) rounds).
    """
    cur = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(cur)
    while state[0]:
        nxt = written(_star(_star(cur, True), False), "edges")
        new = _state(nxt)
        if new == state:
            break
        cur, state = nxt, new
    labels = cur.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.union(cur.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
