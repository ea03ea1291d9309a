"""Connected components of a link table, without collecting it: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import settled, spread_join

ROWS = 1_000_000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b): the least node that it reaches.

    Nodes without a link aren't returned. Loops and repeated links do no harm. Each round ends with a
    checkpoint, so lineage stays short, and nothing of the table is on the driver. A hub's links stay
    where they are (`spread_join`). A round's result is final when it is a set of stars: when no node that
    others hang below hangs below another.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v")
    e, n = settled(e, ROWS)
    counted = F.count(F.lit(1)).alias("rows_of_key")
    for _ in range(max_rounds):
        # large star: neighbours above a node hang below its least neighbour
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), counted)
        large = spread_join(both, least, ["u"], 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        # small star: a node and its lesser neighbours hang below the least of them
        large, n = settled(large, ROWS)
        least = large.groupBy("u").agg(F.min("v").alias("m"), counted)
        pair = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
        small = spread_join(large, least, ["u"], n).select(F.explode(F.array(pair("u", "m"), pair("v", "m"))).alias("e")).select("e.*")
        e, n = settled(small.filter("u > v").distinct(), ROWS)
        if e.join(e.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").isEmpty():
            break
    else:
        raise RuntimeError(f"components haven't settled in {max_rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
