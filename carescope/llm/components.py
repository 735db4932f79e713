"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carescope.llm.common import cut_lineage


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node reachable, for every node in a link of two nodes.

    Each round hangs the larger neighbours of every node on its least neighbour, then the smaller
    ones; nodes keep to their component, and the rounds needed grow with the logarithm of its
    size. Only least neighbours are gathered per node (pre-aggregated in every task); edges are
    never brought together in one place. Each round is checkpointed.
    """
    edges = cut_lineage(links.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u"))
                        .where("u <> v").distinct())
    state = _state(edges)
    while state[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        hung = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                .where("u <> v").distinct())
        least = hung.groupBy("u").agg(F.min("v").alias("m"))
        turned = hung.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = cut_lineage(turned.union(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
