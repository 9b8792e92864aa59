"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receivia.llm.common import cut


def _stars(edges: DataFrame, larger: bool, rows: int) -> DataFrame:
    """One step over edges (a > b): every node's larger (or smaller) neighbours are tied to the
    smallest node that it knows. Minima are aggregated before they meet the neighbours again, and
    are written first, so that Spark can split the join at a node with very many neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges
    least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), rows)
    met = both.join(least, "a")
    moved = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if larger else met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a > b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of every node of links (u, v), smallest nodes included."""
    edges = cut(links.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).filter("a > b").distinct())
    rows = 2 * edges.count()  # there are never more edges than links and nodes
    before = None
    for _ in range(most_rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        edges = cut(_stars(cut(_stars(edges, True, rows), rows), False, rows), rows)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
