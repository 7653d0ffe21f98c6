"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatprep.sources.stages import scratch


def _checked(edges: DataFrame) -> tuple:
    """Number of edges and a sum that changes when one of them does."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
    ).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``a < b`` throughout: all smaller neighbours of a node, and it, to the smallest."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    tied = edges.join(least, "b")
    return (
        tied.filter("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        .unionByName(tied.select(F.col("m").alias("a"), "b"))
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of the links ``(a, b)``; ``component`` is the
    smallest node it is joined with. Rounds run as Spark jobs over the edges until they
    no longer change; their number grows with the logarithm of a component's width."""
    edges = scratch(
        links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    before = _checked(edges)
    while before[0]:
        edges = scratch(_small_star(_large_star(edges)), "edges")
        after = _checked(edges)
        if after == before:
            break
        before = after
    # Now every node but the smallest is tied to the smallest alone.
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
