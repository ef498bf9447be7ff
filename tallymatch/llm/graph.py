"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymatch.llm.storage import discard, stored
from tallymatch.operators.lookup import lookup


def _ordered(edges: DataFrame, a: str, b: str) -> DataFrame:
    return (
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    )


def _flat(edges: DataFrame) -> bool:
    """Whether every node hangs directly below one root."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    seen = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node.

    Each round hangs a node's larger neighbours below its smallest one and then skips a generation, so the number of
    rounds grows with the logarithm of the longest path. No node's neighbours are gathered: every step is a join with
    one row per key, which adaptive execution splits at hubs, or an aggregation that combines before the shuffle. The result is a written table.
    """
    at = stored(_ordered(edges, a, b))
    while not _flat(at):
        least = at.groupBy("a").agg(F.min("b").alias("p"))
        hung = lookup(at, least, ["a"])
        pairs = hung.select(F.explode(F.array(F.struct("a", F.col("p").alias("b")), F.struct(F.col("b").alias("a"), F.col("p").alias("b")))).alias("e")).select("e.*")
        pairs = pairs.where("a <> b").distinct()
        above = least.select(F.col("a").alias("b"), F.col("p").alias("above"))
        jumped = lookup(pairs, above, ["b"]).select("a", F.coalesce("above", "b").alias("b"))
        before, at = at, stored(_ordered(jumped, "a", "b"))
        discard(before)
    roots = at.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = stored(at.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots))
    discard(at)
    return found
