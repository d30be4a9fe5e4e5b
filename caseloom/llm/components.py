"""Connected components of links by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import table

#: The rounds grow with the logarithm of a component; this many mean an error.
MAX_ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) for every node of ``links`` (a, b).

    Each round is two aggregations with a join; edges are stored between rounds,
    so a lost executor costs one round's tasks.  A hub's edges are never
    gathered: only its smallest neighbour is, by partial minima.
    """
    edges = table(_tidy(links), "components")
    last = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: neighbours larger than a node go to its smallest neighbour.
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = table(_tidy(large), "components")
        # Small star: a node and its smaller neighbours go to the smallest of them (edges point down: a > b).
        down = edges.select(F.col("a").alias("b"), F.col("b").alias("a"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select("b", "m", "a")
        small = small.select(F.col("b").alias("x"), "m").unionByName(small.select(F.col("a").alias("x"), "m"))
        edges = table(_tidy(small.select(F.col("x").alias("a"), F.col("m").alias("b"))), "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )


def _tidy(links: DataFrame) -> DataFrame:
    """Distinct edges (a < b) without loops."""
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
