"""Connected components of links between documents, by alternating large-star and small-star steps.

Every step is an aggregation (combined before the shuffle) and a join; a hub with very many links is never collected.
Each round is written to the shared folder, so that lineage ends there and lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored

#: More rounds than any graph of fewer than 2**60 nodes takes.
MOST_ROUNDS = 60


def _large(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours go to the least of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """u, root for each node of the links (u, v) but the least of its component; root is that least node.

    Links may repeat, stand in either order and join a node with itself; without links the result is empty.
    """
    edges = stored(links.select("u", "v").filter("u <> v").distinct(), "links")
    before = None
    for _ in range(MOST_ROUNDS):
        last, edges = edges, stored(_small(_large(edges)), "stars")
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select("u", F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components didn't settle in {MOST_ROUNDS} rounds")
