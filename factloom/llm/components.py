"""Connected components over links, as rows: alternating large-star and small-star steps.

Each step points the neighbours of every node at the least of them; the steps
keep what is connected connected, and end in stars around each component's
least node. A step aggregates a minimum per node (map-side first) and joins it
back, to nodes with very many neighbours by broadcast, so no node's neighbours
ever meet in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import checkpoint, join_by_key

#: Far more rounds than any input needs: their number grows with the logarithm of the size.
MOST_ROUNDS = 100


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u"))
    least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
    return join_by_key(both.where("v > u"), least, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = checkpoint(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    moved = join_by_key(down, least, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _signature(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """u, v (linked nodes, u != v) -> node, component: for each node in a link, its component's least node."""
    now = checkpoint(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _signature(now)
    for _ in range(MOST_ROUNDS):
        if not seen[0]:
            break
        now = checkpoint(_small_star(checkpoint(_large_star(now))))
        before, seen = seen, _signature(now)
        if before == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
