"""Connected components of links, by alternating large-star and small-star steps (Kiveris et al., 2014).

Each round is written to the shared folder, and the one before is deleted once it is no longer read. A node with very many
neighbours is not dealt to one task: of at most 2 * PARTS such nodes the least neighbours are broadcast to where their
links are; the others are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedloom.llm.common import forget, settle

#: Links of a node up to which they are shuffled to one task; with more than PARTS times as many links, a PARTS-th of them.
HOT_LINKS = 10_000
PARTS = 4096


def star(e: DataFrame, large: bool, links: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d")).withColumn("m", F.least("u", "m"))
    most = max(HOT_LINKS, links // PARTS)
    if links <= most:
        near = both.join(least.drop("d"), "u")
    else:
        hot = least.filter(F.col("d") > most)  # degrees add up to twice the links, so these are at most 2 * PARTS
        rest = both.join(F.broadcast(hot.select("u")), "u", "left_anti").join(least.filter(F.col("d") <= most).drop("d"), "u")
        near = rest.unionByName(both.join(F.broadcast(hot.drop("d")), "u"))
    if large:
        moved = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def are_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge down, to a node that has none: then the labels are there."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or down > 0 and up > 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """fp, label: the smallest node of its component, for each node of a link a, b but the labels themselves."""
    edges = settle(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not are_stars(edges):
        done, n = edges, edges.count()
        edges = settle(star(star(edges, True, n), False, n))
        forget(done)  # the new table is written and doesn't depend on it
    return edges.select(F.col("u").alias("fp"), F.col("v").alias("label"))
