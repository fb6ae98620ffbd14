"""Connected components of a graph given as links, without bringing the graph together anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almagest.llm.common import cut

# Pieces into which a node's links are dealt when they meet its least neighbour, as one node may hold a third of all links.
SALTS = 8
# Links to a task, about: tables that shrink from round to round are read in fewer tasks.
TASK_ROWS = 50_000


def _least(edges: DataFrame, own: Column, tasks: int) -> DataFrame:
    """Edges (u, v) beside ``low``, the least of ``own`` and all v of their u."""
    low = edges.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("low", own).alias("low")).coalesce(tasks)
    copies = low.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS))).join(copies, ["u", "salt"]).select("u", "v", "low")


def _are_stars(edges: DataFrame) -> bool:
    """Every node that points somewhere points to one node, and nothing points to it."""
    ends = edges.select(F.col("u").alias("node"), "v").unionByName(edges.select(F.col("v").alias("node"), F.lit(None).cast(edges.schema["v"].dataType).alias("v")))
    each = ends.groupBy("node").agg(F.count("v").alias("out"), F.count(F.lit(1)).alias("all"))
    return each.where("out > 1 OR (out = 1 AND all > 1)").limit(1).count() == 0


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that can be reached, for every node that has a link.

    Alternates two steps: every node links its larger neighbours to its least one, then its smaller ones and
    itself. Links turn into stars in a number of rounds that grows with the logarithm of the longest chain, and
    their number never grows. Least neighbours are partial sums and links are dealt by node and salt, so a
    node with very many links is no burden to one task.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while (size := edges.count()) and not _are_stars(edges):
        tasks = -(-size // TASK_ROWS)
        edges = edges.coalesce(tasks)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, F.col("u"), tasks).where("v > u AND v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).coalesce(tasks)
        # A node's own link to its least neighbour is among these: its v is the least one.
        small = _least(large, F.col("low"), tasks).select(F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("low").alias("v"))
        edges = cut(small.distinct().coalesce(tasks))
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = stars.select(F.col("component").alias("node"), "component").distinct()
    return stars.unionByName(centres)
