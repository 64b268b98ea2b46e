"""Connected components of links by contraction; every step is a join or an aggregation, nothing is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.llm.common import cut, mark, release


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b); the root is one node of the component, the same for all of it.

    In each round every node points to its smallest neighbour if that is smaller than itself, pointers are
    followed to their ends by doubling, and links between different ends remain. A round merges every smallest
    node's neighbours into it, so few rounds remain even for chains and stars.
    """
    since = mark()
    links = cut(links.where("a <> b").select("a", "b").distinct())
    found = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = cut(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("b")))
        while True:
            jumped = to.join(to.select(F.col("a").alias("b"), F.col("b").alias("_next")), "b")
            jumped = cut(jumped.select("a", F.col("_next").alias("b"), (F.col("b") != F.col("_next")).alias("moved")))
            to = jumped.select("a", "b")
            if jumped.where("moved").isEmpty():
                break
        to = to.select(F.col("a").alias("_from"), F.col("b").alias("_to"))
        found = to.select(F.col("_from").alias("node"), F.col("_to").alias("root")) if found is None else cut(found.join(to, found["root"] == to["_from"], "left").select("node", F.coalesce("_to", "root").alias("root")))
        moved = links.join(to, F.col("a") == F.col("_from")).select(F.col("_to").alias("a"), "b")
        moved = moved.join(to, F.col("b") == F.col("_from")).select("a", F.col("_to").alias("b"))
        links = cut(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = cut(found)
    release(found.sparkSession, since, found)
    return found
