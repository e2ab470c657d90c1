"""Connected components of a link table, wholly distributed: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialized


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): for every node with a link to another node, the least node that it reaches.

    Links may repeat, point either way, or join a node to itself; such loops, and links with a null end, are left out. No
    links give no rows. Each round writes its edges to the shared folder; the rounds grow with the logarithm of the size.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    edges = materialized(edges, "edges")
    state = _state(edges)
    while state[0]:
        # large star: the greater neighbours of a node move to the least of its neighbours and itself
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = _least(both).withColumn("m", F.least("u", "m"))
        big = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours move to the least of them
        m = _least(big)
        small = big.join(m, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialized(small.unionByName(m.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "edges")
        now = _state(edges)
        if now == state:
            break
        state = now
    labels = edges.groupBy("u").agg(F.min("v").alias("label"))
    return labels.select(F.col("u").alias("node"), "label").unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
