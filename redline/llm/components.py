"""Connected components of a graph of any size, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redline.session import store


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """cls, comp for each of nodes (cls), comp being the smallest cls that links (a, b) reach from it.

    Alternating star contraction: each node's larger neighbours are hung at its smallest neighbour, then its smaller
    ones; a path halves each time, so rounds grow with the logarithm of the longest one. Each round's edges are written
    to the shared folder. Minima are combined before each shuffle, so a node with very many links costs one row a task.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = store(edges, "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = store(small.where("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    return nodes.join(edges.select(F.col("u").alias("cls"), F.col("v").alias("comp")), "cls", "left").select("cls", F.coalesce("comp", "cls").alias("comp"))
