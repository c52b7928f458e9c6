"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that each node of an edge can reach.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each step
    links a node's neighbours to the smallest node around it, so the number of
    rounds grows with the logarithm of the longest path. Edges, labels and
    groups stay distributed, and every round is cut by a table in the shared
    folder. Stars are built with min() aggregates, which combine before the
    shuffle, and a join whose hot keys adaptive execution may split; no group
    is collected.
    """
    e = store.save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "cc")
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above a node link to its least neighbour
        large = store.save(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), "cc")
        # small star: a node and its neighbours below link to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        low = large.join(least, "u")
        small = store.save(low.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct(), "cc")
        old, new = (x.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first() for x in (e, small))
        e = small
        if old == new:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
