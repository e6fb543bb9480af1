"""Plans that Catalyst doesn't find by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookspark.session import cut


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of one orderable type -> (node, component), component the smallest node that can be reached.

    Large-star and small-star steps in turn, with a checkpoint after each
    round, until the edges are stars about the smallest nodes: rounds grow with
    the logarithm of the longest chain. Every step groups by node with a
    partial minimum first; only edges are shuffled. Null ends and loops are left out.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u > v").distinct())
    state = None
    while True:
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionAll(least.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        was, state = state, now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if state == was:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
