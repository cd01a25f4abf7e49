"""Connected components as DataFrame rounds of large-star and small-star (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b), longs, to one row per node: node, root (the smallest node of its component).

    A star's centre is found with a partial minimum and joined back, so that a node with very many edges isn't one
    task's group. Each round is a table in the shared folder. Loops, repeated and reversed edges are allowed; no edge
    gives no row.
    """
    stars = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        centre = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(centre, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        stars = materialize(small.select("e.a", "e.b").where(F.col("a") != F.col("b")).distinct(), "edges")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
