"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written


def connected_components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node reachable, of each node of links (a bigint, b bigint).

    Links with a null end and those of a node with itself say nothing; other
    columns are not read; an empty table gives no row.
    Alternates two steps until nothing changes: each node's larger neighbours
    are linked to its smallest one, then each node to its smallest neighbour. A
    step is one aggregation and one join; each round's links are written out.
    """
    ordered = F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
    edges = written(links.where("a <> b").select(*ordered).distinct(), "links")
    seen = None
    while True:
        both = edges.select(F.col("low").alias("u"), F.col("high").alias("v")).union(edges.select(F.col("high").alias("u"), F.col("low").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("low"), F.col("v").alias("high")).where("low <> high").distinct()
        down = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(down, "high").select(F.explode(F.array(F.struct("m", F.col("low").alias("x")), F.struct("m", F.col("high").alias("x")))).alias("e"))
        last, edges = edges, written(small.select(F.col("e.m").alias("low"), F.col("e.x").alias("high")).where("low <> high").distinct(), "links")
        discard(last)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
    stars = edges.select(F.col("high").alias("node"), F.col("low").alias("root"))
    return stars.union(stars.select("root", "root").distinct())
