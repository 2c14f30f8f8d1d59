"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialise


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long), any order and repeats -> (id, component): the smallest id that links reach.

    Each round replaces a node's links by links to its smallest neighbour, so a chain's length halves; a node of many
    links is one aggregated row on one side of a join whose other side may be split. Ids without a link aren't returned."""
    now = materialise(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct(), "edges")
    state = None
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("hi"), F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo").filter("hi <> lo").distinct()
        before, now = now, materialise(small, "edges")
        drop(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    roots = now.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(roots)
