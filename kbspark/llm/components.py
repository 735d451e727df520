"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import saved


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable from each id that has a link.

    Every id points to the smallest id it is known to reach. Large-star and
    small-star steps move links towards it until nothing changes, which takes
    rounds in proportion to the logarithm of the longest path. A hub's links
    meet its minimum in a join that can be split, never in one group."""
    def both(e: DataFrame) -> DataFrame:
        return e.union(e.select("v", "u"))

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))

    edges = saved(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        around = both(edges)
        large = around.join(least(around), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large.where("u <> v").distinct(), "large-star")
        down = least(large)
        small = (large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(down.select("u", F.col("m").alias("v"))))
        edges = saved(small.where("u <> v").distinct(), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).cast("string")).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
