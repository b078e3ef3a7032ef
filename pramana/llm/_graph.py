"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pramana.llm._spark import checkpoint


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges`` (a long, b long), either direction -> (node, component), smallest node reachable.

    Each round hangs every node under the smallest node around it (large star, then small
    star, both as a minimum per node and a join), until nothing changes. Rounds grow with the
    logarithm of the longest path. Neighbour lists are never built, so one node may have any
    number of links. Null ends and loops are dropped; an empty input gives an empty result.
    """
    e = checkpoint(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi")
        e = checkpoint(small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").union(low.select("hi", F.col("m").alias("lo"))).distinct())
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
