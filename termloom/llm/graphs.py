"""Connected components by joins alone."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.session import written


def swept(spark: SparkSession) -> None:
    """Drops what finished steps have left: plans on the driver, and broadcasts and shuffles, which Spark removes when the driver's garbage goes."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stars(edges: DataFrame) -> bool:
    """Whether edges (u, v), all from larger to smaller, lead each node to a root in one step."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))).alias("e"))
    seen = ends.select("e.*").groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("least"))
    return seen.where("out > 1 or (out > 0 and least = 0)").isEmpty()


def components(edges: DataFrame, name: str = "stars", rounds: int = 60) -> DataFrame:
    """(node, root) of every node that an edge (u, v) has, root the smallest reachable.

    Alternating large and small stars: after each round all edges point to smaller
    nodes, and the number of rounds follows the logarithm of the longest path. Edges
    that are stars already take none.
    """
    now = written(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), name
    )
    for _ in range(rounds):
        if stars(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u_"), F.least("u", "m").alias("m"))
        large = both.join(low, both["u"] == low["u_"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u_"), "m")
        joined = large.join(least, large["u"] == least["u_"])
        small = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = written(small.select("e.u", "e.v").where("u != v").distinct(), name)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
