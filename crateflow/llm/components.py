"""Connected components of a graph given by its edges, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateflow.llm.runtime import drop_table, write_table

MOST_ROUNDS = 100


def _hook(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Each node of u hands its smallest neighbour (or itself) to its neighbours v; small ones to itself as well."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    met = pairs.join(least, F.col("u") == F.col("w"))
    if larger_only:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v: longs, not null); component: the smallest node it reaches.

    Every round is written to the shared folder and the one before removed. Self-loops add nothing; without edges the
    result is empty. Joins on a hub are left to the engine's splitting of skewed partitions.
    """
    spark = edges.sparkSession
    current, path = write_table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(MOST_ROUNDS):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hook(both, larger_only=True)
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        following, new_path = write_table(_hook(down, larger_only=False))
        drop_table(spark, path)
        current, path = following, new_path
        now = current.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).alias("h")).first()
        if state == now:
            break
        state = now
    else:
        raise RuntimeError("the components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
