"""Segments of a track to track-level features: votes, means, medians, vectors and labels, each one grouped pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crateflow.functions.numeric import or_default


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum of products over sum of weights; the plain mean where the weights come to nothing. Rows without value don't count."""
    w = F.when(value.isNotNull(), weight)
    return F.when(F.sum(w) > 0, F.sum(value * w) / F.sum(w)).otherwise(F.avg(value))


def median(value: Column) -> Column:
    """Exact; the mean of the middle two for even counts."""
    return F.median(value)


def key_votes(segments: DataFrame, by: str = "track_id") -> DataFrame:
    """(key, mode) with the largest sum of confidence x quality x match; confidence = that sum over all segments.

    A confidence of 0 or null counts .5. Equal sums go to the pair seen first (the least segment_id).
    """
    weight = or_default(F.col("key_confidence"), 0.5) * F.col("quality") * F.col("match")
    votes = segments.where(F.col("key").isNotNull()).groupBy(by, "key", "mode").agg(F.sum(weight).alias("weight"), F.min("segment_id").alias("first"))
    best = votes.groupBy(by).agg(F.max_by(F.struct("key", "mode", "weight"), F.struct(F.round("weight", 9), -F.col("first"))).alias("best"))
    size = segments.groupBy(by).agg(F.count("*").alias("n"))
    return best.join(size, by).select(by, "best.key", "best.mode", (F.col("best.weight") / F.col("n")).alias("key_confidence"))


def low_level(segments: DataFrame, by: str = "track_id") -> DataFrame:
    """Weighted bpm and loudness, exact medians, duration and the composite confidence of each track."""
    weight = F.col("quality") * F.col("match")
    parser = F.coalesce(F.nullif(F.col("bpm_confidence"), F.lit(0.0)), F.nullif(F.col("key_confidence"), F.lit(0.0)), F.lit(0.85))
    return segments.groupBy(by).agg(
        weighted_mean(F.col("bpm"), weight).alias("bpm"),
        weighted_mean(F.col("loudness"), weight).alias("loudness"),
        median(F.col("centroid")).alias("centroid"),
        F.floor(median(F.col("duration_ms"))).cast("long").alias("duration_ms"),
        F.round(F.avg(parser) * F.avg("quality") * F.avg("match"), 4).alias("confidence"),
        F.count("*").alias("segments"),
    )


def vector_mean(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """Mean of each element over the vectors that have it; as long as the longest."""
    parts = rows.select(by, F.posexplode(vector).alias("at", "x")).groupBy(by, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias(vector))


def fixed_vector_mean(rows: DataFrame, by: str, vector: str, dimension: int) -> DataFrame:
    """vector_mean() that fails on a vector of another length; confidence is always 1."""
    checked = rows.where(F.assert_true(F.size(vector) == dimension, F.lit("vector of another dimension")).isNull())
    return vector_mean(checked, by, vector).withColumn("confidence", F.lit(1.0))


def classifiers(values: DataFrame, segments: DataFrame, by: str = "track_id") -> DataFrame:
    """Median value per track and feature; coverage = segments with a value over all; confidence = median x coverage, 1 at most."""
    total = segments.groupBy(by).agg(F.count_distinct("segment_id").alias("total"))
    used = values.where(F.col("value").isNotNull()).groupBy(by, "feature").agg(median(F.col("value")).alias("value"), median(F.col("confidence")).alias("c"), F.count_distinct("segment_id").alias("used"))
    rows = used.join(total, by).withColumn("coverage", F.col("used") / F.col("total"))
    return rows.select(by, "feature", "value", F.least(F.lit(1.0), F.col("c") * F.col("used") / F.col("total")).alias("confidence"), "coverage", F.when(F.col("used") == F.col("total"), "success").otherwise("partial").alias("status"))


def top_labels(labels: DataFrame, k: int = 3, by: str = "track_id") -> DataFrame:
    """The k labels with the largest median score over the segments that list them; ties by label."""
    scores = labels.groupBy(by, "label").agg(median(F.col("score")).alias("score"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round("score", 9)), "label"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def best_per_segment(outputs: DataFrame, priority: str = "priority") -> DataFrame:
    """The output of the highest priority of each segment; of equal ones the first."""
    first = F.row_number().over(Window.partitionBy("segment_id").orderBy(F.desc(priority), "output_id"))
    return outputs.withColumn("n", first).where("n = 1").drop("n")


def run_mode(modes: DataFrame, by: str = "track_id") -> DataFrame:
    return modes.groupBy(by).agg(F.when(F.bool_or(F.col("mode") == "real"), "real").when(F.bool_or(F.col("mode") == "stub"), "stub").otherwise("none").alias("mode"))


def throughput(samples: DataFrame) -> DataFrame:
    """Per stage the growth of a counter between its first and last sample, a minute."""
    ends = samples.groupBy("stage").agg(F.min_by("done", "at").alias("first"), F.max_by("done", "at").alias("last"), F.min("at").alias("t0"), F.max("at").alias("t1"))
    minutes = (F.unix_timestamp(F.col("t1").cast("timestamp")) - F.unix_timestamp(F.col("t0").cast("timestamp"))) / 60
    return ends.select("stage", F.when(minutes > 0, (F.col("last") - F.col("first")) / minutes).otherwise(0.0).alias("per_minute"))
