"""How much of the library has which features, and what failed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OK = ("success", "partial")
MOST_PER_SOURCE = 300


def by_source(features: DataFrame, total: DataFrame) -> DataFrame:
    """Per source the tracks by status, the covered share in percent and what is missing. total: one row, tracks."""
    has = lambda *s: F.count_distinct(F.when(F.col("status").isin(*s), F.col("track_id")))
    counts = features.where("is_active").groupBy("source").agg(has("success").alias("success"), has("partial").alias("partial"), has("failed").alias("failed"), has("not_found").alias("not_found"), has(*OK).alias("covered"))
    share = F.when(F.col("tracks") > 0, F.round((F.col("success") + F.col("partial")) / F.col("tracks") * 100, 2)).otherwise(0.0)
    return counts.join(F.broadcast(total), F.lit(True)).select("source", "success", "partial", "failed", "not_found", share.alias("coverage_pct"), F.greatest(F.lit(0), F.col("tracks") - F.col("covered")).alias("missing"))


def by_field(features: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Tracks with a value, one column per field, all in one pass."""
    rows = features.where(F.col("is_active") & F.col("status").isin(*OK))
    return rows.agg(*[F.count_distinct(F.when(F.col(f).isNotNull(), F.col("track_id"))).alias(f) for f in fields])


def missing(tracks: DataFrame, features: DataFrame, source: str) -> DataFrame:
    """Ids of tracks without an active success or partial row of the source."""
    covered = features.where((F.col("source") == source) & F.col("is_active") & F.col("status").isin(*OK)).select("track_id")
    return tracks.select("track_id").join(covered, "track_id", "left_anti")


def failed(features: DataFrame, source: str) -> DataFrame:
    return features.where((F.col("source") == source) & (F.col("status") == "failed")).select("track_id").distinct()


def zero_filled(rows: DataFrame, names: Sequence[str], statuses: Sequence[str]) -> DataFrame:
    """Counts by feature and status for every name listed, 0 where there is none."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(n,) for n in names], "feature string")
    counts = rows.groupBy("feature").agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses])
    return F.broadcast(every).join(counts, "feature", "left").na.fill(0, list(statuses))


def previews(tracks: DataFrame, previews_: DataFrame) -> DataFrame:
    """One row: tracks, with any preview, available, failed, missing and the share in percent."""
    per = previews_.groupBy("track_id").agg(F.bool_or(F.col("status") == "available").alias("available"), F.bool_or(F.col("status") == "failed").alias("failed"), F.lit(True).alias("any"))
    yes = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    counts = tracks.select("track_id").join(per, "track_id", "left").agg(F.count("*").alias("total"), yes("any").alias("any_preview"), yes("available").alias("available"), yes("failed").alias("failed"))
    share = F.when(F.col("total") > 0, F.round(F.col("available") / F.col("total") * 100, 2)).otherwise(0.0)
    return counts.select("*", (F.col("total") - F.col("available")).alias("missing"), share.alias("pct"))


def failure_feed(sources: Sequence[DataFrame], after: Column | None = None, page: int = 1, size: int = 50) -> DataFrame:
    """The newest failures of several sources (source, track_id, code, at), each capped before the filter, by time."""
    capped = [s.orderBy(F.desc_nulls_last("at"), "track_id").limit(MOST_PER_SOURCE) for s in sources]
    union = capped[0]
    for s in capped[1:]:
        union = union.unionByName(s, allowMissingColumns=True)
    rows = union.where(F.col("at") > after) if after is not None else union
    return rows.orderBy(F.desc_nulls_last("at"), "source", "track_id").offset((page - 1) * size).limit(size)


def needs_analysis(tracks: DataFrame, features: DataFrame, source: str, fields: Sequence[str]) -> DataFrame:
    """Ids whose row of the source is absent, of a bad status or lacks one of the fields."""
    rows = features.where((F.col("source") == source) & F.col("is_active")).select("track_id", "status", *fields)
    whole = F.col("status").isin(*OK)
    for f in fields:
        whole = whole & F.col(f).isNotNull()
    return tracks.select("track_id").join(rows.where(whole).select("track_id"), "track_id", "left_anti")


def ordered_ids(ids: DataFrame, limit: int) -> DataFrame:
    """The first ids in order, for work selection."""
    return ids.select("track_id").distinct().orderBy("track_id").limit(limit)
