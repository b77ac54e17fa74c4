"""Merges: each returns the new table, to be written to a new path; merge_changed() rewrites only the buckets of a table that change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def last_per_key(rows: DataFrame, keys: Sequence[str], order: str = "ordinal") -> DataFrame:
    """The last of the input rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("__n", rank).where("__n = 1").drop("__n", order)


def upsert(target: DataFrame, changes: DataFrame, keys: Sequence[str], keep: Column | None = None) -> DataFrame:
    """target with changed rows replaced and new rows added; null keys equal each other.

    keep: a condition on the target's row (aliased t) under which it stays as it is. Both tables have the same columns;
    keys are unique in each.
    """
    t, c = target.alias("t"), changes.alias("c")
    match = F.lit(True)
    for k in keys:
        match = match & F.col(f"t.{k}").eqNullSafe(F.col(f"c.{k}"))
    rows = t.withColumn("__t", F.lit(True)).alias("t").join(c.withColumn("__c", F.lit(True)).alias("c"), match, "full")
    new = F.col("__c").isNotNull()
    if keep is not None:
        new = new & ~(F.col("__t").isNotNull() & F.coalesce(keep, F.lit(False)))
    return rows.select(*[F.when(new, F.col(f"c.{x}")).otherwise(F.col(f"t.{x}")).alias(x) for x in target.columns])


BUCKET = "bucket"


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """The bucket of a key; null keys have one too."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_bucketed(rows: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> None:
    """A new table of one folder per bucket of the keys, for merge_changed()."""
    rows.withColumn(BUCKET, bucket_of(keys, buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def merge_changed(spark: SparkSession, path: str, changes: DataFrame, keys: Sequence[str], buckets: int = 64, keep: Column | None = None, insert_only: bool = False) -> list[int]:
    """upsert() into a table of write_bucketed(), in place: only the folders of buckets that the changes fall in are read and written.

    The new files are staged beside the table and take the folders' places when the whole job is done (dynamic partition
    overwrite), so a run that fails leaves the table as it was, and other buckets keep their files. Returns the buckets
    written, which are `buckets` numbers at most. changes: one row per key; insert_only leaves known keys as they are.
    """
    bucket = bucket_of(keys, buckets)
    touched = sorted(r[0] for r in changes.select(bucket.alias("b")).distinct().collect())
    if not touched:
        return []
    schema = spark.read.parquet(path).schema
    target = spark.read.schema(schema).parquet(path).where(F.col(BUCKET).isin(*touched)).drop(BUCKET)
    merged = upsert(target, changes.select(*target.columns), keys, F.lit(True) if insert_only else keep)
    rows = merged.withColumn(BUCKET, bucket).repartition(BUCKET)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return touched


def full_refresh(target: DataFrame, source: DataFrame, key: str, now: Column) -> DataFrame:
    """The state after an import that lists all that is current.

    target: key, data, is_current, first_seen, last_seen; source: key, data. What the import lacks stays, not current.
    """
    s = source.select(F.col(key).alias("__k"), F.col("data").alias("__data"))
    rows = target.join(s, F.col(key) == F.col("__k"), "full")
    listed = F.col("__k").isNotNull()
    return rows.select(
        F.coalesce(key, "__k").alias(key), F.when(listed, F.col("__data")).otherwise(F.col("data")).alias("data"), listed.alias("is_current"),
        F.coalesce("first_seen", now).alias("first_seen"), F.when(listed, now).otherwise(F.col("last_seen")).alias("last_seen"),
    )


def refresh_counts(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """One row: how many of the import's keys are new and how many known."""
    rows = source.select(key).distinct().join(target.select(key, F.lit(1).alias("__old")).distinct(), key, "left")
    return rows.agg(F.count_if(F.col("__old").isNull()).alias("imported"), F.count_if(F.col("__old").isNotNull()).alias("updated"))


def upsert_features(target: DataFrame, changes: DataFrame, force: bool = False, replace_failed: bool = False) -> DataFrame:
    """Feature rows by (track_id, source): existing success and partial rows stay unless forced, failed ones unless asked."""
    stays = F.col("t.status").isin("success", "partial") | (F.lit(not replace_failed) & F.col("t.status").isin("failed", "not_found"))
    return upsert(target, changes, ["track_id", "source"], None if force else stays)


def soft_delete(segments: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    rows = segments.join(ids.select("segment_id", F.lit(True).alias("__gone")), "segment_id", "left")
    gone = F.col("__gone").isNotNull()
    return rows.withColumn("deleted_at", F.when(gone & F.col("deleted_at").isNull(), now).otherwise(F.col("deleted_at"))).withColumn("path", F.when(~gone, F.col("path"))).drop("__gone")
