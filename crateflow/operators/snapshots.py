"""Library snapshots: creating, comparing and classifying what is missing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("removed_from_liked", "missing_from_current_import", "unavailable", "possibly_relinked", "null_playlist_track")


def create(snapshot_id: str, liked: DataFrame, playlist_tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Full copies, current or not, marked with the snapshot's id."""
    mark = F.lit(snapshot_id).alias("snapshot_id")
    return liked.select(mark, "track_id", "added_at"), playlist_tracks.select(mark, "playlist_id", "position", "track_id")


def set_diff(before: DataFrame, after: DataFrame, key: str = "track_id") -> DataFrame:
    """key, change: added or removed."""
    a, b = before.select(key).distinct(), after.select(key).distinct()
    return b.join(a, key, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, key, "left_anti").withColumn("change", F.lit("removed")))


def changed_playlists(before: DataFrame, after: DataFrame) -> DataFrame:
    """Playlists in both whose track at some position differs (a position in one only differs too)."""
    both = before.select("playlist_id").distinct().join(after.select("playlist_id").distinct(), "playlist_id", "left_semi")
    a = before.select("playlist_id", "position", F.col("track_id").alias("old"), F.lit(1).alias("in_old"))
    b = after.select("playlist_id", "position", F.col("track_id").alias("new"), F.lit(1).alias("in_new"))
    rows = a.join(b, ["playlist_id", "position"], "full").join(both, "playlist_id", "left_semi")
    differs = F.col("in_old").isNull() | F.col("in_new").isNull() | ~F.col("old").eqNullSafe(F.col("new"))
    return rows.where(differs).select("playlist_id").distinct()


def sync_diff(wanted: DataFrame, present: DataFrame, key: str = "track_id") -> DataFrame:
    """key, action: to_add, to_remove or unchanged; repetitions collapse."""
    a = wanted.select(key, F.lit(True).alias("w")).distinct()
    b = present.select(key, F.lit(True).alias("p")).distinct()
    action = F.when(F.col("p").isNull(), "to_add").when(F.col("w").isNull(), "to_remove").otherwise("unchanged")
    return a.join(b, key, "full").select(key, action.alias("action"))


def latest_two(snapshots: DataFrame) -> DataFrame:
    """One row: snapshot_id and the one created before it."""
    order = Window.orderBy(F.desc("created_at"), F.desc("snapshot_id"))
    return snapshots.orderBy(F.desc("created_at"), F.desc("snapshot_id")).limit(2).withColumn("previous_id", F.lead("snapshot_id").over(order)).orderBy(F.desc("created_at"), F.desc("snapshot_id")).limit(1).select("snapshot_id", "previous_id")


def status_of(empty: Column, before: Column, after: Column, now: Column, playable: Column, relinked: Column) -> Column:
    """The first status that applies. before, after, now: whether the track was liked in either snapshot and is today."""
    return (
        F.when(empty, "null_playlist_track")
        .when(before & ~after, "removed_from_liked")
        .when(after & ~now, "missing_from_current_import")
        .when(playable == F.lit(False), "unavailable")
        .when(relinked, "possibly_relinked")
    )


def classify(liked_before: DataFrame, liked_after: DataFrame, items_before: DataFrame, items_after: DataFrame, liked_now: DataFrame, tracks: DataFrame) -> DataFrame:
    """track_id, playlist_id, position, status over removed likes, added likes and changed or empty playlist positions.

    A (track, playlist, position) keeps the first status in that order. liked_now counts all rows, current or not;
    tracks: track_id, is_playable, linked_from.
    """
    diff = set_diff(liked_before, liked_after)
    none = [F.lit(None).cast("long").alias("playlist_id"), F.lit(None).cast("int").alias("position")]
    branches = diff.select("track_id", *none, F.col("change").alias("branch"), F.when(F.col("change") == "removed", 0).otherwise(1).alias("turn"))
    old = items_before.select("playlist_id", "position", F.col("track_id").alias("old"), F.lit(True).alias("had"))
    items = items_after.join(old, ["playlist_id", "position"], "left")
    moved = items.where(F.col("track_id").isNull() | F.col("had").isNull() | ~F.col("track_id").eqNullSafe(F.col("old")))
    changed = moved.select("track_id", "playlist_id", "position", F.when(F.col("track_id").isNull(), "null_item").otherwise("item").alias("branch"), F.lit(2).alias("turn"))
    rows = branches.unionByName(changed)
    for name, likes in (("before", liked_before), ("after", liked_after), ("now", liked_now)):
        rows = rows.join(likes.select("track_id", F.lit(True).alias(name)).distinct(), "track_id", "left")
    rows = rows.join(tracks.select("track_id", "is_playable", "linked_from"), "track_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = rows.withColumn("status", status_of(F.col("branch") == "null_item", yes("before"), yes("after"), yes("now"), F.col("is_playable"), F.col("linked_from").isNotNull())).where("status is not null")
    first = F.row_number().over(Window.partitionBy("track_id", "playlist_id", "position").orderBy("turn"))
    return rows.withColumn("n", first).where("n = 1").select("track_id", "playlist_id", "position", "status")


def ids_of_status(tables: Mapping[str, DataFrame], status: str) -> DataFrame:
    """track_ids that the two latest snapshots give a status; none where there are fewer than two.

    tables: snapshots (snapshot_id, created_at), liked_snapshots and playlist_snapshots (rows of create()), liked, tracks.
    """
    pair = latest_two(tables["snapshots"]).where(F.col("previous_id").isNotNull())

    def of(name: str, which: str) -> DataFrame:
        return tables[name].join(F.broadcast(pair.select(F.col(which).alias("snapshot_id"))), "snapshot_id", "left_semi")  # one row at most

    found = classify(of("liked_snapshots", "previous_id"), of("liked_snapshots", "snapshot_id"), of("playlist_snapshots", "previous_id"), of("playlist_snapshots", "snapshot_id"), tables["liked"], tables["tracks"])
    return found.where((F.col("status") == status) & F.col("track_id").isNotNull()).select("track_id").distinct()


def status_counts(classified: DataFrame) -> DataFrame:
    """All statuses, with 0 where none."""
    spark = classified.sparkSession
    every = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    return every.join(classified.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))
