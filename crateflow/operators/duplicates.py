"""Duplicate groups of tracks by ISRC and by title and artist, and how they are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of a duration bucket, and how sure each strategy is.
BUCKET_MS = 3000
CONFIDENCE = {"isrc": 1.0, "title_artist": 0.85, "title_artist_duration": 0.85}
STRATEGIES = tuple(CONFIDENCE)


def isrc_groups(tracks: DataFrame) -> DataFrame:
    """group_key, track_ids (sorted) of ISRCs that several tracks share; null and empty ones make no group."""
    return _groups(tracks.where(F.col("isrc").isNotNull() & (F.col("isrc") != "")).withColumn("key", F.col("isrc")), "isrc")


def title_artist_groups(tracks: DataFrame, with_duration: bool = False) -> DataFrame:
    """By normalised title and first artist, and by duration bucket if asked; tracks lacking either make no group.

    The spread of durations within a bucket is below its width by construction; near tracks on both sides of a bucket's
    edge stay apart.
    """
    rows = tracks.where((F.col("normalized_title") != "") & (F.col("artist") != ""))
    key = F.concat_ws("|", "normalized_title", "artist")
    if with_duration:
        key = F.concat_ws("|", key, F.floor(F.col("duration_ms") / BUCKET_MS).cast("string"))
    return _groups(rows.withColumn("key", key), "title_artist_duration" if with_duration else "title_artist", BUCKET_MS if with_duration else None)


def _groups(rows: DataFrame, strategy: str, most_spread: int | None = None) -> DataFrame:
    found = rows.groupBy("key").agg(F.array_sort(F.collect_set("track_id")).alias("track_ids"), (F.max("duration_ms") - F.min("duration_ms")).alias("spread_ms")).where(F.size("track_ids") > 1)
    if most_spread is not None:
        found = found.where(F.col("spread_ms") <= most_spread)
    return found.select(F.lit(strategy).alias("strategy"), F.lit(CONFIDENCE[strategy]).alias("confidence"), F.col("key").alias("group_key"), "track_ids", "spread_ms")


def all_groups(tracks: DataFrame) -> DataFrame:
    """The groups of all strategies; of equal member sets the first strategy's stays."""
    union = isrc_groups(tracks).unionByName(title_artist_groups(tracks)).unionByName(title_artist_groups(tracks, True))
    rank = F.array_position(F.array(*map(F.lit, STRATEGIES)), F.col("strategy"))
    first = F.row_number().over(Window.partitionBy("track_ids").orderBy(rank, "group_key"))
    return union.withColumn("n", first).where("n = 1").drop("n")


def page(groups: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    return groups.orderBy(F.desc("confidence"), "strategy", "group_key").offset((number - 1) * size).limit(size)


def summary(groups: DataFrame) -> DataFrame:
    return groups.groupBy("strategy").agg(F.count("*").alias("groups"), F.sum(F.size("track_ids")).alias("tracks"))


def shown(members: DataFrame) -> DataFrame:
    """Two-level collapse of a group's occurrences: by platform id, then by fingerprint; occurrences add up, ids unite.

    members: group_key, platform_id, fingerprint, track_id, isrc, occurrences.
    """
    by_id = members.groupBy("group_key", "platform_id").agg(F.min("fingerprint").alias("fingerprint"), F.sum("occurrences").alias("occurrences"), F.collect_set("track_id").alias("ids"), F.min("isrc").alias("isrc"))
    return by_id.groupBy("group_key", "fingerprint").agg(F.sum("occurrences").alias("occurrences"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("track_ids"), F.min("isrc").alias("isrc"))


def headers(collapsed: DataFrame) -> DataFrame:
    """occurrence and unique counts per group; repeated: one unique track that occurs several times."""
    found = collapsed.groupBy("group_key").agg(F.sum("occurrences").alias("occurrences"), F.count("*").alias("uniques"), F.min("isrc").alias("isrc"))
    return found.withColumn("is_repeated", (F.col("uniques") == 1) & (F.col("occurrences") > 1))


def first_per_isrc(tracks: DataFrame) -> DataFrame:
    """The smallest track_id of each ISRC; tracks without one all stay."""
    known = F.col("isrc").isNotNull() & (F.col("isrc") != "")
    least = tracks.where(known).groupBy("isrc").agg(F.min("track_id").alias("track_id"))
    return tracks.where(~known).unionByName(tracks.join(least, ["isrc", "track_id"], "left_semi"))
