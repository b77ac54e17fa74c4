"""Landed platform documents to library tables, and plans of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crateflow.functions.status import cover_image
from crateflow.functions.text import normalize
from crateflow.sources.analysis import analysis_documents  # noqa: F401

_ARTIST = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType())])
_IMAGE = T.StructType([T.StructField("width", T.LongType()), T.StructField("url", T.StringType())])
_ALBUM = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("release_date", T.StringType()), T.StructField("images", T.ArrayType(_IMAGE))])
TRACK = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("duration_ms", T.LongType()), T.StructField("explicit", T.BooleanType()),
    T.StructField("popularity", T.LongType()), T.StructField("is_playable", T.BooleanType()), T.StructField("album", _ALBUM), T.StructField("artists", T.ArrayType(_ARTIST)),
    T.StructField("external_ids", T.StructType([T.StructField("isrc", T.StringType())])), T.StructField("linked_from", T.StructType([T.StructField("id", T.StringType())])),
])
SAVED_PAGE = T.StructType([T.StructField("items", T.ArrayType(T.StructType([T.StructField("added_at", T.StringType()), T.StructField("track", TRACK)])))])


def read_pages(spark: SparkSession, path: str, schema: T.StructType = SAVED_PAGE) -> DataFrame:
    """Landed pages of a paged source, one JSON document per file or line; a malformed one has only nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def saved_tracks(pages: DataFrame) -> DataFrame:
    """added_at, track of every item whose track is an object with an id."""
    return pages.select(F.explode("items").alias("i")).where("i.track.id is not null").select(F.try_to_timestamp("i.added_at").cast("timestamp_ntz").alias("added_at"), F.col("i.track").alias("track"))


def normalised(tracks: DataFrame) -> dict[str, DataFrame]:
    """Track documents (track, ordinal) to tables, the last document of an id winning.

    An artist's position counts only artists with an id.
    """
    last = F.row_number().over(Window.partitionBy("track.id").orderBy(F.desc("ordinal")))
    rows = tracks.withColumn("n", last).where("n = 1").select("track.*")
    credited = rows.select(F.col("id").alias("track_id"), F.posexplode(F.filter("artists", lambda a: a["id"].isNotNull())).alias("position", "a"))
    cover = cover_image(F.col("album.images"))
    return {
        "tracks": rows.select(F.col("id").alias("track_id"), "name", normalize(F.col("name")).alias("normalized_title"), "duration_ms", "explicit", "popularity", "is_playable", F.col("album.id").alias("album_id"), F.col("external_ids.isrc").alias("isrc"), F.col("linked_from.id").alias("linked_from")),
        "albums": rows.where("album.id is not null").groupBy(F.col("album.id").alias("album_id")).agg(F.max_by(F.struct(F.col("album.name").alias("name"), F.col("album.release_date").alias("release_date"), cover.alias("cover")), "id").alias("a")).select("album_id", "a.*"),
        "artists": credited.groupBy(F.col("a.id").alias("artist_id")).agg(F.max("a.name").alias("name")),
        "track_artists": credited.select("track_id", F.col("a.id").alias("artist_id"), "position"),
    }


#: Lengths of segments, and the zones of a track in which three of them begin.
SEGMENT_SECONDS, MOST_SECONDS = 15.0, 30.0
ZONES = {"A": 0.10, "B": 0.45, "C": 0.70}


def plan_segments(tracks: DataFrame, seconds: float = SEGMENT_SECONDS) -> DataFrame:
    """Three segments at the zones' starts; one in the middle if the track is shorter than 2.5 of them.

    tracks: track_id, duration_s. Adds segment, start_s and length_s, rounded to a millisecond.
    """
    d = F.col("duration_s")
    s = F.least(F.lit(min(seconds, MOST_SECONDS)), d)
    three = F.array(*[F.struct(F.lit(n).alias("segment"), F.round(F.least(d * at, d - s), 3).alias("start_s"), F.round(s, 3).alias("length_s")) for n, at in ZONES.items()])
    one = F.array(F.struct(F.lit("A").alias("segment"), F.round((d - s) / 2, 3).alias("start_s"), F.round(s, 3).alias("length_s")))
    return tracks.where(d > 0).select("track_id", F.explode(F.when(d < 2.5 * s, one).otherwise(three)).alias("p")).select("track_id", "p.*")


def plan_by_availability(tracks: DataFrame, precise: bool = False, seconds: float = SEGMENT_SECONDS) -> DataFrame:
    """Segments by what can be had: a preview, a search result, both or neither.

    tracks: track_id, duration_s, has_preview, has_search. Adds decision and, per segment, source, segment, start_s and
    length_s; a track with nothing to be had has one row without a segment. Fast plans take a preview whole, whatever length
    is asked for.
    """
    d, preview, search = F.col("duration_s"), F.col("has_preview"), F.col("has_search")
    s = F.least(F.lit(min(seconds, MOST_SECONDS)), d)

    def part(source: str, name: str, start: Column, length: Column) -> Column:
        return F.struct(F.lit(source).alias("source"), F.lit(name).alias("segment"), F.round(start, 3).alias("start_s"), F.round(length, 3).alias("length_s"))

    def centred(name: str, share: float) -> Column:
        start = F.greatest(F.lit(0.0), F.least(d, F.greatest(F.lit(0.0), d * share - s / 2) + s) - s)
        return part("search", name, start, s)

    def whole(length: Column) -> Column:
        return part("preview", "preview", F.lit(0.0), length)

    full = F.lit(MOST_SECONDS)
    if precise:
        plan = F.when(preview & search, F.array(whole(s), centred("1/3", 1 / 3), centred("2/3", 2 / 3))).when(search, F.array(centred("1/4", 0.25), centred("1/2", 0.5), centred("3/4", 0.75))).when(preview, F.array(whole(s)))
        decision = F.when(preview & search, "preview_and_two").when(search, "three_segments").when(preview, "preview_only").otherwise("unavailable")
    else:
        plan = F.when(preview, F.array(whole(full))).when(search, F.array(centred("1/2", 0.5)))
        decision = F.when(preview, "preview_only").when(search, "one_segment").otherwise("unavailable")
    return tracks.where(d > 0).select("track_id", decision.alias("decision"), F.explode_outer(plan).alias("p")).select("track_id", "decision", "p.*")
