"""Lists and lookups: filtered, ordered and paged rows, and the context that other operators ask for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crateflow.functions.status import local_analysis

SHOWN_FROM = 0.60


def filtered(rows: DataFrame, **equal: object) -> DataFrame:
    """Rows whose columns have the given values; None means any."""
    for name, value in equal.items():
        rows = rows.where(F.col(name) == F.lit(value)) if value is not None else rows
    return rows


def paged(rows: DataFrame, order: Sequence[Column], page: int = 1, size: int = 50) -> DataFrame:
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def newest_first(rows: DataFrame, time: str, unique: str, page: int = 1, size: int = 50) -> DataFrame:
    return paged(rows, [F.desc_nulls_last(time), F.desc(unique)], page, size)


def exists(rows: DataFrame) -> bool:
    """Whether there is any row, without counting."""
    return not rows.isEmpty()


def running_jobs(jobs: DataFrame, job_type: str) -> DataFrame:
    """Jobs that keep another of their type from starting."""
    return jobs.where((F.col("job_type") == job_type) & F.col("status").isin("queued", "running"))


def seen_since(workers: DataFrame, since: Column, worker_type: str | None = None) -> DataFrame:
    return filtered(workers.where(F.col("last_seen_at") >= since), worker_type=worker_type)


def usable_previews(previews: DataFrame, for_display: bool = True) -> DataFrame:
    """Available previews with a url; for display they need some confidence too."""
    rows = previews.where((F.col("status") == "available") & (F.coalesce("url", F.lit("")) != ""))
    return rows.where(F.col("confidence") >= SHOWN_FROM) if for_display else rows


def active_segments(segments: DataFrame, with_file: bool = False) -> DataFrame:
    rows = segments.where(F.col("deleted_at").isNull())
    return (rows.where(F.col("path").isNotNull()) if with_file else rows).orderBy("track_id", "segment_type", "segment_id")


def stage_items(items: DataFrame, stages: Sequence[str], statuses: Sequence[str], limit: int) -> DataFrame:
    """The oldest items of these stages and statuses, one batch."""
    return items.where(F.col("stage").isin(*stages) & F.col("status").isin(*statuses)).orderBy("created_at", "item_id").limit(limit)


def open_items(items: DataFrame, limit: int = 50) -> DataFrame:
    """Items that are not final, by stage and status, for a look at a stuck job."""
    return items.where(~F.col("status").isin("success", "failed", "skipped", "cancelled")).orderBy("stage", "status", "item_id").limit(limit)


def of_terminal_jobs(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Pending and blocked items whose job has ended: those to cancel."""
    ended = jobs.where(F.col("status").isin("succeeded", "failed", "partial", "cancelled")).select("job_id")
    return items.where(F.col("status").isin("pending", "blocked")).join(ended, "job_id", "left_semi")


def rows_of_tracks(rows: DataFrame, ids: DataFrame, sources: Sequence[str] = ()) -> DataFrame:
    found = rows.join(ids.select("track_id"), "track_id", "left_semi")
    return found.where(F.col("source").isin(*sources)) if sources else found


def playlists_of_tracks(items: DataFrame, playlists: DataFrame) -> DataFrame:
    """track_id and its current playlists, by name and id."""
    named = items.where("is_current").select("track_id", "playlist_id").distinct().join(playlists.select("playlist_id", "name"), "playlist_id")
    return named.groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("name", "playlist_id"))), lambda p: p["playlist_id"]).alias("playlist_ids"))


def track_context(tracks: DataFrame, track_artists: DataFrame, artists: DataFrame) -> DataFrame:
    """track_id, name, isrc, artist: the first by position, else "Unknown"."""
    first = track_artists.join(artists, "artist_id").groupBy("track_id").agg(F.min_by("name", "position").alias("artist"))
    return tracks.select("track_id", "name", "isrc").join(first, "track_id", "left").withColumn("artist", F.coalesce("artist", F.lit("Unknown")))


def lookup_ids(tracks: DataFrame, external_ids: DataFrame, force: bool = False) -> DataFrame:
    """track_id and the id to ask a service with: its cached one unless forced, the platform's, else the ISRC.

    external_ids: track_id, id_type (service, isrc), value.
    """
    wide = external_ids.groupBy("track_id").agg(*[F.max(F.when(F.col("id_type") == t, F.col("value"))).alias(f"__{t}") for t in ("service", "isrc")])
    rows = tracks.select("track_id", "platform_id").join(wide, "track_id", "left")
    asked = F.coalesce("platform_id", "__isrc") if force else F.coalesce("__service", "platform_id", "__isrc")
    return rows.select("track_id", asked.alias("request_id")).where("request_id is not null")


def segments_of_job(downloads: DataFrame, segments: DataFrame) -> DataFrame:
    """job_id, track_id, segment_id of successful downloads; where a job and track has none, segments whose path names the job."""
    done = downloads.where("status = 'success'").select("job_id", "track_id", "segment_id")
    without = downloads.select("job_id", "track_id").distinct().join(done, ["job_id", "track_id"], "left_anti")
    named = without.join(segments.select("track_id", "segment_id", "path"), "track_id").where(F.contains(F.col("path"), F.col("job_id").cast("string")))
    return done.unionByName(named.select("job_id", "track_id", "segment_id"))


def bound_slots(items: DataFrame, ready: DataFrame) -> DataFrame:
    """items with segment_id bound for the slot (job, track, segment index) that a download has filled.

    Blocked items of a bound slot become pending. ready: job_id, track_id, segment_index, segment_id.
    """
    filled = ready.withColumnRenamed("segment_id", "__s")
    rows = items.join(filled, ["job_id", "track_id", "segment_index"], "left")
    bound = F.col("__s").isNotNull()
    return rows.withColumn("segment_id", F.coalesce("segment_id", "__s")).withColumn("status", F.when(bound & (F.col("status") == "blocked"), "pending").otherwise(F.col("status"))).drop("__s")


def feature_status(ids: DataFrame, features: DataFrame, advanced: DataFrame, previews: DataFrame) -> DataFrame:
    """Per track: the statuses of its sources, of local analysis, and whether a preview can be shown."""
    per = features.where("is_active").groupBy("track_id").agg(*[F.max(F.when(F.col("source") == s, F.col("status"))).alias(s) for s in ("api", "local")])
    has = advanced.where(F.col("status").isin("success", "partial")).select("track_id", F.lit("success").alias("advanced")).distinct()
    shown = usable_previews(previews).select("track_id", F.lit(True).alias("preview")).distinct()
    rows = ids.select("track_id").join(per, "track_id", "left").join(has, "track_id", "left").join(shown, "track_id", "left")
    return rows.select("track_id", F.coalesce("api", F.lit("missing")).alias("api"), local_analysis(F.col("local"), F.col("advanced")).alias("local_analysis"), F.coalesce("preview", F.lit(False)).alias("preview_available"))


def resolved_features(resolved: DataFrame, catalogue: Mapping[str, tuple[int, str]], aliases: Sequence[str] = ()) -> DataFrame:
    """Scalar features for display by phase and label: track_id, features (array of struct(phase, label, feature, value, status)).

    catalogue: feature to (phase, label); aliases and features not in it are left out.
    """
    names = {k: v for k, v in catalogue.items() if k not in aliases}
    phase, label = F.lit(None).cast("int"), F.lit(None).cast("string")
    for name, (p, text) in names.items():
        phase = F.when(F.col("feature") == name, p).otherwise(phase)
        label = F.when(F.col("feature") == name, text).otherwise(label)
    rows = resolved.withColumns({"phase": phase, "label": label}).where("phase is not null")
    return rows.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("phase", "label", "feature", "value", "status"))).alias("features"))


def status_rollup(rows: DataFrame) -> DataFrame:
    """Per track: success if any row is usable, else model_missing if any is, else missing."""
    state = F.when(F.bool_or(F.col("status").isin("success", "partial")), "success").when(F.bool_or(F.col("status") == "model_missing"), "model_missing").otherwise("missing")
    return rows.groupBy("track_id").agg(state.alias("status"))


def library_summary(tracks: DataFrame, playlists: DataFrame, albums: DataFrame) -> DataFrame:
    """One row: tracks, playlists, albums."""
    counts = [t.agg(F.count("*").alias(n)) for n, t in (("tracks", tracks), ("playlists", playlists), ("albums", albums))]
    return counts[0].join(F.broadcast(counts[1]), F.lit(True)).join(F.broadcast(counts[2]), F.lit(True))


def numbered(rows: DataFrame, by: Sequence[str], *order: Column) -> DataFrame:
    """position from 0 within each key."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def metadata(ids: DataFrame, tracks: DataFrame, albums: DataFrame, track_artists: DataFrame, artists: DataFrame) -> DataFrame:
    """track_id, name, album and the artists' names in order of the tracks named by ids; those that no track has are left out."""
    wanted = ids.select("track_id").distinct()
    rows = tracks.select("track_id", "name", "album_id").join(wanted, "track_id", "left_semi").join(albums.select("album_id", F.col("name").alias("album")), "album_id", "left")
    credits = track_artists.join(wanted, "track_id", "left_semi").join(artists.select("artist_id", F.col("name").alias("artist")), "artist_id")
    ordered = credits.groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "artist"))), lambda a: a["artist"]).alias("artists"))
    return rows.join(ordered, "track_id", "left").select("track_id", "name", "album", "artists")


def ids_to_audit(previews: DataFrame, downloads: DataFrame, segments: DataFrame, limit: int) -> DataFrame:
    """The first track_ids of previews, of downloads whose metadata (JSON) tell a decision, and of segments, each once."""
    decided = downloads.where(F.get_json_object("metadata", "$.decision").isNotNull())
    ids = previews.select("track_id").unionByName(decided.select("track_id")).unionByName(segments.select("track_id"))
    return ids.distinct().orderBy("track_id").limit(limit)


def temp_file_counts(segments: DataFrame) -> DataFrame:
    """track_id and its files that are there and not deleted."""
    return segments.where(F.col("path").isNotNull() & F.col("deleted_at").isNull()).groupBy("track_id").agg(F.count("*").alias("files"))
