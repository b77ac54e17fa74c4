"""Selecting work, choosing the newest or best of several rows, and looking after files and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_AFFECTED = 500
#: After every place in a list.
END = 1 << 30


def latest(rows: DataFrame, by: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key under an order that ends in a unique column."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def best_preview(previews: DataFrame) -> DataFrame:
    return latest(previews, ["track_id"], F.desc_nulls_last("confidence"), F.col("preview_id"))


def best_download(downloads: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """A successful download if there is one, else the first by the order of statuses, then the oldest."""
    place = F.array_position(F.array(*map(F.lit, statuses)), F.col("status"))
    return latest(downloads.where(F.col("status").isin(*statuses)), ["track_id"], F.desc(F.col("status") == "success"), place, F.col("created_at"), F.col("download_id"))


def latest_success(analyses: DataFrame, level: str, version: str) -> DataFrame:
    rows = analyses.where((F.col("level") == level) & (F.col("version") == version) & (F.col("status") == "success"))
    return latest(rows, ["segment_id"], F.desc("analysis_id"))


def select_missing(wanted: DataFrame, covered: DataFrame, limit: int | None = None) -> DataFrame:
    """track_ids wanted and not covered, in order, capped if asked (the cap is the batch size of a job)."""
    rows = wanted.select("track_id").distinct().join(covered.select("track_id"), "track_id", "left_anti")
    return rows.orderBy("track_id").limit(limit) if limit is not None else rows


def incomplete(tracks: DataFrame, done: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Tracks that lack success in one of the requested stages. done: track_id, stage."""
    have = done.where(F.col("stage").isin(*stages)).groupBy("track_id").agg(F.count_distinct("stage").alias("n")).where(F.col("n") == len(set(stages)))
    return tracks.select("track_id").join(have, "track_id", "left_anti")


def affected(ids: DataFrame, tracks: DataFrame, liked: DataFrame, action: str) -> DataFrame:
    """Dry run of like or unlike: each track with eligible and a warning code; ids that no track has are not found."""
    rows = ids.select("track_id").distinct().join(tracks.select("track_id", "name"), "track_id", "left").join(liked.select("track_id", F.lit(True).alias("__l")), "track_id", "left")
    there, is_liked = F.col("name").isNotNull(), F.coalesce("__l", F.lit(False))
    wrong = F.when(~there, "NOT_FOUND").when(is_liked, "ALREADY_LIKED") if action == "like" else F.when(~there, "NOT_FOUND").when(~is_liked, "NOT_LIKED")
    return rows.select("track_id", "name", wrong.isNull().alias("eligible"), wrong.alias("warning"))


def too_many(rows: DataFrame) -> bool:
    """Whether an action would affect more rows than allowed, without counting them all."""
    return rows.limit(MOST_AFFECTED + 1).count() > MOST_AFFECTED


def cleanup_totals(segments: DataFrame, busy: DataFrame, cutoff: Column) -> DataFrame:
    """One row: distinct old files that nothing needs, how many rows they have and their bytes."""
    rows = segments.where(F.col("path").isNotNull() & F.col("deleted_at").isNull() & (F.col("created_at") < cutoff)).join(busy.select("segment_id"), "segment_id", "left_anti")
    files = rows.groupBy("path").agg(F.max("bytes").alias("bytes"), F.count("*").alias("n"))
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("segments"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def orphan_files(spark: SparkSession, path: str, known: DataFrame, pattern: str = "*") -> DataFrame:
    """path, length of files below a folder that no known path names; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.join(known.select("path"), "path", "left_anti")


def backfilled(albums: DataFrame, derived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(albums with covers taken from `derived` where they differ, one row of counts)."""
    rows = albums.join(derived.select("album_id", F.col("cover").alias("__new")), "album_id", "left")
    changes = F.col("__new").isNotNull() & ~F.col("__new").eqNullSafe(F.col("cover"))
    counts = rows.agg(F.count_if(changes).alias("updated"), F.count_if(~changes).alias("skipped"), F.count("*").alias("total"))
    return rows.withColumn("cover", F.when(changes, F.col("__new")).otherwise(F.col("cover"))).drop("__new"), counts


def profile_closure(edges: DataFrame, start: str) -> DataFrame:
    """All that a profile needs, through any number of edges (name, needs), each once, itself included.

    One recursive query over the catalogue; paths end where they would meet themselves.
    """
    query = """
        with recursive found(name, path) as (
            select cast(:start as string), array(cast(:start as string))
            union all
            select e.needs, array_append(f.path, e.needs) from found f join {edges} e on e.name = f.name where e.needs is not null and not array_contains(f.path, e.needs))
        select distinct name from found"""
    return edges.sparkSession.sql(query, args={"start": start}, edges=edges.select("name", "needs"))


def profile_models(profiles: DataFrame, models: DataFrame, start: str) -> DataFrame:
    """model, place (from 0): what a profile runs, in an order in which each model comes after those that it depends on.

    profiles: name, extends, models (an array); models: model, depends_on (an array). A profile's parents come first, the
    farthest ancestor at once; a chain of parents that comes back ends there. Within a profile models go as listed, each after its
    dependencies as listed; a model's first place counts. Dependencies must not form a cycle. A path is a list
    of places and ends with END, which puts a node after all below it, so ordering the paths is the walk. A profile that is
    not there is an error. Catalogues are dozens of rows, so one task may number them.
    """
    spark = profiles.sparkSession
    if profiles.where(F.col("name") == start).isEmpty():
        raise ValueError(f"PROFILE_NOT_FOUND: {start}")
    query = """
        with recursive chain(name, extends, models, depth, seen) as (
            select name, extends, models, 0, array(name) from {profiles} where name = :start
            union all
            select p.name, p.extends, p.models, c.depth + 1, array_append(c.seen, p.name) from chain c join {profiles} p on p.name = c.extends where not array_contains(c.seen, p.name)),
        listed as (select m.col as model, array(-depth, m.pos) as path from chain, lateral posexplode(models) as m),
        walk(model, path) as (
            select model, path from listed
            union all
            select d.col, array_append(w.path, d.pos) from walk w join {models} m on m.model = w.model, lateral posexplode(m.depends_on) as d)
        select model, min(array_append(path, :end)) as first from walk group by model"""
    found = spark.sql(query, args={"start": start, "end": END}, profiles=profiles.select("name", "extends", "models"), models=models.select("model", "depends_on"))
    return found.select("model", (F.row_number().over(Window.orderBy("first")) - 1).alias("place"))


def build_rows(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of several origins (track_id, feature, ...); the first origin that has a feature of a track wins."""
    ranked = [p.withColumn("__turn", F.lit(k)) for k, p in enumerate(parts)]
    union = ranked[0]
    for p in ranked[1:]:
        union = union.unionByName(p, allowMissingColumns=True)
    return latest(union, ["track_id", "feature"], F.col("__turn")).drop("__turn")


def durations(items: DataFrame) -> DataFrame:
    """Per stage: finished items, mean milliseconds, distinct tracks and tracks a minute between first start and last end."""
    ms = F.timestamp_diff("MILLISECOND", F.col("started_at"), F.col("finished_at"))
    minutes = F.timestamp_diff("MILLISECOND", F.min("started_at"), F.max("finished_at")) / 60_000
    rows = items.where(F.col("status") == "success").groupBy("stage").agg(F.count("*").alias("n"), F.avg(ms).alias("mean_ms"), F.count_distinct("track_id").alias("tracks"), minutes.alias("minutes"))
    return rows.select("stage", "n", "mean_ms", "tracks", F.when(F.col("minutes") > 0, F.col("tracks") / F.col("minutes")).otherwise(0.0).alias("per_minute"))
