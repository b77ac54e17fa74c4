"""Faceted track search: one lazy plan from a specification.

The library's tables are joined only where a facet or the sort needs them. The page is found on narrow rows and the
details are joined to it afterwards, so sorting never carries them.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crateflow.functions.text import plain
from crateflow.operators import snapshots

Tables = Mapping[str, DataFrame]

SORT_KEYS = ("title", "artist", "album", "duration", "popularity", "added_at", "playlist_count", "isrc")
MOST_PER_PAGE, MOST_IDS = 200, 500


@dataclass(frozen=True)
class SearchSpec:
    """Facets are joined by AND; None means absent. `q` and the text facets are LIKE patterns within the normalised column."""

    q: str | None = None
    title: str | None = None
    artist: str | None = None
    album: str | None = None
    isrc: str | None = None
    liked: bool | None = None
    playlist_id: int | None = None
    in_any_playlist: bool | None = None
    not_in_any_playlist: bool | None = None
    market_status: str | None = None
    duration_min: int | None = None
    duration_max: int | None = None
    added_from: str | None = None
    added_to: str | None = None
    ids: DataFrame | None = None
    duplicate_ids: DataFrame | None = None
    duplicate_status: str | None = None
    snapshot_status: str | None = None
    sort: str = "title"
    descending: bool = False
    page: int = 1
    page_size: int = 50

    def checked(self) -> SearchSpec:
        if self.sort not in SORT_KEYS:
            raise ValueError(f"unknown sort key {self.sort}")
        if self.page < 1:
            raise ValueError("pages begin with 1")
        return SearchSpec(**{**self.__dict__, "page_size": max(1, min(MOST_PER_PAGE, self.page_size))})


def _like(column: Column, text: str) -> Column:
    """Wildcards in the text stay wildcards."""
    return column.like(f"%{' '.join(plain(text).split())}%")


def _artists_like(tables: Tables, text: str) -> DataFrame:
    hits = tables["artists"].where(_like(F.col("normalized_name"), text)).select("artist_id")
    return tables["track_artists"].join(hits, "artist_id", "left_semi").select("track_id").distinct()


def matching(tables: Tables, spec: SearchSpec) -> DataFrame:
    """Narrow rows of the matching tracks: track_id, title and the columns that facets and sort have joined."""
    rows = tables["tracks"].select("track_id", "normalized_title", "duration_ms", "popularity", "album_id", "market_status", "isrc")
    wants_liked = spec.liked is not None or spec.added_from or spec.added_to or spec.sort == "added_at"
    if wants_liked:
        rows = rows.join(tables["liked"].select("track_id", "added_at", F.lit(True).alias("liked")), "track_id", "left")
    if spec.q or spec.album or spec.sort == "album":
        rows = rows.join(tables["albums"].select("album_id", F.col("normalized_name").alias("album_name")), "album_id", "left")
    if spec.q:
        by_artist = _artists_like(tables, spec.q).withColumn("by_artist", F.lit(True))
        rows = rows.join(by_artist, "track_id", "left")
        named = _like(F.col("normalized_title"), spec.q) | F.coalesce(_like(F.col("album_name"), spec.q), F.lit(False))
        rows = rows.where(named | F.col("by_artist").isNotNull() | F.coalesce(F.col("isrc").like(f"%{spec.q.strip()}%"), F.lit(False))).drop("by_artist")
    if spec.title:
        rows = rows.where(_like(F.col("normalized_title"), spec.title))
    if spec.album:
        rows = rows.where(_like(F.col("album_name"), spec.album))
    if spec.artist:
        rows = rows.join(_artists_like(tables, spec.artist), "track_id", "left_semi")
    if spec.isrc:
        rows = rows.where(F.col("isrc") == spec.isrc.strip())
    if spec.liked is not None:
        rows = rows.where(F.col("liked").isNotNull() if spec.liked else F.col("liked").isNull())
    current = tables["playlist_tracks"].where("is_current")
    if spec.playlist_id is not None:
        rows = rows.join(current.where(F.col("playlist_id") == spec.playlist_id).select("track_id"), "track_id", "left_semi")
    if spec.in_any_playlist:
        rows = rows.join(current.select("track_id"), "track_id", "left_semi")
    elif spec.not_in_any_playlist:
        rows = rows.join(current.select("track_id"), "track_id", "left_anti")
    if spec.market_status:
        rows = rows.where(F.col("market_status") == spec.market_status)
    for value, test in ((spec.duration_min, F.col("duration_ms") >= F.lit(spec.duration_min)), (spec.duration_max, F.col("duration_ms") <= F.lit(spec.duration_max))):
        rows = rows.where(test) if value is not None else rows
    if spec.added_from:
        rows = rows.where(F.col("added_at") >= F.lit(spec.added_from).cast("timestamp_ntz"))
    if spec.added_to:
        rows = rows.where(F.col("added_at") <= F.lit(spec.added_to).cast("timestamp_ntz"))
    if spec.ids is not None:
        rows = rows.join(spec.ids, "track_id", "left_semi")
    if spec.duplicate_status and spec.duplicate_ids is not None:
        rows = rows.join(spec.duplicate_ids, "track_id", "left_anti" if spec.duplicate_status == "none" else "left_semi")
    if spec.snapshot_status:
        rows = rows.join(snapshots.ids_of_status(tables, spec.snapshot_status), "track_id", "left_semi")
    if spec.sort == "artist":
        first = tables["track_artists"].where("position = 0").join(tables["artists"], "artist_id").select("track_id", F.col("normalized_name").alias("artist_name"))
        rows = rows.join(first, "track_id", "left")
    if spec.sort == "playlist_count":
        rows = rows.join(playlist_counts(tables["playlist_tracks"]), "track_id", "left").withColumn("playlist_count", F.coalesce("playlist_count", F.lit(0)))
    return rows


def playlist_counts(items: DataFrame) -> DataFrame:
    return items.where("is_current").groupBy("track_id").agg(F.count("*").alias("playlist_count"))


def count(tables: Tables, spec: SearchSpec) -> DataFrame:
    """One row: how many tracks match, on the plan without the sort's joins."""
    return matching(tables, SearchSpec(**{**spec.__dict__, "sort": "title"})).agg(F.count("*").alias("total"))


def order_column(spec: SearchSpec) -> str:
    return {"title": "normalized_title", "artist": "artist_name", "album": "album_name", "duration": "duration_ms"}.get(spec.sort, spec.sort)


def order(spec: SearchSpec) -> list[Column]:
    """Nulls are smallest, as in SQLite; equal keys by id."""
    name = order_column(spec)
    return [F.col(name).desc_nulls_last() if spec.descending else F.col(name).asc_nulls_first(), F.col("track_id")]


def page_ids(tables: Tables, spec: SearchSpec) -> DataFrame:
    """track_id, position (from 0 over all pages) and album_id of the page's tracks."""
    spec = spec.checked()
    keys = order(spec)
    rows = matching(tables, spec).orderBy(*keys).offset((spec.page - 1) * spec.page_size).limit(spec.page_size)
    # a page has MOST_PER_PAGE rows at most, so its numbering may be one task's work
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*keys)) - 1 + (spec.page - 1) * spec.page_size).select("track_id", "position", "album_id")


#: Rows before a page from which it is found by ranges instead of a sort of all; how many ranges, and samples for each.
DEEP, RANGES, SAMPLES = 20_000, 64, 40


def _precedes(spec: SearchSpec, name: str, key: Any, track_id: Any, kind: str) -> Column:
    """Whether a row comes before (key, track_id) in the order of order()."""
    c, k = F.col(name), F.lit(key).cast(kind)
    if key is None:
        less, same = (c.isNotNull() if spec.descending else F.lit(False)), c.isNull()
    else:
        less = F.coalesce(c > k, F.lit(False)) if spec.descending else c.isNull() | F.coalesce(c < k, F.lit(False))
        same = F.coalesce(c == k, F.lit(False))
    return less | (same & (F.col("track_id") < track_id))


def deep_page_ids(tables: Tables, spec: SearchSpec) -> DataFrame:
    """page_ids() for a page far behind: the rows of its ranges alone are sorted, a few in RANGES of all.

    The bounds of the ranges are every SAMPLES-th of the matching keys with the smallest hashes of ids, so they are the same each time.
    One pass counts the rows of each range; the counts tell which ranges the page lies in and how many rows come
    before them. Bounds hold the id too, so equal keys are split. RANGES numbers come to the driver.
    """
    spec = spec.checked()
    keys, name = order(spec), order_column(spec)
    rows = matching(tables, spec)
    kind = rows.schema[name].dataType.simpleString()
    sample = rows.select(name, "track_id").orderBy(F.xxhash64("track_id"), "track_id").limit(RANGES * SAMPLES)
    numbered = sample.orderBy(*keys).collect()
    bounds = [tuple(r) for r in numbered[SAMPLES::SAMPLES]]
    place = F.lit(0)
    for key, track_id in bounds:
        place = place + F.when(_precedes(spec, name, key, track_id, kind), 0).otherwise(1)
    counts = dict(map(tuple, rows.groupBy(place.alias("range")).count().collect()))
    first = (spec.page - 1) * spec.page_size
    before, low, high, upto = 0, None, None, 0
    for k in range(len(bounds) + 1):
        n = counts.get(k, 0)
        if upto + n > first and low is None:
            low, before = k, upto
        if low is not None:
            high = k
            if upto + n >= first + spec.page_size:
                break
        upto += n
    if low is None:
        return rows.limit(0).select("track_id", F.lit(0).alias("position"), "album_id")
    some = rows if low == 0 else rows.where(~_precedes(spec, name, *bounds[low - 1], kind))
    some = some if high == len(bounds) else some.where(_precedes(spec, name, *bounds[high], kind))
    found = some.orderBy(*keys).offset(first - before).limit(spec.page_size)
    return found.withColumn("position", F.row_number().over(Window.orderBy(*keys)) - 1 + first).select("track_id", "position", "album_id")


def page(tables: Tables, spec: SearchSpec) -> DataFrame:
    """The page's tracks with their details, artists in order and playlist counts.

    The ids are found once and are a local table of MOST_PER_PAGE rows at most, which all lookups share.
    """
    ids_of = deep_page_ids if (spec.page - 1) * spec.page_size >= DEEP else page_ids
    found = [tuple(r) for r in ids_of(tables, spec).collect()]  # a page
    kind = tables["tracks"].schema["track_id"].dataType.simpleString()
    ids = tables["tracks"].sparkSession.createDataFrame([r[:2] for r in found], f"track_id {kind}, position int")
    numbers, albums = [r[0] for r in found], sorted({r[2] for r in found if r[2] is not None})
    rows = F.broadcast(ids).join(tables["tracks"].where(F.col("track_id").isin(*numbers)), "track_id")
    rows = rows.join(tables["albums"].where(F.col("album_id").isin(*albums)).select("album_id", F.col("name").alias("album")), "album_id", "left")
    rows = rows.join(tables["liked"].where(F.col("track_id").isin(*numbers)).select("track_id", F.lit(True).alias("is_liked"), "added_at"), "track_id", "left")
    rows = rows.join(artists_in_order(tables, tables["track_artists"].where(F.col("track_id").isin(*numbers))), "track_id", "left")
    rows = rows.join(playlist_counts(tables["playlist_tracks"].where(F.col("track_id").isin(*numbers))), "track_id", "left")
    return rows.select(
        "position", "track_id", "name", "album", "artists", "duration_ms", "popularity", "isrc", F.coalesce("market_status", F.lit("unknown")).alias("market_status"),
        F.coalesce("is_liked", F.lit(False)).alias("liked"), "added_at", F.coalesce("playlist_count", F.lit(0)).alias("playlist_count"),
    )


def artists_in_order(tables: Tables, credited: DataFrame | None = None) -> DataFrame:
    """track_id and its artists' names by position."""
    links = tables["track_artists"] if credited is None else credited
    named = links.join(tables["artists"], "artist_id")
    return named.groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda a: a["name"]).alias("artists"))


def page_count(total: int, size: int) -> int:
    return -(-total // size) if total else 0


def search_ids(tables: Tables, **facets: Any) -> DataFrame:
    """Ids for other operators, by title, capped."""
    spec = SearchSpec(**facets).checked()
    return matching(tables, spec).orderBy(*order(spec)).limit(MOST_IDS).select("track_id")
