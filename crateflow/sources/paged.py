"""Landed pages of a paged service as a data source: a task per range of pages, read whole or as a stream.

Pages lie as one JSON document each in folders `offset=<n>` (for items of playlists in `playlist=<id>/offset=<n>`), as
a table written by partitions of offset has them. Register with spark.dataSource.register(LandedPages), then
spark.read.format("landed_pages").option("kind", "saved_tracks").load(path).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

_TRACK = "track_id string, name string, duration_ms long, explicit boolean, popularity long, is_playable boolean, isrc string, album_id string, album_name string, artist_ids array<string>, linked_from string"
KINDS = {
    "saved_tracks": f"place long, added_at string, {_TRACK}",
    "playlists": "place long, playlist_id string, name string, snapshot_id string, owner_id string, tracks_total long",
    "playlist_items": f"playlist_id string, place long, added_at string, is_local boolean, item_kind string, {_TRACK}",
}
#: Items that a page has, all but the last; pages that a task reads.
LIMIT, PAGES = 50, 20
_NAME = re.compile(r"(?:playlist=([^/]+)/)?offset=(\d+)/[^/_.][^/]*$")


def _dig(node: Any, *names: str) -> Any:
    for name in names:
        node = node.get(name) if isinstance(node, dict) else None
    return node


#: How each column is found in an item. Columns that a reader doesn't ask for are not looked up.
_OF_TRACK = {
    "track_id": ("id",), "name": ("name",), "duration_ms": ("duration_ms",), "explicit": ("explicit",), "popularity": ("popularity",), "is_playable": ("is_playable",), "isrc": ("external_ids", "isrc"),
    "album_id": ("album", "id"), "album_name": ("album", "name"), "linked_from": ("linked_from", "id"),
}
_OF_PLAYLIST = {"playlist_id": ("id",), "name": ("name",), "snapshot_id": ("snapshot_id",), "owner_id": ("owner", "id"), "tracks_total": ("tracks", "total")}


def _value(kind: str, column: str, item: dict, place: int, playlist: str | None) -> Any:
    if column == "place":
        return place
    if kind == "playlists":
        return _dig(item, *_OF_PLAYLIST[column])
    if column == "playlist_id":
        return playlist
    if column in ("added_at", "is_local"):
        return item.get(column) if column == "added_at" else bool(item.get("is_local") or _dig(item, "track", "is_local"))
    track = item.get("track")
    if column == "item_kind":
        return _dig(track, "type")
    if column == "artist_ids":
        return [a["id"] for a in _dig(track, "artists") or [] if isinstance(a, dict) and a.get("id")] if isinstance(track, dict) else None
    return _dig(track, *_OF_TRACK[column])


@dataclass
class PageRange(InputPartition):
    pages: list[tuple[str, int, str]]  # playlist or '', offset, file


class _Pages:
    def __init__(self, options: dict, schema: StructType):
        self.kind, self.limit, self.per_task = options.get("kind", "saved_tracks"), int(options.get("limit", LIMIT)), int(options.get("pages_per_task", PAGES))
        self.columns, self.path = [f.name for f in schema.fields], options["path"]

    def found(self) -> list[tuple[str, int, str]]:
        """All pages by playlist and offset; the files are listed, not read."""
        store, root = fs.FileSystem.from_uri(self.path if ":" in self.path else f"file://{self.path}")
        files = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        named = [(m.group(1) or "", int(m.group(2)), f.path) for f in files if f.is_file and (m := _NAME.search(f.path))]
        return sorted(named)

    def whole(self) -> list[tuple[str, int, str]]:
        """found(), if no page is missing between the first and the last of each sequence; the last must be the end of the total."""
        pages = self.found()
        for k, (playlist, offset, _) in enumerate(pages):
            want = pages[k - 1][1] + self.limit if k and pages[k - 1][0] == playlist else 0
            if offset != want:
                raise ValueError(f"page {want} of {playlist or self.kind} is missing before page {offset}")
        last = [p for k, p in enumerate(pages) if k + 1 == len(pages) or pages[k + 1][0] != p[0]]
        for playlist, offset, file in last:
            total = self.document(file).get("total")
            if total is not None and total > offset + self.limit:
                raise ValueError(f"pages of {playlist or self.kind} end at {offset + self.limit} of {total}")
        return pages

    def document(self, file: str) -> dict:
        store, _ = fs.FileSystem.from_uri(self.path if ":" in self.path else f"file://{self.path}")
        with store.open_input_stream(file) as f:
            page = json.loads(f.read())
        if not isinstance(page, dict):
            raise ValueError(f"{file} is no page")
        return page

    def ranges(self, pages: list[tuple[str, int, str]]) -> list[PageRange]:
        return [PageRange(pages[k : k + self.per_task]) for k in range(0, len(pages), self.per_task)]

    def rows(self, some: PageRange | None) -> Iterator[tuple]:
        for playlist, offset, file in some.pages if some else []:
            for k, item in enumerate(self.document(file).get("items") or []):
                if not isinstance(item, dict):
                    continue
                if self.kind == "saved_tracks" and not _dig(item, "track", "id"):
                    continue
                yield tuple(_value(self.kind, c, item, offset + k, playlist) for c in self.columns)


class _Reader(DataSourceReader):
    def __init__(self, pages: _Pages):
        self.pages = pages

    def partitions(self) -> list[PageRange]:
        return self.pages.ranges(self.pages.whole())

    def read(self, partition: PageRange) -> Iterator[tuple]:
        return self.pages.rows(partition)


class _StreamReader(DataSourceStreamReader):
    """Pages in order of offset; a page waits for those before it."""

    def __init__(self, pages: _Pages):
        self.pages = pages

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        there = {offset for _, offset, _ in self.pages.found()}
        n = 0
        while n * self.pages.limit in there:
            n += 1
        return {"page": n}

    def partitions(self, start: dict, end: dict) -> list[PageRange]:
        limit = self.pages.limit
        return self.pages.ranges([p for p in self.pages.found() if start["page"] * limit <= p[1] < end["page"] * limit])

    def read(self, partition: PageRange) -> Iterator[tuple]:
        return self.pages.rows(partition)


class LandedPages(DataSource):
    """Options: kind (a key of KINDS), limit (items of a page), pages_per_task. A schema with fewer columns reads fewer.

    Items of saved tracks whose track has no id are passed over; items of playlists keep their place without one. A missing
    page is an error for a batch, and what a stream waits for. Paths are those that pyarrow opens: shared folders and the
    stores that it knows.
    """

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return KINDS[self.options.get("kind", "saved_tracks")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(_Pages(dict(self.options), schema))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        if self.options.get("kind") == "playlist_items":
            raise ValueError("items of many playlists have no single order; read them as a batch")
        return _StreamReader(_Pages(dict(self.options), schema))
