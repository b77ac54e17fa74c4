import json

import pytest

from crateflow.sources import export
from crateflow.sources.paged import LandedPages
from crateflow.streaming import runs

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def land(folder, offset, items, total, playlist=None):
    where = folder / (f"playlist={playlist}" if playlist else ".") / f"offset={offset}"
    where.mkdir(parents=True)
    (where / "part-0.txt").write_text(json.dumps({"items": items, "offset": offset, "limit": 3, "total": total}) + "\n")


def tracks(*numbers):
    return [{"added_at": f"2026-01-0{n % 9 + 1}T00:00:00Z", "track": {"id": f"t{n}", "duration_ms": n, "artists": [{"id": "a"}, {"name": "x"}], "album": {"id": f"b{n}"}} if n else None} for n in numbers]


def test_batch_and_stream_give_the_same(spark, tmp_path):
    """Pages in several tasks, an item without a track, fewer columns, pages that come later."""
    spark.dataSource.register(LandedPages)
    land(tmp_path / "in", 0, tracks(1, 0, 3), 8)
    land(tmp_path / "in", 3, tracks(4, 5, 6), 8)
    schema = "track_id string, place long, artist_ids array<string>"
    stream = spark.readStream.format("landed_pages").option("limit", 3).schema(schema).load(str(tmp_path / "in"))
    first, _ = runs.run_through(stream, str(tmp_path / "out"))
    assert sorted(r.place for r in first.collect()) == [0, 2, 3, 4, 5]
    land(tmp_path / "in", 6, tracks(7, 8), 8)
    got, _ = runs.run_through(stream, str(tmp_path / "out"))
    read = spark.read.format("landed_pages").option("limit", 3).option("pages_per_task", 1).schema(schema).load(str(tmp_path / "in"))
    rows = sorted(map(tuple, read.collect()))
    assert rows == sorted(map(tuple, got.collect())) and [r[:2] for r in rows] == [("t1", 0), ("t3", 2), ("t4", 3), ("t5", 4), ("t6", 5), ("t7", 6), ("t8", 7)] and rows[0][2] == ["a"]
    assert read.rdd.getNumPartitions() == 3


def test_missing_pages(spark, tmp_path):
    """One in the middle or at the end is an error; a stream waits for it."""
    spark.dataSource.register(LandedPages)
    land(tmp_path / "in", 0, tracks(1, 2, 3), 9)
    land(tmp_path / "in", 6, tracks(7, 8, 9), 9)
    read = lambda: spark.read.format("landed_pages").option("limit", 3).load(str(tmp_path / "in")).count()
    with pytest.raises(Exception, match="page 3 of saved_tracks is missing"):
        read()
    stream = spark.readStream.format("landed_pages").option("limit", 3).load(str(tmp_path / "in"))
    assert runs.run_through(stream, str(tmp_path / "out"))[0].count() == 3
    land(tmp_path / "in", 3, tracks(4, 5, 6), 9)
    assert read() == 9 and runs.run_through(stream, str(tmp_path / "out"))[0].count() == 9
    land(tmp_path / "short", 0, tracks(1, 2, 3), 7)
    with pytest.raises(Exception, match="end at 3 of 7"):
        spark.read.format("landed_pages").option("limit", 3).load(str(tmp_path / "short")).count()


def test_playlists_and_their_items(spark, tmp_path):
    spark.dataSource.register(LandedPages)
    land(tmp_path / "lists", 0, [{"id": "p1", "name": "P", "tracks": {"total": 4}, "owner": {"id": "me"}}, {"id": None}], 2)
    lists = spark.read.format("landed_pages").options(kind="playlists", limit="3").load(str(tmp_path / "lists"))
    assert [(r.playlist_id, r.tracks_total, r.owner_id) for r in lists.orderBy("place").collect()] == [("p1", 4, "me"), (None, None, None)]
    land(tmp_path / "items", 0, [*tracks(1, 0), {"is_local": True, "track": {"type": "episode"}}], 4, "p1")
    land(tmp_path / "items", 3, tracks(4), 4, "p1")
    land(tmp_path / "items", 0, tracks(9), 1, "p2")
    items = spark.read.format("landed_pages").options(kind="playlist_items", limit="3").load(str(tmp_path / "items"))
    got = [(r.playlist_id, r.place, r.track_id, r.is_local, r.item_kind) for r in items.orderBy("playlist_id", "place").collect()]
    assert got == [("p1", 0, "t1", False, None), ("p1", 1, None, False, None), ("p1", 2, None, True, "episode"), ("p1", 3, "t4", False, None), ("p2", 0, "t9", False, None)]
    none = spark.read.format("landed_pages").load(str(tmp_path / "nothing"))
    assert none.count() == 0


def test_copy_between_databases_by_several_connections(spark, tmp_path):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    here, there = (f"jdbc:derby:{tmp_path}/{n};create=true" for n in ("a", "b"))
    rows = spark.range(1000).selectExpr("if(id = 77, null, id * 3) as id", "concat('v', id) as v").coalesce(1)
    rows.write.format("jdbc").options(url=here, dbtable="songs", driver=DRIVER).save()
    read = export.read_table(spark, here, "songs", "id", 4, driver=DRIVER)
    sizes = read.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert len(sizes) == 4 and sum(sizes) == 1000 and max(sizes) < 300
    assert export.copy_table(spark, here, there, "songs", key="id", partitions=3, driver=DRIVER) == (1000, 1000)
    assert export.copy_table(spark, here, there, "songs", key="id", partitions=3, where='"id" >= 1500', driver=DRIVER) == (500, 500)
    back = export.read_table(spark, there, "songs", "id", 2, driver=DRIVER)
    assert sorted(r.id for r in back.collect()) == [k * 3 for k in range(500, 1000)]
    assert export.read_table(spark, here, "songs", "id", 4, '"id" < 0', driver=DRIVER).count() == 0
    assert export.connection("jdbc:sqlite:x")["sessionInitStatement"].startswith("PRAGMA") and "sessionInitStatement" not in export.connection("jdbc:derby:x")
