import datetime as dt

from pyspark.sql import functions as F

from crateflow.operators import matching, work

NOW = dt.datetime(2026, 1, 1)


def test_best_candidate(spark):
    rows = [(1, "Song", "Ann", 200.0, "I1", 0, "Song (Live)", "Ann", 300.0, None, "a"), (1, "Song", "Ann", 200.0, "I1", 1, "Song", "Ann", 201.0, None, "b"), (2, "Song", "Ann", 200.0, "I2", 0, "Other", "Bob", 90.0, "i2 ", ""), (3, "X", "Y", 1.0, None, 0, "Q", "R", 9.0, None, "u")]
    df = spark.createDataFrame(rows, "track_id long, title string, artist string, duration_s double, isrc string, ordinal int, c_title string, c_artist string, c_duration_s double, c_isrc string, url string")
    got = {r.track_id: (r.url, r.status) for r in matching.best(matching.scored(df)).collect()}
    assert got == {1: ("b", "available"), 2: ("", "not_found"), 3: ("u", "not_found")}


def test_ranking(spark):
    df = spark.createDataFrame([(1, 0, "u", 0.4), (1, 1, "v", 0.9), (1, 2, "u", 0.8), (2, 0, "w", 0.1)], "track_id long, ordinal int, url string, confidence double")
    assert sorted((r.track_id, r.rank, r.url, r.is_selected) for r in matching.ranked(df).collect()) == [(1, 0, "v", True), (1, 1, "u", False), (2, 0, "w", False)]


def test_rekeying_and_batches(spark):
    answers = spark.createDataFrame([(0, "a", None, None, "p0"), (1, "a", None, None, "p1"), (2, None, "i", None, "p2"), (3, None, None, "https://host/track/zz", "p3")], "ordinal int, id string, isrc string, href string, payload string")
    asked = spark.createDataFrame([("a",), ("i",), ("zz",), ("none",)], "request_id string")
    assert {r.request_id: r.payload for r in matching.rekeyed(asked, answers).collect()} == {"a": "p1", "i": "p2", "zz": "p3"}
    batches = [r.request_ids for r in matching.request_batches(spark.range(100).select(F.col("id").alias("request_id"))).collect()]
    assert sorted(x for b in batches for x in b) == list(range(100)) and max(map(len, batches)) <= 40


def test_selection(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "track_id long")
    assert [r.track_id for r in work.select_missing(ids(3, 1, 2, 2), ids(2), 1).collect()] == [1]
    done = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "track_id long, stage string")
    assert sorted(r.track_id for r in work.incomplete(ids(1, 2, 3), done, ["a", "b"]).collect()) == [2, 3]
    tracks = spark.createDataFrame([(1, "A"), (2, "B")], "track_id long, name string")
    assert {r.track_id: r.warning for r in work.affected(ids(1, 2, 9), tracks, ids(1), "like").collect()} == {1: "ALREADY_LIKED", 2: None, 9: "NOT_FOUND"}
    assert not work.too_many(tracks)


def test_latest(spark):
    previews = spark.createDataFrame([(1, 1, None), (1, 2, 0.5), (1, 3, 0.5)], "track_id long, preview_id long, confidence double")
    assert [r.preview_id for r in work.best_preview(previews).collect()] == [2]
    rows = spark.createDataFrame([(1, 1, "failed", NOW), (1, 2, "success", NOW), (2, 3, "failed", NOW)], "track_id long, download_id long, status string, created_at timestamp")
    assert sorted(r.download_id for r in work.best_download(rows, ["failed", "success"]).collect()) == [2, 3]


def test_files_and_profiles(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(b"1234")
    (tmp_path / "b.wav").write_bytes(b"1")
    known = spark.createDataFrame([(f"file:{tmp_path}/a.wav",)], "path string")
    assert [r.length for r in work.orphan_files(spark, str(tmp_path), known).collect()] == [1]
    edges = spark.createDataFrame([("full", "base"), ("base", "core"), ("core", "full"), ("other", "x")], "name string, needs string")
    assert sorted(r.name for r in work.profile_closure(edges, "full").collect()) == ["base", "core", "full"]
    segments = spark.createDataFrame([(1, "p", None, NOW, 5), (2, "p", None, NOW, 5), (3, "q", None, NOW, 7), (4, None, None, NOW, 1)], "segment_id long, path string, deleted_at timestamp, created_at timestamp, bytes long")
    row = work.cleanup_totals(segments, spark.createDataFrame([(3,)], "segment_id long"), F.lit(NOW + dt.timedelta(days=1))).first()
    assert (row.files, row.segments, row.bytes) == (1, 2, 5)


def test_rows_and_durations(spark):
    a = spark.createDataFrame([(1, "f", 1.0)], "track_id long, feature string, value double")
    b = spark.createDataFrame([(1, "f", 2.0), (1, "g", 3.0)], "track_id long, feature string, value double")
    assert sorted((r.feature, r.value) for r in work.build_rows([a, b]).collect()) == [("f", 1.0), ("g", 3.0)]
    later = NOW + dt.timedelta(seconds=30)
    rows = spark.createDataFrame([("s", 1, "success", NOW, later), ("s", 2, "success", later, later), ("s", 3, "failed", NOW, later)], "stage string, track_id long, status string, started_at timestamp, finished_at timestamp")
    r = work.durations(rows).first()
    assert (r.n, r.mean_ms, r.tracks, r.per_minute) == (2, 15000.0, 2, 4.0)
    albums = spark.createDataFrame([(1, "x"), (2, None)], "album_id long, cover string")
    new, counts = work.backfilled(albums, spark.createDataFrame([(1, "x"), (2, "y")], "album_id long, cover string"))
    assert {r.album_id: r.cover for r in new.collect()} == {1: "x", 2: "y"} and counts.first().updated == 1
