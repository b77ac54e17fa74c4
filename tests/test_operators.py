"""Operators on small seeds: quirks, ties and edge cases that the tables at large don't show."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from crateflow.functions import numeric, status, text
from crateflow.operators import aggregate, duplicates, jobs, rules, search, snapshots, upserts
from crateflow.plans import catalogue
from crateflow.sources import export, ingest

NOW = dt.datetime(2026, 1, 1, 12)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_text(spark):
    r = one(
        spark, a=text.normalize(F.lit("  Éàñ   Ö ")), b=text.normalize(F.lit(None).cast("string")), c=text.token_overlap(F.lit("The Cat (Live)"), F.lit("cat the dog")), d=text.title_penalty(F.lit("Song (LIVE) karaoke")),
        e=text.duration_score(F.lit(200.0), F.lit(205.0)), f=text.same_isrc(F.lit(" us1 "), F.lit("US1")), g=text.normalize_for_match(F.lit("A-b_c!")), h=text.label_of(F.lit("not_found"), {"x": "y"}), i=text.text_match(F.lit("abcd"), F.lit("bcde")),
    )
    assert (r.a, r.b, r.d, r.e, r.f, r.g, r.h) == ("ean o", "", 0.6, 0.85, True, "a b_c", "Not Found")
    assert abs(r.c - 2 / 3) < 1e-9 and r.i == 0.75


def test_studio_version_wins(spark):
    url = F.lit("u")
    studio, _ = text.preview_score(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(False), text.title_penalty(F.lit("Song")), url)
    live, sure = text.preview_score(F.lit(0.5), F.lit(1.0), F.lit(0.2), F.lit(False), text.title_penalty(F.lit("Song (Live)")), url)
    r = one(spark, a=studio, b=live, c=sure)
    assert r.a == 1.0 and abs(r.b - (0.225 + 0.35 + 0.04 - 0.25)) < 1e-9 and r.c == r.b


def test_numbers(spark):
    n = F.lit(None).cast("double")
    r = one(spark, a=numeric.clamp01(n), b=numeric.unit_from_regression(F.lit(1.02)), c=numeric.energy_proxy(n, n, n)[0], d=numeric.p95(F.array(*map(F.lit, range(1, 41)))), e=numeric.valid_field("key", F.lit(12)), f=numeric.or_default(F.lit(0.0), 0.5), g=numeric.min_max(F.lit(2.0), n, n))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == (None, 1.0, None, 38, None, 0.5, 1.0)


def test_states(spark):
    t, n = F.lit(True), F.lit(None)
    r = one(
        spark, a=status.availability(n.cast("boolean"), F.lit("restricted")), b=status.market_status(t, F.lit("x"), t), c=status.null_reason(t, t, F.lit(False), F.lit("episode"), F.lit("x")), d=status.local_analysis(F.lit("success"), n.cast("string")),
        e=status.json_number(F.lit("{bad"), "$.k"), f=status.audit_verdict(F.lit(False), F.lit(False), t, F.lit(0.5)),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ("restricted", "unavailable", "episode", "partial", None, "low_confidence_fuzzy")


def segment_rows(spark):
    rows = [(1, 1, 120.0, 0, 1, 0.9, -10.0), (1, 2, 122.0, 0, 1, 0.8, -8.0), (1, 3, 121.0, 2, 0, 0.2, -9.0), (2, 1, None, None, None, 0.0, None)]
    df = spark.createDataFrame(rows, "track_id int, segment_id int, bpm double, key int, mode int, key_confidence double, loudness double")
    return df.withColumns({"quality": F.lit(1.0), "match": F.lit(1.0), "centroid": F.lit(1.0), "duration_ms": F.lit(30001), "bpm_confidence": F.lit(None).cast("double")})


def test_segment_aggregates(spark):
    rows = {r.track_id: r for r in aggregate.low_level(segment_rows(spark)).collect()}
    assert rows[1].bpm == 121.0 and rows[1].loudness == -9.0 and rows[1].segments == 3 and rows[2].bpm is None
    votes = {r.track_id: (r.key, r.mode, round(r.key_confidence, 6)) for r in aggregate.key_votes(segment_rows(spark)).collect()}
    assert votes == {1: (0, 1, round(1.7 / 3, 6))}


def test_vectors_and_labels(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0]), (2, [])], "track_id int, v array<double>")
    assert {r.track_id: r.v for r in aggregate.vector_mean(v, "track_id", "v").collect()} == {1: [2.0, 2.0]}
    with pytest.raises(Exception, match="another dimension"):
        aggregate.fixed_vector_mean(v, "track_id", "v", 2).collect()
    labels = spark.createDataFrame([(1, "Techno", 0.9), (1, "Techno", 0.5), (1, "House", 0.1), (1, "House", 0.5), (1, "A", 0.3), (1, "B", 0.3)], "track_id int, label string, score double")
    assert [(r.label, round(r.score, 6)) for r in aggregate.top_labels(labels).orderBy("rank").collect()] == [("Techno", 0.7), ("A", 0.3), ("B", 0.3)]


def taken(chosen):
    return sorted(((r.track_id, r.score) for r in chosen.collect()), key=lambda r: (-r[1], r[0]))


def greedy(rows, per_artist, per_album, size):
    chosen, a_count, b_count = [], {}, {}
    for t, s, a, b in sorted(rows, key=lambda r: (-r[1], r[0])):
        if len(chosen) == size:
            break
        if a_count.get(a, 0) >= per_artist or b_count.get(b, 0) >= per_album:
            continue
        a_count[a], b_count[b] = a_count.get(a, 0) + 1, b_count.get(b, 0) + 1
        chosen.append((t, s))
    return chosen


def test_two_caps_equal_a_greedy_scan(spark):
    rnd = random.Random(5)
    rows = [(k, round(rnd.random(), 2), rnd.randint(0, 9), f"a{rnd.randint(0, 14)}") for k in range(300)]
    df = spark.createDataFrame(rows, "track_id long, score double, artist_id long, album_id string")
    for per_artist, per_album, size in ((2, 3, 40), (3, 1, 10), (5, 2, 500)):
        rule = rules.Rule(max_per_artist=per_artist, max_per_album=per_album, target_size=size)
        assert taken(rules.diversify(df, rule)) == greedy(rows, per_artist, per_album, size)


def test_two_caps_of_skewed_keys(spark):
    """One artist with a third of all rows, one album across artists, a chain in which each row waits for the one before."""
    rnd = random.Random(9)
    rows = [(k, round(rnd.random(), 3), 0 if k % 3 == 0 else rnd.randint(1, 40), "big" if k % 4 == 0 else f"a{rnd.randint(0, 60)}") for k in range(900)]
    chain = [(k, 1.0 - k / 100, k // 2, f"c{(k + 1) // 2}") for k in range(24)]
    for some, per_artist, per_album, size in ((rows, 1, 1, 50), (rows, 4, 2, 200), (chain, 1, 1, 30), (chain, 1, 1, 5)):
        df = spark.createDataFrame(some, "track_id long, score double, artist_id long, album_id string")
        rule = rules.Rule(max_per_artist=per_artist, max_per_album=per_album, target_size=size)
        assert taken(rules.diversify(df, rule)) == greedy(some, per_artist, per_album, size)
    assert rules.diversify(df.limit(0), rule).count() == 0


def test_null_artists_and_albums_have_no_cap(spark):
    rnd = random.Random(6)
    rows = [(k, round(rnd.random(), 2), rnd.choice([None, None, *range(6)]), rnd.choice([None, None, *"abcdefgh"])) for k in range(300)]
    df = spark.createDataFrame(rows, "track_id long, score double, artist_id long, album_id string")
    for per_artist, per_album, size in ((2, 3, 60), (3, 1, 30), (2, None, 100), (None, 2, 100)):
        alone = [(t, s, ("no artist", t) if a is None else a, ("no album", t) if b is None else b) for t, s, a, b in rows]
        rule = rules.Rule(max_per_artist=per_artist, max_per_album=per_album, target_size=size)
        assert taken(rules.diversify(df, rule)) == greedy(alone, per_artist or 999, per_album or 999, size)
    alone = [(t, s, ("no artist", t) if a is None else a, t) for t, s, a, _ in rows]
    got = [(r.track_id, r.score) for r in rules.one_cap(df, "artist_id", 2, 100).collect()]
    assert got == greedy(alone, 2, 999, 100)


def test_end_to_end_playlist(spark):
    dir_ = "/root/testdata/sf0.001"
    lib = catalogue.Library(spark, dir_)
    view = catalogue.wide_view(lib)
    pool = {r.track_id for r in rules.candidates(catalogue.RULE, lib["liked"], lib["playlist_tracks"]).collect()}
    best, rows = {}, []
    for r in view.withColumn("why", rules.reasons(catalogue.RULE)).withColumn("score", rules.score(catalogue.RULE)).collect():
        if r.track_id in pool:
            key = r.isrc or f"#{r.track_id}"
            if key not in best or r.track_id < best[key].track_id:
                best[key] = r
    rows = [(r.track_id, r.score, r.artist_id, r.album_id) for r in best.values() if not r.why and r.score is not None]
    want = greedy(rows, 2, 3, 40)
    got = [(r.track_id, round(r.score, 6)) for r in catalogue.QUERIES["playlist_end_to_end"](spark, dir_).orderBy("position").collect()]
    assert got == [(t, round(s, 6)) for t, s in want] and got


def test_rules():
    assert rules.problems(rules.Rule(), []) == ["NO_SOURCE_SELECTED", "NO_SCORING_COMPONENTS"]
    bad = rules.parse({"liked": True, "filters": [{"feature": "zzz", "low": 2, "high": 1}], "weights": {"bpm": 1}, "target_size": 501})
    assert rules.problems(bad, ["bpm"]) == ["UNKNOWN_FILTER:zzz", "INVALID_RANGE:zzz", "TARGET_SIZE_INVALID"]
    rows = [(1, 0.9, 7), (2, 0.8, 7), (3, 0.7, 8)]
    assert [r[0] for r in rules.spread(rows)] == [1, 3, 2]
    assert rules.ordered([(1, 0.5), (2, 0.9)], "recently_added_desc") == [(2, 0.9), (1, 0.5)]
    assert rules.ordered([(k, 0.0) for k in range(9)], "random_seeded", 0) == rules.ordered([(k, 0.0) for k in range(9)], "random_seeded", 42)
    assert rules.ordered([(1, 0.5), (2, 0.9), (3, 0.1), (4, 0.5)], "artist_grouped", artists={1: "b", 2: "b", 4: "a", 3: None}) == [(3, 0.1), (4, 0.5), (2, 0.9), (1, 0.5)]


def test_search_checks():
    with pytest.raises(ValueError):
        search.SearchSpec(sort="nope").checked()
    assert search.SearchSpec(page_size=999).checked().page_size == 200 and search.page_count(101, 50) == 3 and search.page_count(0, 50) == 0


def test_duplicates_keep_the_smallest(spark):
    df = spark.createDataFrame([(1, "A", 180000), (2, "B", 1), (3, "A", 240000), (4, None, 1), (5, "", 1)], "track_id long, isrc string, duration_ms long")
    assert sorted(r.track_id for r in duplicates.first_per_isrc(df).collect()) == [1, 2, 4, 5]
    groups = duplicates.isrc_groups(df).collect()
    assert [(g.group_key, g.track_ids) for g in groups] == [("A", [1, 3])]


def test_snapshots(spark):
    likes = lambda *x: spark.createDataFrame([(i,) for i in x], "track_id long")
    items = lambda *x: spark.createDataFrame(list(x), "playlist_id long, position int, track_id long")
    tracks = spark.createDataFrame([(1, True, None), (2, True, None), (3, False, None), (4, True, 9)], "track_id long, is_playable boolean, linked_from long")
    got = snapshots.classify(likes(1), likes(2), items((1, 0, None)), items((1, 0, None), (1, 1, 3), (1, 2, 4)), likes(), tracks)
    assert {(r.track_id, r.position, r.status) for r in got.collect()} == {(1, None, "removed_from_liked"), (2, None, "missing_from_current_import"), (None, 0, "null_playlist_track"), (3, 1, "unavailable"), (4, 2, "possibly_relinked")}
    assert {r.status: r.n for r in snapshots.status_counts(got).collect()}["missing_from_current_import"] == 1


def items_frame(spark, rows):
    return spark.createDataFrame(rows, "item_id long, job_id long, stage string, status string, priority int, created_at timestamp_ntz, locked_by string, locked_at timestamp_ntz, next_retry_at timestamp_ntz, attempt_count int, max_attempts int, error_code string")


def test_queue(spark):
    old, new = NOW - dt.timedelta(seconds=700), NOW - dt.timedelta(seconds=100)
    rows = [(1, 1, "download", "pending", 1, old, None, None, None, 0, 3, None), (2, 1, "download", "pending", 5, new, None, None, None, 0, 3, None), (3, 1, "download", "running", 9, old, "w", old, None, 0, 3, None), (4, 1, "tensorflow", "running", 9, old, "w", old, None, 2, 3, None)]
    now = F.lit(NOW).cast("timestamp_ntz")
    items = items_frame(spark, rows)
    assert [r.item_id for r in jobs.queue_head(items, now, 2).collect()] == [2, 1]
    taken = {r.item_id: (r.status, r.locked_by) for r in jobs.reserve(items, now, "me", 1).collect()}
    assert taken[2] == ("running", "me") and taken[1] == ("pending", None)
    freed = {r.item_id: r.status for r in jobs.release_stale(items, now).collect()}
    assert freed == {1: "pending", 2: "pending", 3: "pending", 4: "running"}
    failures = spark.createDataFrame([(3, "x", True, 0), (4, "y", True, 60)], "item_id long, error string, retryable boolean, delay_s int")
    after = {r.item_id: (r.status, r.attempt_count) for r in jobs.fail(items, failures, now).collect()}
    assert after == {1: ("pending", 0), 2: ("pending", 0), 3: ("pending", 1), 4: ("failed", 3)}
    assert {r.status for r in jobs.cancel(items, F.lit(1)).collect()} == {"cancelled", "running"}


def test_dependencies(spark):
    items = spark.createDataFrame([(1, "download", "success"), (2, "download", "failed"), (3, "lowlevel", "failed"), (10, "x", "blocked"), (11, "x", "blocked"), (12, "x", "blocked"), (13, "x", "blocked")], "item_id long, stage string, status string")
    edges = spark.createDataFrame([(10, 1), (10, 3), (11, 2), (12, 99)], "item_id long, needs_id long")
    assert sorted(r.item_id for r in jobs.unblocked(items, edges).collect()) == [10, 13]


def test_plan(spark):
    rows = jobs.plan(spark.createDataFrame([(1, 5)], "job_id long, track_id long")).collect()
    assert len(rows) == 11 and sum(r.status == "pending" for r in rows) == 3


def test_upserts(spark):
    target = spark.createDataFrame([(1, None, "a"), (2, "k", "b")], "id long, part string, v string")
    changes = spark.createDataFrame([(1, None, "A"), (3, "k", "c")], "id long, part string, v string")
    assert sorted((r.id, r.v) for r in upserts.upsert(target, changes, ["id", "part"]).collect()) == [(1, "A"), (2, "b"), (3, "c")]
    rows = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "id long, ordinal int, v string")
    assert [r.v for r in upserts.last_per_key(rows, ["id"]).collect()] == ["y"]
    counts = upserts.refresh_counts(target, changes, "id").first()
    assert (counts.imported, counts.updated) == (1, 1)


def test_ingest(spark, tmp_path):
    page = """{"items": [{"added_at": "2026-01-02T03:04:05Z", "track": {"id": "t1", "name": "Sóng", "duration_ms": 1000, "album": {"id": "a1", "name": "Al", "images": [{"width": 640, "url": "big"}, {"width": 300, "url": "mid"}, {"width": 64, "url": "small"}]},
      "artists": [{"id": null, "name": "local"}, {"id": "x", "name": "X"}], "external_ids": {"isrc": "I"}}}, {"added_at": null, "track": null}]}"""
    (tmp_path / "p.json").write_text(page.replace("\n", " ") + "\n{broken\n")
    saved = ingest.saved_tracks(ingest.read_pages(spark, str(tmp_path / "p.json")))
    row = saved.first()
    assert saved.count() == 1 and row.added_at == dt.datetime(2026, 1, 2, 3, 4, 5)
    tables = ingest.normalised(saved.withColumn("ordinal", F.lit(0)))
    assert tables["track_artists"].first().asDict() == {"track_id": "t1", "artist_id": "x", "position": 0}
    assert tables["tracks"].first().normalized_title == "song" and tables["albums"].first().cover == "small"


def test_analysis_documents(spark):
    good = '{"metadata": {"audio_properties": {"length": 30.0}}, "tonal": {"key_key": "C#", "key_scale": "major", "key_strength": 0.7}, "rhythm": {"bpm": 120.5}, "lowlevel": {"loudness": 0, "spectral_centroid": {"mean": 2200}, "mfcc": {"mean": [1, 2, 3]}}}'
    rows = ingest.analysis_documents(spark.createDataFrame([(1, good), (2, "{bad")], "id int, value string")).orderBy("id").collect()
    assert (rows[0].bpm, rows[0].bpm_confidence, rows[0].key, rows[0].mode, rows[0].loudness, rows[0].centroid, rows[0].mfcc) == (120.5, 0.85, 1, 1, None, 2200.0, [1.0, 2.0, 3.0])
    assert rows[1].bpm is None and rows[1].bpm_confidence is None


def test_segment_plan(spark):
    df = spark.createDataFrame([(1, 200.0), (2, 40.0), (3, 20.0)], "track_id long, duration_s double")
    got = {(r.track_id, r.segment): (r.start_s, r.length_s) for r in ingest.plan_segments(df).collect()}
    assert got[(1, "A")] == (20.0, 15.0) and got[(1, "C")] == (140.0, 15.0) and got[(2, "B")] == (18.0, 15.0) and got[(3, "A")] == (2.5, 15.0) and len(got) == 7


def test_exports(spark, tmp_path):
    tracks = spark.createDataFrame([(1, "A", None)], "track_id long, name string, isrc string")
    liked = spark.createDataFrame([(1, NOW)], "track_id long, added_at timestamp")
    rows = export.liked_rows(tracks, liked)
    assert rows.first().isrc == "" and rows.first().added_at == "2026-01-01T12:00:00"
    export.write_csv(rows, str(tmp_path / "out"), one_file=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 1
    items = spark.createDataFrame([(1, 1, None), (1, 0, 1)], "playlist_id long, position int, track_id long")
    nested = export.playlists_nested(export.playlist_rows(spark.createDataFrame([(1, "P")], "playlist_id long, name string"), items, tracks)).first()
    assert [i.name for i in nested["items"]] == ["A", ""]


def test_plans_by_availability(spark):
    df = spark.createDataFrame([(1, 200.0, True, True), (2, 200.0, False, True), (3, 10.0, True, False), (4, 9.0, False, False)], "track_id long, duration_s double, has_preview boolean, has_search boolean")
    fast = {r.track_id: (r.decision, r.start_s, r.length_s) for r in ingest.plan_by_availability(df).collect()}
    assert fast == {1: ("preview_only", 0.0, 30.0), 2: ("one_segment", 92.5, 15.0), 3: ("preview_only", 0.0, 30.0), 4: ("unavailable", None, None)}
    precise = sorted((r.track_id, r.segment or "", r.start_s) for r in ingest.plan_by_availability(df, precise=True).collect())
    assert precise == [(1, "1/3", 59.167), (1, "2/3", 125.833), (1, "preview", 0.0), (2, "1/2", 92.5), (2, "1/4", 42.5), (2, "3/4", 142.5), (3, "preview", 0.0), (4, "", None)]


def test_caps_tell_why(spark):
    rnd = random.Random(8)
    rows = [(k, round(rnd.random(), 2), rnd.choice([None, *range(5)]), rnd.choice([None, *"abcd"])) for k in range(120)]
    df = spark.createDataFrame(rows, "track_id long, score double, artist_id long, album_id string")
    for per_artist, per_album, size in ((2, 3, 12), (0, 2, 500), (None, 1, 500), (1, None, 5)):
        rule = rules.Rule(max_per_artist=per_artist, max_per_album=per_album, target_size=size)
        chosen, why, artists, albums = [], {}, {}, {}
        for t, s, a, b in sorted(rows, key=lambda r: (-r[1], r[0])):
            if len(chosen) == size:
                break
            if per_artist is not None and a is not None and artists.get(a, 0) >= per_artist:
                why[t] = "MAX_TRACKS_PER_ARTIST"
            elif per_album is not None and b is not None and albums.get(b, 0) >= per_album:
                why[t] = "MAX_TRACKS_PER_ALBUM"
            else:
                artists[a], albums[b] = artists.get(a, 0) + 1, albums.get(b, 0) + 1
                chosen.append((t, s))
        found = rules.diversify(df, rule)
        assert taken(found) == chosen
        assert {r.track_id: r.reason for r in rules.capped(df, rule, found).collect()} == why


def test_rule_codes_and_notices(spark):
    rule = rules.parse({"liked": True, "weights": {"zzz": 1, "freshness_score": 1}, "ordering": "cluster_walk", "sync_mode": "other", "exclude_tags": ["x"], "seed_tracks": [1], "clusters": ["c"], "vocal_balance": True})
    assert rules.problems(rule, ["bpm"]) == ["UNKNOWN_FILTER:zzz", "ORDERING_MODE_NOT_AVAILABLE_YET", "UNKNOWN_SYNC_MODE"]
    assert rules.notices(rule, ["zzz"]) == ["CLUSTER_SOURCE_NOT_AVAILABLE_YET", "SEED_TRACKS_NOT_AVAILABLE_IN_PHASE_5", "FEATURE_NOT_AVAILABLE_YET:zzz", "FEATURE_NOT_AVAILABLE_YET:vocal_balance"]
    df = spark.createDataFrame([(1, "available", "restricted"), (2, None, "available")], "track_id long, availability string, market_status string")
    got = df.select("track_id", rules.reasons(rules.Rule(availability=["available"], market=["available"])).alias("r")).orderBy("track_id").collect()
    assert [r.r for r in got] == [["MARKET_UNAVAILABLE"], ["TRACK_UNAVAILABLE"]]
    assert [r[0] for r in rules.spread([(1, 0.9, None), (2, 0.8, None), (3, 0.7, 5)])] == [1, 2, 3]


def test_one_normalisation_for_term_and_column(spark):
    words = ["Việt Nam", "ﬁre", "ＡＢＣ", "Ünï", "plain", "Ａ́b", ""]
    got = [r.n for r in spark.createDataFrame([(w,) for w in words], "w string").select(text.normalize(F.col("w")).alias("n")).collect()]
    assert got == [" ".join(text.plain(w).split()) for w in words] and got[:3] == ["viet nam", "fire", "abc"]
