"""Queries for states of items, merges into tables, landed documents and small lists. Each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from crateflow.functions import status
from crateflow.operators import jobs, lists, matching, rules, search, snapshots, upserts, work
from crateflow.plans.catalogue import ORACLES, RULE, playlist_snapshots, query, r6, wide_view
from crateflow.sources import export, ingest
from crateflow.sources.paged import LandedPages
from crateflow.sources.tables import fresh_path


def _now() -> Column:
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


@query("""select item_id, r.segment_id, case when r.segment_id is not null and status = 'blocked' then 'pending' else status end as status from (select *, item_id % 3 as place from items)
    left join (select job_id, track_id, item_id % 3 as place, max(item_id) as segment_id from items where stage = 'download' and status = 'success' group by all) r using (job_id, track_id, place)""", "items")
def bound_slots(lib):
    items = lib["items"].withColumn("segment_index", F.col("item_id") % 3)
    ready = items.where("stage = 'download' and status = 'success'").groupBy("job_id", "track_id", "segment_index").agg(F.max("item_id").alias("segment_id"))
    return lists.bound_slots(items.withColumn("segment_id", F.lit(None).cast("long")), ready).select("item_id", "segment_id", "status")


@query("""select item_id, case when n <= 500 then 'running' else status end as status, case when n <= 500 then 'w1' end as locked_by from items
    left join (select item_id, row_number() over (order by priority desc, created_at, item_id) as n from items where status = 'pending') using (item_id)""", "items")
def reserved_items(lib):
    items = lib["items"].withColumn("locked_at", F.lit(None).cast("timestamp_ntz"))
    return jobs.reserve(items, _now(), "w1", 500).select("item_id", "status", "locked_by")


@query("""select item_id, a + hit::int as attempt_count, case when not hit then status when item_id % 2 = 0 and a + 1 < 3 then case when item_id % 3 > 0 then 'rate_limited' else 'pending' end else 'failed' end as status,
    case when hit and item_id % 2 = 0 and a + 1 < 3 and item_id % 3 > 0 then 30 * (item_id % 3) end as waits
    from (select *, (item_id % 4)::int as a, stage = 'download' and status = 'pending' as hit from items)""", "items")
def failures_applied(lib):
    n = F.col("item_id")
    items = lib["items"].withColumns({"attempt_count": (n % 4).cast("int"), "max_attempts": F.lit(3), "error_code": F.lit(None).cast("string")})
    failures = items.where("stage = 'download' and status = 'pending'").select("item_id", F.lit("timeout").alias("error"), (n % 2 == 0).alias("retryable"), (n % 3 * 30).cast("int").alias("delay_s"))
    return jobs.fail(items, failures, _now()).select("item_id", "attempt_count", "status", F.timestamp_diff("SECOND", _now(), F.col("next_retry_at")).alias("waits"))


@query("select job_id, job_type from (select job_id, job_type, bool_or(status = 'pending') as q, bool_or(status = 'blocked') as r from items group by all) where job_type = (select min(job_type) from items) and (q or r)", "items")
def running_jobs(lib):
    items = lib["items"]
    per = items.groupBy("job_id", "job_type").agg(F.bool_or(F.col("status") == "pending").alias("q"), F.bool_or(F.col("status") == "blocked").alias("r"))
    state = F.when(F.col("q"), "queued").when(F.col("r"), "running").otherwise("succeeded")
    return lists.running_jobs(per.select("job_id", "job_type", state.alias("status")), items.agg(F.min("job_type")).scalar()).select("job_id", "job_type")


@query("""select job_id as worker_id, max(created_at) as last_seen_at from items group by job_id having max(created_at) >= (select max(created_at) from items) - interval 1 day""", "items")
def recent_workers(lib):
    items = lib["items"]
    beats = jobs.heartbeats(items.select(F.col("job_id").alias("worker_id"), F.col("created_at").alias("last_seen_at")))
    since = items.agg(F.max("created_at")).scalar() - F.expr("interval 1 day")
    return lists.seen_since(beats, since)


@query("select case status when 'queued' then 'pending' when 'succeeded' then 'success' else status end as label, count(*) as n from (select case status when 'pending' then 'queued' when 'success' then 'succeeded' else status end as status from items) group by all", "items")
def job_labels(lib):
    raw = F.when(F.col("status") == "pending", "queued").when(F.col("status") == "success", "succeeded").otherwise(F.col("status"))
    return lib["items"].select(status.job_label(raw).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("""select track_id, case when l = 'failed' then 'failed' when l in ('success', 'partial') and a in ('success', 'partial') then 'success' when l in ('success', 'partial') or a in ('success', 'partial') then 'partial' else 'missing' end as analysis
    from (select track_id, max(status) filter (source = 'api') as l, max(status) filter (source = 'local') as a from features group by track_id)""", "features")
def local_analysis(lib):
    of = lambda s: F.max(F.when(F.col("source") == s, F.col("status")))
    rows = lib["features"].groupBy("track_id").agg(of("api").alias("low"), of("local").alias("advanced"))
    return rows.select("track_id", status.local_analysis(F.col("low"), F.col("advanced")).alias("analysis"))


@query("""select track_id as segment_id, strftime(case when track_id % 4 = 0 then date '2020-01-01' when track_id % 3 = 0 then date '2024-02-01' end, '%Y-%m-%d') as deleted_on, case when track_id % 3 <> 0 then 'f' || track_id end as path from tracks""", "tracks")
def deleted_segments(lib):
    n = F.col("track_id")
    rows = lib["tracks"].select(n.alias("segment_id"), F.when(n % 4 == 0, F.lit("2020-01-01").cast("timestamp_ntz")).alias("deleted_at"), F.concat(F.lit("f"), n).alias("path"))
    gone = upserts.soft_delete(rows, rows.where("segment_id % 3 = 0"), _now())
    return gone.select("segment_id", F.date_format("deleted_at", "yyyy-MM-dd").alias("deleted_on"), "path")


@query("select count(*) filter (not known) as imported, count(*) filter (known) as updated from (select playlist_id, playlist_id in (select playlist_id from playlist_tracks where is_current) as known from playlists)", "playlists", "playlist_tracks")
def playlist_refresh_counts(lib):
    return upserts.refresh_counts(lib["playlist_tracks"].where("is_current").select("playlist_id"), lib["playlists"], "playlist_id")


@query("""select a.album_id, coalesce(d.cover, case when length(a.album_id) % 2 = 0 then 'old' end) as cover from albums a
    left join (select album_id, 'c' || max(track_id) as cover from tracks where track_id % 3 > 0 group by album_id) d using (album_id)""", "albums", "tracks")
def album_covers(lib):
    albums = lib["albums"].select("album_id", F.when(F.length("album_id") % 2 == 0, "old").alias("cover"))
    derived = lib["tracks"].where("track_id % 3 > 0").groupBy("album_id").agg(F.concat(F.lit("c"), F.max("track_id")).alias("cover"))
    return work.backfilled(albums, derived)[0].select("album_id", "cover")


@query("""select track_id, case when a between 64 and 300 and b between 64 and 300 then case when a <= b then 'a' else 'b' end when a between 64 and 300 then 'a' when b between 64 and 300 then 'b'
    when a > 0 and b > 0 then case when a <= b then 'a' else 'b' end when a > 0 then 'a' when b > 0 then 'b' else 'a' end as cover from (select track_id, track_id % 400 as a, track_id * 7 % 400 as b from tracks)""", "tracks")
def cover_choice(lib):
    n = F.col("track_id")
    image = lambda width, url: F.struct(width.cast("long").alias("width"), F.lit(url).alias("url"))
    return lib["tracks"].select("track_id", status.cover_image(F.array(image(n % 400, "a"), image(n * 7 % 400, "b"))).alias("cover"))


@query("with recursive edges as (select n_nationkey as name, (n_nationkey * 7 + n_regionkey) % 25 as needs from nation union all select n_nationkey, n_regionkey from nation where n_nationkey % 5 = 0), found as (select 3::bigint as name union select needs::bigint from edges join found using (name)) select name::varchar as name from found")
def profile_closure(lib):
    key, region = F.col("n_nationkey"), F.col("n_regionkey")
    nation = lib.raw("nation")
    edges = nation.select(key.alias("name"), ((key * 7 + region) % 25).alias("needs")).unionByName(nation.where(key % 5 == 0).select(key.alias("name"), region.alias("needs")))
    return work.profile_closure(edges.select(F.col("name").cast("string"), F.col("needs").cast("string")), "3")


@query("select 't' || track_id as track_id, strftime(added_at, '%Y-%m-%d') as added_on, track_id as duration_ms from liked where track_id % 5 > 0", "liked")
def landed_saved_tracks(lib):
    """Pages of a hundred or so items as JSON; items whose track is null are passed over."""
    n = F.col("track_id")
    track = F.when(n % 5 > 0, F.struct(F.concat(F.lit("t"), n).alias("id"), n.alias("duration_ms")))
    item = F.struct(F.date_format("added_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("added_at"), track.alias("track"))
    pages = lib["liked"].groupBy((F.xxhash64("track_id") % 64).alias("page")).agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("page_json"))
    saved = ingest.saved_tracks(pages.select(F.from_json("page_json", ingest.SAVED_PAGE).alias("p")).select("p.*"))
    return saved.select("track.id", F.date_format("added_at", "yyyy-MM-dd").alias("added_on"), "track.duration_ms").withColumnRenamed("id", "track_id")


@query("select 't' || track_id as track_id, 'a' || artist_id as artist_id, (row_number() over (partition by track_id order by artist_id) - 1)::int as position from track_artists where not (track_id % 3 = 0 and artist_id % 2 = 0)", "track_artists")
def normalised_artists(lib):
    """An artist without an id has no position; of two documents of a track the later one counts."""
    credit = F.struct("artist_id", F.when(~((F.col("track_id") % 3 == 0) & (F.col("artist_id") % 2 == 0)), F.concat(F.lit("a"), "artist_id")).alias("id"))
    credited = lib["track_artists"].groupBy("track_id").agg(F.array_sort(F.collect_list(credit)).alias("c"))
    named = credited.select(F.struct(F.concat(F.lit("t"), "track_id").alias("id"), F.transform("c", lambda a: F.struct(a["id"].alias("id"), F.lit("n").alias("name"))).alias("artists")).alias("d"))
    track = named.select(F.from_json(F.to_json("d"), ingest.TRACK).alias("track"), F.lit(2).alias("ordinal"))
    older = track.where("cast(substring(track.id, 2) as long) % 2 = 0").select(F.col("track").withField("artists", F.array_repeat(F.struct(F.lit("x").alias("id"), F.lit("n").alias("name")), 1)).alias("track"), F.lit(1).alias("ordinal"))
    return ingest.normalised(track.unionByName(older))["track_artists"]


@query("""select track_id, 1 as phase, 'Tempo' as label, 'bpm' as feature, bpm as value, status from features where source = 'api' and is_active
    union all select track_id, 2, 'Energy', 'energy', energy, status from features where source = 'api' and is_active""", "features")
def displayed_features(lib):
    active = lib["features"].where("source = 'api' and is_active")
    long = [active.select("track_id", F.lit(f).alias("feature"), F.col(c).alias("value"), "status") for f, c in (("bpm", "bpm"), ("energy", "energy"), ("alias", "bpm"), ("other", "energy"))]
    rows = long[0].unionByName(long[1]).unionByName(long[2]).unionByName(long[3])
    shown = lists.resolved_features(rows, {"bpm": (1, "Tempo"), "energy": (2, "Energy"), "alias": (1, "Tempo")}, ["alias"])
    return shown.select("track_id", F.explode("features").alias("f")).select("track_id", "f.*")


@query("select track_id, source, row_id from features where track_id in (select track_id from liked where is_current) and source in ('local')", "features", "liked")
def rows_of_liked(lib):
    return lists.rows_of_tracks(lib["features"], lib["liked"].where("is_current"), ["local"]).select("track_id", "source", "row_id")


@query("select track_id, segment_id from segments where quality >= 1 and mode = 1", "segments")
def active_segments(lib):
    rows = lib["segments"].withColumns({"deleted_at": F.when(F.col("quality") < 1, _now()), "path": F.when(F.col("mode") == 1, "p"), "segment_type": F.lit("A")})
    return lists.active_segments(rows, with_file=True).select("track_id", "segment_id")


@query("""with recursive p as (select r_regionkey as name, (r_regionkey + 1) % 5 as extends from region), n as (select n_nationkey as m, n_regionkey as r, row_number() over (partition by n_regionkey order by n_nationkey desc) - 1 as pos from nation),
    chain as (select 2 as name, 0 as depth union all select (name + 1) % 5, depth + 1 from chain where depth < 4),
    walk as (select m::bigint as m, [-depth, pos] as path from chain join n on r = name
      union all select d.need::bigint, list_append(path, d.pos) from walk, (values (0, 2), (1, 3)) as v(pos, k), lateral (select walk.m // v.k as need, v.pos as pos) d where walk.m >= 2),
    f as (select m, min(list_append(path, 1000000)) as first from walk group by m)
    select 'm' || m as model, (row_number() over (order by first) - 1)::int as place from f""")
def profile_models(lib):
    """Nations as models that depend on smaller ones, regions as profiles that extend each other in a ring."""
    key = F.col("n_nationkey")
    name = lambda c: F.concat(F.lit("m"), F.floor(c).cast("string"))
    models = lib.raw("nation").select(name(key).alias("model"), F.when(key >= 2, F.array(name(key / 2), name(key / 3))).otherwise(F.array().cast("array<string>")).alias("depends_on"), "n_regionkey", key)
    listed = models.groupBy("n_regionkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "model")), False), lambda m: m["model"]).alias("models"))
    profiles = lib.raw("region").join(listed, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_regionkey").cast("string").alias("name"), ((F.col("r_regionkey") + 1) % 5).cast("string").alias("extends"), "models")
    return work.profile_models(profiles, models, "2")


#: A node of each shape, with what it is as a number; {v} is a value.
SHAPES = (
    ("{v}", "v"), ('{{"mean": {v}}}', "v"), ('{{"mean": [{v}, {v}, 4]}}', "(2 * v + 4) / 3.0"), ('{{"value": {v}}}', "v"), ('{{"mean": "x", "avg": {v}}}', "v"), ('{{"average": {v}, "median": 1}}', "v"),
    ('[{v}, "x", 3, null]', "(v + 3) / 2.0"), ('"{v}"', "null"), ("null", "null"), ('{{"mean": [], "avg": null}}', "null"), ("[]", "null"), ('{{"mean": {{"mean": 1}}}}', "null"),
)


def _by_shape(k: str, part: int) -> str:
    return f"case {k} % {len(SHAPES)} " + " ".join(f"when {n} then " + (f"replace('{shape[0].format(v='@')}', '@', cast(v as string))" if part == 0 else shape[1]) for n, shape in enumerate(SHAPES)) + " end"


@query(f"""with e as (select event_id, event_id % 977 as v from events), n as (select event_id, v, ({_by_shape("event_id", 1)})::double as bpm, ({_by_shape("(event_id // 3)", 1)})::double as loudness,
      ({_by_shape("(event_id // 5)", 1)})::double as average from e),
    given as (select *, case event_id // 3 % {len(SHAPES)} when 0 then v <> 0 when 8 then false when 10 then false else true end as there from n)
    select event_id, round(bpm, 6) + 0.0 as bpm, case when bpm is not null then 0.85::double end as bpm_confidence, round(case when there then loudness else average end, 6) + 0.0 as loudness, case event_id % 4 when 0 then 1 when 1 then 10 when 2 then 3 end as key, case event_id % 3 when 0 then 1 when 1 then 0 end as mode,
      case when event_id % 2 = 0 then round(v / 7.0::double, 6) end + 0.0 as first_mfcc, (v * 1000)::bigint as duration_ms from given""")
def analysis_numbers(lib):
    """Documents with every shape of node, one malformed tail, keys in several places."""
    from crateflow.sources.analysis import analysis_documents

    e = lib.raw("events").select("event_id", (F.col("event_id") % 977).alias("v"))
    shape = lambda k: F.expr(_by_shape(k, 0))
    key = F.expr("case event_id % 4 when 0 then '\"key_key\": \"C#\"' when 1 then '\"key_key\": \"\", \"key\": \" bB \"' when 2 then '\"key_edma\": 5, \"key_krumhansl\": {\"key\": 3}' else '\"key\": \"H\"' end")
    scale = F.expr("case event_id % 3 when 0 then '\"scale\": \"Major\"' when 1 then '\"key_scale\": null, \"scale\": \"min\"' else '\"scale\": \"x\"' end")
    mfcc = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"mean": ['), (F.col("v") / 7.0).cast("string"), F.lit(", 2]}"))).otherwise(F.lit("null"))
    text = F.concat(
        F.lit('{"rhythm": {"bpm": '), shape("event_id"), F.lit('}, "tonal": {'), key, F.lit(", "), scale, F.lit('}, "metadata": {"audio_properties": {"length": '), F.col("v").cast("string"),
        F.lit('}}, "lowlevel": {"loudness": '), shape("(event_id div 3)"), F.lit(', "average_loudness": '), shape("(event_id div 5)"), F.lit(', "mfcc": '), mfcc, F.lit("}}"),
    )
    rows = analysis_documents(e.select("event_id", text.alias("value")))
    return rows.select("event_id", r6("bpm").alias("bpm"), "bpm_confidence", r6("loudness").alias("loudness"), "key", "mode", r6(F.get("mfcc", F.lit(0))).alias("first_mfcc"), "duration_ms")


@query("""select n // 50 * 50 + n % 50 as place, 't' || track_id as track_id, track_id as duration_ms, strftime(added_at, '%Y-%m-%dT%H:%M:%SZ') as added_at from (select *, row_number() over (order by track_id) - 1 as n from liked) where track_id % 5 > 0""", "liked")
def paged_saved_tracks(lib):
    """Likes landed as pages of fifty, one document each, read as a source with a task for each range of pages."""
    path = fresh_path(lib.spark)
    rows = lib["liked"].withColumn("n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("track_id")) - 1)
    n = F.col("track_id")
    track = F.when(n % 5 > 0, F.struct(F.concat(F.lit("t"), n).alias("id"), n.alias("duration_ms")))
    item = F.struct("n", F.date_format("added_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("added_at"), track.alias("track"))
    page = F.struct(F.array_sort(F.collect_list(item)).alias("items"))
    pages = rows.groupBy((F.floor(F.col("n") / 50) * 50).alias("offset")).agg(F.to_json(page).alias("value"))
    pages.repartition("offset").write.partitionBy("offset").text(path)
    lib.spark.dataSource.register(LandedPages)
    return lib.spark.read.format("landed_pages").schema("place long, track_id string, duration_ms long, added_at string").load(path)


@query(f"select track_id from tracks where track_id in (select track_id from ({ORACLES['snapshot_status_first']}) where status = 'unavailable') order by normalized_title, track_id limit 500", "tracks")
def search_snapshot_status(lib):
    """Tracks that the two latest of three snapshots find unavailable."""
    t = lib["tracks"]
    before, after = playlist_snapshots(lib)
    marked = lambda rows, name: rows.withColumn("snapshot_id", F.lit(name))
    tables = {name: lib[name] for name in ("tracks", "albums", "artists", "track_artists", "playlist_tracks")} | {
        "snapshots": lib.raw("region").where("r_regionkey < 3").select(F.concat(F.lit("s"), "r_regionkey").alias("snapshot_id"), F.col("r_regionkey").alias("created_at")),
        "liked_snapshots": marked(t.where("track_id % 5 = 0").select("track_id"), "s0").unionByName(marked(t.where("track_id % 2 = 0").select("track_id"), "s1")).unionByName(marked(t.where("track_id % 3 = 0").select("track_id"), "s2")),
        "playlist_snapshots": marked(before, "s1").unionByName(marked(after, "s2")), "liked": t.where("track_id % 11 <> 0").select("track_id", F.lit(None).cast("timestamp_ntz").alias("added_at")),
    }
    return search.search_ids(tables, snapshot_status="unavailable")


@query(""", i as (select *, case job_id % 3 when 0 then 'preview_resolve' when 1 then 'audio_analysis_pipeline' else 'other' end as kind, case when item_id % 4 = 0 then '{"is_available": true}' when item_id % 4 = 1 then '{"is_available": 0}' when item_id % 4 = 2 then '{bad' end as result from (select * replace (item_id // 20 as job_id) from items where status in ('success', 'failed', 'skipped'))),
    c as (select job_id, kind, count(*) as total, count(*) filter (status = 'success' and (kind <> 'preview_resolve' or item_id % 4 = 0)) as succeeded, count(*) filter (status = 'success' and kind = 'preview_resolve' and item_id % 4 <> 0) as not_found, count(*) filter (status = 'failed') as failed,
      count(*) filter (status = 'skipped') as skipped, count(*) filter (status = 'success') as s, arg_max('e' || item_id, item_id) filter (status = 'failed') as last_error, count(*) filter (stage = 'download' and status = 'failed') as failed_downloads from i group by all)
    select job_id, case when failed > 0 and s > 0 then 'partial' when failed > 0 then 'failed' else 'succeeded' end as status, case when job_id % 2 = 0 then 7 else total end::bigint as track_count, succeeded, failed, skipped, not_found, last_error, case when kind = 'audio_analysis_pipeline' then failed_downloads else 0 end as failed_downloads from c""", "items")
def job_results(lib):
    """Jobs of twenty items of three kinds; of items only those that have ended. Failures end in order of their ids."""
    n = F.col("item_id")
    items = lib["items"].where("status in ('success', 'failed', 'skipped')").withColumns({"job_id": F.floor(n / 20), "error_message": F.concat(F.lit("e"), n), "finished_at": F.timestamp_seconds(n)})
    items = items.withColumn("result_json", F.when(n % 4 == 0, '{"is_available": true}').when(n % 4 == 1, '{"is_available": 0}').when(n % 4 == 2, "{bad"))
    kind = F.element_at(F.array(*map(F.lit, ("preview_resolve", "audio_analysis_pipeline", "other"))), (F.col("job_id") % 3).cast("int") + 1)
    ended = items.select("job_id").distinct().select("job_id", kind.alias("job_type"), F.when(F.col("job_id") % 2 == 0, 7).otherwise(0).cast("long").alias("track_count"))
    found = jobs.terminal_results(ended, items)
    return found.select("job_id", "status", "track_count", "succeeded", "failed", "skipped", "not_found", "last_error", F.coalesce(F.try_element_at("stages", F.lit("download:failed")), F.lit(0)).alias("failed_downloads"))


@query("""select track_id, segment_id as ordinal, round(0.7::double * 2 * least(m, n) / (m + n) + 0.3::double * greatest(0, 1 - abs(x - y) / greatest(x, 1.0::double)), 6) + 0.0 as score from
      (select track_id, segment_id, 1 + track_id % 6 as m, 1 + segment_id * 7 % 11 as n, (track_id % 50)::double as x, (segment_id * 3 % 60)::double as y from segments) where abs(x - y) <= 15
    qualify row_number() over (partition by track_id order by round(0.7::double * 2 * least(m, n) / (m + n) + 0.3::double * greatest(0, 1 - abs(x - y) / greatest(x, 1.0::double)), 9) desc, segment_id) = 1""", "segments")
def compared_downloads(lib):
    """Texts of one letter, whose ratio is known; few pairs of texts reach the comparison."""
    n, k = F.col("track_id"), F.col("segment_id")
    rows = lib["segments"].select("track_id", k.alias("ordinal"), F.expr("repeat('a', cast(1 + track_id % 6 as int))").alias("text"), F.expr("repeat('A', cast(1 + segment_id * 7 % 11 as int))").alias("c_text"), (n % 50).cast("double").alias("duration_s"), (k * 3 % 60).cast("double").alias("c_duration_s"))
    best, _ = matching.best_downloads(rows)
    return best.withColumn("score", r6("score"))


@query("""select track_id::varchar as track_id, coalesce(name, '') as name, coalesce(isrc, '') as isrc, strftime(added_at, '%Y-%m-%dT%H:%M:%S') as added_at from liked join tracks using (track_id)""", "liked", "tracks")
def exported_likes(lib):
    """Written as CSV and read back."""
    path = fresh_path(lib.spark)
    export.write_csv(export.liked_rows(lib["tracks"], lib["liked"]), path)
    return lib.spark.read.option("header", True).option("nullValue", "\x00").csv(path).select("track_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("isrc", F.lit("")).alias("isrc"), "added_at")


@query("""select playlist_id, p.name as playlist, position, track_id, coalesce(t.name, '') as name from playlist_tracks join playlists p using (playlist_id) left join tracks t using (track_id)""", "playlist_tracks", "playlists", "tracks")
def exported_playlists(lib):
    """Nested JSON, a document per playlist, written, read back and flattened."""
    path = fresh_path(lib.spark)
    export.write_json(export.playlists_nested(export.playlist_rows(lib["playlists"], lib["playlist_tracks"], lib["tracks"])), path)
    back = lib.spark.read.schema("playlist_id long, playlist string, items array<struct<position long, track_id long, name string>>").json(path)
    return back.select("playlist_id", "playlist", F.explode("items").alias("i")).select("playlist_id", "playlist", "i.*")


@query("""select 'liked' as kind, track_id, null::bigint as playlist_id, null::bigint as position from liked where track_id % 3 > 0 union all select 'item', track_id, playlist_id, position from playlist_tracks where playlist_id % 5 = 0""", "liked", "playlist_tracks")
def exported_snapshot(lib):
    """A snapshot's rows as JSON lines of their kinds, written, read back and parsed; another snapshot's rows are left out."""
    path = fresh_path(lib.spark)
    likes, items = snapshots.create("s1", lib["liked"].where("track_id % 3 > 0"), lib["playlist_tracks"].where("playlist_id % 5 = 0"))
    other, _ = snapshots.create("s2", lib["liked"], lib["playlist_tracks"])
    export.write_json(export.snapshot_document("s1", likes.unionByName(other), lib["playlists"].where("false").withColumn("snapshot_id", F.lit("s1")), items), path)
    back = lib.spark.read.schema("kind string, document string").json(path)
    d = F.from_json("document", "track_id long, playlist_id long, position long")
    return back.select("kind", d.alias("d")).select("kind", "d.*")


@query(ORACLES["rule_filter_reasons"].replace("select track_id, array_to_string(reasons, ',') as reasons from sc", """select track_id, code, case when code like 'BPM%' then 'bpm' else 'energy' end as field, case when code like 'BPM%' then '{"min": 70, "max": 150}' else '{"min": 0.1, "max": null}' end as expected,
      round(case when code like 'BPM%' then bpm when code in ('ENERGY_OUT_OF_RANGE', 'FEATURE_LOW_CONFIDENCE') then energy end, 6) + 0.0 as value from (select *, unnest(reasons) as code from sc)"""))
def rule_exclusions(lib):
    rows = wide_view(lib).select("track_id", F.explode(rules.details(RULE)).alias("r")).select("track_id", "r.*")
    return rows.withColumn("value", r6(F.col("value").cast("double")))
