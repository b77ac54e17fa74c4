"""Further queries over the driver's tables: lists, states, choices among rows, scores. Each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from crateflow.functions import numeric, status, text
from crateflow.operators import aggregate, coverage, gating, jobs, lists, matching, ranking, resolve, search, snapshots, upserts, work
from crateflow.plans.catalogue import query, r6
from crateflow.sources import ingest
from crateflow.sources.tables import fresh_path


@query("select track_id from tracks where market_status = 'restricted' order by normalized_title nulls first, track_id limit 500", "tracks")
def search_market_ids(lib):
    return search.search_ids(lib, market_status="restricted")


@query("select track_id from tracks where track_id in (select track_id from liked) order by duration_ms nulls first, track_id limit 500", "tracks", "liked")
def search_ids_of_liked(lib):
    return search.search_ids(lib, ids=lib["liked"].select("track_id"), sort="duration")


@query("select track_id from tracks where isrc = (select min(isrc) from tracks)", "tracks")
def search_by_isrc(lib):
    return search.search_ids(lib, isrc=lib["tracks"].agg(F.min("isrc")).first()[0])


@query("select track_id from tracks where isrc in (select isrc from tracks group by isrc having count(*) > 1) order by normalized_title, track_id limit 500", "tracks")
def search_duplicate_ids(lib):
    from crateflow.operators import duplicates

    groups = duplicates.isrc_groups(lib["tracks"])
    return search.search_ids(lib, duplicate_ids=groups.select(F.explode("track_ids").alias("track_id")), duplicate_status="isrc")


@query("select track_id from tracks where track_id not in (select track_id from playlist_tracks where position = 5) order by normalized_title, track_id limit 500", "tracks", "playlist_tracks")
def search_not_in_sixth_place(lib):
    """Items in the sixth place alone count as current, so that many tracks are in no playlist."""
    tables = {name: lib[name] for name in ("tracks", "albums", "artists", "track_artists", "liked")}
    return search.search_ids(tables | {"playlist_tracks": lib["playlist_tracks"].withColumn("is_current", F.col("position") == 5)}, not_in_any_playlist=True)


@query("""select coalesce(c.track_id, o.track_id) as track_id, case when c.track_id is not null then c.part else o.part end as part, case when c.track_id is not null then c.name else o.name end as name
    from (select track_id, market_status as part, name from tracks where track_id % 3 <> 0) o full join (select track_id, market_status as part, upper(name) as name from tracks where track_id % 2 = 0) c on o.track_id = c.track_id and o.part is not distinct from c.part""", "tracks")
def upsert_null_keys(lib):
    t = lib["tracks"].select("track_id", F.col("market_status").alias("part"), "name")
    return upserts.upsert(t.where("track_id % 3 <> 0"), t.where("track_id % 2 = 0").withColumn("name", F.upper("name")), ["track_id", "part"])


@query("select job_id, arg_max(status, item_id) as status from items group by job_id", "items")
def last_row_per_key(lib):
    return upserts.last_per_key(lib["items"].select("job_id", F.col("item_id").alias("ordinal"), "status"), ["job_id"])


@query("select track_id as old_id, stage as source, item_id as row_id from items qualify row_number() over (partition by track_id, stage order by finished_at desc nulls last, item_id desc) = 1", "items")
def newest_per_source(lib):
    rows = lib["items"].select("track_id", F.col("stage").alias("source"), F.col("finished_at").alias("fetched_at"), F.col("item_id").alias("row_id"))
    return resolve.newest_per_source(rows).select(F.col("track_id").alias("old_id"), "source", "row_id")


@query("select status, count(*) as n from items group by status", "items")
def item_status_counts(lib):
    return jobs.status_counts(lib["items"])


@query("select job_id, item_id from items where status = 'failed' qualify row_number() over (partition by job_id order by finished_at desc nulls last, item_id) = 1", "items")
def first_failed_items(lib):
    return jobs.first_failed(lib["items"]).select("job_id", "item_id")


@query("""select item_id, case when status = 'pending' then case when (epoch_us((select max(created_at) from items)) - epoch_us(created_at)) // 1000000 > case stage when 'download' then 600 when 'lowlevel' then 900 when 'tensorflow' then 1800 else 900 end then 'pending' else 'running' end else status end as status from items""", "items")
def stale_locks(lib):
    """Pending items taken as running since they were made."""
    i = lib["items"]
    now = i.agg(F.max("created_at")).scalar()
    running = i.withColumn("status", F.when(F.col("status") == "pending", "running").otherwise(F.col("status"))).withColumn("locked_by", F.lit("w")).withColumn("locked_at", F.col("created_at"))
    return jobs.release_stale(running, now).select("item_id", "status")


@query("select item_id, case when status = 'failed' and job_id = (select min(job_id) from items) then 'pending' else status end as status, case when status = 'failed' and job_id = (select min(job_id) from items) then 0 else 2 end as attempt_count from items", "items")
def retried_items(lib):
    rows = lib["items"].withColumn("attempt_count", F.lit(2)).withColumn("error_code", F.lit("x"))
    return jobs.retry_failed(rows, lib["items"].agg(F.min("job_id")).scalar()).select("item_id", "status", "attempt_count")


@query("select item_id, case when status in ('pending', 'blocked', 'rate_limited') and job_id = (select min(job_id) from items) then 'cancelled' else status end as status from items", "items")
def cancelled_items(lib):
    return jobs.cancel(lib["items"], lib["items"].agg(F.min("job_id")).scalar()).select("item_id", "status")


@query("""select track_id % 5 as job_id, track_id, segment, stage, case when stage = 'download' then 'pending' else 'blocked' end as status from tracks,
    (select s as segment, t as stage from (values (0), (1), (2)) a(s), (values ('download'), ('lowlevel'), ('tensorflow')) b(t) union all select null, t from (values ('aggregation'), ('cleanup')) c(t))""", "tracks")
def pipeline_fan_out(lib):
    return jobs.plan(lib["tracks"].select((F.col("track_id") % 5).alias("job_id"), "track_id"))


@query("select segment_id from (select track_id as segment_id from tracks where track_id % 4 <> 0 and track_id % 5 <> 0) where segment_id not in (select track_id from items where status in ('pending', 'running', 'rate_limited', 'blocked') and stage in ('lowlevel', 'tensorflow'))", "tracks", "items")
def removable_files(lib):
    segments = lib["tracks"].select(F.col("track_id").alias("segment_id"), F.when(F.col("track_id") % 4 != 0, F.col("name")).alias("path"), F.when(F.col("track_id") % 5 == 0, F.lit("2024-01-01")).alias("deleted_at"))
    return jobs.removable_files(segments, lib["items"].withColumn("segment_id", F.col("track_id"))).select("segment_id")


@query("select job_id, case when job_id % 3 = 0 and job_id % 2 = 0 then 'failed' else 'queued' end as status from (select distinct job_id from items)", "items")
def orphaned_jobs(lib):
    """Jobs of even number are alive nowhere; every third is of a kind that no worker manages."""
    all_ = lib["items"].select("job_id").distinct().select("job_id", F.lit("queued").alias("status"), F.when(F.col("job_id") % 3 == 0, "import").otherwise("pipeline").alias("job_type"))
    return jobs.orphaned(all_, all_.where("job_id % 2 <> 0"), ("pipeline",)).select("job_id", "status")


@query("""select track_id, case when track_id % 6 = 0 then 'unknown' when is_playable is null then 'unavailable' when is_playable then 'local' when track_id % 2 = 0 then 'episode' when linked_from is null then 'unavailable' end as reason from tracks""", "tracks")
def null_reasons(lib):
    kind = F.when(F.col("track_id") % 2 == 0, "episode").otherwise("track")
    reason = status.null_reason(F.col("track_id") % 6 != 0, F.col("is_playable").isNotNull(), F.coalesce("is_playable", F.lit(False)), kind, F.col("linked_from").cast("string"))
    return lib["tracks"].select("track_id", reason.alias("reason"))


@query("select verdict, count(*) as n, bool_or(verdict in ('mismatch', 'low_confidence_fuzzy')) as needs_remedy from (select case when isrc is null then 'isrc_unresolvable' when track_id % 5 = 0 then 'mismatch' when track_id % 2 = 1 and (track_id % 10) / 10.0 < 0.6 then 'low_confidence_fuzzy' else 'ok' end as verdict from tracks) group by verdict", "tracks")
def audit_histogram(lib):
    rows = lib["tracks"].select(F.col("isrc").isNull().alias("isrc_unresolvable"), (F.col("track_id") % 5 == 0).alias("mismatch"), (F.col("track_id") % 2 == 1).alias("fuzzy"), ((F.col("track_id") % 10) / 10.0).alias("confidence"))
    return matching.verdict_counts(matching.audited(rows))


@query("""select track_id, round(least(1, greatest(0, track_id % 30 / 10.0 - 1)), 6)::double as clamped, case track_id % 3 when 0 then 1.0::double when 1 then 0.9::double else 0.5::double end as match, case track_id % 4 when 0 then 0.95::double when 1 then 1.0::double when 2 then 0.7::double else 1.0::double end as origin,
    round(case when track_id % 2 = 0 then (track_id % 10) / 10.0::double else 1 / (1 + exp(-(track_id % 7)::double)) end, 6) + 0.0 as binary from tracks""", "tracks")
def unit_scores(lib):
    n = F.col("track_id")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (n % len(v)).cast("int") + 1)
    return lib["tracks"].select(
        "track_id", r6(numeric.clamp01(n % 30 / 10 - 1)).alias("clamped"), numeric.match_confidence(pick("isrc", "id", "text")).alias("match"), numeric.origin_weight(pick("representative", "three_segments", "preview", "other")).alias("origin"),
        r6(numeric.binary_score(F.when(n % 2 == 0, n % 10 / 10), (n % 7).cast("double"), F.lit(None).cast("double"))).alias("binary"),
    )


@query("""select track_id, trim(regexp_replace(lower(album_id), '\\s+', ' ', 'g')) as plain, trim(regexp_replace(regexp_replace(lower(album_id), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as matched, track_id::varchar as from_link, case when isrc is null then false else true end as same,
    case when abs(track_id % 40 - 10) <= 15 then round(0.7::double * 0.5::double + 0.3::double * greatest(0, 1 - abs(track_id % 40 - 10) / 10.0::double), 6) + 0.0 end as download from tracks""", "tracks")
def text_forms(lib):
    t = lib["tracks"]
    link = F.concat(F.lit("https://host/track/"), F.col("track_id").cast("string"), F.lit("?a=b"))
    score = text.download_score(F.lit(0.5), F.lit(10.0), (F.col("track_id") % 40).cast("double"))
    return t.select("track_id", text.normalize(F.col("album_id")).alias("plain"), text.normalize_for_match(F.col("album_id")).alias("matched"), text.id_from_url(link).alias("from_link"), text.same_isrc(F.lower("isrc"), F.concat(F.lit(" "), F.col("isrc"))).alias("same"), r6(score).alias("download"))


@query("select 's1' as snapshot_id, track_id, strftime(added_at, '%Y-%m-%d') as day from liked", "liked")
def snapshot_copy(lib):
    likes, _ = snapshots.create("s1", lib["liked"], lib["playlist_tracks"])
    return likes.select("snapshot_id", "track_id", F.date_format("added_at", "yyyy-MM-dd").alias("day"))


@query("""select count(*) as total, count(*) filter (any_) as any_preview, count(*) filter (a) as available, count(*) filter (f) as failed, count(*) - count(*) filter (a) as missing, round(count(*) filter (a) / count(*)::double * 100, 2) as pct
    from tracks left join (select track_id, bool_or(status = 'success') as a, bool_or(status = 'failed') as f, true as any_ from features group by track_id) using (track_id)""", "tracks", "features")
def preview_coverage(lib):
    rows = lib["features"].select("track_id", F.when(F.col("status") == "success", "available").otherwise(F.col("status")).alias("status"))
    return coverage.previews(lib["tracks"], rows)


@query("""select track_id::varchar as request_id, 'p' || max(o) as payload from (select track_id, track_id as o from tracks where track_id % 4 <> 3 union all select track_id, track_id + 1000000 from tracks where track_id % 4 = 0) group by track_id""", "tracks")
def rekeyed_responses(lib):
    """Three ways to name an answer; every fourth track is answered by two of the same way."""
    t, n = lib["tracks"], F.col("track_id").cast("string")
    none = F.lit(None).cast("string")
    way = F.col("track_id") % 4
    once = t.where(way != 3).select(F.col("track_id").alias("ordinal"), F.when(way == 0, n).otherwise(none).alias("id"), F.when(way == 1, n).alias("isrc"), F.when(way == 2, F.concat(F.lit("https://h/track/"), n)).alias("href"), F.concat(F.lit("p"), n).alias("payload"))
    again = t.where(way == 0).select((F.col("track_id") + 1000000).alias("ordinal"), n.alias("id"), none.alias("isrc"), none.alias("href"), F.concat(F.lit("p"), (F.col("track_id") + 1000000).cast("string")).alias("payload"))
    return matching.rekeyed(t.select(n.alias("request_id")), once.unionByName(again))


@query("""select track_id, segment_id as ordinal, (row_number() over (partition by track_id order by match desc, segment_id) - 1)::int as rank, row_number() over (partition by track_id order by match desc, segment_id) = 1 and match >= 0.95 as is_selected
    from (select track_id, segment_id, match from segments qualify row_number() over (partition by track_id, segment_id % 4 order by match desc, segment_id) = 1)""", "segments")
def ranked_downloads(lib):
    rows = lib["segments"].select("track_id", F.col("segment_id").alias("ordinal"), (F.col("segment_id") % 4).cast("string").alias("url"), F.col("match").alias("confidence"))
    return matching.ranked(rows, 0.95).select("track_id", "ordinal", "rank", "is_selected")


@query("select track_id, min(row_id) as row_id from features where status in ('success', 'partial') group by track_id", "features")
def first_usable_embeddings(lib):
    return resolve.first_usable_embedding(lib["features"].select("track_id", "row_id", "status")).select("track_id", "row_id")


@query("""select track_id, 'valence' as feature, case when l.energy is not null and v.valence is null then l.energy else v.valence end as value, case when l.energy is not null and v.valence is null then 'local' when v.valence is not null then 'api' end as source
    from (select track_id, valence from features where is_active and source = 'api') v left join (select track_id, energy from features where is_active and source = 'local') l using (track_id)
    union all select track_id, 'valence_inverse', 1 - valence, 'api' from features where is_active and source = 'api' and valence is not null""", "features")
def fallback_features(lib):
    active = lib["features"].where("is_active")
    first = resolve.by_priority(active.where("source = 'api'"), "valence", ["api"])
    local = active.where("source = 'local'").select("track_id", F.lit("other").alias("feature"), F.col("energy").alias("value"), "confidence", "status")
    return resolve.with_fallback(first, local, {"valence": "other"}).select("track_id", "feature", "value", "source")


@query("select track_id from tracks where track_id % 3 = 0 and track_id % 10 >= 6", "tracks")
def shown_previews(lib):
    n = F.col("track_id")
    rows = lib["tracks"].select("track_id", F.when(n % 3 == 0, "available").otherwise("failed").alias("status"), F.when(n % 7 != 7, "u").alias("url"), (n % 10 / 10).alias("confidence"))
    return lists.usable_previews(rows).select("track_id")


@query("select item_id from items where stage in ('download', 'lowlevel') and status in ('pending', 'blocked') order by created_at, item_id limit 100", "items")
def oldest_stage_items(lib):
    return lists.stage_items(lib["items"], ["download", "lowlevel"], ["pending", "blocked"], 100).select("item_id")


@query("select item_id from items where status in ('pending', 'blocked') and job_id % 2 = 0", "items")
def items_of_ended_jobs(lib):
    ended = lib["items"].select("job_id").distinct().withColumn("status", F.when(F.col("job_id") % 2 == 0, "failed").otherwise("running"))
    return lists.of_terminal_jobs(lib["items"], ended).select("item_id")


@query("select item_id from items order by created_at desc nulls last, item_id desc limit 50 offset 50", "items")
def newest_items_page(lib):
    return lists.newest_first(lib["items"], "created_at", "item_id", page=2).select("item_id")


@query("select playlist_id, track_id, row_number() over (partition by playlist_id order by track_id, position) - 1 as place from playlist_tracks", "playlist_tracks")
def numbered_items(lib):
    rows = lists.numbered(lib["playlist_tracks"].select("playlist_id", "track_id", F.col("position").alias("old")), ["playlist_id"], F.col("track_id"), F.col("old"))
    return rows.select("playlist_id", "track_id", F.col("position").cast("long").alias("place"))


@query("select track_id, coalesce(case when track_id % 3 = 0 then 's' || track_id end, case when track_id % 2 = 0 then 'p' || track_id end, isrc) as request_id from tracks where coalesce(case when track_id % 3 = 0 then 's' end, case when track_id % 2 = 0 then 'p' end, isrc) is not null", "tracks")
def lookup_requests(lib):
    t, n = lib["tracks"], F.col("track_id").cast("string")
    held = t.where("track_id % 3 = 0").select("track_id", F.lit("service").alias("id_type"), F.concat(F.lit("s"), n).alias("value")).unionByName(t.where("isrc is not null").select("track_id", F.lit("isrc").alias("id_type"), F.col("isrc").alias("value")))
    return lists.lookup_ids(t.withColumn("platform_id", F.when(F.col("track_id") % 2 == 0, F.concat(F.lit("p"), n))), held)


@query("select track_id, name, case when name is null then 'NOT_FOUND' when l then 'ALREADY_LIKED' end as warning from (select track_id from tracks union select track_id + 100000000 from tracks where track_id <= 50) left join (select track_id, name from tracks) using (track_id) left join (select track_id, true as l from liked) using (track_id)", "tracks", "liked")
def like_dry_run(lib):
    t = lib["tracks"].select("track_id")
    wanted = t.unionByName(t.where("track_id <= 50").select((F.col("track_id") + 100000000).alias("track_id")))
    return work.affected(wanted, lib["tracks"], lib["liked"], "like").select("track_id", "name", "warning")


@query("select job_id as track_id from (select distinct job_id from items) where job_id not in (select job_id from items where status = 'success' and stage in ('download', 'lowlevel') group by job_id having count(distinct stage) = 2)", "items")
def incomplete_tracks(lib):
    rows = lib["items"].select(F.col("job_id").alias("track_id"), "stage", "status")
    return work.incomplete(rows.select("track_id").distinct(), rows.where("status = 'success'"), ["download", "lowlevel"])


@query("select job_id as track_id, item_id as download_id from items where status in ('pending', 'blocked', 'success') qualify row_number() over (partition by job_id order by status = 'success' desc, case status when 'pending' then 1 when 'blocked' then 2 else 3 end, created_at, item_id) = 1", "items")
def best_downloads(lib):
    rows = lib["items"].select(F.col("job_id").alias("track_id"), F.col("item_id").alias("download_id"), "status", "created_at")
    return work.best_download(rows, ["pending", "blocked", "success"]).select("track_id", "download_id")


@query("select track_id, segment_id as preview_id from segments qualify row_number() over (partition by track_id order by match desc nulls last, segment_id) = 1", "segments")
def best_previews(lib):
    return work.best_preview(lib["segments"].select("track_id", F.col("segment_id").alias("preview_id"), F.col("match").alias("confidence"))).select("track_id", "preview_id")


@query("select job_id as segment_id, max(item_id) as analysis_id from items where status = 'success' and stage = 'lowlevel' group by job_id", "items")
def latest_analyses(lib):
    rows = lib["items"].select(F.col("job_id").alias("segment_id"), F.col("item_id").alias("analysis_id"), F.col("stage").alias("level"), F.lit("v1").alias("version"), "status")
    return work.latest_success(rows, "lowlevel", "v1").select("segment_id", "analysis_id")


@query("select track_id, 'bpm' as feature, coalesce(max(bpm) filter (source = 'api'), max(bpm) filter (source = 'local')) as value from features where bpm is not null group by track_id", "features")
def built_rows(lib):
    f = lib["features"].where("bpm is not null")
    return work.build_rows([f.where(F.col("source") == s).select("track_id", F.lit("bpm").alias("feature"), F.col("bpm").alias("value")) for s in ("api", "local")])


@query("select stage, count(*) as n, count(distinct track_id) as tracks, round(avg(60000.0 * (item_id % 7)), 6) + 0.0 as mean_ms from items where status = 'success' group by stage", "items")
def stage_durations(lib):
    rows = lib["items"].withColumn("started_at", F.col("created_at")).withColumn("finished_at", F.timestamp_add("MINUTE", (F.col("item_id") % 7).cast("int"), F.col("created_at")))
    return work.durations(rows).select("stage", "n", "tracks", r6("mean_ms").alias("mean_ms"))


@query("select track_id, decision, segment, round(start_s, 3)::double as start_s from (select track_id, case when track_id % 2 = 0 then 'preview_only' when track_id % 3 = 0 then 'one_segment' else 'unavailable' end as decision, case when track_id % 2 = 0 then 'preview' when track_id % 3 = 0 then '1/2' end as segment, case when track_id % 2 = 0 then 0.0 when track_id % 3 = 0 then d / 2 - least(15.0, d) / 2 end as start_s from (select track_id, duration_ms / 1000.0::double as d from tracks) where d > 0)", "tracks")
def availability_plans(lib):
    rows = lib["tracks"].select("track_id", (F.col("duration_ms") / 1000).alias("duration_s"), (F.col("track_id") % 2 == 0).alias("has_preview"), (F.col("track_id") % 3 == 0).alias("has_search"))
    return ingest.plan_by_availability(rows).select("track_id", "decision", "segment", (F.col("start_s") + 0.0).alias("start_s"))


@query("select track_id, v[greatest(1, (floor(len(v) * 0.95))::int)] as p95 from (select track_id, list_sort(list(duration_ms)) as v from segments group by track_id)", "segments")
def percentiles(lib):
    return ranking.p95s(lib["segments"], ["track_id"], "duration_ms").select("track_id", "p95")


@query("""select l_returnflag as flag, round(median(l_extendedprice), 6) + 0.0 as price, round(median(l_quantity), 6) + 0.0 as quantity, min(l_extendedprice) as least from lineitem group by 1""")
def hot_medians(lib):
    """Three groups of a third of all rows or so."""
    lines = lib.raw("lineitem")
    price = ranking.medians(lines, ["l_returnflag"], "l_extendedprice").withColumnRenamed("median", "price")
    quantity = ranking.medians(lines, ["l_returnflag"], "l_quantity").withColumnRenamed("median", "quantity")
    least = ranking.values_at(lines, ["l_returnflag"], "l_extendedprice", {"least": F.lit(0)})
    return price.join(quantity, "l_returnflag").join(least, "l_returnflag").select(F.col("l_returnflag").alias("flag"), r6("price").alias("price"), r6("quantity").alias("quantity"), "least")


@query("select track_id, (row_number() over (order by popularity desc nulls last, track_id) - 1)::int as position from tracks qualify position between 1400 and 1449", "tracks")
def search_deep_page(lib):
    """A page found by ranges: page 29 of fifty."""
    return search.deep_page_ids(lib, search.SearchSpec(sort="popularity", descending=True, page=29)).select("track_id", "position")


@query("""select coalesce(n.track_id, o.track_id) as track_id, case when n.track_id is not null then upper(n.name) else o.name end as name from (select track_id, name from tracks where track_id % 5 > 0) o
    full join (select track_id, name from tracks where track_id % 97 = 0) n on n.track_id = o.track_id""", "tracks")
def merged_in_place(lib):
    """A written table into which a few changed and new tracks are merged; the other buckets keep their files."""
    path = fresh_path(lib.spark)
    t = lib["tracks"].select("track_id", "name")
    upserts.write_bucketed(t.where("track_id % 5 > 0"), path, ["track_id"])
    upserts.merge_changed(lib.spark, path, t.where("track_id % 97 = 0").withColumn("name", F.upper("name")), ["track_id"])
    return upserts.read_bucketed(lib.spark, path)


@query("select track_id, case when bool_or(key = 3) then 'real' when bool_or(key = 2) then 'stub' else 'none' end as mode from segments group by track_id", "segments")
def run_modes(lib):
    return aggregate.run_mode(lib["segments"].select("track_id", F.when(F.col("key") == 3, "real").when(F.col("key") == 2, "stub").otherwise("none").alias("mode")))


@query("select track_id as segment_id, segment_id as output_id from segments qualify row_number() over (partition by track_id order by quality desc, segment_id) = 1", "segments")
def best_outputs(lib):
    rows = lib["segments"].select(F.col("track_id").alias("segment_id"), F.col("segment_id").alias("output_id"), F.col("quality").alias("priority"))
    return aggregate.best_per_segment(rows).select("segment_id", "output_id")


@query("""select track_id, t.name, a.name as album, artists from (select * from tracks where track_id not in (select track_id from features where status = 'success')) t left join albums a using (album_id)
    left join (select track_id, string_agg(r.name, ',' order by position) as artists from track_artists join artists r using (artist_id) group by track_id) using (track_id)""", "tracks", "albums", "artists", "track_artists", "features")
def missing_track_metadata(lib):
    ids = lib["tracks"].join(lib["features"].where("status = 'success'"), "track_id", "left_anti")
    rows = lists.metadata(ids, lib["tracks"], lib["albums"], lib["track_artists"], lib["artists"])
    return rows.select("track_id", "name", "album", F.array_join("artists", ",").alias("artists"))


@query("select track_id from (select track_id from liked union select track_id from features where status = 'success' union select track_id from segments where quality > 0.9) order by track_id limit 300", "liked", "features", "segments")
def ids_to_audit(lib):
    downloads = lib["features"].select("track_id", F.when(F.col("status") == "success", '{"decision": "keep"}').when(F.col("status") == "failed", "{bad").otherwise('{"other": 1}').alias("metadata"))
    return lists.ids_to_audit(lib["liked"], downloads, lib["segments"].where("quality > 0.9"), 300)


@query("select track_id, count(*) as files from segments where quality > 0.9 and key <> 3 group by track_id", "segments")
def temp_files(lib):
    rows = lib["segments"].select("track_id", F.when(F.col("quality") > 0.9, F.lit("p")).alias("path"), F.when(F.col("key") == 3, F.lit("2024-01-01")).alias("deleted_at"))
    return lists.temp_file_counts(rows)


@query("""select 'm' || n_nationkey as model, case when n_nationkey % 7 < 4 and n_regionkey <> 2 then 'run' else 'models_missing' end as state from nation where n_regionkey < 4 and n_nationkey % 7 < 6""")
def gated_models(lib):
    """Nations as models: their regions are extractors, their numbers' rests heads. Some regions and heads are in no profile, some are not there."""
    n = lib.raw("nation")
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    extractor, head = name("e", F.col("n_regionkey")), name("h", F.col("n_nationkey") % 7)
    models = n.select(name("m", F.col("n_nationkey")).alias("model"), extractor.alias("extractor"), head.alias("head"))
    named = lambda r, h: n.where(r).select(extractor.alias("name")).unionByName(n.where(h).select(head.alias("name"))).distinct()
    return gating.gated(models, named("n_regionkey < 4", "n_nationkey % 7 < 6"), named("n_regionkey <> 2", "n_nationkey % 7 < 4"))


@query("select track_id, case when track_id % 5 = 0 then 'not_found' when track_id % 5 = 1 then 'not_found' else 'success' end as status, case when track_id % 5 = 0 then 'RECCOBEATS_NOT_FOUND' when track_id % 5 = 1 then 'RECCOBEATS_FEATURES_MISSING' end as error_code, case when track_id % 5 > 1 then 60 + track_id % 100 end::double as bpm, case when track_id % 5 > 1 then duration_ms end as duration_ms, case when track_id % 5 > 1 then case when isrc is not null then 1.0::double else 0.9::double end end as feature_confidence from tracks", "tracks")
def mapped_responses(lib):
    n = F.col("track_id")
    unit = (n % 10) / 10.0
    found = {f: unit for f in ("energy", "danceability", "valence", "acousticness", "instrumentalness", "speechiness", "liveness")}
    raw = F.struct((60 + n % 100).cast("double").alias("tempo"), *[c.alias(f) for f, c in found.items()], F.lit(-7.0).alias("loudness"), F.lit(3).alias("key"), F.lit(1).alias("mode"), F.lit(4).alias("time_signature"), F.lit(0).cast("long").alias("duration_ms"))
    track = F.struct(n.cast("string").alias("id"), F.upper("isrc").alias("isrc"), F.col("duration_ms").alias("duration_ms"))
    rows = lib["tracks"].select("track_id", F.lower("isrc").alias("isrc"), F.when(n % 5 > 0, track).alias("track"), F.when(n % 5 > 1, raw).alias("features"))
    return gating.mapped(rows).select("track_id", "status", "error_code", "bpm", "duration_ms", "feature_confidence")
