"""The queries over the driver's tables that apply the library's operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crateflow.functions import numeric, status, text
from crateflow.operators import aggregate, coverage, duplicates, jobs, lists, matching, resolve, rules, search, snapshots, upserts, work
from crateflow.plans.binding import Library, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str, *views: str):
    """Registers a function of a Library under its name, with its SQL."""

    def register(f: Callable[[Library], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Library(spark, sf_dir))
        ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return register


def r6(c: Column | str) -> Column:
    """Six digits by scaled halves away from zero, as the SQL engine rounds, and no negative zero."""
    scaled = (F.col(c) if isinstance(c, str) else c).cast("double") * 1e6
    return F.signum(scaled) * F.floor(F.abs(scaled) + 0.5) / 1e6 + F.lit(0.0)


def _page(lib: Library, **facets) -> DataFrame:
    rows = search.page(lib, search.SearchSpec(**facets))
    return rows.withColumn("artists", F.array_join("artists", ",")).withColumn("added_at", F.date_format("added_at", "yyyy-MM-dd"))


def _page_sql(where: str, order: str, limit: int = 50, offset: int = 0, joins: str = "") -> str:
    return f"""
    , pc as (select track_id, count(*) as playlist_count from playlist_tracks where is_current group by track_id),
    aa as (select track_id, string_agg(a.name, ',' order by position) as artists from track_artists join artists a using (artist_id) group by track_id),
    fa as (select track_id, a.normalized_name as artist_name from track_artists join artists a using (artist_id) where position = 0),
    m as (select t.*, al.name as album, l.added_at, l.track_id is not null as liked, coalesce(pc.playlist_count, 0) as playlist_count, row_number() over (order by {order}) - 1 as position
        from tracks t left join albums al using (album_id) left join liked l using (track_id) left join pc using (track_id) left join fa using (track_id) {joins} where {where})
    select position, track_id, m.name, album, artists, duration_ms, popularity, isrc, coalesce(market_status, 'unknown') as market_status, liked, strftime(added_at, '%Y-%m-%d') as added_at, playlist_count
    from m left join aa using (track_id) where position >= {offset} and position < {offset + limit}""".replace("\n    , pc", "\n    , pc", 1)


_LIBRARY = ("tracks", "albums", "artists", "track_artists", "liked", "playlist_tracks")


def _search(name: str, sql: str, **facets) -> None:
    QUERIES[name] = lambda spark, sf_dir: _page(Library(spark, sf_dir), **facets)
    ORACLES[name] = with_views(sql, *_LIBRARY).replace("\n\n    , pc", ",\n    pc")


_HAS_ARTIST = "exists (select 1 from track_artists x join artists y using (artist_id) where x.track_id = t.track_id and y.normalized_name like '{}')"
_search("search_page", _page_sql("true", "normalized_title, track_id"))
_search("search_second_page", _page_sql("true", "normalized_title, track_id", offset=50), page=2)
_search("search_q_or", _page_sql(f"normalized_title like '%5%' or al.normalized_name like '%5%' or isrc like '%5%' or {_HAS_ARTIST.format('%5%')}", "normalized_title, track_id"), q="5")
_search("search_wildcard_title", _page_sql("normalized_title like '%a_e%'", "normalized_title, track_id"), title="a_e")
_search("search_artist_album", _page_sql(f"al.normalized_name like '%1%' and {_HAS_ARTIST.format('%1%')}", "normalized_title, track_id"), artist="1", album="1")
_search("search_liked_tri", _page_sql("l.track_id is null", "duration_ms desc nulls last, track_id"), liked=False, sort="duration", descending=True)
_search("search_sort_liked_desc", _page_sql("true", "added_at desc nulls last, track_id"), sort="added_at", descending=True)
_search("search_in_playlist", _page_sql("exists (select 1 from playlist_tracks p where p.is_current and p.playlist_id = 7 and p.track_id = t.track_id)", "normalized_title, track_id"), playlist_id=7)
_search("search_not_in_playlist", _page_sql("not exists (select 1 from playlist_tracks p where p.is_current and p.track_id = t.track_id)", "normalized_title, track_id"), not_in_any_playlist=True)
_search("search_ranges", _page_sql("duration_ms between 60000 and 180000 and added_at >= timestamp '1998-01-01' and added_at <= timestamp '2001-06-30' and market_status = 'available'", "popularity desc nulls last, track_id"), duration_min=60000, duration_max=180000, added_from="1998-01-01", added_to="2001-06-30", market_status="available", sort="popularity", descending=True)
_search("search_sort_primary_artist", _page_sql("true", "artist_name nulls first, track_id"), sort="artist")
_search("search_sort_playlist_count", _page_sql("true", "playlist_count desc nulls last, track_id"), sort="playlist_count", descending=True)


@query("select count(*) as total from tracks where normalized_title like '%a%' and track_id in (select track_id from liked)", "tracks", "liked")
def search_count(lib):
    return search.count(lib, search.SearchSpec(title="a", liked=True))


@query("select track_id, string_agg(name, ',' order by position) as artists from track_artists join artists using (artist_id) group by track_id", "track_artists", "artists")
def artists_array(lib):
    return search.artists_in_order(lib).withColumn("artists", F.array_join("artists", ","))


@query("select track_id from tracks where track_id not in (select track_id from features where source = 'api' and is_active and status in ('success', 'partial'))", "tracks", "features")
def missing_source_ids(lib):
    return coverage.missing(lib["tracks"], lib["features"], "api")


@query("select distinct track_id from features where source = 'api' and status = 'failed'", "features")
def failed_source_ids(lib):
    return coverage.failed(lib["features"], "api")


@query("""select source, count(distinct track_id) filter (status = 'success') as success, count(distinct track_id) filter (status = 'partial') as partial, count(distinct track_id) filter (status = 'failed') as failed,
    count(distinct track_id) filter (status = 'not_found') as not_found, round((count(distinct track_id) filter (status = 'success') + count(distinct track_id) filter (status = 'partial'))::double / (select count(*) from tracks) * 100, 2) as coverage_pct,
    greatest(0, (select count(*) from tracks) - count(distinct track_id) filter (status in ('success', 'partial'))) as missing from features where is_active group by source""", "tracks", "features")
def coverage_by_source(lib):
    return coverage.by_source(lib["features"], lib["tracks"].agg(F.count("*").alias("tracks")))


@query("select " + ", ".join(f"count(distinct track_id) filter ({f} is not null) as {f}" for f in ("bpm", "energy", "valence")) + " from features where is_active and status in ('success', 'partial')", "features")
def coverage_fields_onepass(lib):
    return coverage.by_field(lib["features"], ["bpm", "energy", "valence"])


@query("select track_id from tracks where track_id not in (select track_id from features where source = 'api' and is_active and status in ('success', 'partial') and bpm is not null and energy is not null)", "tracks", "features")
def needs_analysis_ids(lib):
    return coverage.needs_analysis(lib["tracks"], lib["features"], "api", ["bpm", "energy"])


@query("""select s.stage, """ + ", ".join(f"count(*) filter (i.status = '{x}') as {x}" for x in jobs.STATUSES) + " from (values " + ", ".join(f"('{x}')" for x in jobs.STAGES) + ") s(stage) left join items i on i.stage = s.stage group by s.stage", "items")
def stage_status_matrix(lib):
    return jobs.stage_matrix(lib["items"])


_DUP_TRACKS = """, d as (select t.*, y.normalized_name as artist from tracks t left join track_artists x on x.track_id = t.track_id and x.position = 0 left join artists y using (artist_id)),
    g as (select 'isrc' as strategy, 1 as rank, isrc as group_key, track_id, duration_ms from d where isrc <> ''
      union all select 'title_artist', 2, normalized_title || '|' || artist, track_id, duration_ms from d where normalized_title <> '' and artist <> ''
      union all select 'title_artist_duration', 3, normalized_title || '|' || artist || '|' || (duration_ms // 3000), track_id, duration_ms from d where normalized_title <> '' and artist <> ''),
    k as (select strategy, rank, group_key, string_agg(track_id::varchar, ',' order by track_id) as track_ids, count(*) as n, max(duration_ms) - min(duration_ms) as spread_ms from g group by all having count(*) > 1)
"""


def _dup_tracks(lib: Library) -> DataFrame:
    first = lib["track_artists"].where("position = 0").join(lib["artists"], "artist_id").select("track_id", F.col("normalized_name").alias("artist"))
    return lib["tracks"].join(first, "track_id", "left")


def _flat_groups(groups: DataFrame) -> DataFrame:
    return groups.select("strategy", "group_key", F.array_join(F.col("track_ids").cast("array<string>"), ",").alias("track_ids"), "spread_ms")


@query(_DUP_TRACKS + "select strategy, group_key, track_ids, spread_ms from k where rank = 1", "tracks", "track_artists", "artists")
def dup_isrc_groups(lib):
    return _flat_groups(duplicates.isrc_groups(_dup_tracks(lib)))


@query(_DUP_TRACKS + "select strategy, group_key, track_ids, spread_ms from k where rank = 3 and spread_ms <= 3000", "tracks", "track_artists", "artists")
def dup_title_artist_bucket(lib):
    return _flat_groups(duplicates.title_artist_groups(_dup_tracks(lib), True))


@query(_DUP_TRACKS + "select strategy, group_key, track_ids, spread_ms from k qualify row_number() over (partition by track_ids order by rank, group_key) = 1", "tracks", "track_artists", "artists")
def dup_all_deduped(lib):
    return _flat_groups(duplicates.all_groups(_dup_tracks(lib)))


@query(_DUP_TRACKS + ", u as (select * from k qualify row_number() over (partition by track_ids order by rank, group_key) = 1) select strategy, count(*) as groups, sum(n)::bigint as tracks from u group by strategy", "tracks", "track_artists", "artists")
def dup_summary(lib):
    return duplicates.summary(duplicates.all_groups(_dup_tracks(lib)))


@query("""select album_id as group_key, normalized_title as fingerprint, count(*) as occurrences, string_agg(distinct track_id::varchar, ',') is not null as any_id, count(distinct track_id) as ids, min(isrc) as isrc from tracks group by all""", "tracks")
def fingerprint_collapse(lib):
    rows = lib["tracks"].select(F.col("album_id").alias("group_key"), F.col("track_id").alias("platform_id"), F.col("normalized_title").alias("fingerprint"), "track_id", "isrc", F.lit(1).alias("occurrences"))
    return duplicates.shown(rows).select("group_key", "fingerprint", "occurrences", F.col("track_ids").isNotNull().alias("any_id"), F.size("track_ids").cast("long").alias("ids"), "isrc")


@query("select track_id, isrc from tracks where isrc is null or isrc = '' union all select min(track_id), isrc from tracks where isrc <> '' group by isrc", "tracks")
def isrc_dedupe(lib):
    return duplicates.first_per_isrc(lib["tracks"]).select("track_id", "isrc")


@query("""select track_id, round(case when sum(quality * match) > 0 then sum(bpm * quality * match) / sum(quality * match) else avg(bpm) end, 6) + 0.0 as bpm, round(case when sum(quality * match) > 0 then sum(loudness * quality * match) / sum(quality * match) else avg(loudness) end, 6) + 0.0 as loudness,
    round(median(centroid::double), 6) + 0.0 as centroid, floor(median(duration_ms::double))::bigint as duration_ms, round(avg(case when key_confidence = 0 then 0.85 else key_confidence end) * avg(quality) * avg(match), 4) as confidence, count(*) as segments from segments group by track_id""", "segments")
def low_level_features(lib):
    rows = aggregate.low_level(lib["segments"])
    return rows.select("track_id", r6("bpm").alias("bpm"), r6("loudness").alias("loudness"), r6("centroid").alias("centroid"), "duration_ms", "confidence", "segments")


@query("""select track_id, key, mode, round(weight / n, 6) + 0.0 as key_confidence from (select track_id, key, mode, sum(case when key_confidence = 0 then 0.5 else key_confidence end * quality * match) as weight, min(segment_id) as first from segments where key is not null group by all)
    join (select track_id, count(*) as n from segments group by track_id) using (track_id) qualify row_number() over (partition by track_id order by round(weight, 9) desc, first) = 1""", "segments")
def key_mode_vote(lib):
    return aggregate.key_votes(lib["segments"]).withColumn("key_confidence", r6("key_confidence"))


@query("select label, place, round(avg(x), 6) + 0.0 as x from (select label, unnest(range(0, len(embedding))) as place, unnest(embedding)::double as x from embeddings) group by all")
def vector_mean(lib):
    rows = aggregate.fixed_vector_mean(lib.raw("embeddings"), "label", "embedding", 64)
    return rows.select("label", F.posexplode("embedding").alias("place", "x")).select("label", F.col("place").cast("long").alias("place"), r6("x").alias("x"))


@query("select label, place, round(avg(x), 6) + 0.0 as x from (select label, unnest(range(0, len(v))) as place, unnest(v)::double as x from (select label, embedding[1 : (vec_id % 64)::int + 1] as v from embeddings)) group by all")
def vector_mean_ragged(lib):
    ragged = lib.raw("embeddings").withColumn("embedding", F.slice("embedding", F.lit(1), (F.col("vec_id") % 64 + 1).cast("int")))
    rows = aggregate.vector_mean(ragged, "label", "embedding")
    return rows.select("label", F.posexplode("embedding").alias("place", "x")).select("label", F.col("place").cast("long").alias("place"), r6("x").alias("x"))


@query("""select track_id, feature, round(value, 6) + 0.0 as value, round(least(1.0, c * used::double / total), 6) + 0.0 as confidence, case when used = total then 'success' else 'partial' end as status
    from (select track_id, 'f' || key as feature, median(key_confidence::double) as value, median(match::double) as c, count(distinct segment_id) as used from segments where quality > 0.8 group by all) join (select track_id, count(distinct segment_id) as total from segments group by all) using (track_id)""", "segments")
def classifier_features(lib):
    s = lib["segments"]
    values = s.where("quality > 0.8").select("track_id", "segment_id", F.concat(F.lit("f"), "key").alias("feature"), F.col("key_confidence").alias("value"), F.col("match").alias("confidence"))
    rows = aggregate.classifiers(values, s)
    return rows.select("track_id", "feature", r6("value").alias("value"), r6("confidence").alias("confidence"), "status")


@query("""select track_id, label, round(score, 6) + 0.0 as score, rank from (select track_id, label, score, row_number() over (partition by track_id order by round(score, 9) desc, label) as rank from (select track_id, 'k' || key as label, median(key_confidence::double) as score from segments group by all)) where rank <= 3""", "segments")
def label_topk_median(lib):
    rows = aggregate.top_labels(lib["segments"].select("track_id", F.concat(F.lit("k"), "key").alias("label"), F.col("key_confidence").alias("score")))
    return rows.select("track_id", "label", r6("score").alias("score"), "rank")


@query("""select f.track_id, 'bpm' as feature, case when v >= 0 then v end as value, case when v >= 0 then c end as confidence, case when v >= 0 then s end as source, case when v is null or v < 0 then 'missing' when c < 0.5 then 'low_confidence' else 'available' end as status
    from (select track_id, coalesce(max(bpm) filter (source = 'api'), max(bpm) filter (source = 'local')) as v, case when max(bpm) filter (source = 'api') is not null then max(coalesce(nullif(confidence, 0), 1)) filter (source = 'api') else max(coalesce(nullif(confidence, 0), 1)) filter (source = 'local') end as c,
      case when max(bpm) filter (source = 'api') is not null then 'api' when max(bpm) filter (source = 'local') is not null then 'local' end as s from features where is_active group by track_id) f""", "features")
def resolve_field_priority(lib):
    return resolve.by_priority(lib["features"].where("is_active"), "bpm", ["api", "local"], "confidence")


@query("select track_id, source, status, status in ('success', 'partial') and row_number() over (partition by track_id order by (status in ('success', 'partial')) desc, priority desc, row_id) = 1 as is_winner from features", "features")
def merge_winner(lib):
    return resolve.merge_winner(lib["features"]).select("track_id", "source", "status", "is_winner")


@query("select track_id, status, row_id from features qualify row_number() over (partition by track_id order by case status when 'success' then 3 when 'partial' then 2 when 'model_missing' then 1 else 0 end desc, row_id desc) = 1", "features")
def status_precedence(lib):
    return resolve.best_status(lib["features"].withColumn("feature", F.lit("all"))).select("track_id", "status", "row_id")


RULE = rules.parse({
    "liked": True, "playlists": [1, 2, 3, 5, 8, 13], "track_ids": [1, 3, 5, 7], "exclude_playlists": [2], "exclude_track_ids": [3],
    "filters": [{"feature": "bpm", "low": 70, "high": 150}, {"feature": "energy", "low": 0.1, "required": True}],
    "weights": {"bpm": 0.5, "energy": 0.3, "valence": 0.2}, "ranges": {"bpm": (60, 160)}, "max_per_artist": 2, "max_per_album": 3, "target_size": 40,
})


def wide_view(lib: Library) -> DataFrame:
    """Resolved features as columns, with artist, album and availability."""
    active = lib["features"].where("is_active")
    rows = lib["tracks"]
    fields = ("bpm", "energy", "valence")
    wide = resolve.wide_by_priority(active, fields, ["api", "local"], "confidence")
    rows = rows.join(wide.select("track_id", *[c for f in fields for c in (F.col(f"{f}.value").alias(f), F.col(f"{f}.status").alias(f"{f}_status"))]), "track_id", "left")
    first = lib["track_artists"].where("position = 0").select("track_id", "artist_id")
    credits = lib["track_artists"].groupBy("track_id").agg(F.collect_set("artist_id").alias("artist_ids"))
    return rows.join(first, "track_id", "left").join(credits, "track_id", "left").withColumn("availability", status.availability(F.col("is_playable"), F.col("market_status")))


def _resolved_sql(f: str, valid: str) -> str:
    return f"""r_{f} as (select track_id, case when {valid} then v end as {f}, case when v is null or not ({valid}) then 'missing' when c < 0.5 then 'low_confidence' else 'available' end as {f}_status from
      (select track_id, coalesce(max({f}) filter (source = 'api'), max({f}) filter (source = 'local')) as v, case when max({f}) filter (source = 'api') is not null then max(coalesce(nullif(confidence, 0), 1)) filter (source = 'api')
        else max(coalesce(nullif(confidence, 0), 1)) filter (source = 'local') end as c from features where is_active group by track_id))"""


_CANDIDATES = """cand as (select track_id from (select track_id from liked where is_current union select track_id from playlist_tracks where is_current and playlist_id in (1, 2, 3, 5, 8, 13) union select unnest([1, 3, 5, 7]))
      where track_id not in (select track_id from playlist_tracks where is_current and playlist_id = 2) and track_id <> 3)"""
_WIDE = f""", {_resolved_sql("bpm", "v >= 0")}, {_resolved_sql("energy", "v between 0 and 1")}, {_resolved_sql("valence", "v between 0 and 1")}, {_CANDIDATES},
    w as (select t.*, x.artist_id, bpm, bpm_status, energy, energy_status, valence, valence_status from tracks t left join r_bpm using (track_id) left join r_energy using (track_id) left join r_valence using (track_id)
      left join track_artists x on x.track_id = t.track_id and x.position = 0),
    why as (select *, list_filter([case when bpm_status is null or bpm_status = 'missing' then null when bpm < 70 then 'BPM_OUT_OF_RANGE' when bpm > 150 then 'BPM_OUT_OF_RANGE' end,
        case when energy_status is null or energy_status = 'missing' then case when energy_status is null then 'FEATURE_MISSING' else 'FEATURE_NOT_AVAILABLE_YET' end when energy_status = 'low_confidence' then 'FEATURE_LOW_CONFIDENCE' when energy < 0.1 then 'ENERGY_OUT_OF_RANGE' end], lambda x: x is not null) as reasons,
      coalesce(bpm_status = 'available', false) as ub, coalesce(energy_status = 'available', false) as ue, coalesce(valence_status = 'available', false) as uv from w),
    sc as (select *, case when ub or ue or uv then greatest(0, least(1, (case when ub then greatest(0, least(1, (bpm - 60) / 100)) * 0.5::double else 0 end + case when ue then energy * 0.3::double else 0 end + case when uv then valence * 0.2::double else 0 end)
      / (case when ub then 0.5::double else 0 end + case when ue then 0.3::double else 0 end + case when uv then 0.2::double else 0 end))) end as score from why)"""
_RULE_VIEWS = ("tracks", "track_artists", "liked", "playlist_tracks", "features")


@query(f", {_CANDIDATES} select track_id from cand", "liked", "playlist_tracks")
def rule_candidates(lib):
    return rules.candidates(RULE, lib["liked"], lib["playlist_tracks"])


@query(_WIDE + " select track_id, array_to_string(reasons, ',') as reasons from sc", *_RULE_VIEWS)
def rule_filter_reasons(lib):
    return wide_view(lib).select("track_id", F.array_join(rules.reasons(RULE), ",").alias("reasons"))


@query(_WIDE + " select track_id, round(score, 6) + 0.0 as score from sc", *_RULE_VIEWS)
def rule_score(lib):
    return wide_view(lib).select("track_id", r6(rules.score(RULE)).alias("score"))


@query(_WIDE + """ select track_id, round(score, 6) + 0.0 as score from (select * from sc where score is not null qualify row_number() over (partition by artist_id order by score desc, track_id) <= 2) order by score desc, track_id limit 40""", *_RULE_VIEWS)
def diversity_one_cap(lib):
    scored = wide_view(lib).withColumn("score", rules.score(RULE)).where("score is not null")
    return rules.one_cap(scored, "artist_id", 2, 40).select("track_id", r6("score").alias("score"))


def _scan_sql(caps: dict[str, int], size: int) -> str:
    """A greedy scan of `o` (n from 1, track_id, artist_id, album_id): the list `ids` of last(ids)."""
    fits = " and ".join(f"(o.{c} is null or len(list_filter({c}s, lambda a: a = o.{c})) < {cap})" for c, cap in caps.items())
    return f"""
    g as (select 0::bigint as n, []::bigint[] as ids, []::bigint[] as artist_ids, []::varchar[] as album_ids
      union all select m, case when fits then list_append(ids, track_id) else ids end, case when fits then list_append(artist_ids, artist_id) else artist_ids end, case when fits then list_append(album_ids, album_id) else album_ids end
      from (select g.ids, g.artist_ids, g.album_ids, o.track_id, o.artist_id, o.album_id, o.n as m, {fits} as fits from g join o on o.n = g.n + 1 where len(ids) < {size})),
    last as (select ids from g order by n desc limit 1)"""


@query(_WIDE + f""", f as (select * from sc where track_id in (select track_id from cand) qualify isrc is null or isrc = '' or row_number() over (partition by isrc order by track_id) = 1),
    o as (select track_id, artist_id, album_id, score, row_number() over (order by score desc, track_id) as n from f where len(reasons) = 0 and score is not null), {_scan_sql({"artist_id": 2, "album_id": 3}, 40)}
    select position::int as position, track_id, round(score, 6) + 0.0 as score from (select unnest(ids) as track_id, generate_subscripts(ids, 1) - 1 as position from last) join o using (track_id)""", *_RULE_VIEWS)
def playlist_end_to_end(lib):
    items, _ = rules.preview(RULE, wide_view(lib), lib["liked"], lib["playlist_tracks"])
    return items.withColumn("score", r6("score"))


ORACLES["playlist_end_to_end"] = ORACLES["playlist_end_to_end"].replace("with", "with recursive", 1)


def liked_snapshots(lib: Library) -> tuple[DataFrame, DataFrame]:
    o = lib.raw("orders").select(F.col("o_orderkey").alias("track_id"), "o_orderdate")
    return o.where("o_orderdate < timestamp_ntz'2000-04-11'").select("track_id"), o.where("o_orderdate >= timestamp_ntz'1997-08-23'").select("track_id")


_BEFORE = "lb as (select o_orderkey as track_id from orders where o_orderdate < timestamp '2000-04-11'), la as (select o_orderkey as track_id from orders where o_orderdate >= timestamp '1997-08-23')"


@query(f"with {_BEFORE} select track_id, 'added' as change from la where track_id not in (select track_id from lb) union all select track_id, 'removed' from lb where track_id not in (select track_id from la)")
def snapshot_liked_diff(lib):
    before, after = liked_snapshots(lib)
    return snapshots.set_diff(before, after)


def playlist_snapshots(lib: Library) -> tuple[DataFrame, DataFrame]:
    p = lib["playlist_tracks"]
    before = p.select("playlist_id", "position", "track_id")
    after = p.where("playlist_id % 10 <> 0").select("playlist_id", "position", F.expr("case when playlist_id % 3 = 0 and position = 0 then null when playlist_id % 7 = 0 and position = 1 then track_id + 1 else track_id end").alias("track_id"))
    return before, after


_ITEMS = ", ib as (select playlist_id, position, track_id from playlist_tracks), ia as (select playlist_id, position, case when playlist_id % 3 = 0 and position = 0 then null when playlist_id % 7 = 0 and position = 1 then track_id + 1 else track_id end as track_id from playlist_tracks where playlist_id % 10 <> 0)"


@query(_ITEMS + " select distinct playlist_id from ib join ia using (playlist_id, position) where ib.track_id is distinct from ia.track_id", "playlist_tracks")
def snapshot_playlist_changed(lib):
    return snapshots.changed_playlists(*playlist_snapshots(lib))


@query(_ITEMS + """, lb as (select track_id from tracks where track_id % 2 = 0), la as (select track_id from tracks where track_id % 3 = 0), ln as (select track_id from tracks where track_id % 11 <> 0),
    d as (select track_id, null::bigint as playlist_id, null::int as position, 'removed' as branch, 0 as turn from lb where track_id not in (select track_id from la) union all select track_id, null, null, 'added', 1 from la where track_id not in (select track_id from lb)
      union all select a.track_id, a.playlist_id, a.position::int, case when a.track_id is null then 'null_item' else 'item' end, 2 from ia a left join ib b using (playlist_id, position) where a.track_id is null or b.playlist_id is null or a.track_id is distinct from b.track_id),
    s as (select d.*, case when branch = 'null_item' then 'null_playlist_track' when d.track_id in (select track_id from lb) and d.track_id not in (select track_id from la) then 'removed_from_liked' when d.track_id in (select track_id from la) and d.track_id not in (select track_id from ln) then 'missing_from_current_import'
      when is_playable = false then 'unavailable' when linked_from is not null then 'possibly_relinked' end as status from d left join tracks t on t.track_id = d.track_id)
    select track_id, playlist_id, position, status from s where status is not null qualify row_number() over (partition by track_id, playlist_id, position order by turn) = 1""", "tracks", "playlist_tracks")
def snapshot_status_first(lib):
    t = lib["tracks"]
    return snapshots.classify(t.where("track_id % 2 = 0"), t.where("track_id % 3 = 0"), *playlist_snapshots(lib), t.where("track_id % 11 <> 0"), t)


@query("select snapshot_id, previous_id from (select user_id as snapshot_id, lead(user_id) over (order by max(ts) desc, user_id desc) as previous_id, row_number() over (order by max(ts) desc, user_id desc) as n from events group by user_id) where n = 1")
def latest_two_snapshots(lib):
    return snapshots.latest_two(lib.raw("events").groupBy(F.col("user_id").alias("snapshot_id")).agg(F.max("ts").alias("created_at")))


@query(f"with {_BEFORE} select coalesce(a.track_id, b.track_id) as track_id, case when b.track_id is null then 'to_add' when a.track_id is null then 'to_remove' else 'unchanged' end as action from (select distinct track_id from lb) a full join (select distinct track_id from la) b on a.track_id = b.track_id")
def sync_three_way(lib):
    before, after = liked_snapshots(lib)
    return snapshots.sync_diff(before, after)


@query("""select source, track_id, code, strftime(failed_at, '%Y-%m-%d %H:%M:%S') as failed_at from (select * from (select 'items' as source, item_id as track_id, stage as code, created_at as failed_at from items where status = 'failed' order by failed_at desc nulls last, track_id limit 300)
    union all select * from (select 'features' as source, track_id, status as code, null::timestamp as failed_at from features where status in ('failed', 'not_found') order by track_id limit 300)) order by failed_at desc nulls last, source, track_id limit 200""", "items", "features")
def failure_feed(lib):
    a = lib["items"].where("status = 'failed'").select(F.lit("items").alias("source"), F.col("item_id").alias("track_id"), F.col("stage").alias("code"), F.col("created_at").alias("at"))
    b = lib["features"].where("status in ('failed', 'not_found')").select(F.lit("features").alias("source"), "track_id", F.col("status").alias("code"), F.lit(None).cast("timestamp_ntz").alias("at"))
    return coverage.failure_feed([a, b], size=200).select("source", "track_id", "code", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("failed_at"))


@query("""select t.job_type, j.job_id, j.item_id from (values ('view'), ('click'), ('purchase'), ('no such type')) t(job_type) left join (select * from items where finished_at is not null qualify row_number() over (partition by job_type order by finished_at desc, job_id desc) = 1) j using (job_type)""", "items")
def latest_job_per_type(lib):
    return jobs.latest_per_type(lib["items"], ("view", "click", "purchase", "no such type")).select("job_type", "job_id", "item_id")


@query("""select *, case when pending > 0 then 'running' when failed > 0 and succeeded > 0 then 'partial' when failed > 0 then 'failed' else 'succeeded' end as status from (select job_id, count(*) as total,
    count(*) filter (status in ('success', 'failed', 'skipped', 'cancelled', 'rate_limited')) as done, count(*) filter (status in ('pending', 'running', 'rate_limited', 'blocked')) as pending, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'success') as succeeded from items group by job_id)""", "items")
def job_progress(lib):
    return jobs.job_progress(lib["items"])


@query("""select job_id, track_id, case when c = 'success' then 'completed' when c in ('failed', 'cancelled') or ((c is null or c in ('skipped', 'pending', 'blocked')) and f) then 'failed' else 'pending' end as progress
    from (select job_id, track_id, max(status) filter (stage = 'cleanup') as c, bool_or(status = 'failed') as f from items group by all)""", "items")
def track_progress(lib):
    return jobs.track_progress(lib["items"])


@query("select a.job_id, count(*) as pairs from items a join items b on a.job_id = b.job_id and a.track_id = b.track_id where a.stage = 'tensorflow' and a.status = 'pending' and b.stage = 'lowlevel' and b.status = 'success' group by a.job_id", "items")
def ready_self_join(lib):
    return jobs.ready(lib["items"], "tensorflow", "lowlevel")


@query("""select b.item_id from items b where b.status = 'blocked' and not exists (select 1 from (select b.item_id - 1 as n union all select b.item_id - 2) p left join items i on i.item_id = p.n where not coalesce(case when i.stage = 'download' then i.status = 'success' else i.status in ('success', 'skipped', 'failed') end, false))""", "items")
def dependency_unblock(lib):
    items = lib["items"]
    return jobs.unblocked(items, items.select("item_id", F.explode(F.array(F.col("item_id") - 1, F.col("item_id") - 2)).alias("needs_id")))


@query("select item_id, priority from items where status = 'pending' order by priority desc, created_at, item_id limit 25", "items")
def queue_head(lib):
    return jobs.queue_head(lib["items"], F.lit("2030-01-01").cast("timestamp_ntz"), 25).select("item_id", "priority")


@query("""select job_id, case when bool_or(stage = 'download' and status = 'rate_limited') then 'DOWNLOAD_RATE_LIMITED' when bool_or(stage = 'download' and status = 'pending') then 'WAITING_FOR_DOWNLOAD' when bool_or(stage = 'lowlevel' and status = 'pending') then 'WAITING_FOR_LOWLEVEL'
    when bool_or(stage = 'tensorflow' and status = 'pending') then 'WAITING_FOR_TENSORFLOW' when bool_or(stage = 'aggregation' and status in ('pending', 'blocked')) then 'WAITING_FOR_AGGREGATION' when bool_or(stage = 'cleanup' and status in ('pending', 'blocked')) then 'WAITING_FOR_CLEANUP' end as hint from items group by job_id""", "items")
def stuck_hint(lib):
    return jobs.stuck_hint(lib["items"])


@query("""select track_id, segment_id, round(least(1, greatest(0, (0.45 * greatest(0, least(1, (loudness + 60) / 60)) + 0.20 * greatest(0, least(1, match / 8))) / 0.65)), 6) + 0.0 as energy, round(0.5 + 0.5 * 2 / 3, 6) as confidence from segments""", "segments")
def energy_proxy(lib):
    value, sure = numeric.energy_proxy(F.col("loudness"), F.lit(None).cast("double"), F.col("match"))
    return lib["segments"].select("track_id", "segment_id", r6(value).alias("energy"), r6(sure).alias("confidence"))


@query("""select vec_id, round(1 / (1 + exp(-x)), 6) as sigmoid, round(case when y between 0 and 1 then y when y between -1.05 and 1.05 then greatest(0, least(1, (y + 1) / 2)) when y > 1 and y <= 9.05 then greatest(0, least(1, (y - 1) / 8)) else 1 / (1 + exp(-y)) end, 6) + 0.0 as unit
    from (select vec_id, embedding[1]::double as x, (vec_id % 25) - 10.5::double as y from embeddings)""")
def sigmoid_unit_map(lib):
    rows = lib.raw("embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), (F.col("vec_id") % 25 - F.lit(10.5)).alias("y"))
    return rows.select("vec_id", r6(numeric.sigmoid(F.col("x"))).alias("sigmoid"), r6(numeric.unit_from_regression(F.col("y"))).alias("unit"))


@query("""select p_partkey, round(least(0.6, case when regexp_matches(x, '(?i)\\blive\\b') then 0.25 else 0 end + case when regexp_matches(x, '(?i)\\bremix\\b') then 0.15 else 0 end + case when regexp_matches(x, '(?i)\\bkaraoke\\b') then 0.40 else 0 end), 6) + 0.0 as penalty
    from (select p_partkey, p_name || case p_partkey % 4 when 0 then ' (Live)' when 1 then ' LIVE remix' when 2 then ' karaoke remix live' else ' alive' end as x from part)""")
def title_penalty(lib):
    x = F.concat("p_name", F.expr("case p_partkey % 4 when 0 then ' (Live)' when 1 then ' LIVE remix' when 2 then ' karaoke remix live' else ' alive' end"))
    return lib.raw("part").select("p_partkey", r6(text.title_penalty(x)).alias("penalty"))


@query("""select event_id, try_cast(props->>'$.k' as double) as k, try_cast(props->>'$.none' as double) as none from events""")
def json_payload_extract(lib):
    return lib.raw("events").select("event_id", status.json_number(F.col("props"), "$.k").alias("k"), status.json_number(F.col("props"), "$.none").alias("none"))


@query("select track_id, case when is_playable is null then market_status when is_playable then 'available' else 'unavailable' end as availability from tracks", "tracks")
def market_status_case(lib):
    return lib["tracks"].select("track_id", status.availability(F.col("is_playable"), F.col("market_status")).alias("availability"))


@query("""select track_id, segment, case when d < 2.5 * s then round((d - s) / 2, 3) else round(least(d * z, d - s), 3) end + 0.0 as start_s, round(s, 3) + 0.0 as length_s
    from (select track_id, duration_ms / 1000.0::double as d, least(15.0::double, duration_ms / 1000.0::double) as s from tracks), (values ('A', 0.10::double), ('B', 0.45::double), ('C', 0.70::double)) v(segment, z) where d > 0 and (d >= 2.5 * s or segment = 'A')""", "tracks")
def segment_plan_explode(lib):
    from crateflow.sources.ingest import plan_segments

    rows = plan_segments(lib["tracks"].select("track_id", (F.col("duration_ms") / 1000).alias("duration_s")))
    return rows.select("track_id", "segment", (F.col("start_s") + 0.0).alias("start_s"), (F.col("length_s") + 0.0).alias("length_s"))


@query("""select coalesce(o.k, n.k) as track_id, case when n.k is not null then n.data else o.data end as data, n.k is not null as is_current from (select track_id as k, name as data from tracks where track_id % 3 <> 0) o full join (select track_id as k, upper(name) as data from tracks where track_id % 2 = 0) n on o.k = n.k""", "tracks")
def full_refresh_merge(lib):
    t, now = lib["tracks"], F.lit("2024-01-01").cast("timestamp_ntz")
    old = t.where("track_id % 3 <> 0").select("track_id", F.col("name").alias("data"), F.lit(True).alias("is_current"), now.alias("first_seen"), now.alias("last_seen"))
    return upserts.full_refresh(old, t.where("track_id % 2 = 0").select("track_id", F.upper("name").alias("data")), "track_id", now).select("track_id", "data", "is_current")


@query("""select o.track_id, o.source, case when n.track_id is not null and not (o.status in ('success', 'partial') or o.status in ('failed', 'not_found')) then n.status else o.status end as status from features o left join (select track_id, source, 'success' as status from features where track_id % 2 = 0) n using (track_id, source)""", "features")
def feature_upsert_keep(lib):
    f = lib["features"].select("track_id", "source", "status")
    return upserts.upsert_features(f, f.where("track_id % 2 = 0").withColumn("status", F.lit("success")))


@query("select event_type as stage, round((max_by(k, ts) - min_by(k, ts)) / (date_diff('second', min(ts), max(ts)) / 60.0::double), 6) + 0.0 as per_minute from (select event_type, ts, event_id as k from events) group by 1")
def stage_rate_window(lib):
    rows = lib.raw("events").select(F.col("event_type").alias("stage"), F.col("ts").alias("at"), F.col("event_id").alias("done"))
    return aggregate.throughput(rows).select("stage", r6("per_minute").alias("per_minute"))


@query("select (select count(*) from tracks) as tracks, (select count(*) from playlists) as playlists, (select count(*) from albums) as albums", "tracks", "playlists", "albums")
def library_summary(lib):
    return lists.library_summary(lib["tracks"], lib["playlists"], lib["albums"])


@query("select track_id, string_agg(playlist_id::varchar, ',' order by name, playlist_id) as playlist_ids from (select distinct track_id, playlist_id, name from playlist_tracks join playlists using (playlist_id) where is_current) group by track_id", "playlist_tracks", "playlists")
def playlists_of_tracks(lib):
    return lists.playlists_of_tracks(lib["playlist_tracks"], lib["playlists"]).select("track_id", F.array_join(F.col("playlist_ids").cast("array<string>"), ",").alias("playlist_ids"))


@query("select t.track_id, t.name, t.isrc, coalesce(min_by(a.name, position), 'Unknown') as artist from tracks t left join track_artists x using (track_id) left join artists a using (artist_id) group by all", "tracks", "track_artists", "artists")
def track_context(lib):
    return lists.track_context(lib["tracks"], lib["track_artists"], lib["artists"])


@query("select track_id, case when bool_or(status in ('success', 'partial')) then 'success' when bool_or(status = 'model_missing') then 'model_missing' else 'missing' end as status from features group by track_id", "features")
def status_rollup(lib):
    return lists.status_rollup(lib["features"])


@query("select item_id, stage, status from items where status not in ('success', 'failed', 'skipped', 'cancelled') order by stage, status, item_id limit 50", "items")
def open_items(lib):
    return lists.open_items(lib["items"]).select("item_id", "stage", "status")


@query("""select t.track_id, coalesce(a.status, 'missing') as api, case when l.status = 'failed' then 'failed' when l.status in ('success', 'partial') and v.track_id is not null then 'success' when l.status in ('success', 'partial') or v.track_id is not null then 'partial' else 'missing' end as local_analysis, t.track_id % 2 = 0 as preview_available
    from tracks t left join (select * from features where is_active and source = 'api') a using (track_id) left join (select * from features where is_active and source = 'local') l using (track_id) left join (select distinct track_id from segments where quality > 0.9 and match > 0.93 and key = 1) v using (track_id)""", "tracks", "features", "segments")
def feature_status(lib):
    t = lib["tracks"]
    previews = t.select("track_id", F.lit("available").alias("status"), F.lit("u").alias("url"), F.when(F.col("track_id") % 2 == 0, 0.9).otherwise(0.1).alias("confidence"))
    advanced = lib["segments"].where("quality > 0.9 and match > 0.93 and key = 1").select("track_id", F.lit("success").alias("status"))
    return lists.feature_status(t, lib["features"], advanced, previews)


@query("""select track_id, candidate_id, score from (select t.track_id, c.track_id as candidate_id, round(greatest(0, least(1, 0.45::double * (t.normalized_title = c.normalized_title)::int::double + 0.35::double + 0.20::double * case when abs(t.duration_ms - c.duration_ms) <= 3000 then 1.0::double
    when abs(t.duration_ms - c.duration_ms) <= 10000 then 0.85::double when abs(t.duration_ms - c.duration_ms) <= 30000 then 0.6::double else greatest(0, 1 - abs(t.duration_ms - c.duration_ms) / t.duration_ms::double) end + case when upper(t.isrc) = upper(c.isrc) then 0.35::double else 0 end)), 4) as s0, case when upper(t.isrc) = upper(c.isrc) then 1.0::double else s0 end as score,
    coalesce(upper(t.isrc) = upper(c.isrc), false) as exact from tracks t join tracks c on t.album_id = c.album_id and t.track_id <> c.track_id) qualify row_number() over (partition by track_id order by exact desc, score desc, candidate_id) = 1""", "tracks")
def preview_best_match(lib):
    """The best match of every track among the others of its album."""
    title = F.regexp_replace("normalized_title", r"[^\p{L}\p{N}]", "")
    rows = lib["tracks"].select("track_id", F.col("album_id").alias("grp"), title.alias("title"), "duration_ms", "isrc")
    return matching.best_in_group(rows).select("track_id", F.col("ordinal").alias("candidate_id"), "score")


def preview_best_match_all(spark, sf_dir):
    """preview_best_match without SQL, for tables on which all pairs of an album are too many for it. Tested against all pairs."""
    return QUERIES["preview_best_match"](spark, sf_dir)


QUERIES["preview_best_match_all"] = preview_best_match_all


@query("select track_id from tracks where track_id not in (select track_id from liked) order by track_id limit 40", "tracks", "liked")
def work_selection(lib):
    return work.select_missing(lib["tracks"], lib["liked"], 40)


@query("select job_id, arg_max(item_id, (created_at, item_id)) as item_id from items group by job_id", "items")
def worker_heartbeats(lib):
    beats = lib["items"].select(F.col("job_id").alias("worker_id"), F.col("created_at").alias("last_seen_at"), "item_id")
    return jobs.heartbeats(beats, "item_id").select(F.col("worker_id").alias("job_id"), "item_id")


@query("""
    , cand as (select t.track_id, t.popularity::double as score, case when t.track_id % 9 <> 0 then x.artist_id end as artist_id, case when t.track_id % 11 <> 0 then split_part(t.album_id, '|', 1) end as album_id
      from tracks t left join track_artists x on x.track_id = t.track_id and x.position = 0),
    o as (select *, row_number() over (order by score desc, track_id) as n from cand),
    g as (select 0::bigint as n, []::bigint[] as ids, []::bigint[] as artists, []::varchar[] as albums
      union all select o.n, case when fits then list_append(ids, o.track_id) else ids end, case when fits then list_append(artists, o.artist_id) else artists end, case when fits then list_append(albums, o.album_id) else albums end
      from (select g.*, o.track_id, o.artist_id, o.album_id, o.n as m, (o.artist_id is null or len(list_filter(artists, lambda a: a = o.artist_id)) < 2) and (o.album_id is null or len(list_filter(albums, lambda a: a = o.album_id)) < 3) as fits
        from g join o on o.n = g.n + 1 where len(ids) < 90) as o(n0, ids, artists, albums, track_id, artist_id, album_id, n, fits)),
    last as (select ids from g order by n desc limit 1)
    select unnest(ids) as track_id, (generate_subscripts(ids, 1) - 1)::int as position from last""", "tracks", "track_artists")
def diversity_two_caps(lib):
    """Two artists' and three albums' tracks at most, those without an artist or album uncapped."""
    first = lib["track_artists"].where("position = 0").select(F.col("track_id").alias("t"), "artist_id")
    rows = lib["tracks"].join(first, F.col("track_id") == F.col("t"), "left")
    scored = rows.select("track_id", F.col("popularity").cast("double").alias("score"), F.when(F.col("track_id") % 9 != 0, F.col("artist_id")).alias("artist_id"), F.when(F.col("track_id") % 11 != 0, F.element_at(F.split("album_id", r"\|"), 1)).alias("album_id"))
    rule = rules.Rule(max_per_artist=2, max_per_album=3, target_size=90)
    return rules.arranged(rules.diversify(scored, rule), rule).select("track_id", "position")


ORACLES["diversity_two_caps"] = ORACLES["diversity_two_caps"].replace("with", "with recursive", 1)

from crateflow.plans import further, lookups, states, streams  # noqa: E402, F401  (register their queries here)
