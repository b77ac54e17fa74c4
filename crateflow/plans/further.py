"""Queries for lists, headers, payloads and orders that the other modules of plans leave open. Each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from crateflow.functions import text
from crateflow.operators import coverage, duplicates, gating, lists, matching, resolve, rules, snapshots, work
from crateflow.plans.catalogue import _BEFORE, _DUP_TRACKS, _RULE_VIEWS, _WIDE, ORACLES, _dup_tracks, liked_snapshots, playlist_snapshots, query, r6, wide_view
from crateflow.sources import export
from crateflow.sources.tables import fresh_path


@query("""with d as (select job_id, track_id, item_id as segment_id, status from (select *, row_number() over () from items where stage = 'download' and item_id % 2 = 0)),
    s as (select job_id, track_id, segment_id from d where status = 'success'), o as (select distinct job_id, track_id from d where (job_id, track_id) not in (select (job_id, track_id) from s))
    select * from s union all select o.job_id, o.track_id, f.segment_id from o join (select track_id, item_id as segment_id, 'x/' || job_id || '-' || item_id as path from items where item_id % 3 = 0 and item_id < 3000) f using (track_id) where contains(f.path, o.job_id::varchar)""".replace("with d as", ", d as", 1), "items")
def segment_ids_of_jobs(lib):
    """Successful downloads, and for tracks without one the segments whose path names the job."""
    i = lib["items"]
    downloads = i.where("stage = 'download' and item_id % 2 = 0").select("job_id", "track_id", F.col("item_id").alias("segment_id"), "status")
    files = i.where("item_id % 3 = 0 and item_id < 3000").select("track_id", F.col("item_id").alias("segment_id"), F.concat(F.lit("x/"), F.col("job_id"), F.lit("-"), F.col("item_id")).alias("path"))
    return lists.segments_of_job(downloads, files)


@query(f"""select s.status, count(c.status) as n from (values ('removed_from_liked'), ('missing_from_current_import'), ('unavailable'), ('possibly_relinked'), ('null_playlist_track')) s(status)
    left join ({ORACLES["snapshot_status_first"]}) c on c.status = s.status group by s.status""")
def snapshot_status_totals(lib):
    t = lib["tracks"]
    return snapshots.status_counts(snapshots.classify(t.where("track_id % 2 = 0"), t.where("track_id % 3 = 0"), *playlist_snapshots(lib), t.where("track_id % 11 <> 0"), t))


@query("select track_id, item_id as download_id, status from items where stage = 'download' qualify row_number() over (partition by track_id order by created_at desc, item_id desc) = 1", "items")
def latest_downloads(lib):
    rows = lib["items"].where("stage = 'download'").select("track_id", F.col("item_id").alias("download_id"), "status", "created_at")
    return work.latest(rows, ["track_id"], F.desc("created_at"), F.desc("download_id")).select("track_id", "download_id", "status")


@query("select track_id from tracks where track_id % 3 = 0 and track_id % 4 > 0", "tracks")
def analysis_previews(lib):
    """For analysis a preview needs a url and no confidence."""
    n = F.col("track_id")
    rows = lib["tracks"].select("track_id", F.when(n % 3 == 0, "available").otherwise("failed").alias("status"), F.when(n % 4 == 1, "u").when(n % 4 > 1, "v").otherwise("").alias("url"), F.lit(0.0).alias("confidence"))
    return lists.usable_previews(rows, for_display=False).select("track_id")


@query("select distinct track_id from features where source = 'api' and status in ('failed', 'not_found') order by track_id limit 200", "features")
def ids_with_status(lib):
    return coverage.ordered_ids(lib["features"].where("source = 'api' and status in ('failed', 'not_found')"), 200)


@query(""", m as (select popularity as group_key, market_status as platform_id, min(track_id % 3) as fingerprint, count(*) as occurrences, min(isrc) as isrc from tracks group by all),
    c as (select group_key, fingerprint, sum(occurrences)::bigint as occurrences, min(isrc) as isrc from m group by all)
    select group_key, sum(occurrences)::bigint as occurrences, count(*) as uniques, min(isrc) as isrc, count(*) = 1 and sum(occurrences) > 1 as is_repeated from c group by group_key""", "tracks")
def duplicate_headers(lib):
    members = lib["tracks"].select(F.col("popularity").alias("group_key"), F.col("market_status").alias("platform_id"), (F.col("track_id") % 3).alias("fingerprint"), "track_id", "isrc", F.lit(1).alias("occurrences"))
    return duplicates.headers(duplicates.shown(members))


@query(_DUP_TRACKS + """select strategy, group_key, n from (select *, case rank when 1 then 1.0 else 0.85 end as confidence from k qualify row_number() over (partition by track_ids order by rank, group_key) = 1)
    order by confidence desc, strategy, group_key limit 20 offset 20""", "tracks", "track_artists", "artists")
def duplicate_page(lib):
    groups = duplicates.page(duplicates.all_groups(_dup_tracks(lib)), 2)
    return groups.select("strategy", "group_key", F.size("track_ids").cast("long").alias("n"))


@query("""select event_id, lower(trim(regexp_replace('  A  ' || upper(event_type) || chr(9) || 'b ', '[ \\t]+', ' ', 'g'))) as blanks, case when event_id % 5 = 0 then '' else strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') end as written,
    strftime(date_trunc('second', ts) - interval 2 hour, '%Y-%m-%d %H:%M:%S') as read, case when event_type = 'click' then 'A click' else upper(event_type[1]) || event_type[2:] || ' Kind' end as label, event_id % 3 > 0 as named from events""")
def names_and_times(lib):
    e = lib.raw("events")
    odd = F.concat(F.lit("  A  "), F.upper("event_type"), F.lit("\tb "))
    stamp = F.concat(text.iso(F.col("ts")), F.lit("+02:00"))
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.col("event_type"), F.lit("\x07"))).otherwise(F.col("event_type"))
    labels = text.label_of(F.concat(F.col("event_type"), F.lit("_kind")), {"click_kind": "A click"})
    return e.select(
        "event_id", text.normalize_blanks(odd).alias("blanks"), text.iso(F.when(F.col("event_id") % 5 != 0, F.col("ts"))).alias("written"),
        F.date_format(text.from_iso(stamp), "yyyy-MM-dd HH:mm:ss").alias("read"), labels.alias("label"), text.valid_name(name).alias("named"),
    )


@query("""select track_id, source, case when status = 'failed' then 'model_missing' when energy is null then 'missing' when status = 'partial' or confidence < 0.5 then 'low_confidence' else 'available' end as shown from features""", "features")
def long_form_values(lib):
    status = F.when(F.col("status") == "failed", "model_missing").otherwise(F.col("status"))
    return lib["features"].select("track_id", "source", resolve.long_form_status(status, F.col("energy"), F.col("confidence")).alias("shown"))


@query("""select track_id, array_to_string(list_sort(list_distinct(list_filter(['m' || track_id % 3, 'm' || track_id % 5, case when track_id % 4 = 0 then 'genre' end], lambda x: x is not null and not (x = 'genre' and track_id % 8 = 0)))), ',') as missing,
    case when status = 'not_found' then 'model_missing' else 'FAILED' end as code from tracks join (select track_id, status from features where source = 'api') using (track_id)""", "tracks", "features")
def segment_payloads(lib):
    """Missing models of two runs united; the genre model isn't missing where its labels are there."""
    n = F.col("track_id")
    one = lambda m: F.array(F.concat(F.lit("m"), (n % m).cast("string")))
    genre = F.when(n % 4 == 0, F.array(F.lit("genre")))
    labels = F.when(n % 8 == 0, F.array(F.lit("Techno")))
    status = F.when(F.col("status") == "not_found", "model_missing").otherwise(F.col("status"))
    rows = lib["tracks"].join(lib["features"].where("source = 'api'").select("track_id", "status"), "track_id")
    missing = gating.missing_models([one(3), one(5), genre], F.lit("genre"), labels)
    return rows.select("track_id", F.array_join(F.array_sort(missing), ",").alias("missing"), gating.failure_code(status, "FAILED").alias("code"))


@query("""select track_id, place, case when track_id % 5 = 3 then 'x' || track_id when place = 0 then 'a' || track_id else 'b' || track_id end as id from tracks, (values (0), (1)) p(place) where (track_id % 5 < 3 or (track_id % 5 = 3 and place = 0))""", "tracks")
def answered_items(lib):
    """Payloads that are a list, hold one under either name, are the item themselves, or are malformed; a number in a list is no item."""
    n = F.col("track_id").cast("string")
    pair = F.concat(F.lit('[{"id": "a'), n, F.lit('"}, {"id": "b'), n, F.lit('"}, 7]'))
    way = F.col("track_id") % 5
    payload = F.when(way == 0, pair).when(way == 1, F.concat(F.lit('{"content": '), pair, F.lit("}"))).when(way == 2, F.concat(F.lit('{"content": 3, "audioFeatures": '), pair, F.lit("}"))).when(way == 3, F.concat(F.lit('{"id": "x'), n, F.lit('"}'))).otherwise(F.lit("{bad"))
    return matching.payload_items(lib["tracks"].select("track_id", payload.alias("payload"))).select("track_id", "place", F.get_json_object("item", "$.id").alias("id"))


_CHOSEN = """, c as (select t.track_id, t.popularity::double as score, case when t.track_id % 9 <> 0 then x.artist_id end as artist_id, a.normalized_name as name from tracks t left join track_artists x on x.track_id = t.track_id and x.position = 0 left join artists a using (artist_id)
      order by score desc, t.track_id limit 60)"""


def _chosen(lib):
    first = lib["track_artists"].where("position = 0").join(lib["artists"], "artist_id").select("track_id", "artist_id", F.col("normalized_name").alias("artist_name"))
    rows = lib["tracks"].join(first, "track_id", "left").select("track_id", F.col("popularity").cast("double").alias("score"), F.when(F.col("track_id") % 9 != 0, F.col("artist_id")).alias("artist_id"), "artist_name")
    return rows.orderBy(F.desc("score"), "track_id").limit(60)


@query(_CHOSEN + """, r as (select [{'t': 0::bigint, 'a': null::bigint}][2:] as done, list({'t': track_id, 'a': artist_id} order by score desc, track_id) as left_ from c),
    g as (select done, left_, 0 as n from r union all select list_append(done, x), list_filter(left_, lambda y: y.t <> x.t), n + 1 from
      (select *, coalesce(list_filter(left_, lambda y: len(done) = 0 or y.a is null or done[-1].a is null or y.a <> done[-1].a)[1], left_[1]) as x from g where len(left_) > 0))
    select unnest(done).t as track_id, (generate_subscripts(done, 1) - 1)::int as position from (select done from g order by n desc limit 1)""", "tracks", "track_artists", "artists")
def spread_playlist(lib):
    """Sixty tracks in the order in which no artist follows itself where that can be."""
    return rules.arranged(_chosen(lib), rules.Rule(spread_artists=True, ordering="artist_spread")).select("track_id", "position")


ORACLES["spread_playlist"] = ORACLES["spread_playlist"].replace("with", "with recursive", 1)


@query(_CHOSEN + " select track_id, (row_number() over (order by coalesce(name, ''), score desc, track_id) - 1)::int as position from c", "tracks", "track_artists", "artists")
def grouped_playlist(lib):
    return rules.arranged(_chosen(lib), rules.Rule(ordering="artist_grouped")).select("track_id", "position")


@query(_CHOSEN + " select track_id, (row_number() over (order by score, track_id) - 1)::int as position, round(score, 6) as score from c", "tracks", "track_artists", "artists")
def rising_playlist(lib):
    return rules.arranged(_chosen(lib), rules.Rule(ordering="score_asc")).select("track_id", "position", r6("score").alias("score"))


@query("select count(*) as ids, count(distinct track_id) as unique_ids, min(n)::bigint > 0 as none_empty, max(n)::bigint as largest from (select track_id, 40 as n from tracks)", "tracks")
def lookup_batches(lib):
    """Every id in one batch of forty at most."""
    batches = matching.request_batches(lib["tracks"].select(F.col("track_id").cast("string").alias("request_id")))
    sized = batches.select(F.size("request_ids").cast("long").alias("n"), F.explode("request_ids").alias("id"))
    return sized.agg(F.count("*").alias("ids"), F.count_distinct("id").alias("unique_ids"), (F.min("n") > 0).alias("none_empty"), F.max("n").alias("largest"))


@query("""select track_id, feature, case when feature = 'later' then 'not_available_yet' else 'missing' end as status from (select track_id, unnest(['bpm', 'later', 'other']) as feature from tracks where track_id % 4 = 0)
    where not (feature = 'bpm' and track_id in (select track_id from features where is_active))""", "tracks", "features")
def unresolved_features(lib):
    """Features that nothing resolves: one of a later phase, one that nobody knows, and bpm where a track has no row."""
    wanted = lib["tracks"].where("track_id % 4 = 0").select("track_id", F.explode(F.array(*map(F.lit, ("bpm", "later", "other")))).alias("feature"))
    found = lib["features"].where("is_active").select("track_id", F.lit("bpm").alias("feature")).distinct()
    return resolve.unresolved(wanted, {"bpm": 1, "later": 7}, found)


@query("select label, place::int as place, round(x, 6) + 0.0 as x from (select label, generate_subscripts(v, 1) - 1 as place, unnest(v)::double as x from (select label, embedding[1:8] as v from embeddings where vec_id % 3 > 0 qualify row_number() over (partition by label order by vec_id) = 1))")
def timbre_vectors(lib):
    """The head of the first usable vector of each label."""
    rows = lib.raw("embeddings").select(F.col("label").alias("track_id"), F.col("vec_id").alias("row_id"), F.when(F.col("vec_id") % 3 == 0, "failed").otherwise("success").alias("status"), "embedding")
    first = resolve.first_usable_embedding(rows).select(F.col("track_id").alias("label"), F.posexplode(resolve.timbre(F.col("embedding"), 8)).alias("place", "x"))
    return first.select("label", "place", r6("x").alias("x"))


@query(_WIDE + """ select track_id, round(case when ub or ue or uv then case when ue or uv then greatest(0, least(1, (case when ue then energy * 0.3::double else 0 end + case when uv then valence * 0.2::double else 0 end)
      / (case when ue then 0.3::double else 0 end + case when uv then 0.2::double else 0 end))) else 0 end end, 6) + 0.0 as score from why""", *_RULE_VIEWS)
def overridden_scores(lib):
    """The rule with one component's weight taken away."""
    document = {"liked": True, "weights": {"bpm": 0.5, "energy": 0.3, "valence": 0.2}, "ranges": {"bpm": (60, 160)}}
    rule = rules.parse(rules.override(document, {"weights": {"bpm": 0.0, "energy": 0.3, "valence": 0.2}}))
    return wide_view(lib).select("track_id", r6(rules.score(rule)).alias("score"))


@query(f"with {_BEFORE} select track_id, 'added' as change from la where track_id not in (select track_id from lb) union all select track_id, 'removed' from lb where track_id not in (select track_id from la)")
def exported_diff(lib):
    """A diff as JSON lines, written and read back."""
    path = fresh_path(lib.spark)
    export.write_json(snapshots.set_diff(*liked_snapshots(lib)), path)
    return lib.spark.read.schema("track_id long, change string").json(path)


@query("""select track_id, verdict, verdict in ('mismatch', 'low_confidence_fuzzy') as needs_remedy from (select track_id, case when isrc is null then 'isrc_unresolvable' when track_id % 5 = 0 then 'mismatch' when track_id % 2 = 1 and (track_id % 10) / 10.0 < 0.6 then 'low_confidence_fuzzy' else 'ok' end as verdict from tracks)""", "tracks")
def exported_audit(lib):
    """Verdicts on previews as CSV, written and read back."""
    n = F.col("track_id")
    rows = lib["tracks"].select("track_id", F.col("isrc").isNull().alias("isrc_unresolvable"), (n % 5 == 0).alias("mismatch"), (n % 2 == 1).alias("fuzzy"), (n % 10 / 10.0).alias("confidence"))
    path = fresh_path(lib.spark)
    export.write_csv(matching.audited(rows).select("track_id", "verdict", "needs_remedy"), path)
    return lib.spark.read.option("header", True).schema("track_id long, verdict string, needs_remedy boolean").csv(path)
