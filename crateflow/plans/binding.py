"""The driver's tables seen as a music library: each view once as a DataFrame and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Library:
    """Lazy views over one directory of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)()

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def tracks(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("track_id"), F.col("p_name").alias("name"), F.lower("p_name").alias("normalized_title"), (F.col("p_size") * 6000).cast("long").alias("duration_ms"),
            (F.col("p_partkey") % 101).alias("popularity"), F.concat_ws("|", "p_brand", "p_type").alias("album_id"),
            F.when(F.col("p_partkey") % 7 != 0, F.concat_ws("-", "p_brand", "p_size", "p_type")).alias("isrc"),
            F.expr("element_at(array('available', 'restricted', 'unavailable', null), cast(p_partkey % 4 as int) + 1)").alias("market_status"),
            F.expr("case p_partkey % 3 when 0 then true when 1 then false end").alias("is_playable"), F.expr("if(p_partkey % 13 = 0, p_partkey + 1, null)").alias("linked_from"),
        )

    def albums(self) -> DataFrame:
        return self.raw("part").select(F.concat_ws("|", "p_brand", "p_type").alias("album_id")).distinct().select("album_id", F.col("album_id").alias("name"), F.lower("album_id").alias("normalized_name"))

    def artists(self) -> DataFrame:
        return self.raw("supplier").select(F.col("s_suppkey").alias("artist_id"), F.col("s_name").alias("name"), F.lower("s_name").alias("normalized_name"))

    def track_artists(self) -> DataFrame:
        pairs = self.raw("lineitem").select(F.col("l_partkey").alias("track_id"), F.col("l_suppkey").alias("artist_id")).distinct()
        return pairs.withColumn("position", F.row_number().over(Window.partitionBy("track_id").orderBy("artist_id")) - 1)

    def liked(self) -> DataFrame:
        lines = self.raw("lineitem").where("l_partkey % 2 = 0").groupBy("l_partkey").agg(F.max("l_shipdate").alias("added_at"))
        return lines.select(F.col("l_partkey").alias("track_id"), "added_at", (F.col("l_partkey") % 3 != 0).alias("is_current"))

    def playlists(self) -> DataFrame:
        return self.raw("orders").select(F.col("o_orderkey").alias("playlist_id"), F.col("o_orderpriority").alias("name"))

    def playlist_tracks(self) -> DataFrame:
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
        return self.raw("lineitem").select(F.col("l_orderkey").alias("playlist_id"), F.col("l_partkey").alias("track_id"), (F.row_number().over(order) - 1).alias("position"), (F.col("l_returnflag") != "R").alias("is_current"))

    def segments(self) -> DataFrame:
        order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax")
        return self.raw("lineitem").select(
            F.col("l_partkey").alias("track_id"), F.row_number().over(order).alias("segment_id"), (60 + 2 * F.col("l_quantity")).alias("bpm"), (-60 + 600 * F.col("l_discount")).alias("loudness"),
            (F.col("l_linenumber") % 12).alias("key"), F.expr("int(l_linestatus = 'O')").alias("mode"), (1 - F.col("l_discount")).alias("key_confidence"), F.lit(None).cast("double").alias("bpm_confidence"),
            F.expr("case l_returnflag when 'R' then 0.95D when 'A' then 1.0D else 0.70D end").alias("quality"), (1 - F.col("l_tax")).alias("match"),
            (F.col("l_extendedprice") / 10).alias("centroid"), (F.col("l_quantity") * 1000).cast("long").alias("duration_ms"),
        )

    def features(self) -> DataFrame:
        """Rows of the two sources: one from the part itself, one from its lines."""
        own = self.raw("part").where("p_partkey % 5 <> 4").select(
            F.col("p_partkey").alias("track_id"), F.lit("api").alias("source"), F.lit(60).alias("priority"), (F.col("p_partkey") * 2).alias("row_id"),
            F.expr("element_at(array('success', 'partial', 'failed', 'not_found'), cast(p_partkey % 5 as int) + 1)").alias("status"),
            F.expr("if(p_partkey % 5 < 2, 60 + p_size * 2.0D, null)").alias("bpm"), F.expr("if(p_partkey % 5 = 0, p_size / 50.0D, null)").alias("energy"),
            F.expr("if(p_partkey % 5 < 2, (p_partkey % 100) / 100.0D, null)").alias("valence"), F.expr("(p_partkey % 10) / 10.0D").alias("confidence"), F.lit(True).alias("is_active"),
        )
        lines = self.raw("lineitem").groupBy("l_partkey").agg(F.max("l_quantity").alias("q"), F.max(F.expr("cast(round(l_discount * 100) as int)")).alias("d"))
        local = lines.where("l_partkey % 4 <> 3").select(
            F.col("l_partkey").alias("track_id"), F.lit("local").alias("source"), F.lit(40).alias("priority"), (F.col("l_partkey") * 2 + 1).alias("row_id"),
            F.expr("if(l_partkey % 4 = 0, 'success', 'partial')").alias("status"), (60 + 2 * F.col("q")).cast("double").alias("bpm"), (F.col("d") / F.lit(10.0)).alias("energy"),
            F.lit(None).cast("double").alias("valence"), F.lit(0.8).alias("confidence"), (F.col("l_partkey") % 6 != 5).alias("is_active"),
        )
        return own.unionByName(local)

    def items(self) -> DataFrame:
        """Job items out of the events: five stages, a status by the number in props."""
        k = F.get_json_object("props", "$.k").cast("int")
        stages = "element_at(array('download', 'lowlevel', 'tensorflow', 'aggregation', 'cleanup'), cast(event_id % 5 as int) + 1)"
        return self.raw("events").select(
            F.col("event_id").alias("item_id"), F.col("user_id").alias("job_id"), (F.col("event_id") % 17).alias("track_id"), F.expr(stages).alias("stage"), (k % 3).alias("priority"), F.col("ts").alias("created_at"),
            F.element_at(F.array(*[F.lit(s) for s in ("success", "failed", "pending", "skipped", "blocked")]), k % 5 + 1).alias("status"), F.col("event_type").alias("job_type"),
            F.lit(None).cast("string").alias("locked_by"), F.lit(None).cast("timestamp_ntz").alias("next_retry_at"), F.when(k % 5 < 2, F.col("ts")).alias("finished_at"),
        )


#: The same views as SQL, each with the views that it reads.
SQL: dict[str, tuple[str, tuple[str, ...]]] = {
    "tracks": ("""select p_partkey as track_id, p_name as name, lower(p_name) as normalized_title, (p_size * 6000)::bigint as duration_ms, p_partkey % 101 as popularity, p_brand || '|' || p_type as album_id,
        case when p_partkey % 7 <> 0 then p_brand || '-' || p_size || '-' || p_type end as isrc, case p_partkey % 4 when 0 then 'available' when 1 then 'restricted' when 2 then 'unavailable' end as market_status,
        case p_partkey % 3 when 0 then true when 1 then false end as is_playable, case when p_partkey % 13 = 0 then p_partkey + 1 end as linked_from from part""", ()),
    "albums": ("select distinct p_brand || '|' || p_type as album_id, p_brand || '|' || p_type as name, lower(p_brand || '|' || p_type) as normalized_name from part", ()),
    "artists": ("select s_suppkey as artist_id, s_name as name, lower(s_name) as normalized_name from supplier", ()),
    "track_artists": ("select track_id, artist_id, row_number() over (partition by track_id order by artist_id) - 1 as position from (select distinct l_partkey as track_id, l_suppkey as artist_id from lineitem)", ()),
    "liked": ("select l_partkey as track_id, max(l_shipdate) as added_at, l_partkey % 3 <> 0 as is_current from lineitem where l_partkey % 2 = 0 group by l_partkey", ()),
    "playlists": ("select o_orderkey as playlist_id, o_orderpriority as name from orders", ()),
    "playlist_tracks": ("select l_orderkey as playlist_id, l_partkey as track_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as position, l_returnflag <> 'R' as is_current from lineitem", ()),
    "segments": ("""select l_partkey as track_id, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) as segment_id, 60 + 2 * l_quantity as bpm,
        -60 + 600 * l_discount as loudness, l_linenumber % 12 as key, (l_linestatus = 'O')::int as mode, 1 - l_discount as key_confidence, case l_returnflag when 'R' then 0.95::double when 'A' then 1.0::double else 0.70::double end as quality,
        1 - l_tax as match, l_extendedprice / 10 as centroid, (l_quantity * 1000)::bigint as duration_ms from lineitem""", ()),
    "features": ("""select p_partkey as track_id, 'api' as source, 60 as priority, p_partkey * 2 as row_id, case p_partkey % 5 when 0 then 'success' when 1 then 'partial' when 2 then 'failed' else 'not_found' end as status,
        case when p_partkey % 5 < 2 then 60 + p_size * 2.0::double end as bpm, case when p_partkey % 5 = 0 then p_size / 50.0::double end as energy, case when p_partkey % 5 < 2 then (p_partkey % 100) / 100.0::double end as valence,
        (p_partkey % 10) / 10.0::double as confidence, true as is_active from part where p_partkey % 5 <> 4
        union all select l_partkey, 'local', 40, l_partkey * 2 + 1, case when l_partkey % 4 = 0 then 'success' else 'partial' end, 60 + 2 * max(l_quantity)::double, max(round(l_discount * 100)::int) / 10.0::double, null, 0.8::double, l_partkey % 6 <> 5
        from lineitem where l_partkey % 4 <> 3 group by l_partkey""", ()),
    "items": ("""select event_id as item_id, user_id as job_id, event_id % 17 as track_id, case event_id % 5 when 0 then 'download' when 1 then 'lowlevel' when 2 then 'tensorflow' when 3 then 'aggregation' else 'cleanup' end as stage,
        k % 3 as priority, ts as created_at, case k % 5 when 0 then 'success' when 1 then 'failed' when 2 then 'pending' when 3 then 'skipped' else 'blocked' end as status, event_type as job_type, case when k % 5 < 2 then ts end as finished_at
        from (select *, (props->>'$.k')::int as k from events)""", ()),
}


def with_views(query: str, *views: str) -> str:
    """The query after a WITH of these views."""
    return "with " + ",\n".join(f"{v} as ({SQL[v][0]})" for v in views) + "\n" + query
