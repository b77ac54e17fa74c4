"""Queries that run the library's streams over the events, to their end, and read back what they wrote. Each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateflow.operators import jobs
from crateflow.operators.jobs import LOCK_SECONDS
from crateflow.plans.binding import Library
from crateflow.plans.catalogue import query
from crateflow.sources.tables import fresh_path
from crateflow.streaming import items, runs

#: What the kinds of events stand for in the queue.
KINDS = {"view": "reserve", "click": "fail", "purchase": "success", "error": "limit", "signup": "block"}


def queue_events(events: DataFrame) -> DataFrame:
    """item_id, event_id, stage, event, at: ten items of each user."""
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    item = F.col("user_id") * 10 + F.get_json_object("props", "$.k").cast("long") % 10
    stage = F.element_at(F.array(*map(F.lit, (*LOCK_SECONDS, "report"))), (item % 4).cast("int") + 1)
    return events.select(item.alias("item_id"), "event_id", stage.alias("stage"), kind[F.col("event_type")].alias("event"), F.col("ts").cast("timestamp").alias("at"))


_KIND_SQL = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in KINDS.items()) + " end"
_LOCK_SQL = "case item_id % 4 " + " ".join(f"when {k} then {s}" for k, s in enumerate((*LOCK_SECONDS.values(), 900))) + " end"


@query(f"""with recursive e as (select user_id * 10 + (props->>'$.k')::bigint % 10 as item_id, event_id, epoch_ms(ts) as t, {_KIND_SQL} as event from events),
    d as (select *, row_number() over (partition by item_id order by t, event_id) as rn from e where t < (select max(t) - 600000 from e)),
    r as (select item_id, 0::bigint as rn, 'pending' as status, 0 as attempts, null::bigint as due, 0 as changes from (select distinct item_id from d)
      union all select item_id, rn, new, tries, case when new = s1 and tries = attempts then d1 when new = 'running' then t + 1000 * {_LOCK_SQL} when new = 'rate_limited' then t + 60000 end, c1 + (new <> s1 or tries <> attempts)::int from (
        select *, attempts + (s1 not in ('success', 'failed') and event in ('fail', 'limit'))::int as tries, case when s1 in ('success', 'failed') then s1
          when event in ('fail', 'limit') then case when attempts + 1 >= 3 then 'failed' when event = 'fail' then 'pending' else 'rate_limited' end
          when event = 'success' then 'success' when event = 'reserve' and s1 = 'pending' then 'running' when event = 'block' and s1 = 'pending' then 'blocked' else s1 end as new
        from (select r.item_id, d.rn, d.t, d.event, r.attempts, case when r.due < d.t then 'pending' else r.status end as s1, case when r.due < d.t then null else r.due end as d1, r.changes + (coalesce(r.due < d.t, false))::int as c1
          from r join d on d.item_id = r.item_id and d.rn = r.rn + 1))),
    l as (select *, coalesce(due < (select max(t) - 600000 from e), false) as over from r qualify row_number() over (partition by item_id order by rn desc) = 1)
    select item_id, case when over then 'pending' else status end as status, attempts, (changes + over::int)::bigint as changes from l where changes + over::int > 0""")
def streamed_item_states(lib: Library):
    """The last state of each item that changed, from the stream's changes; the last ten minutes wait behind the watermark."""
    changes, _ = runs.run_through(items.item_states(queue_events(runs.table_stream(lib.spark, lib.dir, "events"))))
    return last_states(changes)


def last_states(changes: DataFrame) -> DataFrame:
    """Of changes at one time the one that time alone made comes first."""
    newest = F.struct("at", F.coalesce("event_id", F.lit(-1)))
    return changes.groupBy("item_id").agg(F.max_by("status", newest).alias("status"), F.max_by("attempts", newest).alias("attempts"), F.count("*").alias("changes"))


def _stage_items(events: DataFrame) -> DataFrame:
    """Items as they come: jobs of a hundred of them, each with three tracks."""
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.element_at(F.array(*[F.lit(s) for s in ("success", "failed", "pending", "skipped", "blocked")]), k % 5 + 1)
    stage = F.element_at(F.array(*map(F.lit, ("download", "lowlevel", "tensorflow", "aggregation", "cleanup"))), (F.col("event_id") % 5).cast("int") + 1)
    return events.select(F.col("event_id").alias("item_id"), "event_id", F.floor(F.col("event_id") / 100).alias("job_id"), (F.col("event_id") % 3).alias("track_id"), stage.alias("stage"), status.alias("status"), F.col("ts").cast("timestamp").alias("at"))


_STAGE_ITEMS = "i as (select item_id, item_id // 100 as job_id, item_id % 3 as track_id, item_id % 17 as track_17, stage, status, created_at from items)"


@query(f""", {_STAGE_ITEMS}
    select b.job_id, b.track_id, b.item_id from i b where b.status = 'blocked' and not exists (select 1 from (select b.item_id - 3 as n union all select b.item_id - 6) p
      left join i on i.item_id = p.n and i.job_id = b.job_id and i.track_id = b.track_id where not coalesce(case when i.stage = 'download' then i.status = 'success' else i.status in ('success', 'skipped', 'failed') end, false))""", "items")
def streamed_unblocks(lib: Library):
    """Blocked items whose two predecessors of the same track are of the same job too, and done."""
    events = runs.table_stream(lib.spark, lib.dir, "events")
    rows = _stage_items(events)
    needs = F.when(F.col("status") == "blocked", F.array(F.col("item_id") - 3, F.col("item_id") - 6))
    both = rows.withColumn("kind", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("needs", F.when(F.col("kind") == 1, needs)).where((F.col("kind") == 0) | F.col("needs").isNotNull())
    return runs.run_through(items.unblocked_items(both))[0]


@query(f""", {_STAGE_ITEMS} select s.job_id, s.track_17 as track_id, s.item_id, r.item_id as segment_id from (select * from i where status = 'blocked') s join (select * from i where stage = 'download' and status = 'success') r
    on r.job_id = s.job_id and r.track_17 = s.track_17 and r.item_id % 3 = s.item_id % 3 and abs(epoch_us(r.created_at) - epoch_us(s.created_at)) <= 86400000000""", "items")
def streamed_handoffs(lib: Library):
    """Blocked items and the downloads of their job, track and slot within a day of each other, as two streams."""
    def rows(at: str) -> DataFrame:
        e = _stage_items(runs.table_stream(lib.spark, lib.dir, "events"))
        return e.select("job_id", (F.col("item_id") % 17).alias("track_id"), (F.col("item_id") % 3).alias("segment_index"), "item_id", "stage", "status", F.col("at").alias(at))

    slots = rows("slot_at").where("status = 'blocked'").select("job_id", "track_id", "segment_index", "item_id", "slot_at")
    ready = rows("ready_at").where("stage = 'download' and status = 'success'").withColumnRenamed("item_id", "segment_id").drop("stage", "status")
    return runs.run_through(items.handed_over(slots, ready))[0].select("job_id", "track_id", "item_id", "segment_id")


_UNBLOCKED = """b as (select item_id, case when status = 'blocked' and not exists (select 1 from (select o.item_id - 1 as n union all select o.item_id - 2) p left join items i on i.item_id = p.n
      where not coalesce(case when i.stage = 'download' then i.status = 'success' else i.status in ('success', 'skipped', 'failed') end, false)) then 'pending' else status end as status, job_id from items o)"""


def reconciled(lib: Library) -> runs.Reconciler:
    """The items in four batches of files through foreachBatch."""
    spark = lib.spark
    source, folder = fresh_path(spark), fresh_path(spark)
    rows = lib["items"].withColumns({"event_id": F.col("item_id"), "locked_at": F.lit(None).cast("timestamp_ntz")}).select(*runs.Reconciler.COLUMNS, "event_id")
    rows.repartitionByRange(4, "created_at").write.parquet(source)
    tables = spark.read.parquet(source)
    edges = tables.select("item_id", F.explode(F.array(F.col("item_id") - 1, F.col("item_id") - 2)).alias("needs_id"))
    held = runs.Reconciler(spark, folder, edges)
    stream = spark.readStream.schema(tables.schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/progress").foreachBatch(held.each).start().awaitTermination()
    return held


@query(f", {_UNBLOCKED} select item_id, status from b", "items")
def reconciled_items(lib: Library):
    return reconciled(lib).items().select("item_id", "status")


@query(f""", {_UNBLOCKED} select job_id, case when bool_or(status in ('pending', 'running', 'rate_limited', 'blocked')) then 'running' when bool_or(status = 'failed') and bool_or(status = 'success') then 'partial' when bool_or(status = 'failed') then 'failed' else 'succeeded' end as status from b group by job_id""", "items")
def reconciled_jobs(lib: Library):
    return jobs.job_progress(reconciled(lib).items()).select("job_id", "status")


@query(""", h as (select *, row_number() over (partition by job_id order by created_at, item_id) as n, count(*) over (partition by job_id) as backlog from (select * exclude (job_id), job_id % 7 as job_id from items) where stage = 'aggregation' and status = 'pending')
    select item_id, job_id from h b where n <= case when backlog >= 100 then 50 else 25 end and not exists (select 1 from (select b.item_id - 1 as n) p left join items i on i.item_id = p.n where not coalesce(case when i.stage = 'download' then i.status = 'success' else i.status in ('success', 'skipped', 'failed') end, false))""", "items")
def aggregation_run(lib: Library):
    rows = lib["items"].withColumn("job_id", F.col("job_id") % 7)
    return jobs.run_head(rows, "aggregation", rows.select("item_id", (F.col("item_id") - 1).alias("needs_id"))).select("item_id", "job_id")


@query(""", busy as (select distinct item_id % 40 as s from items where status in ('pending', 'running', 'rate_limited', 'blocked') and stage in ('lowlevel', 'tensorflow') and item_id % 400 < 40),
    h as (select * from items where stage = 'cleanup' and status = 'pending' qualify row_number() over (partition by job_id order by created_at, item_id) <= 25),
    s as (select job_id, track_id, count(*) as blocked from (select job_id, track_id, item_id % 40 as s from items where stage = 'download') where s in (select s from busy) group by all)
    select item_id, case when s.blocked > 0 then 'failed' else 'success' end as status, case when s.blocked > 0 then 'SEGMENT_CONSUMER_PENDING' end as error_code, coalesce(s.blocked, 0)::bigint as blocked from h left join s using (job_id, track_id)""", "items")
def cleanup_run(lib: Library):
    rows = lib["items"].withColumn("segment_id", F.when(F.col("item_id") % 400 < 40, F.col("item_id") % 40))
    segments = rows.where("stage = 'download'").select("job_id", "track_id", (F.col("item_id") % 40).alias("segment_id"))
    head = jobs.run_head(rows, "cleanup", rows.select("item_id", F.col("item_id").alias("needs_id")).limit(0), adaptive=False)
    return jobs.cleaned_up(head, segments, rows)

