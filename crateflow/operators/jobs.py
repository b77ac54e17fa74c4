"""Analytics over a job queue, and its state changes as batch transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("pending", "running", "success", "failed", "skipped", "blocked", "cancelled", "rate_limited")
STAGES = ("plan", "download", "lowlevel", "tensorflow", "aggregation", "cleanup", "report")
DONE = ("success", "failed", "skipped", "cancelled", "rate_limited")
#: Seconds after which a worker's lock is stale.
LOCK_SECONDS = {"download": 600, "lowlevel": 900, "tensorflow": 1800}


def status_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("status").agg(F.count("*").alias("n"))


def stage_matrix(items: DataFrame, stages: tuple[str, ...] = STAGES, statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """A row per stage of the domain and a column per status, 0 where there is no item; one pass."""
    spark = items.sparkSession
    every = spark.createDataFrame([(s,) for s in stages], "stage string")
    counts = items.groupBy("stage").agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses])
    return F.broadcast(every).join(counts, "stage", "left").na.fill(0, list(statuses))


def job_progress(items: DataFrame, pipeline: bool = True) -> DataFrame:
    """Per job: total, done, pending and the status that follows. Rate-limited items count as done and as pending.

    Blocked items are pending in pipeline jobs only.
    """
    waiting = ("pending", "running", "rate_limited", *(("blocked",) if pipeline else ()))
    counts = items.groupBy("job_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status").isin(*DONE)).alias("done"), F.count_if(F.col("status").isin(*waiting)).alias("pending"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "success").alias("succeeded"),
    )
    status = F.when(F.col("pending") > 0, "running").when((F.col("failed") > 0) & (F.col("succeeded") > 0), "partial").when(F.col("failed") > 0, "failed").otherwise("succeeded")
    return counts.withColumn("status", status)


def track_progress(items: DataFrame) -> DataFrame:
    """Per job and track: completed, failed or pending."""
    tracks = items.groupBy("job_id", "track_id").agg(F.max(F.when(F.col("stage") == "cleanup", F.col("status"))).alias("cleanup"), F.bool_or(F.col("status") == "failed").alias("any_failed"))
    open_ = F.col("cleanup").isNull() | F.col("cleanup").isin("skipped", "pending", "blocked")
    state = F.when(F.col("cleanup") == "success", "completed").when(F.col("cleanup").isin("failed", "cancelled") | (open_ & F.col("any_failed")), "failed").otherwise("pending")
    return tracks.select("job_id", "track_id", state.alias("progress"))


def terminal_results(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """What the jobs that have ended came to: job_id, status, track_count, succeeded, failed, skipped, not_found, tracks by progress, stages, last_error.

    jobs: job_id, job_type (preview_resolve and audio_analysis_pipeline are special), track_count (null or 0: the items'
    number counts). items: job_id, item_id, track_id, stage, status, result_json, error_message, finished_at. A preview job
    succeeds where an item's result says is_available; other successes, and malformed results, are not found. A pipeline job has
    a count per stage and status too. last_error: the first 2000 characters of the newest failure.
    """
    said = F.coalesce(F.get_json_object("result_json", "$.is_available"), F.lit(""))
    available = ~said.isin("", "false", "0", "0.0", "[]", "{}")
    success = F.col("status") == "success"
    kinds = items.join(jobs.select("job_id", (F.col("job_type") == "preview_resolve").alias("previews"), (F.col("job_type") == "audio_analysis_pipeline").alias("pipeline"), "track_count"), "job_id")
    counts = kinds.groupBy("job_id", "pipeline", "track_count").agg(
        F.count("*").alias("total"), F.count_if(success & (~F.col("previews") | available)).alias("succeeded"), F.count_if(success & F.col("previews") & ~available).alias("not_found"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("failed", "skipped")], F.count_if(success).alias("successes"),
        F.count_if(F.col("status").isin("pending", "running", "rate_limited") | (F.col("pipeline") & (F.col("status") == "blocked"))).alias("open"),
        F.max_by(F.substring("error_message", 1, 2000), F.when(F.col("status") == "failed", F.struct("finished_at", -F.col("item_id")))).alias("last_error"),
    )
    stages = kinds.where("pipeline").groupBy("job_id", "stage", "status").agg(F.count("*").alias("n")).groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws(":", "stage", "status").alias("k"), F.col("n"))))).alias("stages"))
    progress = track_progress(kinds.where("pipeline")).groupBy("job_id").agg(F.count("*").alias("tracks_total"), F.count_if(F.col("progress") == "completed").alias("tracks_completed"), F.count_if(F.col("progress") == "failed").alias("tracks_failed"))
    status = F.when((F.col("failed") > 0) & (F.col("successes") > 0), "partial").when(F.col("failed") > 0, "failed").otherwise("succeeded")
    ended = counts.where("open = 0").join(stages, "job_id", "left").join(progress, "job_id", "left")
    return ended.select("job_id", status.alias("status"), F.coalesce(F.nullif("track_count", F.lit(0)), "total").alias("track_count"), "succeeded", "failed", "skipped", "not_found", "tracks_total", "tracks_completed", "tracks_failed", "stages", "last_error")


def latest_per_type(jobs: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """The last finished job of each listed type; a type without one has nulls."""
    spark = jobs.sparkSession
    newest = F.row_number().over(Window.partitionBy("job_type").orderBy(F.desc("finished_at"), F.desc("job_id")))
    last = jobs.where(F.col("finished_at").isNotNull()).withColumn("n", newest).where("n = 1").drop("n")
    return F.broadcast(spark.createDataFrame([(t,) for t in types], "job_type string")).join(last, "job_type", "left")


def first_failed(items: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc_nulls_last("finished_at"), "item_id"))
    return items.where("status = 'failed'").withColumn("n", rank).where("n = 1").drop("n")


def ready(items: DataFrame, stage: str, after: str) -> DataFrame:
    """Pairs of a pending item of `stage` and a finished one of `after` for the same job and track, counted per job."""
    a = items.where((F.col("stage") == stage) & (F.col("status") == "pending")).select("job_id", "track_id")
    b = items.where((F.col("stage") == after) & (F.col("status") == "success")).select("job_id", "track_id")
    # both sides are counted first: the pairs of a key are the product, and no pair is ever a row
    x, y = (d.groupBy("job_id", "track_id").agg(F.count("*").alias(n)) for d, n in ((a, "x"), (b, "y")))
    return x.join(y, ["job_id", "track_id"]).groupBy("job_id").agg(F.sum(F.col("x") * F.col("y")).alias("pairs"))


def unblocked(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Blocked items whose prerequisites are all success, skipped or failed (a download: success only); item_id.

    edges: item_id, needs_id. A prerequisite that does not exist is not met; an item without any is met.
    """
    blocked = items.where("status = 'blocked'").select("item_id")
    return blocked.join(unmet(blocked, items, edges), "item_id", "left_anti")


def unmet(some: DataFrame, items: DataFrame, edges: DataFrame) -> DataFrame:
    """Those of some item_ids with a prerequisite that isn't met."""
    state = items.select(F.col("item_id").alias("needs_id"), F.when(F.col("stage") == "download", F.col("status") == "success").otherwise(F.col("status").isin("success", "skipped", "failed")).alias("met"))
    needs = edges.join(some, "item_id", "left_semi").join(state, "needs_id", "left")
    return needs.where(~F.coalesce("met", F.lit(False))).select("item_id").distinct()


def queue_head(items: DataFrame, now: Column, n: int = 1) -> DataFrame:
    """The next n items: pending, unlocked and due, by priority (high first), age and id."""
    due = (F.col("status") == "pending") & F.col("locked_by").isNull() & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now))
    return items.where(due).orderBy(F.desc("priority"), "created_at", "item_id").limit(n)


def reserve(items: DataFrame, now: Column, worker: str, n: int) -> DataFrame:
    """items with the n next ones running and locked by the worker."""
    head = queue_head(items, now, n).select("item_id", F.lit(True).alias("__head"))
    rows = items.join(F.broadcast(head), "item_id", "left")
    taken = F.coalesce("__head", F.lit(False))
    return rows.withColumn("status", F.when(taken, "running").otherwise(F.col("status"))).withColumn("locked_by", F.when(taken, worker).otherwise(F.col("locked_by"))).withColumn("locked_at", F.when(taken, now).otherwise(F.col("locked_at"))).drop("__head")


def release_stale(items: DataFrame, now: Column) -> DataFrame:
    """Running items locked for longer than their stage allows become pending and unlocked."""
    limit = F.lit(900)
    for stage, seconds in LOCK_SECONDS.items():
        limit = F.when(F.col("stage") == stage, seconds).otherwise(limit)
    age = F.timestamp_diff("SECOND", F.col("locked_at"), now)
    stale = F.coalesce((F.col("status") == "running") & (age > limit), F.lit(False))
    return items.withColumn("status", F.when(stale, "pending").otherwise(F.col("status"))).withColumn("locked_by", F.when(~stale, F.col("locked_by"))).withColumn("locked_at", F.when(~stale, F.col("locked_at")))


def fail(items: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """Applies failures (item_id, error, retryable, delay_s): retryable ones with attempts left wait, others fail."""
    rows = items.join(failures, "item_id", "left")
    hit = F.col("retryable").isNotNull()
    again = hit & F.col("retryable") & (F.col("attempt_count") + 1 < F.col("max_attempts"))
    later = F.coalesce("delay_s", F.lit(0)) > 0
    status = F.when(again & later, "rate_limited").when(again, "pending").when(hit, "failed").otherwise(F.col("status"))
    out = rows.withColumn("status", status).withColumn("next_retry_at", F.when(again & later, F.timestamp_add("SECOND", F.col("delay_s"), now)).otherwise(F.col("next_retry_at")))
    out = out.withColumn("attempt_count", F.col("attempt_count") + hit.cast("int")).withColumn("error_code", F.when(hit, F.substring("error", 1, 2000)).otherwise(F.col("error_code")))
    return out.withColumn("locked_by", F.when(~hit, F.col("locked_by"))).drop("error", "retryable", "delay_s")


def retry_failed(items: DataFrame, job_id: Column) -> DataFrame:
    hit = (F.col("status") == "failed") & (F.col("job_id") == job_id)
    return items.withColumn("attempt_count", F.when(hit, 0).otherwise(F.col("attempt_count"))).withColumn("error_code", F.when(~hit, F.col("error_code"))).withColumn("status", F.when(hit, "pending").otherwise(F.col("status")))


def cancel(items: DataFrame, job_id: Column) -> DataFrame:
    """Queued states of the job become cancelled; running items finish."""
    hit = (F.col("job_id") == job_id) & F.col("status").isin("pending", "blocked", "rate_limited")
    return items.withColumn("status", F.when(hit, "cancelled").otherwise(F.col("status")))


def plan(tracks: DataFrame, segments: int = 3) -> DataFrame:
    """The work of a pipeline job: per track and segment download, then low-level and tensorflow; then aggregation, cleanup."""
    per_segment = tracks.select("job_id", "track_id", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("segment")).select("job_id", "track_id", "segment", F.explode(F.array(*map(F.lit, ("download", "lowlevel", "tensorflow")))).alias("stage"))
    per_track = tracks.select("job_id", "track_id", F.lit(None).cast("int").alias("segment"), F.explode(F.array(*map(F.lit, ("aggregation", "cleanup")))).alias("stage"))
    every = per_segment.unionByName(per_track)
    return every.withColumn("status", F.when(F.col("stage") == "download", "pending").otherwise("blocked"))


def removable_files(segments: DataFrame, items: DataFrame) -> DataFrame:
    """Segments with a file that no pending, running, rate-limited or blocked consumer needs."""
    busy = items.where(F.col("status").isin("pending", "running", "rate_limited", "blocked") & F.col("stage").isin("lowlevel", "tensorflow"))
    return segments.where(F.col("path").isNotNull() & F.col("deleted_at").isNull()).join(busy.select("segment_id"), "segment_id", "left_anti")


def stuck_hint(items: DataFrame) -> DataFrame:
    """Per job the first diagnosis that its open items support."""
    has = lambda stage, *status: F.bool_or((F.col("stage") == stage) & F.col("status").isin(*status))
    hint = F.when(has("download", "rate_limited"), "DOWNLOAD_RATE_LIMITED").when(has("download", "pending", "running"), "WAITING_FOR_DOWNLOAD").when(has("lowlevel", "pending", "running"), "WAITING_FOR_LOWLEVEL").when(has("tensorflow", "pending", "running"), "WAITING_FOR_TENSORFLOW").when(has("aggregation", "pending", "blocked"), "WAITING_FOR_AGGREGATION").when(has("cleanup", "pending", "blocked"), "WAITING_FOR_CLEANUP")
    return items.groupBy("job_id").agg(hint.alias("hint"))


#: Items that a run of aggregation or cleanup takes, and the backlog from which it takes twice as many.
RUN_SIZE, HIGH_BACKLOG = 25, 100


def run_head(items: DataFrame, stage: str, edges: DataFrame, adaptive: bool = True) -> DataFrame:
    """The pending items of a stage that a run takes of each job: the oldest RUN_SIZE, twice as many from HIGH_BACKLOG on, if adaptive.

    Of these only items whose needs are met are returned; the others keep their place and wait.
    """
    pending = items.where((F.col("stage") == stage) & (F.col("status") == "pending"))
    backlog = pending.groupBy("job_id").agg(F.count("*").alias("backlog"))
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy("created_at", "item_id"))
    first = pending.withColumn("n", rank).where(F.col("n") <= 2 * RUN_SIZE).join(backlog, "job_id")
    most = F.when((F.col("backlog") >= HIGH_BACKLOG) & F.lit(adaptive), 2 * RUN_SIZE).otherwise(RUN_SIZE)
    head = first.where(F.col("n") <= most).drop("n", "backlog")
    waiting = unmet(head.select("item_id"), items, edges)
    return head.join(waiting, "item_id", "left_anti")


def cleaned_up(head: DataFrame, segments: DataFrame, items: DataFrame, keep: bool = False) -> DataFrame:
    """What a cleanup run makes of its items: item_id, status, error_code, blocked (segments that other items still need).

    An item with such a segment fails and may be tried again; with keep nothing is removed and all succeed. segments: job_id, track_id, segment_id.
    """
    busy = items.where(F.col("status").isin("pending", "running", "rate_limited", "blocked") & F.col("stage").isin("lowlevel", "tensorflow")).select("segment_id").distinct()
    held = segments.join(busy, "segment_id", "left_semi").groupBy("job_id", "track_id").agg(F.count("*").alias("blocked"))
    rows = head.join(held, ["job_id", "track_id"], "left").withColumn("blocked", F.lit(0).cast("long") if keep else F.coalesce("blocked", F.lit(0)))
    waits = F.col("blocked") > 0
    return rows.select("item_id", F.when(waits, "failed").otherwise("success").alias("status"), F.when(waits, "SEGMENT_CONSUMER_PENDING").alias("error_code"), "blocked")


def orphaned(jobs: DataFrame, alive: DataFrame, managed: tuple[str, ...]) -> DataFrame:
    """Queued or running jobs that nothing alive runs become failed; types that workers manage stay."""
    live = jobs.join(alive.select("job_id", F.lit(True).alias("__alive")), "job_id", "left")
    lost = F.col("status").isin("queued", "running") & F.col("__alive").isNull() & ~F.col("job_type").isin(*managed)
    return live.withColumn("status", F.when(lost, "failed").otherwise(F.col("status"))).drop("__alive")


def heartbeats(beats: DataFrame, tie: str | None = None) -> DataFrame:
    """The last beat of each worker; of beats at one time the one with the largest `tie`, if that is named."""
    rest = [c for c in beats.columns if c != "worker_id"]
    newest = F.struct("last_seen_at", *([tie] if tie else []))
    return beats.groupBy("worker_id").agg(F.max_by(F.struct(*rest), newest).alias("b")).select("worker_id", *[F.col(f"b.{c}").alias(c) for c in rest])
