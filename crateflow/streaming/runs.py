"""Running streams to their end, and micro-batches that count once: a ledger of finished batches, and the reconcile tick."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from crateflow.operators import jobs, upserts
from crateflow.sources.tables import fresh_path

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB, on disk; the session's own setting comes back afterwards."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The files of one table of a folder as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_through(stream: DataFrame, path: str | None = None) -> tuple[DataFrame, StreamingQuery]:
    """All that the source has now, written and read back; run again on the same path, it takes up where it ended."""
    spark = stream.sparkSession
    path = path or fresh_path(spark)
    with rocksdb(spark):
        query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows"), query


def late_rows(query: StreamingQuery) -> int:
    """How many rows the query's operators dropped as later than the watermark, in the batches that it still reports."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


class Ledger:
    """Marks of the batches whose results are whole, as empty files in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/ledger")
        self.files = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files.mkdirs(self.folder)

    def done(self) -> list[int]:
        return sorted(int(f.getPath().getName()) for f in self.files.listStatus(self.folder))

    def mark(self, batch: int) -> None:
        self.files.create(self.path(self.folder, str(batch)), True).close()


def once(spark: SparkSession, folder: str, handle: Callable[[DataFrame, int, int | None], None]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that calls handle(batch, number, number of the batch done before) and marks the batch as done.

    A batch that is marked is passed over. One that was broken off is handled again with the same predecessor, so handle
    must write to places named by the batch, over what lies there.
    """
    ledger = Ledger(spark, folder)

    def each(batch: DataFrame, number: int) -> None:
        done = ledger.done()
        if number not in done:
            handle(batch, number, max((n for n in done if n < number), default=None))
            ledger.mark(number)

    return each


def tick(events: DataFrame, handle: Callable[[DataFrame, int], None], progress: str, seconds: int = 45) -> StreamingQuery:
    """Hands every micro-batch to handle(batch, number), one each so many seconds; progress: the folder to take up from."""
    return events.writeStream.trigger(processingTime=f"{seconds} seconds").option("checkpointLocation", progress).foreachBatch(handle).start()


class Reconciler:
    """The state of all items as a table per batch, and the jobs that each batch ended.

    A batch holds newer rows of items (item_id, job_id, track_id, stage, status, locked_by, locked_at, created_at). They replace the
    items' rows; locks that are stale by the batch's newest time are released; items whose needs are met are unblocked. edges:
    item_id, needs_id. Readers take the newest version that the ledger names, so they never see half of one.
    """

    COLUMNS = ("item_id", "job_id", "track_id", "stage", "status", "locked_by", "locked_at", "created_at")

    def __init__(self, spark: SparkSession, folder: str, edges: DataFrame):
        self.spark, self.folder, self.edges = spark, folder, edges
        self.each = once(spark, folder, self._step)

    def _version(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/items/{number}")

    def items(self) -> DataFrame:
        return self._version(Ledger(self.spark, self.folder).done()[-1])

    def ended(self) -> DataFrame:
        """job_id, status, batch: each job in the batches in which it became terminal."""
        done = Ledger(self.spark, self.folder).done()
        return self.spark.read.parquet(*[f"{self.folder}/ended/{n}" for n in done])

    def _step(self, batch: DataFrame, number: int, before: int | None) -> None:
        newest = batch.groupBy("item_id").agg(F.max_by(F.struct(*self.COLUMNS[1:]), F.struct("created_at", "event_id")).alias("r")).select("item_id", "r.*")
        held = self._version(before) if before is not None else newest.limit(0)
        merged = upserts.upsert(held, newest, ["item_id"])
        now = batch.agg(F.max("created_at")).first()[0]
        free = jobs.release_stale(merged, F.lit(now).cast("timestamp_ntz"))
        ready = jobs.unblocked(free, self.edges).withColumn("ready", F.lit(True))
        items = free.join(ready, "item_id", "left").withColumn("status", F.when(F.col("ready"), "pending").otherwise(F.col("status"))).drop("ready")
        items.write.mode("overwrite").parquet(f"{self.folder}/items/{number}")
        ended = jobs.job_progress(self._version(number)).where("status <> 'running'").select("job_id", "status")
        if before is not None:
            ended = ended.join(jobs.job_progress(held).where("status <> 'running'").select("job_id"), "job_id", "left_anti")
        ended.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/ended/{number}")
