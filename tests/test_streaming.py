import datetime as dt
import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from crateflow.operators import jobs
from crateflow.plans import streams
from crateflow.streaming import items, runs

START = dt.datetime(2026, 1, 1, 10, 0, 0)
EVENTS = "item_id string, event_id long, stage string, event string, at timestamp"


def write(folder, n, rows):
    """Rows of item, event id, stage, event, seconds after START."""
    folder.mkdir(exist_ok=True)
    lines = [dict(zip(("item_id", "event_id", "stage", "event"), r, strict=False)) | {"at": (START + dt.timedelta(seconds=r[4])).isoformat()} for r in rows]
    (folder / f"{n}.json").write_text("\n".join(map(json.dumps, lines)))


def run(spark, tmp_path, name="out", keep=86_400):
    events = spark.readStream.schema(EVENTS).json(str(tmp_path / "in"))
    changes, query = runs.run_through(items.item_states(events, watermark="60 seconds", keep_seconds=keep), str(tmp_path / name))
    got = {}
    for r in sorted(changes.collect(), key=lambda r: (r.at, r.event_id or -1)):
        got.setdefault(r.item_id, []).append(r.status)
    return got, query


def state_rows(query):
    """Of the last batch that had a state; variables of a processor count together."""
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


ROWS = [
    ("a", 1, "download", "reserve", 0), ("a", 2, "download", "success", 60), ("b", 3, "download", "reserve", 0), ("b", 4, "download", "fail", 30), ("c", 5, "download", "reserve", 0),
    ("d", 6, "lowlevel", "reserve", 0), ("d", 7, "lowlevel", "limit", 5), ("e", 8, "report", "block", 1), ("e", 9, "report", "reserve", 2), ("e", 10, "report", "unblock", 3),
]


def test_item_states_with_a_stale_lock_and_a_wait(spark, tmp_path):
    write(tmp_path / "in", 0, ROWS)
    run(spark, tmp_path)
    write(tmp_path / "in", 1, [("z", 20, "download", "reserve", 3600)])
    got, _ = run(spark, tmp_path)
    assert got == {"a": ["running", "success"], "b": ["running", "pending"], "c": ["running", "pending"], "d": ["running", "rate_limited", "pending"], "e": ["blocked", "pending"]}


def test_repeated_events_change_nothing_and_final_states_stay(spark, tmp_path):
    write(tmp_path / "in", 0, [*ROWS, *ROWS])
    write(tmp_path / "in", 1, [("z", 20, "download", "reserve", 300)])
    once, _ = run(spark, tmp_path)
    write(tmp_path / "in", 2, [*ROWS, ("a", 30, "download", "reserve", 400), ("z", 31, "download", "success", 500), ("y", 32, "download", "reserve", 900)])
    got, query = run(spark, tmp_path)
    assert once["a"] == got["a"] == ["running", "success"] and got["b"] == ["running", "pending"] and got["z"] == ["running", "success"]
    assert runs.late_rows(query) == len(ROWS)


def test_state_goes_after_its_time(spark, tmp_path):
    """A final item is kept for a while of event time, then its state is empty."""
    write(tmp_path / "in", 0, ROWS[:2])
    run(spark, tmp_path, keep=600)
    write(tmp_path / "in", 1, [("z", 20, "download", "skip", 400)])
    _, query = run(spark, tmp_path, keep=600)
    held = state_rows(query)
    write(tmp_path / "in", 2, [("y", 21, "download", "skip", 5000)])
    run(spark, tmp_path, keep=600)
    write(tmp_path / "in", 3, [("y", 22, "download", "skip", 9000)])
    got, query = run(spark, tmp_path, keep=600)
    assert held >= 2 and state_rows(query) <= 2 and got["a"] == ["running", "success"]


@pytest.mark.parametrize("cut", [1, 3, 7])
def test_the_changes_do_not_depend_on_the_batches(spark, tmp_path, cut):
    """Events that come within the watermark's delay in any order, in one batch or several."""
    rnd = random.Random(3)
    kinds = ["reserve", "fail", "success", "limit", "block", "unblock", "cancel", "skip"]
    rows = sorted(((f"i{rnd.randint(0, 12)}", k, rnd.choice(["download", "report"]), rnd.choice(kinds[: 2 + k % 7]), rnd.randint(0, 4000)) for k in range(150)), key=lambda r: r[4] + rnd.randint(0, 59))
    size = -(-len(rows) // cut)
    for n in range(cut):
        write(tmp_path / "in", n, rows[n * size : (n + 1) * size])
        got, query = run(spark, tmp_path)
        assert runs.late_rows(query) == 0
    want = {}
    for item in {r[0] for r in rows}:
        status, attempts, due, stage = "pending", 0, None, None
        mine = sorted((r for r in rows if r[0] == item and r[4] < 3940), key=lambda r: (r[4], r[1]))
        last = max(r[4] for r in rows) - 60
        for _, _, s, event, at in [*[r for r in mine if r[4] < last], (0, 0, None, "end", last)]:
            if due is not None and due < at:
                status, due = "pending", None
                want.setdefault(item, []).append("pending")
            new, tries = items.advance(status, attempts, event, 3)
            stage = s or stage
            if (new, tries) != (status, attempts):
                want.setdefault(item, []).append(new)
                due = at + {"running": 600 if stage == "download" else 900, "rate_limited": 60}[new] if new in ("running", "rate_limited") else None
            status, attempts = new, tries
    assert got == want


def test_moves():
    assert items.advance("running", 2, "fail", 3) == ("failed", 3)
    assert items.advance("success", 0, "cancel", 3) == ("success", 0)
    assert items.advance("running", 0, "cancel", 3) == ("running", 0)
    assert items.advance("running", 0, "unblock", 3) == ("running", 0) and items.advance("blocked", 0, "unblock", 3) == ("pending", 0)


def test_windows(spark, tmp_path):
    write(tmp_path / "in", 0, ROWS[:5])
    events = spark.readStream.schema(EVENTS).json(str(tmp_path / "in"))
    query = items.windowed_counts(events).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    try:
        query.processAllAvailable()
        assert {(r.event, r.n) for r in spark.sql("select * from counts").collect()} == {("reserve", 3), ("success", 1), ("fail", 1)}
    finally:
        query.stop()


def test_unblocks_in_any_order(spark, tmp_path):
    """Needs before and after the items, an older status after a newer one, an item freed once."""
    rows = [(1, 1, 10, 1, 5, [11, 12], None, None), (1, 1, 11, 2, 1, None, "download", "failed"), (1, 1, 11, 3, 9, None, "download", "success"), (1, 1, 11, 4, 4, None, "download", "failed"),
            (1, 1, 12, 5, 3, None, "lowlevel", "skipped"), (1, 2, 20, 6, 1, [21], None, None), (1, 2, 22, 7, 1, None, "lowlevel", "success"), (2, 1, 30, 8, 1, [], None, None), (1, 1, 12, 9, 20, None, "lowlevel", "success")]
    schema = "job_id long, track_id long, item_id long, event_id long, s int, needs array<long>, stage string, status string"
    for turn, order in enumerate((rows, rows[::-1])):
        for n in range(3):
            spark.createDataFrame(order[n::3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{turn}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in{turn}").withColumn("at", F.timestamp_seconds("s"))
        got, _ = runs.run_through(items.unblocked_items(stream), f"{tmp_path}/out{turn}")
        assert sorted(r.item_id for r in got.collect()) == [10, 30]


class Counted:
    """A handle whose variables count their calls; the value stays as after an update."""

    def __init__(self):
        self.calls, self.value = 0, None

    def __getattr__(self, name):
        def call(*given):
            self.calls += not name.endswith("State")
            if name == "update":
                self.value = given[0]
            return self if name.endswith("State") else self.value if name == "get" else []

        return call


def test_state_calls_do_not_grow_with_the_rows():
    """Each is a round trip out of Python: a few a key and batch, whether it has ten rows or a thousand."""
    calls = []
    for n in (10, 1000):
        held, free = Counted(), items.Dependencies()
        free.init(held)
        rows = [Row(job_id=1, track_id=1, item_id=k, event_id=k, at_ms=k, needs=[k + 1] if part else None, met=k % 2 == 0) for k in range(n) for part in (0, 1)]
        got = [r.item_id for batch in (rows[: n // 2], rows[n // 2 :]) for r in free.handleInputRows((1, 1), iter(batch), None)]
        calls.append((n, held.calls, sorted(got)))
    assert calls[0][1] == calls[1][1] <= 4
    assert all(got == list(range(1, n - 1, 2)) for n, _, got in calls)


def test_calls_of_item_states_do_not_grow_with_items_and_events():
    """The value read and written and a timer set, once for a slot's rows and once at its timer."""
    kinds = ("reserve", "fail", "reserve", "success")
    now = type("Now", (), {"getCurrentWatermarkInMs": lambda self: 10_000})()
    for n in (1, 50):
        held, states = Counted(), items.ItemStates(3, 86_400)
        states.init(held)
        rows = [Row(item_id=k, at=None, at_ms=t, event_id=t, stage=None, event=e, entry=json.dumps({"item": str(k), "at_ms": t, "event_id": t, "stage": None, "event": e})) for t, e in enumerate(kinds) for k in range(n)]
        assert list(states.handleInputRows((1,), iter(rows), None)) == [] and held.calls <= 3
        got = [r.status for r in states.handleExpiredTimer((1,), now, None)]
        assert got == ["running", "pending", "running", "success"] * n and held.calls <= 6


def test_a_batch_counts_once(spark, tmp_path):
    """A batch whose handling broke off is handled again, one that is marked is not."""
    seen, broken = [], [True]

    def handle(batch, number, before):
        seen.append((number, before))
        batch.write.mode("overwrite").parquet(f"{tmp_path}/t/rows/{number}")
        if number == 1 and broken.pop():
            broken.append(False)
            raise RuntimeError("lost")

    each = runs.once(spark, f"{tmp_path}/t", handle)
    each(spark.range(3), 0)
    each(spark.range(3), 0)
    with pytest.raises(RuntimeError):
        each(spark.range(4), 1)
    assert runs.Ledger(spark, f"{tmp_path}/t").done() == [0]
    each(spark.range(4), 1)
    assert seen == [(0, None), (1, 0), (1, 0)] and runs.Ledger(spark, f"{tmp_path}/t").done() == [0, 1]


def test_a_killed_reconcile_gives_the_same_tables(spark, tmp_path):
    """The query fails in its second batch after its tables were written, and is started again on the same folders."""
    kinds = ["success", "failed", "pending", "blocked", "skipped"]
    row = "item_id long, job_id long, track_id long, stage string, status string, locked_by string, locked_at timestamp_ntz, created_at timestamp_ntz, event_id long"
    batches = [[(k, k % 5, 1, "download", kinds[(k * 7 + n) % 5], None, None, START + dt.timedelta(minutes=n), 100 * n + k) for k in range(n, 20, 1 + n % 2)] for n in range(4)]
    edges = spark.createDataFrame([(k, k - 1) for k in range(1, 20)], "item_id long, needs_id long")
    for n, b in enumerate(batches):
        spark.createDataFrame(b, row).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def go(name, fail):
        held = runs.Reconciler(spark, f"{tmp_path}/{name}", edges)
        broken = [fail]

        def each(batch, number):
            if number == 1 and broken.pop():
                broken.append(False)
                held._step(batch, number, 0)
                raise RuntimeError("killed")
            held.each(batch, number)

        stream = spark.readStream.schema(row).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        start = lambda: stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}/progress").foreachBatch(each).start().awaitTermination()
        if fail:
            with pytest.raises(Exception, match="killed"):
                start()
        start()
        return sorted((r.item_id, r.status) for r in held.items().collect()), sorted(map(tuple, held.ended().collect()))

    whole, again = go("whole", False), go("again", True)
    assert whole == again and len(whole[0]) == 20 and {b for *_, b in whole[1]} <= {0, 1, 2, 3}


def test_runs_take_more_of_a_long_backlog(spark):
    rows = [(k, k % 2, "aggregation", "pending", START + dt.timedelta(seconds=k)) for k in range(0, 300)] + [(1000 + k, 7, "aggregation", "pending", START) for k in range(60)] + [(2000, 8, "aggregation", "pending", START), (2001, 8, "x", "pending", START)]
    frame = spark.createDataFrame(rows, "item_id long, job_id long, stage string, status string, created_at timestamp_ntz")
    head = jobs.run_head(frame, "aggregation", spark.createDataFrame([(2000, 2001)], "item_id long, needs_id long"))
    assert {r.job_id: r.n for r in head.groupBy("job_id").agg(F.count("*").alias("n")).collect()} == {0: 50, 1: 50, 7: 25}


def test_cleanup_waits_for_consumers(spark):
    items_ = spark.createDataFrame([(1, 1, 1, "cleanup", "pending", None), (2, 1, 2, "cleanup", "pending", None), (3, 1, 1, "lowlevel", "running", 50)], "item_id long, job_id long, track_id long, stage string, status string, segment_id long")
    segments = spark.createDataFrame([(1, 1, 50), (1, 1, 51), (1, 2, 52)], "job_id long, track_id long, segment_id long")
    head = items_.where("stage = 'cleanup'")
    got = {r.item_id: (r.status, r.error_code, r.blocked) for r in jobs.cleaned_up(head, segments, items_).collect()}
    assert got == {1: ("failed", "SEGMENT_CONSUMER_PENDING", 1), 2: ("success", None, 0)}
    assert {r.status for r in jobs.cleaned_up(head, segments, items_, keep=True).collect()} == {"success"}


def test_last_states_order_changes_of_one_time(spark):
    changes = spark.createDataFrame([(1, "running", 0, START, 5), (1, "pending", 0, START, None)], "item_id long, status string, attempts int, at timestamp, event_id long")
    assert streams.last_states(changes).first().status == "running"
