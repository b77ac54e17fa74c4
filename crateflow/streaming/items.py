"""The job queue as a stream of events: item states with lock timeouts, dependencies, and windowed counts."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from crateflow.operators.jobs import LOCK_SECONDS

FINAL = ("success", "skipped", "cancelled", "failed")
#: Seconds that a rate-limited item waits, and those of stages without their own.
WAIT_SECONDS, OTHER_SECONDS = 60, 900
#: Which events lead from where to where; retryable failures are decided by the attempts left.
MOVES = {
    "reserve": (("pending",), "running"), "block": (("pending",), "blocked"), "unblock": (("blocked",), "pending"),
    "cancel": (("pending", "blocked", "rate_limited"), "cancelled"), "success": (None, "success"), "skip": (None, "skipped"),
}


def advance(status: str, attempts: int, event: str, most: int) -> tuple[str, int]:
    """The state after an event: final states stay, running items are not cancelled, failures wait while attempts are left.

    limit is a failure after which the item is rate-limited for a while. An event that doesn't fit the state changes nothing.
    """
    if status in FINAL:
        return status, attempts
    if event in ("fail", "limit"):
        return ({"fail": "pending", "limit": "rate_limited"}[event] if attempts + 1 < most else "failed"), attempts + 1
    froms, to = MOVES.get(event, ((), status))
    return (to if froms is None or status in froms else status), attempts


class Item(NamedTuple):
    """What is kept of an item: due_ms is when its lock or its wait ends, last_* the newest event applied."""

    status: str = "pending"
    stage: str | None = None
    attempts: int = 0
    due_ms: int | None = None
    last_ms: int = -1
    last_id: int = -1
    final_ms: int | None = None


#: Into how many keys of the state the items are dealt.
SLOTS = 1 << 15


class ItemStates(StatefulProcessor):
    """Keeps the events that the watermark hasn't passed and applies the others in order of time and id.

    A key is a slot of items. What they have is one value, read and written once a call, and one timer, as each use of the state is
    a round trip to the JVM: their number grows with the slots, not with items or events.
    """

    def __init__(self, most_attempts: int, keep_seconds: int):
        self.most, self.keep_ms = most_attempts, 1000 * keep_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", "items string, timer_ms long")

    def _read(self) -> tuple[dict[str, tuple[Item, list]], int | None]:
        """Each item with its waiting events (time, id, stage, event), and the slot's timer."""
        held = self.held.get()
        return ({}, None) if held is None else ({name: (Item(*item), waiting) for name, item, waiting in json.loads(held[0])}, held[1])

    def _write(self, states: dict[str, tuple[Item, list]], timer: int | None) -> None:
        self.held.update((json.dumps([(name, *state) for name, state in states.items()]), timer))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = json.loads(f"[{','.join([r.entry for r in rows])}]")
        if new:
            states, timer = self._read()
            for e in new:
                states.setdefault(e["item"], (Item(), []))[1].append((e["at_ms"], e["event_id"], e["stage"], e["event"]))
            first = min(e["at_ms"] for e in new) + 1
            if timer is None or first < timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(first)
                timer = first
            self._write(states, timer)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now, (states, _), changes, times = timerValues.getCurrentWatermarkInMs(), self._read(), [], []
        for name, (item, waiting) in list(states.items()):
            made: list[tuple] = []
            item, rest = self._applied(item, waiting, now, made)
            changes.extend((name, *change) for change in made)
            ends = None if item.final_ms is None else item.final_ms + self.keep_ms
            if ends is not None and ends < now and not rest:
                del states[name]
                continue
            states[name] = (item, rest)
            times.extend(t + 1 for t in (rest[0][0] if rest else None, item.due_ms, ends) if t is not None and t >= now)
        if states:
            timer = min(times, default=None)
            if timer is not None:
                self.handle.registerTimer(timer)
            self._write(states, timer)
        else:
            self.held.clear()
        for name, status, attempts, at, event_id in changes:
            yield Row(item_id=name, status=status, attempts=attempts, at_ms=at, event_id=event_id)

    def _applied(self, item: Item, waiting: list, now: int, changes: list[tuple]) -> tuple[Item, list]:
        """The item after its events before now, and the events that wait on."""
        waiting = sorted(dict.fromkeys(map(tuple, waiting)), key=lambda e: e[:2])
        for at, event_id, stage, event in waiting:
            if at >= now:
                break
            if (at, event_id) <= (item.last_ms, item.last_id):
                continue  # a repeated event
            item = self._released(item, at, changes)._replace(last_ms=at, last_id=event_id)
            status, attempts = advance(item.status, item.attempts, event, self.most)
            item = item._replace(stage=stage or item.stage)
            if (status, attempts) != (item.status, item.attempts):
                changes.append((status, attempts, at, event_id))
                wait = {"running": LOCK_SECONDS.get(item.stage, OTHER_SECONDS), "rate_limited": WAIT_SECONDS}.get(status)
                item = item._replace(status=status, attempts=attempts, due_ms=at + 1000 * wait if wait else None, final_ms=at if status in FINAL else None)
        return self._released(item, now, changes), [e for e in waiting if e[0] >= now]

    @staticmethod
    def _released(item: Item, now: int, changes: list[tuple]) -> Item:
        """An item whose lock or wait ended before now is pending from then on."""
        if item.due_ms is None or item.due_ms >= now:
            return item
        changes.append(("pending", item.attempts, item.due_ms, None))
        return item._replace(status="pending", due_ms=None)


def item_states(events: DataFrame, most_attempts: int = 3, watermark: str = "10 minutes", keep_seconds: int = 86_400) -> DataFrame:
    """A row per change of an item's state: item_id, status, attempts, at, event_id (null where time alone made it).

    events: item_id, event_id, stage, event, at (timestamp). An event waits until the watermark has passed it; then it is applied
    in order of time and id, whatever order and batch it came in. So the changes don't depend on how the stream was cut, a
    repeated event changes nothing, and one later than the watermark is dropped (see late_rows()). A running item whose lock is
    older than its stage allows is pending from that time on, a rate-limited one when it has waited WAIT_SECONDS. Final
    states stay; keep_seconds of event time after one its state goes, as events that old are late by then. Needs the RocksDB
    state store (see streaming.runs).
    """
    kind = events.schema["item_id"].dataType
    entry = F.struct(F.col("item_id").cast("string").alias("item"), F.unix_millis("at").alias("at_ms"), "event_id", "stage", "event")
    slot = F.pmod(F.xxhash64("item_id"), F.lit(SLOTS)).alias("slot")
    rows = events.withWatermark("at", watermark).select(slot, "at", F.to_json(entry, {"ignoreNullFields": "false"}).alias("entry"))  # few columns: each costs Python time a row
    changes = rows.groupBy("slot").transformWithState(ItemStates(most_attempts, keep_seconds), "item_id string, status string, attempts int, at_ms long, event_id long", "Append", "EventTime")
    return changes.select(F.col("item_id").cast(kind).alias("item_id"), "status", "attempts", F.timestamp_millis("at_ms").alias("at"), "event_id")


class Dependencies(StatefulProcessor):
    """Per job and track the status of each item and what blocked items need, in one value: a batch reads and writes a key's once.

    Each call of the state is a round trip to the JVM, so their number must not grow with the rows.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "met string, needs string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.held.get()
        met, needs = ({k: v for k, *v in json.loads(part)} for part in held or ("[]", "[]"))
        for r in rows:
            if r.needs is not None:
                needs[r.item_id] = r.needs
            elif r.item_id not in met or tuple(met[r.item_id][:2]) < (r.at_ms, r.event_id):
                met[r.item_id] = (r.at_ms, r.event_id, r.met)
        free = [item_id for item_id, need in needs.items() if all(n in met and met[n][2] for n in need)]
        for item_id in free:
            del needs[item_id]
        self.held.update(tuple(json.dumps([(k, *v) for k, v in part.items()]) for part in (met, needs)))
        return (Row(job_id=key[0], track_id=key[1], item_id=item_id) for item_id in free)


def unblocked_items(events: DataFrame) -> DataFrame:
    """job_id, track_id, item_id of blocked items, each once, when all they need is met; the streaming form of jobs.unblocked().

    events: job_id, track_id, item_id, event_id, at, and either needs (ids that a blocked item of the same job and track waits
    for) or stage and status (what an item is now). Both may come in any order: of an item's statuses the newest
    counts. Success, skipped and failed meet a need, of a download success only. A key's state is its job's items for one track.
    """
    met = F.when(F.col("stage") == "download", F.col("status") == "success").otherwise(F.col("status").isin("success", "skipped", "failed"))
    rows = events.select("job_id", "track_id", "item_id", "event_id", F.unix_millis("at").alias("at_ms"), "needs", F.coalesce(met, F.lit(False)).alias("met"))
    return rows.groupBy("job_id", "track_id").transformWithState(Dependencies(), "job_id long, track_id long, item_id long", "Append", "None")


def handed_over(slots: DataFrame, ready: DataFrame, wait: str = "1 day", watermark: str = "10 minutes") -> DataFrame:
    """job_id, track_id, segment_index, item_id, segment_id: blocked slots and the segments that downloads have made, joined as they come.

    slots: job_id, track_id, segment_index, item_id, slot_at; ready: the same keys, segment_id, ready_at. Either side may come first;
    they meet if `wait` apart at most, and what the watermarks put beyond that is dropped from the state.
    """
    keys = ["job_id", "track_id", "segment_index"]
    a = slots.withWatermark("slot_at", watermark)
    b = ready.withWatermark("ready_at", watermark).select(*[F.col(k).alias(f"r_{k}") for k in keys], "segment_id", "ready_at")
    near = F.col("ready_at").between(F.col("slot_at") - F.expr(f"interval {wait}"), F.col("slot_at") + F.expr(f"interval {wait}"))
    same = near
    for k in keys:
        same = same & (F.col(k) == F.col(f"r_{k}"))
    return a.join(b, same).select(*keys, "item_id", "segment_id", "slot_at", "ready_at")


def windowed_counts(events: DataFrame, window: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Events per stage and kind in tumbling windows; later than the watermark is dropped."""
    return events.withWatermark("at", watermark).groupBy(F.window("at", window), "stage", "event").agg(F.count("*").alias("n")).select("window.start", "window.end", "stage", "event", "n")
