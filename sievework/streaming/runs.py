"""The run log as a stream: lifecycle and streak state, artifacts once each, snapshots, daily counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.reconcile import ARCHIVE_AFTER, reconcile
from ..operators.runs import CLEAN, FAULTY
from ..sources.commits import CommittedTable

LISTINGS = "source_id string, key string, status string, consecutive_misses int"
STREAKS = "source_id string, consecutive_failures long"


def step(status: str, misses: int, outcome: str) -> tuple[str, int]:
    """A known listing after one outcome of its source's run: seen, missed, not_modified or other."""
    if outcome == "seen":
        return "active", 0
    if status == "active" and outcome == "not_modified":
        return status, 0
    if status == "active" and outcome == "missed":
        return ("archived" if misses + 1 >= ARCHIVE_AFTER else status), misses + 1
    return status, misses


def _ordered(rows: Iterator[Row], what: str) -> list[tuple]:
    """(at, event_id, what) of one key's rows of a batch in order; nulls come last."""
    return sorted(((r["at"], r["event_id"], r[what]) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or 0))


class Lifecycle(StatefulProcessor):
    """Keyed by (source_id, key), so that a source with many listings spreads; events: (ts, outcome).

    Events are put in order within a batch; one that is older than the newest its listing has met is late and ignored.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("listing", "status string, misses int, at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.state.get()
        status, misses, at = known if known is not None else (None, 0, None)
        for ts, _, outcome in _ordered(rows, "outcome"):
            if None not in (ts, at) and ts < at:
                continue
            if status is not None or outcome == "seen":
                status, misses = step(status or "", misses, outcome)
                at = at if ts is None else ts
        if status is not None:
            self.state.update((status, misses, at))
            yield Row(source_id=key[0], key=key[1], status=status, consecutive_misses=misses)

    def close(self) -> None:
        pass


class Streak(StatefulProcessor):
    """Faulty runs since the last clean one, keyed by source_id; events: (ts, status)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("streak", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.state.get()
        n = known[0] if known is not None else 0
        for _, _, status in _ordered(rows, "status"):
            n = 0 if status in CLEAN else n + (status in FAULTY)
        self.state.update((n,))
        yield Row(source_id=key[0], consecutive_failures=n)

    def close(self) -> None:
        pass


def lifecycle(events: DataFrame) -> DataFrame:
    """An update for each listing in each batch, from (source_id, key, event_id, ts, outcome)."""
    marked = events.select("source_id", "key", "event_id", F.unix_micros("ts").alias("at"), "outcome")
    return marked.groupBy("source_id", "key").transformWithState(Lifecycle(), LISTINGS, "Update", "None")


def streaks(events: DataFrame) -> DataFrame:
    marked = events.select("source_id", "event_id", F.unix_micros("ts").alias("at"), "status")
    return marked.groupBy("source_id").transformWithState(Streak(), STREAKS, "Update", "None")


class _InTimeOrder(StatefulProcessor):
    """Holds a key's events back until the watermark has passed them, and then takes them in the order of (at, event_id).

    So the order of arrival does not matter as long as no event is later than the watermark; one that is comes out aside, with its id.
    Times are milliseconds.
    """

    fields, start = "", ()

    def __init__(self, columns: list[str], keep_ms: int | None = None):
        self.row, self.keep_ms = Row(*columns), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long, what string")
        self.state = handle.getValueState("state", f"{self.fields}, at long")

    def take(self, values: tuple, what: str) -> tuple:
        raise NotImplementedError

    def shown(self, values: tuple) -> tuple | None:
        return values

    def is_over(self, values: tuple) -> bool:
        return False

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed, new = timerValues.getCurrentWatermarkInMs(), []
        for r in rows:
            at, event, what = r["at"], r["event_id"], r["what"]
            if at < passed:
                yield self.row(*key, *[None] * len(self.start), event)
            else:
                new.append((at, event, what))
        if new:
            # One timer at the first of them is enough: what is still held when it goes off sets the next one.
            self.waiting.appendList(new)
            self.handle.registerTimer(min(new)[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(x) for x in self.waiting.get())
        ready = [x for x in held if x[0] <= passed]
        known = self.state.get()
        *values, last = known if known is not None else (*self.start, None)
        values = tuple(values)
        for at, _, what in ready:
            values, last = self.take(values, what), at
        if ready:
            if len(ready) < len(held):
                self.waiting.put(held[len(ready) :])
                self.handle.registerTimer(held[len(ready)][0])
            else:
                self.waiting.clear()
            self.state.update((*values, last))
            if self.keep_ms is not None:
                self.handle.registerTimer(last + self.keep_ms)
            if (shown := self.shown(values)) is not None:
                yield self.row(*key, *shown, None)
        elif self.keep_ms is not None and last is not None and last + self.keep_ms <= passed and not held and self.is_over(values):
            self.state.clear()

    def close(self) -> None:
        pass


class OrderedLifecycle(_InTimeOrder):
    """Keyed by (source_id, key). An archived listing without an event for keep_ms is forgotten: it would start anew when it is seen."""

    fields, start = "status string, misses int", ("", 0)

    def take(self, values, what):
        status, misses = values
        return step(status, misses, what) if status or what == "seen" else values

    def shown(self, values):
        return values if values[0] else None

    def is_over(self, values):
        return values[0] == "archived"


class OrderedStreak(_InTimeOrder):
    """Keyed by source_id."""

    fields, start = "n long", (0,)

    def take(self, values, what):
        return (0 if what in CLEAN else values[0] + (what in FAULTY),)


def _in_time(events: DataFrame, late: str, ts: str, keys: list[str], what: str) -> DataFrame:
    # The processor is to see late events too, so it is given the time as a number, which the engine does not filter by.
    marked = events.withWatermark(ts, late)
    return marked.select(*keys, F.unix_millis(ts).alias("at"), "event_id", F.col(what).alias("what")).groupBy(*keys)


def lifecycle_in_time(events: DataFrame, late: str, keep: str | None = None, ts: str = "ts") -> DataFrame:
    """lifecycle() for events that arrive in any order, up to `late` behind the newest: an update whenever the watermark passes events of a listing.

    Events that are later than that come out as rows with late_event_id and change nothing. keep: how long after its last event an archived
    listing is remembered.
    """
    keep_ms = None if keep is None else int(pd.Timedelta(keep).total_seconds() * 1000)
    columns = ["source_id", "key", "status", "consecutive_misses", "late_event_id"]
    grouped = _in_time(events, late, ts, columns[:2], "outcome")
    return grouped.transformWithState(OrderedLifecycle(columns, keep_ms), f"{LISTINGS}, late_event_id long", "Update", "EventTime")


def streaks_in_time(events: DataFrame, late: str, ts: str = "ts") -> DataFrame:
    """streaks() for events that arrive in any order, as lifecycle_in_time()."""
    columns = ["source_id", "consecutive_failures", "late_event_id"]
    return _in_time(events, late, ts, columns[:1], "status").transformWithState(OrderedStreak(columns), f"{STREAKS}, late_event_id long", "Update", "EventTime")


def new_artifacts(events: DataFrame, watermark: str | None = None, ts: str = "ts") -> DataFrame:
    """Each (source_id, content_hash) once: for ever, with state that grows, or within a watermark, with bounded state."""
    keys = ["source_id", "content_hash"]
    if watermark is None:
        return events.dropDuplicates(keys)
    return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


def daily_outcomes(events: DataFrame, late: str = "1 day", ts: str = "ts") -> DataFrame:
    """(day, status, n) of runs by day; rows later than the watermark are dropped."""
    return _counted(events, "1 day", None, late, ts).withColumnRenamed("start", "day")


def weekly_outcomes(events: DataFrame, late: str = "1 day", ts: str = "ts") -> DataFrame:
    """(week, status, n) of runs by week, which its Monday names."""
    return _counted(events, "7 days", "4 days", late, ts).withColumnRenamed("start", "week")  # 1970-01-01 was a Thursday


def _counted(events: DataFrame, every: str, start: str | None, late: str, ts: str) -> DataFrame:
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, every, startTime=start), "status").agg(F.count("*").alias("n"))
    return counted.select(F.to_date("window.start").alias("start"), "status", "n")


def reconcile_onto(observed: Callable[[DataFrame], DataFrame], runs: Callable[[DataFrame], DataFrame], root: str, empty: str, writer: str = "stream") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that reconciles the listings with what each batch observed and with the runs it tells of.

    A batch is committed with its id: one that is repeated after that changes nothing, and one that was stopped before starts from the
    same version again. If another writer was faster, the batch is reconciled with what that one left. empty: the listings' schema.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def after(current: DataFrame | None) -> DataFrame:
            current = spark.createDataFrame([], empty) if current is None else current
            return reconcile(current, observed(batch), runs(batch)).select(*current.columns)

        CommittedTable(spark, root).replace(after, (writer, batch_id))

    return apply


def reconcile_each(apply: Callable[[DataFrame], DataFrame], root: str, writer: str = "stream") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: commits what is made of a batch as the next version, with the batch's id, so that a repeated batch changes nothing."""

    def run(batch: DataFrame, batch_id: int) -> None:
        CommittedTable(batch.sparkSession, root).replace(apply(batch), (writer, batch_id))

    return run
