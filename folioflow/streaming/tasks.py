"""The task queue as state of a stream: leases that run out, retries with back-off, dead letters, quarantine, cursors.

Events of one task, or of one source, meet in the state of their key and nowhere else, so the queue is as wide as its keys.
Times are the events' own; a lease runs out when the watermark passes it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds before the first retry are twice START; they double and don't pass LIMIT.
BACKOFF_START, BACKOFF_LIMIT = 60, 14400
#: Times are milliseconds inside, so that no zone of a worker's matters.
TASKS = "task_id string, source_id string, at long, status string, attempt int, run_at long, worker string"
SOURCES = "source_id string, at long, status string, streak int, last_key string, last_date date, empty_runs int"


class TaskState(StatefulProcessor):
    """One task. Events (kind, at, worker): planned; leased, which holds if the task waits and its time has come, or if its
    lease ran out; heartbeat and done and failed, which only the worker that holds the lease may send. A failure is tried
    again after 60 * 2^n seconds, four hours at most, until the attempts are used up."""

    def __init__(self, lease_seconds: int, attempts: int):
        self.lease, self.attempts = 1000 * max(60, lease_seconds), attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", "source_id string, status string, attempt int, run_at long, until long, worker string")

    def _free(self, until: int | None) -> None:
        if until is not None and until in {t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()}:
            self.handle.deleteTimer(until)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        task = self.state.get() if self.state.exists() else None
        source, status, attempt, run_at, until, worker = task if task else (None, None, 0, None, None, None)
        told = []
        for r in sorted(rows, key=lambda r: (r.ms, r.kind, r.worker or "")):
            now, before = r.ms, status
            holds = status == "running" and r.worker == worker and until > now
            if r.kind == "planned" and status is None:
                source, status, run_at = r.source_id, "pending", now
            elif r.kind == "leased" and ((status == "pending" and run_at <= now) or (status == "running" and until <= now)):
                self._free(until)
                before, status, worker, until = None, "running", r.worker, now + self.lease
                self.handle.registerTimer(until)
            elif r.kind == "heartbeat" and holds:
                self._free(until)
                until = now + self.lease
                self.handle.registerTimer(until)
            elif r.kind == "done" and holds:
                self._free(until)
                status, until, worker = "succeeded", None, None
            elif r.kind == "failed" and holds:
                self._free(until)
                attempt, until, worker = attempt + 1, None, None
                status, run_at = ("pending", now + 1000 * min(BACKOFF_START * 2**attempt, BACKOFF_LIMIT)) if attempt < self.attempts else ("dead_letter", run_at)
            if status != before:
                told.append(Row(task_id=key[0], source_id=source, at=now, status=status, attempt=attempt, run_at=run_at, worker=worker))
        if status is not None:
            self.state.update((source, status, attempt, run_at, until, worker))
        yield from told

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        source, status, attempt, run_at, until, _ = self.state.get()
        if status == "running" and until == at:
            self.state.update((source, "pending", attempt, at, None, None))
            yield Row(task_id=key[0], source_id=source, at=at, status="pending", attempt=attempt, run_at=at, worker=None)

    def close(self) -> None:
        pass


def task_states(events: DataFrame, lease_seconds: int = 900, attempts: int = 3, late: str = "0 seconds") -> DataFrame:
    """A row for every change of a task's status, from a stream of events (task_id, source_id, kind, at, worker). Events that
    mean nothing in the task's status change nothing; rows without a task or a time are left out."""
    timed = events.where("task_id IS NOT NULL AND at IS NOT NULL").withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    out = timed.groupBy("task_id").transformWithState(TaskState(lease_seconds, attempts), outputStructType=TASKS, outputMode="Update", timeMode="EventTime")
    return out.withColumn("at", F.timestamp_millis("at")).withColumn("run_at", F.timestamp_millis("run_at"))


class SourceState(StatefulProcessor):
    """One source: how many of its tasks died in a row, and the cursor of its last run."""

    def __init__(self, streak: int):
        self.most = streak

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("source", "status string, streak int, last_key string, last_date date, empty_runs int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        status, streak, last_key, last_date, empty = self.state.get() if self.state.exists() else ("active", 0, None, None, 0)
        for r in sorted(rows, key=lambda r: (r.ms, r.status)):
            if r.status == "resumed":
                status, streak = "active", 0
            elif r.status == "dead_letter":
                streak += 1
                status = "manual_recovery" if streak >= self.most else status
            elif r.status == "succeeded":
                streak = 0
                if r.found:
                    last_key, empty = r.last_key, 0
                    last_date = max((d for d in (last_date, r.last_date) if d is not None), default=None)
                else:
                    empty += 1
            yield Row(source_id=key[0], at=r.ms, status=status, streak=streak, last_key=last_key, last_date=last_date, empty_runs=empty)
        self.state.update((status, streak, last_key, last_date, empty))

    def close(self) -> None:
        pass


def source_states(outcomes: DataFrame, streak: int = 5) -> DataFrame:
    """Status, streak of dead letters and cursor of each source after every outcome (source_id, at, status, found, last_key,
    last_date): after `streak` dead tasks in a row it waits for someone, until it is resumed. A run that found nothing counts
    as empty and leaves the cursor; a date never goes back. Rows without a source or a time are left out."""
    known = outcomes.where("source_id IS NOT NULL AND at IS NOT NULL").withColumn("found", F.coalesce("found", F.lit(0))).withColumn("ms", F.unix_millis("at"))
    out = known.groupBy("source_id").transformWithState(SourceState(streak), outputStructType=SOURCES, outputMode="Update", timeMode="None")
    return out.withColumn("at", F.timestamp_millis("at"))
