"""Tasks as state machines over a stream of status events, with leases, retries and writes that a restart does not repeat.

A task goes pending -> parsing -> retrieving -> generating -> completed, or from any of the first four to failed; after either end it may be
submitted (pending) again. An event that asks for anything else is rejected: it comes out marked as such and changes nothing.
A task that is being worked on holds a lease: if no accepted event comes for ``lease`` seconds of event time, it is taken back
(``expired``) and pending again, as long as it has attempts left, else failed.

State is one value a task, in a RocksDB store whose checkpoint is in the stream's own; leases are event-time timers. Each trigger
writes its rows under its own number, so one that is run again after a crash replaces what it wrote, and what counts is what the
readable triggers hold. Rows of one task and one trigger are put in order in memory: ``files_each`` of the source bounds a trigger.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from tessera.functions import constants as K
from tessera.operators.workflow import progress

ORDER = [name for name, _ in K.TASK_STATES if name != "failed"]
WORKED_ON = ORDER[1:-1]
LEASE, LATE, ATTEMPTS = 3600, "10 minutes", 3
OUTPUT = "event_id long, at long, before string, status string, outcome string, attempt int"
STATE = "status string, attempt int, last long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def allowed(before: str | None, status: str | None) -> bool:
    """Whether a task may go from one state to another; ``before`` is None for one not seen yet."""
    if before is None or before in ("completed", "failed"):
        return status == "pending"
    return status == "failed" or status == ORDER[ORDER.index(before) + 1]


State = tuple[str | None, int, int]  # status, attempt, microseconds of the last accepted event
Row = tuple[int | None, int, str | None, str | None, str, int]


def expired(state: State, now: int, lease: int, attempts: int) -> tuple[State, Row] | None:
    """The state after its lease ran out before ``now``, and the row that says so; None if it has not."""
    status, attempt, last = state
    end = last + lease * 1_000_000
    if status not in WORKED_ON or now <= end:
        return None
    left = attempt < attempts
    after = "pending" if left else "failed"
    return (after, attempt + left, end), (None, end, status, after, "expired", attempt + left)


def moves(state: State, events: Iterable[tuple[int, int, str | None]], lease: int, attempts: int) -> tuple[State, list[Row]]:
    """A task's state after its ``events(at, event_id, status)`` in their order, and one row for each of them, besides those for leases that ran out."""
    out: list[Row] = []
    for at, event_id, status in sorted(events, key=lambda e: e[:2]):
        while ended := expired(state, at, lease, attempts):
            state = ended[0]
            out.append(ended[1])
        before, attempt, _ = state
        if allowed(before, status):
            attempt = 1 if before in (None, "completed", "failed") else attempt
            state = (status, attempt, at)
            out.append((event_id, at, before, status, "moved", attempt))
        else:
            out.append((event_id, at, before, status, "rejected", attempt))
    return state, out


class Machine(StatefulProcessor):
    """Keeps one task's state; a timer stands at the end of its lease."""

    def __init__(self, key: str, lease: int, attempts: int):
        self.key, self.lease, self.attempts = key, lease, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", STATE)

    def _held(self) -> State:
        found = self.state.get() if self.state.exists() else None
        return (found[0], int(found[1]), int(found[2])) if found else (None, 0, 0)

    def _keep(self, state: State) -> None:
        self.state.update(state)
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        if state[0] in WORKED_ON:
            self.handle.registerTimer((state[2] + self.lease * 1_000_000) // 1000 + 1)  # the first millisecond behind the lease

    def _frame(self, key: tuple, rows: list[Row]) -> pd.DataFrame:
        columns = [c.split()[0] for c in OUTPUT.split(", ")]
        frame = pd.DataFrame(rows, columns=columns).astype({"event_id": "Int64"})
        frame.insert(0, self.key, key[0])
        return frame

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = [e for part in rows for e in zip(part["at"].tolist(), part["event_id"].tolist(), part["status"].tolist(), strict=True)]
        state, out = moves(self._held(), events, self.lease, self.attempts)
        if state[0] is not None:
            self._keep(state)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, out = self._held(), []
        while ended := expired(state, timerValues.getCurrentWatermarkInMs() * 1000, self.lease, self.attempts):
            state = ended[0]
            out.append(ended[1])
        if out:
            self._keep(state)
            yield self._frame(key, out)

    def close(self) -> None:
        pass


def track(events: DataFrame, key: str = "task_id", lease: int = LEASE, late: str = LATE, attempts: int = ATTEMPTS) -> DataFrame:
    """What becomes of a stream of ``events(<key>, event_id, ts, status)``: ``<key>, event_id, at`` (microseconds), ``before, status, outcome, attempt``.

    One row for each event (``moved`` or ``rejected``) and one for each lease that ran out (``expired``, without an event). Events without a key or a
    time are left out, as no task or no moment is theirs; a null status is rejected, a null event id counts as -1. Events more than ``late`` behind the newest are dropped.
    """
    rows = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(key, F.coalesce("event_id", F.lit(-1)).cast("long").alias("event_id"), "ts", "status", F.unix_micros("ts").alias("at")).withWatermark("ts", late)
    kind = events.schema[key].dataType.simpleString()
    return rows.groupBy(key).transformWithStateInPandas(Machine(key, lease, attempts), f"{key} {kind}, {OUTPUT}", "append", "EventTime")


@contextmanager
def rocks(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which this kind of state needs; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def numbered_writes(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A stream whose trigger ``n`` writes ``path/trigger=n``, whole or not at all: a trigger that is run again replaces its rows."""

    def keep(part: DataFrame, number: int) -> None:
        part.write.mode("overwrite").parquet(f"{path}/trigger={number}")

    return rows.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def history(spark: SparkSession, path: str) -> DataFrame:
    """All triggers' rows, with their ``trigger``."""
    return spark.read.option("basePath", path).parquet(f"{path}/trigger=*")


def current(rows: DataFrame, key: str = "task_id") -> DataFrame:
    """``<key>, status, progress, attempt, n_events, n_rejected, n_expired``: where each task of ``history`` stands. A lease that ends at the moment of
    an event ended before it. Aggregates only, so a task of many events costs no more memory than another."""
    changed = F.col("outcome") != "rejected"
    place = F.struct("at", F.coalesce("event_id", F.lit(-(1 << 62))))
    last = F.max_by(F.struct("status", "attempt"), F.when(changed, place))
    got = rows.groupBy(key).agg(
        last.alias("l"), F.count("event_id").alias("n_events"), F.count_if(F.col("outcome") == "rejected").alias("n_rejected"), F.count_if(F.col("outcome") == "expired").alias("n_expired")
    )
    return got.select(key, "l.status", progress(F.col("l.status")).alias("progress"), "l.attempt", "n_events", "n_rejected", "n_expired")
