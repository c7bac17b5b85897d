"""Task state machines: legal moves, leases, restarts and crashes against a plain replay."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.streaming import tasks

LEASE, ATTEMPTS = 600, 2
SCHEMA = "task_id long, event_id long, ts timestamp, status string"
SECOND = 1_000_000


def test_moves_and_leases():
    chain = [(k * SECOND, k, s) for k, s in enumerate(tasks.ORDER)]
    state, rows = tasks.moves((None, 0, 0), chain, LEASE, ATTEMPTS)
    assert state == ("completed", 1, 4 * SECOND) and [r[4] for r in rows] == ["moved"] * 5
    state, rows = tasks.moves(state, [(9 * SECOND, 9, "parsing"), (10 * SECOND, 10, None), (11 * SECOND, 11, "pending"), (12 * SECOND, 12, "generating")], LEASE, ATTEMPTS)
    assert state == ("pending", 1, 11 * SECOND) and [r[4] for r in rows] == ["rejected", "rejected", "moved", "rejected"]
    late = [(12 * SECOND, 1, "parsing"), (700 * SECOND, 2, "retrieving"), (701 * SECOND, 3, "parsing"), (1400 * SECOND, 4, "pending")]
    state, rows = tasks.moves(state, late, LEASE, ATTEMPTS)
    assert [(r[1] // SECOND, r[2], r[3], r[4], r[5]) for r in rows] == [
        (12, "pending", "parsing", "moved", 1), (612, "parsing", "pending", "expired", 2), (700, "pending", "retrieving", "rejected", 2), (701, "pending", "parsing", "moved", 2),
        (1301, "parsing", "failed", "expired", 2), (1400, "failed", "pending", "moved", 1),
    ]
    assert not any(tasks.allowed(None, s) for s in (*tasks.ORDER[1:], "failed", None, "odd")) and tasks.allowed("generating", "failed")


@pytest.fixture(scope="module")
def events():
    """Tasks in time order, one of them with a third of all events."""
    rng = random.Random(11)
    rows, now = [], 1_700_000_000
    for k in range(900):
        now += rng.randrange(1, 60)
        task = 1 if k % 3 == 0 else rng.randrange(2, 12)
        rows.append((task, k, now, rng.choice([*tasks.ORDER, "failed", None, "odd"]) if k % 4 else tasks.ORDER[k // 4 % 5]))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "task_id long, event_id long, s long, status string").select("task_id", "event_id", F.timestamp_seconds("s").alias("ts"), "status")


def replay(rows):
    """What each task's events give when all are there at once, and leases that ran out by the end's watermark."""
    by, out = {}, set()
    for task, event_id, s, status in rows:
        by.setdefault(task, []).append((s * SECOND, event_id, status))
    end = max(r[2] for r in rows) * SECOND - 600 * SECOND
    for task, own in by.items():
        state, found = tasks.moves((None, 0, 0), own, LEASE, ATTEMPTS)
        if ended := tasks.expired(state, end, LEASE, ATTEMPTS):
            found.append(ended[1])
        out |= {(task, *r) for r in found}
    return out


def rows_of(spark, path):
    got = tasks.history(spark, path).select("task_id", "event_id", "at", "before", "status", "outcome", "attempt").collect()
    assert len(got) == len({tuple(r) for r in got})  # nothing twice
    return {tuple(r) for r in got}


def start(spark, source, base, write=None):
    stream = tasks.track(spark.readStream.schema(SCHEMA).parquet(source), lease=LEASE, attempts=ATTEMPTS)
    with tasks.rocks(spark):
        if write:
            run = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        else:
            run = tasks.numbered_writes(stream, f"{base}/history", f"{base}/state").start()
    run.awaitTermination()


def test_a_restart_goes_on_where_it_stopped(spark, events, tmp_path):
    base, source = str(tmp_path), str(tmp_path / "source")
    for part in (events[:400], events[400:]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
        start(spark, source, base)
    assert rows_of(spark, f"{base}/history") == replay(events)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != tasks.ROCKS
    stands = {r.task_id: r for r in tasks.current(tasks.history(spark, f"{base}/history")).collect()}
    assert stands[1].n_events == 300 and sum(r.n_events for r in stands.values()) == 900
    assert sum(r.n_rejected for r in stands.values()) == sum(r[5] == "rejected" for r in replay(events))


def test_a_crash_between_write_and_commit_repeats_nothing(spark, events, tmp_path):
    base, source = str(tmp_path), str(tmp_path / "source")
    frame(spark, events[:500]).coalesce(1).write.parquet(source)

    def crash(part, number):
        part.write.mode("overwrite").parquet(f"{base}/history/trigger={number}")
        raise RuntimeError("lost after the write")

    with pytest.raises(Exception, match="lost after the write"):
        start(spark, source, base, crash)
    assert tasks.history(spark, f"{base}/history").count() >= 500  # written, not committed
    frame(spark, events[500:]).coalesce(1).write.mode("append").parquet(source)
    start(spark, source, base)
    assert rows_of(spark, f"{base}/history") == replay(events)


def test_odd_events(spark, tmp_path):
    base, source = str(tmp_path), str(tmp_path / "source")
    rows = [(None, 1, 10, "pending"), (1, 2, None, "pending"), (1, None, 10, "pending"), (1, 3, 11, None), (2, 4, 10, "pending"), (2, 4, 10, "pending")]
    frame(spark, rows).coalesce(1).write.parquet(source)
    start(spark, source, base)
    got = [(r.task_id, r.event_id, r.status, r.outcome) for r in tasks.history(spark, f"{base}/history").collect()]
    assert sorted(got, key=str) == [(1, -1, "pending", "moved"), (1, 3, None, "rejected"), (2, 4, "pending", "moved"), (2, 4, "pending", "rejected")]
