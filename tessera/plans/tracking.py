"""Queries over tasks that are followed as state machines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import remove, shared_folder, table
from tessera.streaming import feeds, tasks

LEASE, ATTEMPTS = 86_400, 3


def as_tasks(events: DataFrame) -> DataFrame:
    """Events of users as status events of tasks: what kind it is says which state is asked for."""
    status = (
        F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "signup", "parsing").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed")
        .when(F.col("value") > 50, "generating").otherwise("retrieving")
    )
    return events.select(F.col("user_id").alias("task_id"), "event_id", "ts", status.alias("status"))


def task_machine(spark: SparkSession, d: str) -> DataFrame:
    """Where each task stands after all its events, run as a stream: legal moves, rejected ones, leases that ran out."""
    base = f"{shared_folder(spark)}/tasks-{uuid.uuid4().hex}"
    events = as_tasks(feeds.read_events(spark, f"{d}/events.parque[t]", table(spark, d, "events").schema))
    with tasks.rocks(spark):
        run = tasks.numbered_writes(tasks.track(events, lease=LEASE, attempts=ATTEMPTS), f"{base}/history", f"{base}/state").start()
    run.awaitTermination()
    remove(spark, f"{base}/state")
    return tasks.current(tasks.history(spark, f"{base}/history"))


QUERIES = {"stream_task_machine": task_machine}

ORACLE = {
    "stream_task_machine": """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
    CASE event_type WHEN 'view' THEN 'pending' WHEN 'signup' THEN 'parsing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE CASE WHEN value > 50 THEN 'generating' ELSE 'retrieving' END END AS asked FROM events),
  s(user_id, n, status, attempt, last, rejected, expired) AS (
    SELECT DISTINCT user_id, 0::BIGINT, NULL::VARCHAR, 0, 0::BIGINT, 0, 0 FROM events
    UNION ALL
    SELECT user_id, n, CASE WHEN ok THEN asked ELSE st END, CASE WHEN ok AND coalesce(st, 'failed') IN ('completed', 'failed') THEN 1 ELSE att END, CASE WHEN ok THEN t ELSE la END, CASE WHEN ok THEN 0 ELSE 1 END, x FROM (
      SELECT *, CASE WHEN coalesce(st, 'failed') IN ('completed', 'failed') THEN asked = 'pending' ELSE asked = 'failed'
          OR list_position(['pending', 'parsing', 'retrieving', 'generating', 'completed'], asked) = list_position(['pending', 'parsing', 'retrieving', 'generating', 'completed'], st) + 1 END AS ok FROM (
        SELECT user_id, n, t, asked, x, CASE WHEN x = 0 THEN status WHEN attempt < 3 THEN 'pending' ELSE 'failed' END AS st, CASE WHEN x = 1 AND attempt < 3 THEN attempt + 1 ELSE attempt END AS att,
          CASE WHEN x = 1 THEN last + 86400000000 ELSE last END AS la FROM (
          SELECT s.user_id, e.n, e.t, e.asked, s.status, s.attempt, s.last, CASE WHEN s.status IN ('parsing', 'retrieving', 'generating') AND e.t > s.last + 86400000000 THEN 1 ELSE 0 END AS x
          FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)))),
  f AS (SELECT user_id, max_by(status, n) AS status, max_by(attempt, n) AS attempt, max_by(last, n) AS last, max(n) AS n_events, CAST(sum(rejected) AS BIGINT) AS n_rejected, CAST(sum(expired) AS BIGINT) AS n_expired FROM s GROUP BY user_id),
  g AS (SELECT *, CASE WHEN status IN ('parsing', 'retrieving', 'generating') AND (SELECT max(t) // 1000 - 600000 FROM e) * 1000 > last + 86400000000 THEN 1 ELSE 0 END AS x FROM f),
  h AS (SELECT user_id AS task_id, CASE WHEN x = 0 THEN status WHEN attempt < 3 THEN 'pending' ELSE 'failed' END AS status, attempt + CASE WHEN x = 1 AND attempt < 3 THEN 1 ELSE 0 END AS attempt, n_events, n_rejected, n_expired + x AS n_expired FROM g)
  SELECT task_id, status, CASE status WHEN 'parsing' THEN 20 WHEN 'retrieving' THEN 50 WHEN 'generating' THEN 80 WHEN 'completed' THEN 100 ELSE 0 END AS progress, attempt, n_events, n_rejected, n_expired FROM h""",
}
