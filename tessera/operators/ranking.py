"""Latest rows, numbering, paging and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import cut


def recent(tasks: DataFrame, limit: int = 20, unique: bool = True) -> DataFrame:
    """The newest tasks; ``unique``: the newest of each file among the newest ``5 * limit`` (1 to 100), at most ``limit``."""
    order = [F.desc("created_at"), F.asc("task_id")]
    if not unique:
        return tasks.orderBy(*order).limit(max(1, min(limit, 100)))
    few = tasks.orderBy(*order).limit(max(1, min(limit * 5, 100)))
    newest = few.withColumn("_n", F.row_number().over(Window.partitionBy("file_name").orderBy(*order))).where("_n = 1").drop("_n")
    return newest.orderBy(*order).limit(limit)


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of every key that is largest by the columns ``order``: the exact form of ``recent``, without a limit before it.
    An aggregate, so rows fall together before the shuffle however many a key has."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_last"))
    return best.select("_last.*")


def by_ratio(rows: DataFrame, ratio: str, name: str) -> DataFrame:
    """Rows by falling ratio, null last, ties by name."""
    return rows.orderBy(F.desc_nulls_last(ratio), name)


def top_of_each(rows: DataFrame, key: str | list[str], order: list, n: int) -> DataFrame:
    """The ``n`` first rows of each key by ``order``, with ``rank`` (give a total order, else ties are arbitrary). Every task keeps the ``n`` first of its own
    rows of a key before the shuffle, so a key with most of the rows brings no more than that from each."""
    window = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def top_with_warning(hits: DataFrame, key: str, order: list, n: int = 3) -> DataFrame:
    """Specified only: the ``n`` first hits of each key, with ``rank`` and ``warning`` where there are fewer than ``n``: a key has fewer if
    its last rank is lower, so nothing but the few ranked rows is counted."""
    ranked = top_of_each(hits, key, order, n)
    few = F.count("*").over(Window.partitionBy(key)) < n
    return ranked.withColumn("warning", F.when(few, F.concat(F.lit("fewer than "), F.lit(str(n)), F.lit(" similar projects"))))


def argmax_first(rows: DataFrame, key: str, score: Column, order: str, value: str) -> DataFrame:
    """The value with the largest score (null as 0) of each key, the first by ``order`` (a number) on ties."""
    best = F.max_by(value, F.struct(F.coalesce(score, F.lit(0.0)), -F.col(order)))
    return rows.groupBy(key).agg(best.alias(value), F.max(F.coalesce(score, F.lit(0.0))).alias("max_score"))


def numbered(rows: DataFrame, order: list, within: str | list[str] | None = None, name: str = "no") -> DataFrame:
    """Consecutive numbers from 1 by ``order`` within each group (``within``; null is a group of its own), or over all rows.

    Rows are dealt into ranges of the order and numbered inside each. A group that goes over several ranges counts on from its rows in the
    earlier ones, so neither a large group nor the whole table has to fit one task. The ranges are kept in a checkpoint, as sampled bounds
    differ from run to run. ``rows`` are computed twice (sample and shuffle): write them first if they are dear. Rows equal by
    ``order`` share a range and are numbered in any order: give a total order.
    """
    groups = [] if within is None else [within] if isinstance(within, str) else list(within)
    sort = [*(F.asc_nulls_first(g) for g in groups), *order]
    ranged = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    made = cut(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_key", F.struct(F.shiftright("_at", 33).alias("_range"), *groups)))  # a struct, so that null groups meet
    runs = made.groupBy("_key").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*(F.col("_key")[g] for g in groups)).orderBy("_key._range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range and group
    runs = runs.select("_key", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return made.join(runs, "_key").withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_key", "_shift")


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def queue(tasks: DataFrame, group: str, submitted: list, seconds_each: int) -> DataFrame:
    """Specified only: the place of queued tasks in their group's queue and the seconds until their turn."""
    return numbered(tasks, submitted, group, "position").withColumn("eta_seconds", (F.col("position") - 1) * seconds_each)


def status_durations(events: DataFrame, key: str, ts: Column, order: list) -> DataFrame:
    """Seconds between each status and the one before it of the same key (null for the first)."""
    window = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("seconds", ts.cast("long") - F.lag(ts.cast("long")).over(window))
