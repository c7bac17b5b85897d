"""Staffing plans: baseline positions by month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions.values import monthly, row_total, scale


def baseline(spark: SparkSession) -> DataFrame:
    """The fixed baseline: ``baseline_key, function, pos_ord, position, tariff, share, total_days``."""
    days = dict(K.BASELINE_DAYS)
    rows = [(k, f, i, p, t, s, days[f]) for k in K.BASELINE_KEYS for i, (f, p, t, s) in enumerate(K.BASELINE_POSITIONS)]
    return spark.createDataFrame(rows, "baseline_key string, function string, pos_ord int, position string, tariff string, share double, total_days double")


def plan(projects: DataFrame, positions: DataFrame) -> DataFrame:
    """Projects ``(project_id, baseline_key, months, is_complex)`` with their baseline's positions and ``monthly`` (20 values).

    A complex project takes 1.1 times the days. The fixed baseline is a few rows, so the join broadcasts it.
    """
    factor = F.when(F.col("is_complex"), K.COMPLEX_FACTOR).otherwise(1.0)
    joined = projects.join(positions, "baseline_key")
    values = scale(monthly(F.col("total_days") * factor, F.col("months")), F.col("share"))
    return joined.withColumn("monthly", values).withColumn("row_total", row_total(F.col("monthly")))


def months_long(planned: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, month (from 1), fte``: one row for each month of a plan."""
    return planned.select(*keys, F.posexplode("monthly").alias("_m", "fte")).withColumn("month", F.col("_m") + 1).drop("_m")


def complexity(modules: str = "modules"):
    """Whether any module is of high complexity."""
    return F.exists(modules, lambda m: m["complexity"] == K.HIGH)


def remapped(cells: DataFrame, segments: DataFrame, project: str, keys: list[str]) -> DataFrame:
    """Specified only: ``<keys>, month, fte`` of plans moved to another timeline, segment by segment, with their totals kept to a tenth.

    ``cells(<keys>, month, fte)``: month ``m`` is the time from ``m - 1`` to ``m``, and ``project`` one of the keys. ``segments(<project>, old_from, old_to, new_from,
    new_to)`` say, in months, where each stretch between two milestones goes; work is spread evenly over its new stretch, so a stretch that becomes
    shorter is worked by more people. All of a stretch without length goes to the month that it lies in (the first, at a border). What no segment covers is left out, stretches may not overlap.
    Tenths come from rounding the sums up to each month, so each row's total is that of its covered cells, rounded once.
    """
    c = cells.where("fte <> 0").join(segments, project).where((F.col("month") - 1 < F.col("old_to")) & (F.col("month") > F.col("old_from")))
    low, high = F.greatest(F.col("month") - 1, F.col("old_from")), F.least(F.col("month"), F.col("old_to"))
    rate = (F.col("new_to") - F.col("new_from")) / (F.col("old_to") - F.col("old_from"))
    moved = c.select(*keys, (F.col("fte") * (high - low)).alias("work"), (F.col("new_from") + (low - F.col("old_from")) * rate).alias("low"), (F.col("new_from") + (high - F.col("old_from")) * rate).alias("high"))
    moved = moved.withColumns({"low": F.round("low", 9), "high": F.round("high", 9)})  # a border is a border
    none = F.col("high") <= F.col("low")
    first = F.when(none, F.greatest(F.ceil("low"), F.lit(1))).otherwise(F.floor("low") + 1)
    spread = moved.withColumn("to", F.explode(F.sequence(first, F.when(none, first).otherwise(F.ceil("high")))))
    inside = (F.least("to", "high") - F.greatest(F.col("to") - 1, F.col("low"))) / (F.col("high") - F.col("low"))
    sums = spread.groupBy(*keys, F.col("to").cast("int").alias("month")).agg(F.sum(F.col("work") * F.when(none, 1.0).otherwise(inside)).alias("work"))
    order = Window.partitionBy(*keys).orderBy("month")  # the months of one row of a plan
    tenths = F.round(F.round(F.sum("work").over(order) * 10, 6))
    counted = sums.withColumn("tenths", tenths)
    return counted.select(*keys, "month", F.round((F.col("tenths") - F.coalesce(F.lag("tenths").over(order), F.lit(0.0))) / 10, 1).alias("fte"))
