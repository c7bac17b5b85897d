"""The comparison matrix: dimensions by projects, with derived rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import constants as K


def cells(projects: DataFrame, dimensions: list[str]) -> DataFrame:
    """Long cells ``dim_ord, dimension, proj_ord, project_name, value, match`` of projects with ``dimensions`` (map of name
    to (value, match)), ``summary``, ``actual_man_days`` and ``deviation_rate``.

    The list of dimensions is a parameter, so each project row is expanded in place; there is no cross join.
    """
    cell = lambda i, name, value, match: F.struct(F.lit(i).alias("dim_ord"), F.lit(name).alias("dimension"), value.alias("value"), match.alias("match"))
    none = F.lit(None).cast("boolean")
    rows = []
    for i, d in enumerate(dimensions):
        found = F.try_element_at("dimensions", F.lit(d))
        rows.append(cell(i, d, F.coalesce(found["value"], F.lit(K.UNKNOWN)), found["match"]))
    n = len(dimensions)
    rows.append(cell(n, K.SUMMARY_ROW, F.coalesce("summary", F.lit("")), none))
    rows.append(cell(n + 1, K.MAN_DAYS_ROW, F.coalesce(F.col("actual_man_days").cast("string"), F.lit(K.DASH)), none))
    rows.append(cell(n + 2, K.DEVIATION_ROW, F.coalesce("deviation_rate", F.lit(K.DASH)), none))
    return projects.select("proj_ord", "project_name", F.inline(F.array(*rows)))


def nest(long: DataFrame, group: list[str]) -> DataFrame:
    """One row per group and dimension with ``history``, its cells in project order (as many as projects compared)."""
    cell = F.struct("proj_ord", "project_name", "value", "match")
    return long.groupBy(*group, "dim_ord", "dimension").agg(F.array_sort(F.collect_list(cell)).alias("history"))


def with_new_project(rows: DataFrame, profile: dict[str, str]) -> DataFrame:
    """``rows`` and ``new_project``: the profile's value, 未知 without one; derived rows have their own placeholders."""
    fixed = {K.SUMMARY_ROW: K.DASH, K.MAN_DAYS_ROW: K.TO_PREDICT, K.DEVIATION_ROW: K.DASH}
    values = F.create_map(*(F.lit(x) for kv in (profile | fixed).items() for x in kv))
    return rows.withColumn("new_project", F.coalesce(F.try_element_at(values, F.col("dimension")), F.lit(K.UNKNOWN)))
