"""Column functions over JSON, dates, numbers and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import constants as K


def json_text(answer: Column) -> Column:
    """JSON out of a model's answer: the fenced block if there is one, else the whole text, trimmed."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.btrim(F.coalesce(F.nullif(fenced, F.lit("")), answer), F.lit(" \t\r\n"))


def safe_json(answer: Column, schema: str) -> Column:
    """Struct of ``value``, ``parse_error`` and, on an error, the untouched ``raw_output``."""
    value = F.try_parse_json(json_text(answer))
    failed = value.isNull()
    return F.struct(F.when(~failed, F.from_json(json_text(answer), schema)).alias("value"), failed.alias("parse_error"), F.when(failed, answer).alias("raw_output"))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def project_end(start: Column, months: Column) -> Column:
    """Start (date text or date) plus months, the day capped at 28 in every month; null for an invalid start."""
    day = F.try_to_date(F.left(start.cast("string"), F.lit(10)), "yyyy-MM-dd")
    index = F.month(day) - 1 + months
    return F.make_date((F.year(day) + F.floor(index / 12)).cast("int"), (F.pmod(index, F.lit(12)) + 1).cast("int"), F.least(F.day(day), F.lit(28)))


def quotation_number(day: Column, name: Column) -> Column:
    """yy + four digits of a stable hash of the project's name + B000."""
    return F.concat(F.date_format(day, "yy"), F.lpad((F.conv(F.left(F.md5(name.cast("binary")), F.lit(8)), 16, 10).cast("long") % 10000).cast("string"), 4, "0"), F.lit("B000"))


def score(distance: Column) -> Column:
    """1 - distance, within 0 and 1, two decimals."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance)), 2)


def clamp_months(months: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.coalesce(months, F.lit(K.DEFAULT_MONTHS)), F.lit(K.MONTH_SLOTS)))


def full_time(days: Column, months: Column) -> Column:
    """People needed in each month of a project to work ``days`` days, one decimal; 0 for no days."""
    return F.when(days > 0, F.round(days / clamp_months(months) / K.WORK_DAYS_PER_MONTH, 1)).otherwise(0.0)


def monthly(days: Column, months: Column) -> Column:
    """Array of ``MONTH_SLOTS`` months: ``full_time`` in the project's months, then 0."""
    m = clamp_months(months)
    return F.concat(F.array_repeat(full_time(days, months), m), F.array_repeat(F.lit(0.0), F.lit(K.MONTH_SLOTS) - m))


def scale(values: Column, factor: Column) -> Column:
    return F.transform(values, lambda v: F.round(v * factor, 1))


def row_total(values: Column) -> Column:
    """Sum over the months, missing ones as 0, rounded once."""
    return F.round(F.aggregate(values, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))), 1)


def remap_timeline(values: Column, months: Column) -> Column:
    """Specified only: the values of a baseline timeline read at as many evenly spaced places as the project has months."""
    n = F.size(values)
    return F.transform(F.sequence(F.lit(0), months - 1), lambda i: F.get(values, F.least(n - 1, F.floor(i * n / months).cast("int"))))


def percent_text(ratio: Column) -> Column:
    return F.concat(F.round(ratio * 100).cast("long").cast("string"), F.lit("%"))


def percent_value(text: Column) -> Column:
    """"+8%" -> 8.0; null where it is no number."""
    return F.regexp_replace(text, "[+%]", "").try_cast("double")


def bytes_text(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024.0)).otherwise(F.format_string("%.1f MB", n / 1024.0 / 1024.0))
    )


def coverage_bucket(ratio: Column) -> Column:
    return F.when(ratio >= 0.7, "high").when(ratio >= 0.4, "medium").otherwise("low")


def without(scope: Column, covered: Column) -> Column:
    """Ordered difference: what of ``scope`` is not covered, order and repeats kept (``array_except`` would drop repeats)."""
    gone = F.coalesce(covered, F.array().cast("array<string>"))
    return F.filter(F.coalesce(scope, F.array().cast("array<string>")), lambda x: ~F.array_contains(gone, x))


def overlay(base: Column, changes: Column) -> Column:
    """Map union in which later values win."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(changes, k)), changes)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def first_places(items: Column, n: int = 2) -> Column:
    """The non-empty ones of the first ``n`` items: cut first, then drop."""
    return F.filter(F.slice(items, 1, n), lambda x: x.isNotNull() & (x != ""))


def compact_milestones(dates: Column) -> Column:
    """Array of (key, date) in the fixed order of milestone columns, the missing ones skipped."""
    slots = F.array(*(F.struct(F.lit(k).alias("milestone"), F.try_element_at(dates, F.lit(k)).alias("date")) for k in K.MILESTONE_COLUMNS))
    return F.filter(slots, lambda s: s["date"].isNotNull())


def step_status(done: Column, current: Column) -> Column:
    """Array of done flags and the place of the current step -> finish, process or wait for each."""
    return F.transform(done, lambda d, i: F.when(d, "finish").when(i == current, "process").otherwise("wait"))
