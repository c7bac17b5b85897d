"""Aggregates over hits, plans and evaluations. All combine on the map side; none gathers a group's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import constants as K


def confidence(n: Column, top: Column) -> Column:
    """High: three scores or more and 0.85 reached; medium: 0.70 reached; else (also without scores) low."""
    return F.when((n >= 3) & (top >= 0.85), K.HIGH).when((n >= 1) & (top >= 0.70), K.MEDIUM).otherwise(K.LOW)


def confidence_by(scores: DataFrame, key: str, score: str) -> DataFrame:
    got = scores.groupBy(key).agg(F.count(score).alias("n_scores"), F.max(score).alias("max_score"))
    return got.withColumn("confidence", confidence(F.col("n_scores"), F.col("max_score")))


def lacks_evidence(n: Column, top: Column, least: float = 0.65) -> Column:
    """Specified only: no hit, or none scored ``least``."""
    return (n == 0) | (F.coalesce(top, F.lit(0.0)) < least)


def coverage(hits: DataFrame, key: str, functions: str) -> DataFrame:
    """The sorted distinct functions of each key's hits; the set is as small as the list of functions."""
    pairs = hits.select(key, F.explode(functions).alias("_f")).where("_f is not null").distinct()
    return pairs.groupBy(key).agg(F.array_sort(F.collect_set("_f")).alias("covered"))


def coverage_ratios(hits: DataFrame, functions: str, names: list[str]) -> DataFrame:
    """Share of rows whose array holds each name: ``function, ratio``."""
    got = hits.agg(*(F.avg(F.coalesce(F.array_contains(functions, n), F.lit(False)).cast("int")).alias(f"_{i}") for i, n in enumerate(names)))
    return got.select(F.inline(F.array(*(F.struct(F.lit(n).alias("function"), F.col(f"_{i}").alias("ratio")) for i, n in enumerate(names)))))


def store_stats(docs: DataFrame, chunks: Column, project: str) -> DataFrame:
    """Documents, chunks (ten a document where unknown) and projects of a store."""
    return docs.agg(F.count("*").alias("n_documents"), F.sum(F.coalesce(chunks, F.lit(10))).alias("n_chunks"), F.count_distinct(project).alias("n_projects"))


def function_totals(cells: DataFrame, key: str = "function", value: str = "fte") -> DataFrame:
    """Total of each function over positions and months, rounded at the end."""
    return cells.groupBy(key).agg(F.round(F.sum(value), 1).alias("total"))


def module_summary(rows: DataFrame) -> DataFrame:
    """Specified only: whether a module is needed and how many of its dimensions are in scope."""
    return rows.groupBy("module").agg(F.bool_or(F.coalesce("in_scope", F.lit(False))).alias("needed"), F.count_if("in_scope").alias("in_scope_count"))


def pass_rates(rows: DataFrame, **tests: Column) -> DataFrame:
    """Share of rows that pass each test, null counting as failed."""
    return rows.agg(F.count("*").alias("n"), *(F.avg(F.coalesce(t, F.lit(False)).cast("int")).alias(name) for name, t in tests.items()))
