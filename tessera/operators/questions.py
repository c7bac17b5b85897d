"""Question lists: merging, removing near-equal ones and numbering anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import numbered
from tessera.operators.similarity import similar_classes
from tessera.sources.tables import written

SIMILAR = 0.8


def question_key(question: Column) -> Column:
    """Letters and digits of the lower-cased question: what equal questions share."""
    return F.regexp_replace(F.lower(question), r"[^\p{L}\p{N}]+", "")


def merge(rows: DataFrame, area: str, question: str, source: str, order: list[str]) -> DataFrame:
    """Specified only: one row for each area and question key: the most complete (longest) question, then the first by
    ``order``; ``merged_from`` the sorted sources, ``n_merged`` how many rows. Aggregates combine before the shuffle."""
    best = F.min_by(question, F.struct(-F.length(question), *order))
    return (
        rows.groupBy(F.col(area).alias("area"), question_key(F.col(question)).alias("question_key"))
        .agg(best.alias("question"), F.array_sort(F.collect_set(source)).alias("merged_from"), F.count("*").alias("n_merged"))
    )


def question_words(question: Column) -> Column:
    """The different words (runs of letters and digits) of the lower-cased question, sorted; empty for null."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(question, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")))


def similar_questions(rows: DataFrame, area: str, question: str, order: list[str], at_least: float = SIMILAR) -> DataFrame:
    """Specified only: ``rows`` with what they were merged into: ``no`` (the number of the kept question in its area), ``kept`` (whether this row is
    the one that stays) and ``n_merged`` (rows merged into it). Where the rows have such columns already, these are replaced.

    Questions of an area are near-equal if their words, as sets, have a Jaccard coefficient of ``at_least`` or more, or are joined by
    others that are. Of each class the most complete (longest) question stays, then the first by ``order`` (give a total order: rows
    equal by it all stay). Kept questions are numbered by their place in ``order``. Null questions have no words, and those are one class;
    a null area is an area. Every row comes back, so what was merged is rows and not an array.
    """
    rows = rows.drop("no", "kept", "n_merged").withColumn("_area", F.coalesce(F.concat(F.lit("="), F.col(area)), F.lit(""))).withColumn("_words", question_words(F.col(question)))
    best = F.min(F.struct((-F.length(F.coalesce(question, F.lit("")))).alias("l"), *(F.col(c).alias(f"o{k}") for k, c in enumerate(order))))
    kinds = rows.groupBy("_area", "_words").agg(best.alias("_best"), F.count("*").alias("_n"))
    kinds, _ = written(kinds.withColumn("_id", F.monotonically_increasing_id()), "questions")
    classes = similar_classes(kinds.select(F.col("_id").alias("id"), F.col("_area").alias("area"), F.col("_words").alias("items")), at_least)
    classes = classes.select(F.col("id").alias("_id"), F.col("class").alias("_class"))
    classed, _ = written(kinds.select("_id", "_area", "_best", "_n").join(classes, "_id"), "classes")  # words move once more, to the rows
    kept = classed.groupBy("_area", "_class").agg(F.min("_best").alias("_best"), F.sum("_n").alias("n_merged"))
    kept = numbered(kept, [F.asc_nulls_first(f"_best.o{k}") for k in range(len(order))], "_area")
    found = classed.select("_id", "_class").join(kept.select("_class", F.col("_best").alias("_kept"), "no", "n_merged"), "_class").drop("_class")
    mine = F.struct((-F.length(F.coalesce(question, F.lit("")))).alias("l"), *(F.col(c).alias(f"o{k}") for k, c in enumerate(order)))
    known = rows.withColumn("_mine", mine).join(kinds.select("_area", "_words", "_id"), ["_area", "_words"]).drop("_area", "_words")
    return known.join(found, "_id").withColumn("kept", F.col("_mine") == F.col("_kept")).drop("_id", "_mine", "_kept")


def renumber(rows: DataFrame, order: list, within: str = "area") -> DataFrame:
    """Numbers from 1 within each area, dealt by ranges: an area of any size is spread over tasks."""
    return numbered(rows, order, within)
