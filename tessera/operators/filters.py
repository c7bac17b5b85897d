"""Row filters and row-wise projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions.text import basename, or_else


def overlapping(hits: DataFrame, column: str, wanted: Sequence[str] | None) -> DataFrame:
    """Rows whose array shares a value with ``wanted``; all rows for an empty or missing ``wanted``; a null array shares nothing."""
    if not wanted:
        return hits
    return hits.where(F.coalesce(F.arrays_overlap(F.col(column), F.array(*map(F.lit, wanted))), F.lit(False)))


def among(hits: DataFrame, column: str, wanted: Sequence[str] | None) -> DataFrame:
    """Rows whose value is among ``wanted``; all rows for an empty or missing ``wanted``; null never is."""
    return hits.where(F.col(column).isin(list(wanted))) if wanted else hits


def valid_search(query: Column, k: Column, score: Column | None = None) -> Column:
    """Bounds of a search request: 2 to 500 characters, 1 to 20 hits, scores from 0 to 1."""
    ok = F.length(query).between(2, K.QUERY_CHARS) & k.between(1, 20)
    return F.coalesce(ok if score is None else ok & score.between(0, 1), F.lit(False))


def uploads(files: DataFrame, limit: int = K.UPLOAD_LIMIT) -> DataFrame:
    """Files that may be stored (``.docx``, within the size limit), under a unique name without any folder part."""
    ok = F.lower("name").endswith(".docx") & (F.length("content") <= limit)
    return files.where(ok).withColumn("stored_name", F.concat(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit("_"), basename("name")))


def store_uploads(files: DataFrame, folder: str, limit: int = K.UPLOAD_LIMIT) -> None:
    """The files that may be stored, with their bytes and unique names, appended to the table at ``folder``."""
    uploads(files, limit).write.mode("append").parquet(folder)


def index_status(docs: DataFrame, failed: DataFrame, stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` and ``status``, ``error``: failed (``failed(key, error)``) beats indexed (``stored(key)``) beats pending."""
    bad = failed.groupBy(key).agg(F.min(F.coalesce("error", F.lit(""))).alias("_error"))
    there = stored.select(key).distinct().withColumn("_stored", F.lit(True))
    joined = docs.join(bad, key, "left").join(there, key, "left")
    status = F.when(F.col("_error").isNotNull(), "failed").when(F.col("_stored"), "indexed").otherwise("pending")
    return joined.withColumn("status", status).withColumn("error", F.nullif("_error", F.lit(""))).drop("_error", "_stored")


def qa_rows(items: DataFrame) -> DataFrame:
    """Normalised question rows: number or place + 1, function or area, impact and reference never null."""
    return items.select(
        F.coalesce("no", F.col("place") + 1).alias("no"), or_else(F.col("question"), F.lit("")).alias("question"),
        F.coalesce(F.nullif("function", F.lit("")), F.nullif("area", F.lit("")), F.lit("")).alias("function"),
        F.coalesce("impact", F.lit("")).alias("impact"), F.coalesce("history_reference", F.lit("")).alias("history_reference"),
    )


def editable_requirements(rows: DataFrame) -> DataFrame:
    """Rows a user may edit (no derived rows), the last row of each dimension by ``ord``: ``dimension, new_project``."""
    own = ~(F.col("dimension").startswith("技术") | F.col("dimension").contains("人天") | F.col("dimension").contains("偏差"))
    return rows.where(own).groupBy("dimension").agg(F.max_by("new_project", "ord").alias("new_project"))


def set_cell(rows: DataFrame, dimension: str, value: str) -> DataFrame:
    return rows.withColumn("new_project", F.when(F.col("dimension") == dimension, F.lit(value)).otherwise(F.col("new_project")))


def in_scope_only(rows: DataFrame) -> DataFrame:
    """Specified only: out-of-scope rows show a dash, rows of unknown scope are kept as they are."""
    return rows.withColumn("content", F.when(F.col("in_scope") == F.lit(False), K.DASH).otherwise(F.col("content")))
