"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import cut, table, written

__all__ = ["ascii_lower", "cut", "fitted", "free_name", "id_bucket", "ordered_sample", "sample_by", "sample_texts", "saved", "table", "written"]


def saved(df: DataFrame, name: str) -> DataFrame:
    return written(df, name)[0]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it as far as ``df`` has such a column: operators overwrite no column of the caller."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_bucket(doc_id: str, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ordered_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """The ``rows`` rows with the smallest ``key``: a bounded sample that any partitioning of the input gives alike."""
    return df.withColumn("_key", key).orderBy("_key").limit(rows).drop("_key")


def fitted(sample: DataFrame, fit: Callable[..., object]) -> object:
    """``fit`` called with the columns (as lists) of a bounded ``sample``, in one task; only the model comes to the driver."""
    names = sample.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        columns = [[x for b in held for x in b.column(k).to_pylist()] for k in range(len(names))]
        held.clear()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(*columns))], pa.binary())], ["model"])

    made = sample.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made["model"]) if made else fit(*([] for _ in names))


def sample_by(rows: DataFrame, group: str, each: int, chars: int, groups: int) -> DataFrame:
    """``text, <group>``: about ``each`` different texts (their first ``chars`` characters) of each of the ``groups`` most
    frequent values of ``group``, those with the smallest hashes; never more than ``each``.

    One pass counts the different texts of each group (a sketch, off by some hundredths); the next takes hashes below four times the
    share wanted, so what is ranked is bounded whatever the input, and repeated texts fall together before they are. A group of
    few texts in many rows keeps them all.
    """
    known = rows.where(F.length("text") > 0).select(group, "text", F.xxhash64("text").alias("_hash"))
    top = known.groupBy(group).agg(F.count("*").alias("_rows"), F.approx_count_distinct("_hash").alias("_n")).orderBy(F.desc("_rows"), group).limit(groups)
    part = F.pmod("_hash", F.lit(1 << 30)) * F.col("_n") < 4.0 * each * (1 << 30)
    near = known.join(F.broadcast(top.select(group, "_n")), group).where(part)
    near = near.groupBy(group, "_hash").agg(F.min(F.left("text", F.lit(chars))).alias("text"))
    order = Window.partitionBy(group).orderBy("_hash")
    return near.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= each).select("text", group)


def sample_texts(docs: DataFrame, rows: int, chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text``: at most ``rows`` different texts of 1 to ``chars`` characters, those with the smallest hashes, in their order.

    Hashes and ids alone decide; the texts of the ``rows`` rows chosen are read afterwards, one for each hash, so an id
    that many rows share brings no more.
    """
    known = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.length("_text").between(1, chars))
    hashes = known.select("_id", F.xxhash64("_text").alias("_hash")).groupBy("_hash").agg(F.min("_id").alias("_id"))
    chosen = ordered_sample(hashes, F.struct("_hash", "_id"), rows)
    got = known.join(F.broadcast(chosen), "_id").where(F.xxhash64("_text") == F.col("_hash"))
    return got.groupBy("_hash").agg(F.min("_text").alias("text")).coalesce(1).orderBy("_hash").select("text")
