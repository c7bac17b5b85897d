"""The training-data pipeline: toxicity, near-duplicates, benchmark decontamination, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. ``run`` writes each stage's rows as Parquet into the
shared folder and reads them again for the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontam import remove_leaky
from tessera.llm.packing import op3_packing
from tessera.llm.pii import redact_pii
from tessera.llm.similar import keep_one
from tessera.llm.toxicity import reject_toxic
from tessera.sources.tables import remove, shared_folder, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. Null and empty texts score as a text without a known word does; every row is
    judged by itself, so repeated rows and null ids stay or go like any other. All columns stay as they are."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similar five-word shingles, or linked fingerprints) one row stays: the one with the
    smallest id, null ids last. Rows count one by one, also where they repeat or share an id; null texts count as
    empty, and texts without a word are one group. All columns stay as they are."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none, null and empty items are in none; every
    row is judged by itself. All columns stay as they are."""
    return remove_leaky(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind and ``n_chars`` counted anew; a null text stays null. Every row stays,
    and so do all other columns."""
    return redact_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts left, as packed pieces of token sequences. A null or empty text is its end mark alone; rows are packed one
    by one, also repeated ones and those without an id."""
    return op3_packing(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]

#: Trained fields and tokenisation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's table goes as soon as the next one is written; the last one stays."""
    docs, base = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            remove(spark, f"{base}/{before}")
        before = name
    return docs
