"""Incremental ingestion by content hash, and a table that is replaced as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.sources.tables import exists, remove


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def classify(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Outcome of each id of either side (``doc_id, hash``): new, changed, unchanged or deleted. Ids are unique on each side."""
    old = stored.select("doc_id", F.col("hash").alias("old_hash"))
    both = incoming.select("doc_id", F.col("hash").alias("new_hash")).join(old, "doc_id", "full_outer")
    outcome = (
        F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "deleted")
        .when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    )
    return both.select("doc_id", outcome.alias("outcome"))


def counters(outcomes: DataFrame) -> DataFrame:
    """One row: new, changed, unchanged, deleted, and how many are stored afterwards."""
    each = [F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in ("new", "changed", "unchanged", "deleted")]
    return outcomes.agg(*each, F.count_if(F.col("outcome") != "deleted").alias("n_total"))


def pending(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose (id, hash) is not stored yet: the only ones to extract and embed."""
    return incoming.join(stored.select("doc_id", "hash"), ["doc_id", "hash"], "left_anti")


def upsert(stored: DataFrame, rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``stored`` with the rows of ``rows`` in place of those with the same key; columns missing on a side are null."""
    return stored.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def chunk_record(doc_id: Column, text: Column, meta: Column) -> list[Column]:
    """Columns of a stored chunk: the first 8000 characters and all metadata that is not null, as text."""
    return [doc_id.alias("doc_id"), F.left(text, F.lit(K.STORED_CHARS)).alias("text"), F.map_filter(meta, lambda _, v: v.isNotNull()).alias("meta"), content_hash(text).alias("hash")]


def metadata_of(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids(doc_id)`` and ``found``, ``meta`` of each: null metadata for an id that is not stored."""
    known = stored.select("doc_id", F.lit(True).alias("_there"), "meta")
    return ids.join(known, "doc_id", "left").select("doc_id", F.coalesce("_there", F.lit(False)).alias("found"), "meta")


def updated(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``rows`` with the values that ``changes`` (one row a key, any of the columns) give, null for no change; changes to
    unknown keys are ignored."""
    names = [c for c in changes.columns if c != key]
    new = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in names))
    joined = rows.join(new, key, "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in rows.columns))


class Versions:
    """A table kept as numbered Parquet folders; readers take the newest complete one, so a rewrite never touches what is read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def names(self) -> list[str]:
        fs, path = self._fs()
        if not fs.exists(path):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("v") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))

    def read(self) -> DataFrame | None:
        names = self.names()
        return self.spark.read.parquet(f"{self.root}/{names[-1]}") if names else None

    def write(self, rows: DataFrame) -> None:
        names = self.names()
        number = int(names[-1][1:9]) + 1 if names else 1
        rows.write.parquet(f"{self.root}/v{number:08d}-{uuid.uuid4().hex[:8]}")

    def expire(self, keep: int = 2) -> None:
        fs, _ = self._fs()
        for name in self.names()[:-keep]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"), True)


class Buckets:
    """A table of one row a key in ``n`` hash buckets, of which a batch rewrites only those that its keys fall into.

    The new contents of these buckets are written aside first and then put in place of the old ones. If that is interrupted, the next one to open the table
    finds what was written aside and puts it in place again, which gives the same; one writer at a time. Readers may see some buckets
    of a batch before others. ``n`` stays what it was when the table was made. Rows without a key are kept as they come, none replaces another.
    """

    def __init__(self, spark: SparkSession, root: str, n: int, key: str = "doc_id"):
        self.spark, self.root, self.n, self.key = spark, root, n, key
        self.data, self.aside = f"{root}/data", f"{root}/aside"
        if exists(spark, f"{self.aside}/_SUCCESS"):
            self._put()

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.n)).cast("int")

    def read(self) -> DataFrame | None:
        return self.spark.read.parquet(self.data).drop("bucket") if exists(self.spark, self.data) else None

    def upsert(self, rows: DataFrame, gone: DataFrame | None = None) -> list[int]:
        """Rows take the place of those with the same key, keys of ``gone`` leave; columns missing on a side are null. The buckets rewritten."""
        new = rows.withColumn("bucket", self.bucket())
        leaving = new.select(self.key, "bucket")
        if gone is not None:
            leaving = leaving.unionByName(gone.select(self.key).withColumn("bucket", self.bucket()))
        touched = sorted(r["bucket"] for r in leaving.select("bucket").distinct().collect())  # n at most
        if touched:
            if exists(self.spark, self.data):
                old = self.spark.read.parquet(self.data).where(F.col("bucket").isin(touched))
                new = old.join(leaving.select(self.key).distinct(), self.key, "left_anti").unionByName(new, allowMissingColumns=True)
            new = new.repartition(len(touched), "bucket")
            new.write.mode("overwrite").parquet(self.aside)
            self.spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1).write.mode("overwrite").json(f"{self.root}/touched")
            self._put()
        return touched

    def _put(self) -> None:
        held = self.spark.read.parquet(self.aside)
        held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.data)
        filled = {r["bucket"] for r in held.select("bucket").distinct().collect()}
        for r in self.spark.read.schema("bucket int").json(f"{self.root}/touched").collect():
            if r["bucket"] not in filled:  # all its keys have left
                remove(self.spark, f"{self.data}/bucket={r['bucket']}")
        remove(self.spark, self.aside)
