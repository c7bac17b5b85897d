"""Task status feeds and file arrival as streams.

Streams run with ``availableNow`` for a scheduled job or continuously; state is in the checkpoint, so a restart neither
loses nor repeats a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tessera.operators.ingest import Versions, classify, counters, pending, upsert
from tessera.operators.workflow import progress
from tessera.sources.documents import FILE, described, extract, scan


def read_events(spark: SparkSession, path: str, schema, files_each: int | None = None, pattern: str | None = None) -> DataFrame:
    """Parquet files of events as they arrive; ``ts`` becomes a timestamp (UTC session), which watermarks need."""
    reader = spark.readStream.schema(schema)
    if files_each:
        reader = reader.option("maxFilesPerTrigger", files_each)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def status_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events of each type in tumbling windows; batch and stream alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a user's events with no pause longer than ``gap``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def task_states(events: DataFrame, key: str = "user_id", status: str = "event_type") -> DataFrame:
    """The latest status of each task and the progress it stands for, as a running aggregate."""
    last = F.max_by(status, F.struct("ts", "event_id"))
    return events.groupBy(key).agg(last.alias("status"), F.count("*").alias("n_events")).withColumn("progress", progress(F.col("status")))


def to_memory(rows: DataFrame, name: str, mode: str) -> StreamingQuery:
    return rows.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()


def ingest_files(spark: SparkSession, root: str, store: Versions, dead_letters: str, checkpoint: str) -> DataStreamWriter:
    """New Word files of ``root`` into the store by content hash; files that cannot be read go to ``dead_letters``.

    A batch that is run again finds its rows in the store and writes the same table.
    """

    def batch(files: DataFrame, number: int) -> None:
        rows = described(files, root)
        old = store.read()
        fresh = pending(rows, old) if old is not None else rows
        read = fresh.withColumn("x", extract("content")).select("doc_id", "project_name", "doc_type", "hash", "x.text", "x.error").persist()
        read.where("error is not null").select("doc_id", "error").write.mode("append").json(dead_letters)
        good = read.where("error is null").drop("error")
        if not good.isEmpty():
            store.write(good if old is None else upsert(old, good))
        read.unpersist()

    files = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True).option("pathGlobFilter", "*.docx").load(root)
    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def reindex(spark: SparkSession, root: str, store: Versions) -> DataFrame:
    """Builds the whole table anew from the files of ``root``; readers see the old one until the new one is complete.
    Returns the counters of what changed."""
    old = store.read()
    rows = described(scan(spark, root), root).withColumn("x", extract("content")).where("x.error is null")
    store.write(rows.select("doc_id", "project_name", "doc_type", "hash", "x.text"))
    new = store.read()
    none = new.limit(0).select("doc_id", "hash")
    return counters(classify(new.select("doc_id", "hash"), none if old is None else old.select("doc_id", "hash")))
