"""Tables, state files, logs and stored artefacts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
FILES_AT_ONCE = 32  # of an Arrow batch, however many rows that has


def in_slices(batches: Iterator[pa.Array], rows: int = FILES_AT_ONCE) -> Iterator[pa.Array]:
    """Parts of a few rows of each batch: what a file holds, unpacked in Python, is there for so many files at once and not for a whole batch."""
    return (batch.slice(at, rows) for batch in batches for at in range(0, len(batch), rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, or the checkpoint folder that is set.

    Only with a local master one is made where none is named; on a cluster the driver's own disk would not do.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="shared-")
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the cluster's shared folder.

    A checkpoint hands on the size estimated for the plan behind it, a product over joins. Over the rounds of a loop that
    number's own length multiplies; loops write tables instead (``written``), whose sizes are those of their files.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the cluster's shared folder as Parquet and read again, and its path. What was shuffled for it goes as soon as it is written,
    not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


STATE = "last_import_at string, failed_files array<struct<doc_id:string,error:string>>"


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The import state, one row or none: missing and corrupt files are no state."""
    if not exists(spark, path):
        return spark.createDataFrame([], STATE)
    return spark.read.schema(f"{STATE}, _corrupt_record string").option("mode", "PERMISSIVE").json(path).where("last_import_at is not null").select("last_import_at", "failed_files")


def write_state(state: DataFrame, path: str) -> None:
    state.coalesce(1).write.mode("overwrite").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Feedback as JSON lines; each call adds files and rewrites none."""
    rows.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str, limit: int, offset: int = 0) -> DataFrame:
    return spark.read.schema(schema).json(path).orderBy("created_at", "feedback_id").offset(offset).limit(limit)


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of an older and a newer shape of a table; columns that one lacks are null there."""
    return old.unionByName(new, allowMissingColumns=True)


def existing(catalog: DataFrame, files: DataFrame, key: str = "filename") -> DataFrame:
    """Catalogue entries whose file is there."""
    return catalog.join(files.select(key).distinct(), key, "left_semi")


def resolve(catalog: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """The one catalogue entry of that name with an ``error`` column: 400 for a path, 404 for an unknown or missing file."""
    spark = catalog.sparkSession
    if "/" in name or "\\" in name or ".." in name:
        return spark.createDataFrame([(name, 400)], "filename string, error int")
    there = existing(catalog, files).where(F.col("filename") == name).select("filename", F.lit(None).cast("int").alias("error"))
    return there.union(spark.createDataFrame([(name, 404)], "filename string, error int").join(there.select("filename"), "filename", "left_anti"))


def materialise(spark: SparkSession, path: str, build) -> DataFrame:
    """The stored artefact, built and written first if it is not there."""
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def manifest(rows: DataFrame, column: str, expected: list[str]) -> DataFrame:
    """Specified only: package manifests (JSON) to one row per expected document type, with ``present``."""
    schema = "engagement_id string, documents array<struct<doc_type:string,path:string>>"
    parsed = rows.select(F.from_json(column, schema).alias("m")).select("m.engagement_id", F.map_from_entries(F.array_distinct(F.transform("m.documents", lambda d: F.struct(d["doc_type"], d["path"])))).alias("paths"))
    wanted = F.explode(F.array(*map(F.lit, expected)))
    return parsed.select("engagement_id", wanted.alias("doc_type"), "paths").select("engagement_id", "doc_type", F.try_element_at("paths", F.col("doc_type")).alias("path")).withColumn("present", F.col("path").isNotNull())
