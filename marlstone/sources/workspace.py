"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, as in tests on one machine, a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="marlstone-")
    return f"file://{_LOCAL[app]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """df written as a table and read back: computed once, its lineage cut."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_signature(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of a table's files: changes whenever a file does, without reading columns."""
    files = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size", F.col("_metadata.file_modification_time").cast("string").alias("time")).distinct()
    one = files.select(F.xxhash64("file_path", "file_size", "time").alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("h")).first()
    return f"{one.n}:{one.h}"
