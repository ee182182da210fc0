"""What the operators of this subpackage share: table access and durable intermediate tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    _LIBC = ctypes.CDLL("libc.so.6") if hasattr(ctypes.CDLL("libc.so.6"), "malloc_trim") else None
except OSError:  # another C library
    _LIBC = None
_LOCAL_FALLBACK: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where it is unset a folder of this machine is used, which is right only when
    everything runs in one process; on any other master its absence is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[app] = tempfile.mkdtemp(prefix="marlstone-")
    return f"file://{_LOCAL_FALLBACK[app]}"


def _path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    jvm = spark.sparkContext._jvm
    named = jvm.org.apache.hadoop.fs.Path(path)
    return named.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), named


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors.

    The table is deleted when the driver ends, or by discard.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, named = _path(spark, path)
    files.deleteOnExit(named)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of materialize that no later plan reads."""
    for t in tables:
        if t is not None and (path := getattr(t, "written_to", None)):
            files, named = _path(t.sparkSession, path)
            files.delete(named, True)


def fresh(taken: Sequence[str], *stems: str) -> list[str]:
    """A column name for each stem that is none of the taken ones, in any case of letters."""
    used = {t.lower() for t in taken}
    out = []
    for stem in stems:
        name = stem
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def join_classes(rows: DataFrame, classes: DataFrame, keys: Sequence[str], n: str, total: int, most: int = 4096) -> DataFrame:
    """rows with the further columns of classes, null where no class has the keys.

    classes has one row for each key, its column n the number of its rows. Classes of more than a 1/most part of the total
    rows, fewer than most, are broadcast; their rows are spread over the tasks of the join with the others.
    The other side's salt is computed from n: a literal would be folded into the join's condition, which leaves rows dealt by the keys alone.
    """
    values = [c for c in classes.columns if c not in (*keys, n)]
    taken = [*rows.columns, *classes.columns]
    found, salt, other = fresh(taken, "found", "salt", "other_salt")
    hot_keys, rest_keys = fresh(taken, *(f"hot_{k}" for k in keys)), fresh(taken, *(f"rest_{k}" for k in keys))
    hot_values, rest_values = fresh(taken, *(f"hot_{v}" for v in values)), fresh(taken, *(f"rest_{v}" for v in values))
    large = F.col(n) * most > total
    named = lambda df, ks, vs: [*(F.col(a).alias(b) for a, b in zip(keys, ks)), *(F.col(a).alias(b) for a, b in zip(values, vs))]
    hot = classes.where(large).select(*named(classes, hot_keys, hot_values), F.lit(True).alias(found))
    rest = classes.where(~large).select(*named(classes, rest_keys, rest_values), F.pmod(F.col(n).cast("long"), F.lit(1).cast("long")).alias(other))
    on = lambda ks: [F.col(a) == F.col(b) for a, b in zip(keys, ks)]
    spread = F.when(F.col(found), 1 + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16))).otherwise(F.lit(0)).cast("long")
    met = rows.join(F.broadcast(hot), on(hot_keys), "left").withColumn(salt, spread)
    met = met.join(rest, [*on(rest_keys), F.col(salt) == F.col(other)], "left")
    return met.select(*rows.columns, *(F.when(F.col(found), F.col(a)).otherwise(F.col(b)).alias(v) for a, b, v in zip(hot_values, rest_values, values)))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def bounded_batches(spark: SparkSession, size: int = 16 << 20) -> None:
    """Let no Arrow batch that goes to Python take more than size bytes, however long the texts are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, f"{1 << 30}b")
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > size:
        spark.conf.set(key, f"{size}b")


def give_back() -> None:
    """Return a Python worker's unused memory: idle workers of earlier stages stay beside those of later ones."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)
