"""Whitening of vectors by their principal components, from singular value decompositions that are merged up a tree.

The distinct vectors are the fit list. Each partition of it becomes a summary: count, exact sums, mean, and all singular
values and right vectors of its rows less their mean. Two summaries merge without loss: their
vectors times values stand above each other, with one more row for the difference of the means, weighted by the counts, and
are decomposed again. FAN_IN summaries meet in a task, then their results, until one is left; it has at most one
vector for each dimension, so it is small whatever the table.

Vectors are whole numbers: x = floor(scale * c) + shift of each entry c as double. They are taken less `shift` before anything is
squared, so means and differences keep all digits.

Defined results. Vectors that are null, or hold null, NaN or infinite entries, are dropped; so are those whose length is not the
most frequent one (of equal counts the longest) and empty ones. Equal vectors, and rows with equal or null ids, are rows of
their own with equal results. A component without variance (below 1e-24 of the trace) has whitened null and is no
part of the identity error. One distinct vector alone has no variance; no vectors give no rows.
deviation is exact; where it leaves 64 bits Spark's arithmetic error is raised rather than a wrong number given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, materialize

SCALE, SHIFT = 64, 1_000_000
FAN_IN = 16
#: Rows that are decomposed at once.
ROWS = 4096
NO_VARIANCE = 1e-24

_SUMMARY = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("mean", pa.list_(pa.float64())), ("scaled", pa.list_(pa.float64()))])
_SUMMARY_DDL = "part long, n long, sums array<long>, mean array<double>, scaled array<double>"

Summary = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def summary(x: np.ndarray) -> Summary:
    """(count, sums, mean, singular values times right vectors) of whole-number rows."""
    sums = x.sum(axis=0)
    mean = sums / len(x)
    _, values, vectors = np.linalg.svd(x - mean, full_matrices=False)
    return len(x), sums, mean, values[:, None] * vectors


def merged(a: Summary, b: Summary) -> Summary:
    """The summary of the rows of both: all values and vectors, and one row for the difference of the means."""
    n = a[0] + b[0]
    between = np.sqrt(a[0] / n * b[0]) * (a[2] - b[2])
    _, values, vectors = np.linalg.svd(np.vstack((a[3], b[3], between)), full_matrices=False)
    sums = a[1] + b[1]
    return n, sums, sums / n, values[:, None] * vectors


def _row(part: int, s: Summary) -> pa.RecordBatch:
    columns = ([part], [s[0]], [s[1].tolist()], [s[2].tolist()], [s[3].ravel().tolist()])
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _SUMMARY)], schema=_SUMMARY)


def _matrix(column: pa.ChunkedArray | pa.Array, dtype: type) -> np.ndarray:
    """Lists of one length as rows."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(dtype, copy=False)


def _summaries(x: DataFrame) -> DataFrame:
    """One summary for each partition that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        so_far: Summary | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                own = summary(_matrix(batch.column(0).slice(at, ROWS), np.int64))
                so_far = own if so_far is None else merged(so_far, own)
        if so_far is not None:
            yield _row(TaskContext.get().partitionId(), so_far)

    return x.mapInArrow(run, _SUMMARY_DDL)


def _merge(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    parts = [(r["n"], np.array(r["sums"], np.int64), np.array(r["mean"]), np.array(r["scaled"]).reshape(-1, len(r["mean"]))) for r in rows]
    out = parts[0]
    for other in parts[1:]:
        out = merged(out, other)
    return pa.Table.from_batches([_row(rows[0]["part"] // FAN_IN, out)])


def fit(x: DataFrame) -> Summary | None:
    """The summary of the distinct vectors in column x, merged FAN_IN at a time in Spark; None if there are none."""
    level = materialize(_summaries(x.select("x").distinct()), "svd")
    # the highest number of a partition bounds the rounds
    top = level.agg(F.max("part")).first()[0]
    if top is None:
        return None
    while top > 0:
        level = level.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(_merge, _SUMMARY_DDL)
        top //= FAN_IN
    row = level.first()
    return row.n, np.array(row["sums"], np.int64), np.array(row["mean"]), np.array(row["scaled"]).reshape(-1, len(row["mean"]))


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, x): the vectors without null or non-finite entries, of the most frequent length, as whole numbers less shift."""
    c = F.transform(F.col(f"`{vector_col}`"), lambda v: v.cast("double"))
    fine = F.forall(F.col("c"), lambda v: v.isNotNull() & (F.abs(v) < float("inf")))  # NaN is above infinity
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), c.alias("c")).where(F.col("c").isNotNull() & fine & (F.size("c") > 0))
    rows = rows.select("id", F.transform("c", lambda v: F.floor(v * scale).cast("long")).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return rows.where(F.size("x") == (lengths["length"] if lengths else 0))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each vector and each of the first components, by falling variance.

    deviation is over x with its shift; sums with and without it give the same.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    x = whole_numbers(vectors, id_col, vector_col, scale, shift)
    id_type = vectors.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(x)
    if model is None:
        return spark.createDataFrame([], schema)
    n, sums, mean, scaled = model
    scaled = np.vstack((scaled, np.zeros((max(0, len(mean) - len(scaled)), len(mean)))))  # fewer vectors than dimensions
    values = (scaled * scaled).sum(axis=1) / n
    order = np.argsort(-values, kind="stable")[:components]
    trace, values, vectors_ = values.sum(), values[order], scaled[order]
    varied = values > NO_VARIANCE * max(trace, np.finfo(float).tiny)
    unit = np.divide(vectors_, np.linalg.norm(vectors_, axis=1, keepdims=True), out=np.zeros_like(vectors_), where=varied[:, None])
    basis = unit.T / np.where(varied, np.sqrt(values), 1)
    k = len(order)

    def projected(batch: pa.RecordBatch, column: int) -> np.ndarray:
        return (_matrix(batch.column(column), np.int64) - mean) @ basis

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = projected(batch, 0)
            yield pa.record_batch([pa.array([w.sum(axis=0).tolist()]), pa.array([(w.T @ w).ravel().tolist()])], names=["s", "p"])

    added = lambda name: F.array(*(F.sum(F.col(name)[i]) for i in range(k if name == "s" else k * k))).alias(name)
    sums_of = x.select("x").distinct().mapInArrow(moments, "s array<double>, p array<double>").agg(added("s"), added("p")).first()
    s, p = np.array(sums_of["s"]), np.array(sums_of["p"]).reshape(k, k)
    off = np.abs(p / n - np.outer(s / n, s / n) - np.eye(k))[np.ix_(varied, varied)]
    error, explained = float(off.max(initial=0.0)), (values / trace if trace > 0 else np.zeros(k))
    names = [id_col, "component", "whitened", "explained", "deviation"]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                w = projected(part, 1)
                rows = np.repeat(np.arange(part.num_rows), k)
                columns = [part.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows)), pa.array(w.ravel(), mask=np.tile(~varied, part.num_rows)), pa.array(np.tile(explained, part.num_rows)), part.column(2).take(pa.array(rows))]
                yield pa.record_batch(columns, names=names)

    offsets = F.array(*(F.lit(int(v)) for v in sums.tolist()))
    squares = F.transform(F.zip_with("x", offsets, lambda v, total: F.lit(n) * v - total), lambda v: v * v)
    rows = x.select(F.col("id"), "x", F.aggregate(squares, F.lit(0).cast("long"), lambda a, b: a + b).alias("deviation"))
    out = rows.mapInArrow(project, f"`{id_col}` {id_type}, component int, whitened double, explained double, deviation long")
    return out.select(F.col(f"`{id_col}`"), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))
