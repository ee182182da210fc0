"""The streaming forms give the rows of the finite ones, in whatever order events arrive inside the watermark."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.streaming import watch

EVENTS = "path string, at timestamp, grp string"


def streamed(spark, tmp_path, rows, files, late, **how):
    """The rows of the stream over files that arrive one after the other, and a last one that lets the watermark pass all."""
    size = -(-len(rows) // files)
    schema = "path string, ms long, grp string"
    last = [("end", max(r[1] for r in rows) + 10_000_000, "end")]
    for k, part in enumerate([rows[i : i + size] for i in range(0, len(rows), size)] + [last, [("end", last[0][1] + 10_000_000, "end")]]):
        spark.createDataFrame(part, schema).coalesce(1).write.json(f"{tmp_path}/in/{k:03d}")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*").select("path", F.timestamp_millis("ms").alias("at"), "grp")
    out = watch.debounced(events, "grp", late=late, **how)
    name = f"debounced_{random.getrandbits(40)}"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run = out.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination(180)
        run.stop()
    finally:
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return sorted((r.grp, r.batch, r.path, r.at) for r in spark.table(name).collect() if r.grp != "end")


@pytest.mark.parametrize("shuffled", [False, True])
def test_capped_debounce_in_any_order(spark, tmp_path, shuffled):
    rng = random.Random(9)
    rows, t = [], 1_700_000_000_000
    for _ in range(60):
        t += rng.choice([0, 1000, 3000, 4999, 5000, 7000, 20_000])
        rows.append((rng.choice("abc"), t, rng.choice("xy")))
    finite = spark.createDataFrame(rows, "path string, ms long, grp string").select("path", F.timestamp_millis("ms").alias("at"), "grp")
    want = sorted((r.grp, r.batch, r.path, r.at) for r in watch.capped_batches(finite, "grp", 5, 15).collect())
    if shuffled:
        rng.shuffle(rows)
    assert streamed(spark, tmp_path, rows, 4, late=3600, quiet=5, longest=15) == want


def gappy(rng, n):
    """(path, µs, grp) rows: long runs, gaps of exactly the quiet time and a microsecond less, ties, an empty group name and none."""
    rows = []
    for grp in ("a", "", None):
        t = 1_700_000_000_000_000 + rng.randrange(10**9)
        for _ in range(n):
            t += rng.choice([0, 1, 999, 1_000_000, 4_999_000, 4_999_999, 5_000_000, 5_000_001, 31_000_000])
            rows.append((rng.choice(["x", "y", None]), t, grp))
    return rows


def test_capped_batches_and_sessions_over_cells(spark):
    """Runs are told apart by cells: the same batches and sessions as by folding each group in order, and no group in one task."""
    rng = random.Random(31)
    rows = gappy(rng, 400)
    events = spark.createDataFrame(rows, "path string, us long, grp string").select("path", F.timestamp_micros("us").alias("at"), "grp")
    capped, sessions = {}, {}
    for grp in ("a", "", None):
        mine = sorted((r for r in rows if r[2] == grp), key=lambda r: r[1])
        for (path, us, _), no in zip(mine, watch.capped_runs([r[1] // 1000 for r in mine], 5000, 15_000)):
            capped[grp, no, path] = us
        start = last = None
        for path, us, _ in mine:
            if last is None or us >= last + 5_000_000:
                start = us
            last = us
            sessions.setdefault((grp, start), []).append((us, path))
    micros = F.unix_micros("at")
    assert {(r.grp, r.batch, r.path): r.us for r in watch.capped_batches(events, "grp", 5, 15).withColumn("us", micros).collect()} == capped
    quiet = watch.quiet_batches(events, 5, by="grp").select("grp", F.unix_micros("start").alias("a"), F.unix_micros("stop").alias("b"), "events", "paths").collect()
    assert {(r.grp, r.a): (r.b, r.events, r.paths) for r in quiet} == {k: (max(u for u, _ in v) + 5_000_000, len(v), len({p for _, p in v} - {None})) for k, v in sessions.items()}


def test_events_without_a_time(spark):
    """They stay in their group's last batch, as the SQL has them, where they stopped the job before."""
    rows = [("x", 1, "a"), ("y", 100_000_000, "a"), ("z", None, "a"), ("y", None, "a"), ("w", None, "b")]
    events = spark.createDataFrame(rows, "path string, us long, grp string").select("path", F.timestamp_micros("us").alias("at"), "grp")
    got = {(r.grp, r.batch, r.path, r.us) for r in watch.capped_batches(events, "grp", 5, 15).withColumn("us", F.unix_micros("at")).collect()}
    assert got == {("a", 0, "x", 1), ("a", 1, "y", 100_000_000), ("a", 1, "z", None), ("b", 0, "w", None)}
