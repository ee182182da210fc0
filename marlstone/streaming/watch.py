"""Watched-folder streams: event de-duplication, quiet-time batches, self-write suppression, hash de-duplication.

Every function takes an event relation (path, mtime, at), streaming or not.  Events
are watermarked, so state is dropped once it can no longer matter; later events are lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import LongType, StringType, StructField, StructType

from marlstone.operators.running import running_sum
from marlstone.sources.workspace import materialize

QUIET_SECONDS, LONGEST_SECONDS = 5, 60
EVENT_TTL_SECONDS, OWN_WRITE_SECONDS = 600, 120
PERIOD_DAYS = {"daily": 1, "weekly": 7, "monthly": 30}


def file_events(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """A stream of (path, mtime, at, content) of new or rewritten files under a folder."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    schema = "path string, modificationTime timestamp, length long, content binary"
    return files.schema(schema).load(folder).select("path", F.col("modificationTime").alias("mtime"), F.col("modificationTime").alias("at"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def accepted_once(seconds: int) -> Callable:
    """For applyInPandasWithState: lets an event of its key through unless another was let through less than so many seconds before."""
    ttl = 1_000_000 * seconds

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values("at", kind="stable")
        kept = []
        for at in micros(rows["at"]):
            kept.append(last is None or at >= last + ttl)
            last = at if kept[-1] else last
        state.update((last,))
        state.setTimeoutTimestamp(max((last + ttl) // 1000, state.getCurrentWatermarkMs() + 1))
        yield rows[kept]

    return run


def micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


def drop_repeats(events: DataFrame, seconds: int = EVENT_TTL_SECONDS) -> DataFrame:
    """Events of whose (path, mtime) none was let through in the so many seconds before; an event that is dropped renews nothing.

    A finite relation is folded in order, one row at a time, so no group is held in memory.
    """
    if events.isStreaming:
        keyed = events.withWatermark("at", f"{seconds} seconds").groupBy("path", "mtime")
        return keyed.applyInPandasWithState(accepted_once(seconds), events.schema, "last long", "append", "EventTimeTimeout")
    ttl, names = 1_000_000 * seconds, events.columns
    stamped = events.select(F.struct(*names).alias("row"), F.struct("path", "mtime").alias("key"), F.unix_micros(F.col("at").cast("timestamp")).alias("at"))
    dealt = stamped.withColumn("hash", F.xxhash64("key")).repartition("key").sortWithinPartitions("hash", "key", "at", "row")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = last = None
        for batch in batches:
            kept = []
            for now, at in zip(batch.column("key").to_pylist(), batch.column("at").to_pylist()):
                if now != key:
                    key, last = now, None
                kept.append(last is None or at >= last + ttl)
                last = at if kept[-1] else last
            yield batch.filter(pa.array(kept, pa.bool_())).select(["row"])

    return dealt.mapInArrow(fold, StructType([StructField("row", events.schema)])).select("row.*")


def in_cell(t: Column, width: int) -> Column:
    """The number of the stretch of so many units that a whole number lies in; the quotient of a multiple is exact."""
    return ((t - F.pmod(t, F.lit(width))) / width).cast("long")


def quiet_runs(times: DataFrame, quiet: int) -> DataFrame:
    """(grp, cell, first, last, run) of times (grp, t), whole numbers: runs of a group with gaps of less than `quiet`, numbered upwards over all groups.

    A cell is a stretch of time as long as `quiet`, so no run ends inside one, and whether one begins is told by the cell before it: no group
    is sorted or held by one task.
    """
    cells = times.groupBy("grp", in_cell(F.col("t"), quiet).alias("cell")).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    cells = materialize(cells, "quiet-cells")
    before = cells.select(F.col("grp").alias("of"), (F.col("cell") + 1).alias("after"), F.col("last").alias("before"))
    met = cells.join(before, F.col("grp").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("after")), "left")
    begins = F.when(F.col("first") < F.col("before") + quiet, 0).otherwise(1)
    return running_sum(met.select("grp", "cell", "first", "last", begins.alias("begins")), "begins", "run", "grp", "cell").drop("begins")


def quiet_batches(events: DataFrame, seconds: int = QUIET_SECONDS, *, by: str | None = None) -> DataFrame:
    """(start, stop, events, paths) of runs of events with gaps of less than so many seconds; by splits them by a column, which a stream needs."""
    if events.isStreaming:
        rows = events.withWatermark("at", f"{seconds} seconds")
        keys = [F.session_window("at", f"{seconds} seconds").alias("w")] + ([F.col(by)] if by else [])
        out = rows.groupBy(*keys).agg(F.count("*").alias("events"), F.size(F.collect_set("path")).cast("long").alias("paths"))
        return out.select(*([by] if by else []), F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "events", "paths")
    quiet, kind = 1_000_000 * seconds, events.schema["at"].dataType
    rows = events.select((F.col(by) if by else F.lit(0)).alias("grp"), "path", F.unix_micros(F.col("at").cast("timestamp")).alias("t")).where("t IS NOT NULL")
    runs = materialize(quiet_runs(rows, quiet), "quiet-runs")
    seen = rows.groupBy("grp", in_cell(F.col("t"), quiet).alias("cell"), "path").agg(F.count("*").alias("n"))
    placed = seen.join(runs.select(F.col("grp").alias("of"), F.col("cell").alias("at"), "run"), F.col("grp").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("at")))
    counted = placed.groupBy("run", "path").agg(F.sum("n").alias("n")).groupBy("run").agg(F.sum("n").alias("events"), F.count("path").alias("paths"))
    spans = runs.groupBy("run").agg(F.first("grp").alias("grp"), F.min("first").alias("first"), F.max("last").alias("last"))
    out = spans.join(counted, "run").select(F.col("grp").alias(by or "grp"), F.timestamp_micros("first").cast(kind).alias("start"), F.timestamp_micros(F.col("last") + quiet).cast(kind).alias("stop"), "events", "paths")
    return out if by else out.drop("grp")


def capped_runs(times: list[int], quiet: int, longest: int) -> list[int]:
    """The batch of each time, in milliseconds and ascending: a batch closes after `quiet` without an event, at most `longest` after its first."""
    out, batch, first, last = [], -1, 0, 0
    for t in times:
        if batch < 0 or t >= min(last + quiet, first + longest):
            batch, first = batch + 1, t
        last = t
        out.append(batch)
    return out


def capped_batches(events: DataFrame, group: str, quiet: int = QUIET_SECONDS, longest: int = LONGEST_SECONDS) -> DataFrame:
    """(group, batch, path, at): the last event of each path in each capped batch of a group; a finite relation.

    A batch ends with its quiet run at the latest, so runs are cut on their own, each from its distinct milliseconds in order; none is held in
    memory. Events without a time belong to their group's last batch.
    """
    rows = events.select(F.col(group).cast("string").alias("grp"), F.col("path").cast("string").alias("path"), F.unix_micros(F.col("at").cast("timestamp")).alias("at"))
    rows = rows.withColumn("t", in_cell(F.col("at"), 1000))
    times = materialize(rows.where("t IS NOT NULL").select("grp", "t").distinct(), "capped-times")
    runs = quiet_runs(times, 1000 * quiet).select(F.col("grp").alias("of"), F.col("cell"), "run")
    placed = times.join(runs, F.col("grp").eqNullSafe(F.col("of")) & (in_cell(F.col("t"), 1000 * quiet) == F.col("cell"))).select("grp", "run", "t")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, no, first = None, -1, 0
        for batch in batches:
            numbers = []
            for now, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if now != run:
                    run, no, first = now, 0, t
                elif t >= first + 1000 * longest:
                    no, first = no + 1, t
                numbers.append(no)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], ["grp", "run", "t", "no"])

    numbered = placed.repartition("run").sortWithinPartitions("run", "t").mapInArrow(cut, "grp string, run long, t long, no long")
    numbered = materialize(numbered, "capped-numbered")
    # a run's batches follow those of the group's runs before it
    sizes = running_sum(numbered.groupBy("run").agg(F.first("grp").alias("grp"), (F.max("no") + 1).alias("size")), "size", "upto", "run")
    sizes = materialize(sizes.select("run", "grp", "upto", (F.col("upto") - F.col("size")).alias("before")), "capped-sizes")
    spans = sizes.groupBy("grp").agg(F.min("before").alias("base"), F.max("upto").alias("end"))
    spans = spans.select(F.col("grp").alias("whose"), "base", (F.col("end") - F.col("base") - 1).alias("final"))
    known = numbered.join(sizes.select("run", "before"), "run").join(spans, F.col("grp").eqNullSafe(F.col("whose")))
    known = known.select(F.col("grp").alias("of"), F.col("t").alias("then"), (F.col("no") + F.col("before") - F.col("base")).alias("batch"))
    dated = rows.where("t IS NOT NULL").join(known, F.col("grp").eqNullSafe(F.col("of")) & (F.col("t") == F.col("then"))).select("grp", "batch", "path", "at")
    undated = rows.where("t IS NULL").join(spans, F.col("grp").eqNullSafe(F.col("whose")), "left").select("grp", F.coalesce("final", F.lit(0)).alias("batch"), "path", "at")
    found = dated.unionByName(undated).groupBy("grp", F.col("batch").cast("int").alias("batch"), "path").agg(F.timestamp_micros(F.max("at")).alias("at"))
    return found.withColumnRenamed("grp", group)


class CappedDebounce(StatefulProcessor):
    """Numbers a group's batches in the order of event time, whatever the order in which events arrive.

    Events wait in the state until the watermark has passed them, so nothing earlier can follow; then they are folded in
    order of time and path, as capped_runs folds them. A batch goes out once the watermark has passed the time at which it
    falls due. The state holds the events younger than the watermark, and of the open batch the last event of each path.
    """

    def __init__(self, quiet: int = QUIET_SECONDS, longest: int = LONGEST_SECONDS):
        self.quiet, self.longest = 1000 * quiet, 1000 * longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        text, number = (lambda n: StructField(n, StringType())), (lambda n: StructField(n, LongType()))
        self.waiting = handle.getMapState("waiting", StructType([number("at"), text("path")]), StructType([number("events")]))
        self.pending = handle.getMapState("pending", StructType([text("path")]), StructType([number("at")]))
        self.span = handle.getValueState("span", StructType([number("batch"), number("first"), number("last")]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = 1000 * timerValues.getCurrentWatermarkInMs()
        for part in rows:
            for path, at in zip(part["path"], part["at"]):
                at = int(at)
                if at >= mark:  # what comes later than the watermark allows is late, as for any operator with one
                    self.waiting.updateValue((at, path), (1,))
                    self.handle.registerTimer(at // 1000 + 1)
        yield from self._fold(key, mark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._fold(key, 1000 * timerValues.getCurrentWatermarkInMs())

    def _fold(self, key, mark: int) -> Iterator[pd.DataFrame]:
        """Fold the waiting events before the mark; times are microseconds, what falls due is counted in milliseconds."""
        batch, first, last = self.span.get() if self.span.exists() else (-1, 0, 0)
        ripe = sorted(((k[0], k[1]) for k in self.waiting.keys() if k[0] < mark), key=lambda e: (e[0], e[1] is not None, e[1] or ""))
        for at, path in ripe:
            now = at // 1000
            if batch < 0 or now >= min(last + self.quiet, first + self.longest):
                yield from self._flush(key, batch)
                batch, first = batch + 1, now
            last = now
            self.pending.updateValue((path,), (at,))
            self.waiting.removeKey((at, path))
        if batch >= 0:
            self.span.update((batch, first, last))
            due = min(last + self.quiet, first + self.longest)
            if mark > 1000 * due:
                yield from self._flush(key, batch)
            elif ripe:
                self.handle.registerTimer(due + 1)

    def _flush(self, key, batch: int) -> Iterator[pd.DataFrame]:
        rows = [(key[0], batch, p[0], pd.Timestamp(v[0], unit="us")) for p, v in self.pending.iterator()]
        if rows:
            self.pending.clear()
            yield pd.DataFrame(rows, columns=["grp", "batch", "path", "at"])

    def close(self) -> None:
        pass


def debounced(events: DataFrame, group: str, quiet: int = QUIET_SECONDS, longest: int = LONGEST_SECONDS, late: int | None = None) -> DataFrame:
    """The streaming form of capped_batches: (grp, batch, path, at), a batch once it is due, whatever the order of arrival.

    Events may come up to `late` seconds (quiet, if not given) after later ones; more belated ones are dropped.
    """
    marked = events.withWatermark("at", f"{quiet if late is None else late} seconds")
    rows = marked.select(F.col(group).cast("string").alias("grp"), F.col("path").cast("string").alias("path"), F.col("at").alias("event_at"), F.unix_micros(F.col("at")).alias("at"))
    schema = "grp string, batch long, path string, at timestamp"
    return rows.groupBy("grp").transformWithStateInPandas(CappedDebounce(quiet, longest), outputStructType=schema, outputMode="append", timeMode="EventTime")


def suppress_own_writes(events: DataFrame, writes: DataFrame, seconds: int = OWN_WRITE_SECONDS) -> DataFrame:
    """Events of paths that the engine itself did not write in the so many seconds before; writes is (path, wrote_at)."""
    w = writes.select(F.col("path").alias("wrote"), "wrote_at")
    if events.isStreaming:
        events, w = events.withWatermark("at", f"{seconds} seconds"), w.withWatermark("wrote_at", f"{seconds} seconds")
    near = (F.col("path") == F.col("wrote")) & (F.col("at") >= F.col("wrote_at")) & (F.col("at") <= F.col("wrote_at") + F.make_dt_interval(secs=F.lit(seconds)))
    if events.isStreaming:
        return events.join(w, near, "left_outer").where(F.col("wrote").isNull()).drop("wrote", "wrote_at")
    return events.join(w, near, "left_anti")


def unseen_by_hash(batch: DataFrame, ingested: DataFrame, hash_col: str = "hash", order: str = "path") -> DataFrame:
    """The first row of each content hash in a batch that was not ingested before; ingested has the column hash_col."""
    first = batch.withColumn("__at", F.row_number().over(Window.partitionBy(hash_col).orderBy(order))).where("__at = 1").drop("__at")
    return first.join(ingested.select(hash_col), hash_col, "left_anti")


def run_batches(events: DataFrame, ingest: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Start a query that hands every micro-batch to ingest(rows, batch_id); trigger as for writeStream.trigger."""
    return events.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def due(last_run: DataFrame, now, period: str) -> DataFrame:
    """last_run (job, at) of jobs whose period has passed."""
    return last_run.where(F.col("at") + F.make_dt_interval(F.lit(PERIOD_DAYS[period])) <= now)


def changed_since(files: DataFrame, last) -> DataFrame:
    """One row (changed): whether any file (path, mtime) is newer."""
    return files.agg(F.coalesce(F.max("mtime") > last, F.lit(False)).alias("changed"))


def enqueue(queue: DataFrame, fresh: DataFrame) -> DataFrame:
    """The queue (path, status) with fresh paths as pending, those in flight and repeats left out."""
    flying = queue.where(F.col("status").isin("pending", "running"))
    new = fresh.select("path").distinct().join(flying, "path", "left_anti").withColumn("status", F.lit("pending"))
    return queue.join(new.select("path"), "path", "left_anti").unionByName(new)
