"""Caches, logs, histories, limits and batches: the running sums and ordered picks of upkeep jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.running import running_sum

CACHE = {"ttl_days": 30, "bytes": 100 << 20, "entries": 1000, "entry_bytes": 10 << 20}
#: Items a batch, batches and items in all, by how fine the extraction is.
GRANULARITY = {"fine": (30, 12, 100), "standard": (20, 6, 50), "coarse": (10, 3, 10), "minimal": (5, 1, 5)}
SHORT_CONTENT, CHARS_PER_ITEM, LEAST_BATCH = 20_000, 600, 5
RESPONSE_CHARS = 16_000


def expired(entries: DataFrame, now: Column, days: int = CACHE["ttl_days"]) -> DataFrame:
    return entries.where(F.col("mtime") < now - F.make_dt_interval(F.lit(days)))


def evicted(entries: DataFrame, most_bytes: int, most_entries: int) -> DataFrame:
    """entries (key, size, mtime) to drop, oldest first, until both caps hold.

    Days are summed first: only the day in which the cut lies is walked row by row.
    """
    day = F.date_trunc("day", "mtime")
    per_day = entries.groupBy(day.alias("day")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_day.select("day", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"))
    total = per_day.agg(F.sum("bytes").alias("all_bytes"), F.sum("n").alias("all_n"))
    inside = Window.partitionBy("day").orderBy("mtime", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = entries.withColumn("day", day).join(starts, "day").crossJoin(F.broadcast(total))
    gone_bytes = F.col("bytes_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    gone_n = F.col("n_before") + F.coalesce(F.count("*").over(inside), F.lit(0))
    out = placed.withColumn("out", (F.col("all_bytes") - gone_bytes > most_bytes) | (F.col("all_n") - gone_n > most_entries))
    return out.where("out").select(*entries.columns)


def trim_log(lines: DataFrame, keep_chars: int) -> DataFrame:
    """lines (pos, line) from the first heading within the last keep_chars on."""
    tail = running_sum(lines, F.char_length("line") + 1, "after", F.col("pos").desc()).where(F.col("after") <= keep_chars)
    first = tail.where("line LIKE '## %'").agg(F.min("pos").alias("first"))
    return tail.crossJoin(F.broadcast(first)).where("pos >= first").select("pos", "line")


def folder_tree(files: DataFrame) -> DataFrame:
    """(folder, depth, files, below): each folder with the files in it and those anywhere below.  files is (path)."""
    parts = F.split("path", "/")
    depth = F.size(parts) - 1
    prefixes = F.transform(F.sequence(F.lit(0), depth), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, 1, d), "/").alias("folder"), (d == depth).alias("own")))
    flat = files.select(F.explode(prefixes).alias("p")).select("p.*")
    return flat.groupBy("folder", "depth").agg(F.count_if("own").alias("files"), F.count("*").alias("below"))


def batch_limits(length: Column, granularity: str = "standard") -> Column:
    """Struct (batch, batches, items) for content of a length."""
    size, base, items = GRANULARITY[granularity]
    fewer = F.least(F.lit(items), F.greatest(F.lit(5), F.ceil(length / CHARS_PER_ITEM)))
    batches = F.least(F.lit(3 * base), F.greatest(F.lit(2), F.ceil(length / 2000) + 2))
    return F.struct(F.lit(size).alias("batch"), batches.cast("int").alias("batches"), F.when(length < SHORT_CONTENT, fewer).otherwise(items).cast("int").alias("items"))


def resized_batch(size: Column, response: Column, threshold: float = 0.7 * RESPONSE_CHARS) -> Column:
    return F.when((response > threshold) & (size > LEAST_BATCH), F.greatest(F.lit(LEAST_BATCH), F.floor(size * 0.75))).otherwise(size)


def capped(items: DataFrame, cap: int, group: str, *order: str) -> DataFrame:
    """The first `cap` rows of each group."""
    return items.withColumn("at", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("at") <= cap)


def deltas(entries: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """entries with the previous value in the group and the change; no previous value gives null and 0."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(order))
    return entries.withColumn("previous", before).withColumn("delta", F.coalesce(F.col(value) - before, F.lit(0.0)))


def delta_label(delta: Column, previous: Column) -> Column:
    return F.when(previous.isNull(), F.lit(None).cast("string")).when(delta == 0, "same").when(delta > 0, "up").otherwise("down")


def within(ts: Column, now: Column, days: int) -> Column:
    """Whether the end of an entry's day lies in the last so many days."""
    return F.date_trunc("day", ts) + F.make_dt_interval(F.lit(1)) >= now - F.make_dt_interval(F.lit(days))


def first_occurrences(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("at = 1").drop("at")


def merge_adjacent(sections: DataFrame) -> DataFrame:
    """sections (entry, pos, heading, count): runs of equal headings become one row with the sum of counts."""
    w = Window.partitionBy("entry").orderBy("pos")
    start = F.when(F.lag("heading").over(w).eqNullSafe(F.col("heading")), 0).otherwise(1)
    return sections.withColumn("start", start).withColumn("run", F.sum("start").over(w)).groupBy("entry", "run").agg(F.min("pos").alias("pos"), F.first("heading").alias("heading"), F.sum("count").alias("count"))


def rate_limits(failures: DataFrame, concurrency: int, delay: int) -> DataFrame:
    """One row (failures, concurrency, delay) if a failure speaks of a rate limit, else none.  failures is (reason, type)."""
    hit = F.lower("reason").rlike(r"429|rate.?limit|too many requests|throttl") & ~F.col("type").eqNullSafe(F.lit("parse-failure"))
    n = failures.where(hit).agg(F.count("*").alias("failures")).where("failures > 0")
    return n.select("failures", F.lit(max(1, concurrency - 1)).alias("concurrency"), F.lit(500 if delay < 100 else min(2 * delay, 10_000)).alias("delay"))


def merge_batches(items: DataFrame, cap: int | None = None) -> DataFrame:
    """(source, name, batch, mentions, place): an ordered fold of extraction batches.

    items is (source, batch, pos, name, aliases, mentions).  A name that an earlier batch kept, as name or alias, is a
    duplicate whose mentions join the kept row of that name; inside one batch repeats stay; at most cap rows of a source are kept.
    """
    import pandas as pd

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        seen: set[str] = set()
        kept: list[list] = []
        for batch, part in rows.sort_values(["batch", "pos"], kind="stable").groupby("batch", sort=True):
            new = []
            for name, aliases, mentions in zip(part["name"], part["aliases"], part["mentions"]):
                key = name.strip().lower()
                if key in seen:
                    for row in kept:
                        if row[1].strip().lower() == key:
                            row[3] += [m for m in mentions if m not in row[3]]
                else:
                    new.append(([rows["source"].iloc[0], name, batch, list(mentions)], aliases))
            room = len(new) if cap is None else max(0, cap - len(kept))
            for row, aliases in new[:room]:
                kept.append(row)
                seen |= {row[1].strip().lower(), *(a.strip().lower() for a in aliases)}
        return pd.DataFrame([(*r, k) for k, r in enumerate(kept)], columns=["source", "name", "batch", "mentions", "place"])

    return items.groupBy("source").applyInPandas(fold, "source string, name string, batch int, mentions array<string>, place int")


def convergence(batches: DataFrame, start: int = 20, least: int = LEAST_BATCH) -> DataFrame:
    """(source, batch, size, stop): the batch sizes of an extraction and where it stops.

    batches is (source, batch, raw, new); without the column new, raw stands for it.  Under half of the asked yield halves the
    size once and stops the second time; a batch with nothing in it, or nothing new, stops at once.
    """
    import pandas as pd

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        size, halved, out = start, False, []
        for r in rows.sort_values("batch").itertuples():
            stop = r.raw == 0 or r.new == 0
            used = size
            if not stop and r.raw / size < 0.5 and size > least:
                stop = halved
                size, halved = (size, True) if halved else (max(least, size // 2), True)
            out.append((r.source, r.batch, used, stop))
            if stop:
                break
        return pd.DataFrame(out, columns=["source", "batch", "size", "stop"])

    counted = batches.select("source", F.col("batch").cast("int").alias("batch"), "raw", F.col("new" if "new" in batches.columns else "raw").alias("new"))
    return counted.groupBy("source").applyInPandas(fold, "source string, batch int, size int, stop boolean")


def cumulative_stop(batches: DataFrame, most: int) -> DataFrame:
    """batches (source, batch, new) with the running total and whether it has reached `most`."""
    return batches.withColumn("total", F.sum("new").over(Window.partitionBy("source").orderBy("batch"))).withColumn("stop", F.col("total") >= most)
