"""Event queries: the finite forms of the streaming operators over `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.plans.registry import load, query
from marlstone.streaming import watch


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Users are paths; the event's day is the file time; kinds are folders."""
    return load(spark, sf, "events").select(F.col("user_id").alias("path"), F.date_trunc("day", "ts").alias("mtime"), F.col("ts").alias("at"), F.col("event_type").alias("folder"), "event_id")


@query("event_dedup_ttl", """WITH RECURSIVE e AS (SELECT event_id, user_id, date_trunc('day', ts) AS day, ts, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS place FROM events),
r AS (SELECT event_id, user_id, day, place, ts AS accepted, TRUE AS kept FROM e WHERE place = 1
  UNION ALL SELECT e.event_id, e.user_id, e.day, e.place, CASE WHEN e.ts >= accepted + INTERVAL 600 SECOND THEN e.ts ELSE accepted END, e.ts >= accepted + INTERVAL 600 SECOND
  FROM r JOIN e ON e.user_id = r.user_id AND e.day = r.day AND e.place = r.place + 1)
SELECT event_id FROM r WHERE kept""")
def event_dedup_ttl(spark: SparkSession, sf: str) -> DataFrame:
    return watch.drop_repeats(_events(spark, sf)).select("event_id")


SESSION_SQL = """x AS (SELECT event_type, user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL {s} SECOND THEN 0 ELSE 1 END AS start FROM events),
r AS (SELECT *, sum(start) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM x)"""


@query("debounce_sessions", f"WITH {SESSION_SQL.format(s=600)} SELECT event_type AS folder, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS events, count(DISTINCT user_id) AS paths FROM r GROUP BY event_type, run")
def debounce_sessions(spark: SparkSession, sf: str) -> DataFrame:
    out = watch.quiet_batches(_events(spark, sf), 600, by="folder")
    return out.select("folder", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "events", "paths")


@query("debounce_capped", """WITH RECURSIVE e AS (SELECT event_type, user_id, ts, epoch_ms(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, user_id::VARCHAR) AS place FROM events),
r AS (SELECT event_type, user_id, ts, t, place, 0 AS batch, t AS first FROM e WHERE place = 1
  UNION ALL SELECT e.event_type, e.user_id, e.ts, e.t, e.place, CASE WHEN e.t >= least(r.t + 600000, first + 3600000) THEN batch + 1 ELSE batch END, CASE WHEN e.t >= least(r.t + 600000, first + 3600000) THEN e.t ELSE first END
  FROM r JOIN e ON e.event_type = r.event_type AND e.place = r.place + 1)
SELECT event_type AS folder, batch, user_id::VARCHAR AS path, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS at FROM r GROUP BY ALL""")
def debounce_capped(spark: SparkSession, sf: str) -> DataFrame:
    return watch.capped_batches(_events(spark, sf), "folder", 600, 3600).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("self_write_suppression", """SELECT event_id FROM events e WHERE event_type <> 'purchase' AND NOT EXISTS (SELECT 1 FROM events w WHERE w.event_type = 'purchase' AND w.user_id = e.user_id AND e.ts >= w.ts AND e.ts <= w.ts + INTERVAL 7200 SECOND)""")
def self_write_suppression(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases stand for the engine's own writes."""
    e = _events(spark, sf)
    writes = e.where("folder = 'purchase'").select("path", F.col("at").alias("wrote_at"))
    return watch.suppress_own_writes(e.where("folder <> 'purchase'"), writes, 7200).select("event_id")


@query("hash_dedup_batch", """WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS h, source FROM documents), old AS (SELECT DISTINCT h FROM d WHERE source = 'src0')
SELECT doc_id FROM d WHERE source <> 'src0' AND h NOT IN (SELECT h FROM old) QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1""")
def hash_dedup_batch(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("hash"), "source")
    return watch.unseen_by_hash(docs.where("source <> 'src0'"), docs.where("source = 'src0'").select("hash").distinct(), order="doc_id").select("doc_id")
