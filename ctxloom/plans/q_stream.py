"""Streaming queries: run once over the events folder, with the same rows as a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxloom.operators import store as S
from ctxloom.plans.registry import query
from ctxloom.sources import scratch
from ctxloom.streaming import stateful
from ctxloom.streaming import stream as ST


def _place(t, name: str) -> str:
    return scratch.new_path(t.spark, f"stream-{name}")


@query("stream_hourly", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_hourly(t):
    at = _place(t, "hourly")
    src = ST.source(t.spark, f"{t.dir}/events.parquet")
    # append mode emits an hour once the watermark has passed it; a complete table is folded batch by batch
    ST.fold(src, at + "/checkpoint", lambda b, n: ST.hourly(b, ["event_type"]).write.mode("overwrite").parquet(f"{at}/out/batch={n}"))
    return t.spark.read.parquet(at + "/out").groupBy(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.sum("n").alias("n"))


@query("stream_upsert", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def stream_upsert(t):
    at = _place(t, "upsert")
    ST.fold(ST.source(t.spark, f"{t.dir}/events.parquet").select("user_id", "event_id"), at + "/checkpoint", ST.upsert_table(at + "/table", "user_id", "event_id"))
    versions = t.spark.read.option("recursiveFileLookup", "true").parquet(at + "/table")
    return S.latest(versions, "user_id", "event_id")


@query("stream_late", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_late(t):
    at = _place(t, "late")
    src = ST.source(t.spark, f"{t.dir}/events.parquet")
    ST.once(ST.hourly(src, ["event_type"], delay="1 hour"), at + "/out", at + "/checkpoint")
    return t.spark.read.schema("hour timestamp, event_type string, n long").parquet(at + "/out").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("stream_dedupe", """, RECURSIVE e AS (SELECT user_id, ts, min(event_id) AS event_id FROM events GROUP BY user_id, ts),
n AS MATERIALIZED (SELECT e.user_id, e.event_id, f.event_id AS later FROM e ASOF LEFT JOIN e f ON e.user_id = f.user_id AND e.ts + INTERVAL 1 HOUR <= f.ts),
c AS (SELECT user_id, arg_min(event_id, ts) AS event_id FROM e GROUP BY user_id UNION ALL SELECT c.user_id, n.later FROM c JOIN n ON n.event_id = c.event_id WHERE n.later IS NOT NULL)
SELECT event_id FROM c""")
def stream_dedupe(t):
    return ST.accepted(t.events.select("event_id", "ts", "user_id"), "user_id", seconds=3600).select("event_id")


@query("stream_dedupe_watermark")
def stream_dedupe_watermark(t):
    at = _place(t, "dedupe")
    ST.once(ST.deduped(ST.source(t.spark, f"{t.dir}/events.parquet"), ["user_id", "event_type"], seconds=3600).select("event_id"), at + "/out", at + "/checkpoint")
    return t.spark.read.schema("event_id long").parquet(at + "/out")


@query("stream_coalesce", "SELECT event_type, arg_max(value, event_id) AS value FROM events GROUP BY event_type")
def stream_coalesce(t):
    return t.events.groupBy("event_type").agg(F.max_by("value", "event_id").alias("value"))


@query("win_sliding", "SELECT CAST(w AS TIMESTAMP) AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY w")
def win_sliding(t):
    return t.events.groupBy(F.window(F.col("ts").cast("timestamp"), "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("win_session", """, g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def win_session(t):
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("stream_ttl", """SELECT user_id, event_id, ts + INTERVAL 6 HOUR AS expire_at FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS later FROM events)
WHERE later >= ts + INTERVAL 6 HOUR OR (later IS NULL AND ts + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events))""")
def stream_ttl(t):
    """Each event is a version of its user's record, which lives for six hours."""
    at, spark = _place(t, "ttl"), stateful.stateful_session(t.spark)
    src = ST.source(spark, f"{t.dir}/events.parquet").select("user_id", "event_id", "ts", (F.col("ts") + F.make_interval(hours=F.lit(6))).alias("expire_at"))
    ST.once(stateful.expirations(src, "user_id", "event_id", "ts", "expire_at", "1 hour"), at + "/out", at + "/checkpoint")
    return t.spark.read.schema("user_id long, event_id long, expire_at timestamp").parquet(at + "/out").withColumn("expire_at", F.col("expire_at").cast("timestamp_ntz"))


@query("stream_countdown", "SELECT concat(operation, '/', user_id) AS task, count(*) AS total FROM usage GROUP BY operation, user_id HAVING count(*) = count(*) FILTER (status_code < 400)")
def stream_countdown(t):
    """A task for each operation of a user, registered with its number of calls; calls that succeed count it down."""
    at, spark = _place(t, "countdown"), stateful.stateful_session(t.spark)
    u = t.usage.select(F.concat_ws("/", "operation", "user_id").alias("task"), F.col("event_id").alias("seq"), "status_code")
    start = u.groupBy("task").agg(F.lit(-1).cast("long").alias("seq"), F.count("*").alias("total"))
    start.unionByName(u.where("status_code < 400").select("task", "seq", F.lit(None).cast("long").alias("total"))).write.parquet(at + "/log")
    ST.once(stateful.completions(ST.source(spark, at + "/log", 1 << 30), "task", "seq", "total"), at + "/out", at + "/checkpoint")
    return t.spark.read.schema("task string, total long").parquet(at + "/out")
