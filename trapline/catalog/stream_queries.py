"""Streaming operators, run over all files present and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.catalog.registry import micros, query
from trapline.fixtures import Tables
from trapline.session import scratch_path
from trapline.streaming import ingest, live, retry


def _ingested(t: Tables, **options) -> str:
    out = scratch_path(t.spark, "ingest")
    lines = ingest.sensor_line_stream(t.spark, t.sensor_files(), **options)
    ingest.start_ingest(lines, out, scratch_path(t.spark, "offsets"), period=None).awaitTermination()
    return out


def _event_stream(t: Tables, rows: DataFrame) -> DataFrame:
    path = scratch_path(t.spark, "events")
    rows.write.parquet(path)
    return t.spark.readStream.schema(rows.schema).parquet(path)


def _result(t: Tables, frame: DataFrame) -> DataFrame:
    out = scratch_path(t.spark, "live")
    live.run_available(frame, out, scratch_path(t.spark, "offsets"))
    return t.spark.read.schema(frame.schema).parquet(out)


KEPT = "SELECT * FROM kept WHERE source_ip IS NOT NULL"


@query("T01_continuous_ingest", f"""
SELECT service, event_type, severity, count(*) AS n, count(DISTINCT source_ip) AS sources FROM ({KEPT}) GROUP BY ALL""", ["kept"])
def _(t: Tables):
    events = t.spark.read.parquet(f"{_ingested(t)}/events")
    return events.groupBy("service", "event_type", "severity").agg(
        F.count("*").alias("n"), F.count_distinct("src_ip").alias("sources"))


@query("T01_growing_files", f"""
SELECT service, event_type, severity, count(*) AS n, count(DISTINCT source_ip) AS sources FROM ({KEPT}) GROUP BY ALL""", ["kept"])
def _(t: Tables):
    # Files appear, grow, and are started anew with fewer lines; each run goes on from the last one's offsets.
    folder, out, offsets = (scratch_path(t.spark, n) for n in ("growing", "ingest", "offsets"))
    for steps in ([0], [0, 1], [2]):
        t.grow_files(folder, steps)
        ingest.start_ingest(ingest.growing_line_stream(t.spark, folder), out, offsets, period=None).awaitTermination()
    events = t.spark.read.parquet(f"{out}/events")
    return events.groupBy("service", "event_type", "severity").agg(
        F.count("*").alias("n"), F.count_distinct("src_ip").alias("sources"))


@query("T02_micro_batches", f"SELECT count(*) AS events, true AS several_batches FROM ({KEPT})", ["kept"])
def _(t: Tables):
    events = t.spark.read.parquet(f"{_ingested(t, files_per_batch=2)}/events")
    return events.agg(
        F.count("*").alias("events"), (F.count_distinct("batch") > 1).alias("several_batches"))


@query("T03_dead_letters", """
SELECT service, 'malformed line' AS reject_reason, count(*) AS n FROM lines WHERE broken GROUP BY service""", ["lines"])
def _(t: Tables):
    # Replaying lines that are still broken rejects all of them again.
    _events, rejects = ingest.replay_rejects(t.spark, _ingested(t))
    return rejects.groupBy("service", "reject_reason").agg(F.count("*").alias("n"))


@query("T03_timed_retry", f"""
SELECT service, 'delivered' AS outcome, 1 AS tries, count(*) AS n FROM ({KEPT}) WHERE id % 50 = 3 GROUP BY service
UNION ALL SELECT service, 'malformed line', 2, count(*) FROM lines WHERE broken GROUP BY service""", ["kept"])
def _(t: Tables):
    # Events with a broken time are refused and get their own time back while they wait; broken lines are given up.
    never = F.when(F.col("id") % 50 == 3, F.regexp_replace("value", '"timestamp":"[^"]*"', '"timestamp":"never"')).otherwise(F.col("value"))
    sent = t.sensor_lines.withColumn("sent", never)
    folder, out = scratch_path(t.spark, "sensor-lines"), scratch_path(t.spark, "ingest")
    sent.select("service", "sent").write.partitionBy("service").text(folder)
    ingest.start_ingest(ingest.sensor_line_stream(t.spark, folder), out, scratch_path(t.spark, "offsets"), period=None).awaitTermination()
    refused = t.spark.read.parquet(f"{out}/rejects").filter("reject_reason = 'bad timestamp'").select(
        retry.line_key(F.col("service"), F.col("value")).alias("key"))
    mends = sent.select(retry.line_key(F.col("service"), F.col("sent")).alias("key"), "value")
    retry.mend(t.spark, out, mends.join(refused, "key", "left_semi"))
    retry.settle(retry.start_retry(t.spark, out, scratch_path(t.spark, "offsets"), delay=1, most=2, period="0 seconds", partitions=8))
    delivered = t.spark.read.parquet(f"{out}/retried").groupBy("service").agg(F.count("*").alias("n")).select(
        "service", F.lit("delivered").alias("outcome"), F.lit(1).alias("tries"), "n")
    given_up = t.spark.read.parquet(f"{out}/given_up").groupBy(
        "service", F.col("reject_reason").alias("outcome"), F.col("attempt").alias("tries")).agg(F.sum("copies").alias("n"))
    return delivered.unionByName(given_up)


@query("T04_canonical_stream", f"""
SELECT timestamp, source_ip AS src_ip, event_type, sensor_id, service,
  coalesce(nullif(session_id, ''), sha256(source_ip || ':' || event_type || ':' || regexp_replace(timestamp[:13], '[^0-9]', '', 'g'))) AS session_id
FROM ({KEPT})""", ["kept"])
def _(t: Tables):
    return t.spark.read.parquet(f"{_ingested(t)}/events").select(
        "timestamp", "src_ip", "event_type", "sensor_id", "service", "session_id")


def _counted(t: Tables, counts: DataFrame, *keys: str) -> DataFrame:
    """The counts of all windows, those that are still open included."""
    out = scratch_path(t.spark, "counts")
    live.start_source_counts(counts, out, scratch_path(t.spark, "offsets"), availableNow=True).awaitTermination()
    return live.latest_counts(t.spark, out, *keys)


@query("T05_hourly_sessions", """
SELECT epoch_us(date_trunc('hour', ts)) AS hour, src_ip, event_type, count(*) AS events FROM raw_logs
GROUP BY ALL""")
def _(t: Tables):
    rows = t.raw_logs.select("ts", "src_ip", "event_type")
    return _counted(t, live.hourly_sessions(_event_stream(t, rows)), "hour", "src_ip", "event_type").select(
        micros("hour.start").alias("hour"), "src_ip", "event_type", "events")


@query("T06_distinct_events", "SELECT id, event_type, src_ip FROM raw_logs")
def _(t: Tables):
    # Every event arrives twice.
    rows = t.raw_logs.select("id", "ts", "event_type", "src_ip")
    return _result(t, live.distinct_events(_event_stream(t, rows.unionAll(rows)))).drop("ts")


@query("T07_last_minute", """
SELECT epoch_us(s) AS start, count(*) AS events FROM (
  SELECT ts, time_bucket(INTERVAL 10 SECOND, ts) - to_seconds(10 * unnest([0, 1, 2, 3, 4, 5])) AS s FROM raw_logs)
GROUP BY s""")
def _(t: Tables):
    rows = t.raw_logs.select("ts")
    return _counted(t, live.last_minute(_event_stream(t, rows)), "minute").select(
        micros("minute.start").alias("start"), "events")


@query("T08_live_leaders", """
SELECT epoch_us(day) AS day, src_ip, events, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY day ORDER BY events DESC, src_ip) AS rank FROM (
    SELECT date_trunc('day', ts)::TIMESTAMP AS day, src_ip, count(*) AS events FROM raw_logs WHERE src_ip NOT LIKE '10.%' GROUP BY ALL))
WHERE rank <= 8""")
def _(t: Tables):
    out = scratch_path(t.spark, "leaders")
    counts = live.source_counts(_event_stream(t, t.raw_logs.select("ts", "src_ip")))
    live.start_source_counts(
        counts, out, scratch_path(t.spark, "offsets"), availableNow=True).awaitTermination()
    return live.live_leaders(t.spark, out).select(
        micros("day.start").alias("day"), "src_ip", "events", "rank")
