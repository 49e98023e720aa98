"""Live aggregates with bounded state.

Every operator takes a watermark delay. Events later than that reach only the
batch reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trapline.operators.filters import public_sources

# --- fixed values -----------------------------------------------------------
DELAY = "1 hour"
LEADERS = 8
# --- end of fixed values ----------------------------------------------------


def hourly_sessions(events: DataFrame, ts: str = "ts", delay: str = DELAY) -> DataFrame:
    """Events per source, type and hour.

    Append mode gives an hour once it is final, update mode also the current one.
    """
    return (events.withWatermark(ts, delay)
            .groupBy(F.window(ts, "1 hour").alias("hour"), "src_ip", "event_type")
            .agg(F.count("*").alias("events")))


def distinct_events(events: DataFrame, key: str = "id", ts: str = "ts", delay: str = DELAY) -> DataFrame:
    """Each event once, if its copies arrive within the delay."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def last_minute(events: DataFrame, ts: str = "ts", delay: str = DELAY) -> DataFrame:
    """Events in the last 60 seconds, every 10 seconds (T07); modes as for hours."""
    return (events.withWatermark(ts, delay)
            .groupBy(F.window(ts, "60 seconds", "10 seconds").alias("minute"))
            .agg(F.count("*").alias("events")))


def source_counts(events: DataFrame, ts: str = "ts", delay: str = DELAY) -> DataFrame:
    """Events per public source and day (T08), for update mode."""
    return (public_sources(events).withWatermark(ts, delay)
            .groupBy(F.window(ts, "24 hours").alias("day"), "src_ip")
            .agg(F.count("*").alias("events")))


def start_source_counts(counts: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Store the changed counts of every micro-batch, open windows included."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (counts.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def latest_counts(spark: SparkSession, out: str, *keys: str) -> DataFrame:
    """The newest stored count of every window, final or still open."""
    return spark.read.parquet(out).groupBy(*keys).agg(F.max_by("events", "batch").alias("events"))


def live_leaders(spark: SparkSession, out: str, size: int = LEADERS) -> DataFrame:
    """Top sources per day from the stored counts."""
    latest = latest_counts(spark, out, "day", "src_ip")
    rank = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("events"), "src_ip"))
    return latest.withColumn("rank", rank).filter(F.col("rank") <= size)


def run_available(frame: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything present into parquet, then stop."""
    (frame.writeStream.format("parquet").outputMode(mode).option("path", out)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
