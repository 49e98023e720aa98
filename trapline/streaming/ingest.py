"""Continuous ingest of sensor files.

Sensors that rotate their files are followed by the file source, those that append by the
source of growing files. The batch job uses the same column functions, so all give the same rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trapline.operators.normalize import canonical, normalise_sensor_lines, split_valid
from trapline.sources.files import parse_lines
from trapline.sources.growing import RANGE_BYTES, file_system, growing_lines

# --- fixed values -----------------------------------------------------------
BATCH_PERIOD = "2 seconds"
FILES_PER_BATCH = 1000
# --- end of fixed values ----------------------------------------------------

SERVICE_FOLDER = r"service=([a-z]+)"


def sensor_line_stream(
    spark: SparkSession, path: str, files_per_batch: int = FILES_PER_BATCH,
    since: datetime | None = None,
) -> DataFrame:
    """Lines of new sensor files below ``service=<name>`` folders.

    ``since`` skips files that were last changed before it, for a first run
    that should not read old files.
    """
    lines = (spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch)
             .option("recursiveFileLookup", True).load(path))
    if since is not None:
        lines = lines.filter(F.col("_metadata.file_modification_time") >= F.lit(since))
    service = F.regexp_extract(F.col("_metadata.file_path"), SERVICE_FOLDER, 1)
    return lines.select("value", service.alias("service"))


def growing_line_stream(
    spark: SparkSession, path: str, pattern: str = "*", from_end: bool = False, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Lines appended to sensor files below ``service=<name>`` folders, each once.

    ``from_end`` begins behind what the files hold at the first run.
    """
    lines = growing_lines(spark, path, pattern, from_end, range_bytes)
    return lines.select("value", F.regexp_extract("path", SERVICE_FOLDER, 1).alias("service"))


def ingest_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical events, and rejected lines with the reason.

    Noise that the sensors' own filters drop is in neither. Every reject keeps the
    line as it came, so it can be replayed.
    """
    good, malformed = parse_lines(lines)
    valid, invalid = split_valid(normalise_sensor_lines(good, keep_raw=True))
    rejected = malformed.select("service", "value", F.lit("malformed line").alias("reject_reason"))
    refused = invalid.select(F.col("honeypot_type").alias("service"), F.col("raw").alias("value"), "reject_reason")
    return canonical(valid), rejected.unionByName(refused)


def finished(path: str) -> bool:
    """Whether a table was written here to its end."""
    system, base = file_system(path)
    return system.get_file_info(f"{base}/_SUCCESS").is_file


def _write_batch(out: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        # Overwriting the batch's own folder makes a repeated batch harmless.
        lines = batch.persist()
        try:
            events, rejects = ingest_lines(lines)
            events.write.mode("overwrite").parquet(f"{out}/events/batch={batch_id}")
            # The retry may have read whole rejects already, so they are not written anew.
            if not finished(f"{out}/rejects/batch={batch_id}"):
                rejects.write.mode("overwrite").parquet(f"{out}/rejects/batch={batch_id}")
        finally:
            lines.unpersist()

    return write


def start_ingest(
    lines: DataFrame, out: str, checkpoint: str, period: str | None = BATCH_PERIOD
) -> StreamingQuery:
    """Write canonical events and rejects per micro-batch.

    ``period=None`` takes all files present and stops.
    """
    writer = lines.writeStream.foreachBatch(_write_batch(out)).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if period is None else {"processingTime": period}
    return writer.trigger(**trigger).start()


def replay_rejects(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """Run all stored rejects, malformed or refused, through the ingest again."""
    stored = spark.read.parquet(f"{out}/rejects")
    return ingest_lines(stored.select("value", "service"))
