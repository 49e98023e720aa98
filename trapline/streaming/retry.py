"""Rejected lines tried again on a timer.

The rejects of an ingest are the letters. A stateful operator holds each one by its key for ``delay`` seconds, then
lets it out for another try through the same ingest. What fails goes back with one more try counted, for good or,
after ``most`` tries, to the lines given up. A line that was mended in between is tried as mended. Equal lines of a
service are one key with a count of copies, so the state grows with the different lines that wait. It lies in the state
store; a worker has some ``LINES_AT_ONCE`` lines before it, however many wait.

Time is the clock of the cluster, so tries go on while nothing arrives. Held letters and timers are part of the
checkpoint: a query that is started again goes on with them.
"""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trapline.streaming.ingest import finished, ingest_lines

# --- fixed values -----------------------------------------------------------
RETRY_SECONDS = 30.0
LINES_AT_ONCE = 500
# --- end of fixed values ----------------------------------------------------

REJECTS = "service string, value string, reject_reason string"
FAILED = "service string, value string, key string, attempt int, copies long, reject_reason string"
MENDS = "key string, value string"
TRIED = "key string, service string, value string, attempt int, copies long"
HELD = "service string, value string, mended string, attempt int, copies long, due long"


def line_key(service: Column, value: Column) -> Column:
    """The name of a rejected line, as mends give it."""
    return F.sha2(F.concat_ws(":", F.coalesce(service, F.lit("")), value), 256)


def mend(spark: SparkSession, out: str, mends: DataFrame) -> None:
    """Store ``key, value``: what lines are to be tried as from now on."""
    mends.select("key", "value").write.mode("append").parquet(f"{out}/mends")


def _stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    # The folder has to be there; an empty table makes it.
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(path)


def waiting(spark: SparkSession, out: str) -> DataFrame:
    """First rejects, lines that failed again, and mends, in the columns of the stateful operator."""
    first = _stream(spark, f"{out}/rejects", REJECTS).select(
        line_key(F.col("service"), F.col("value")).alias("key"), F.lit("letter").alias("kind"), "service", "value",
        F.lit(0).alias("attempt"), F.lit(1).cast("long").alias("copies"))
    again = _stream(spark, f"{out}/again", FAILED).select("key", F.lit("letter").alias("kind"), "service", "value", "attempt", "copies")
    mends = _stream(spark, f"{out}/mends", MENDS).select(
        "key", F.lit("mend").alias("kind"), F.lit(None).cast("string").alias("service"), "value",
        F.lit(None).cast("int").alias("attempt"), F.lit(0).cast("long").alias("copies"))
    return first.unionByName(again).unionByName(mends)


def _hold(delay_ms: int, at_once: int):
    """Keeps a key until its time has come. A mend that finds no letter waits ten delays for one.

    A worker hands over states along with rows only, more than ``at_once`` of them, and holds all until then. So every
    ``at_once`` keys so many rows without a key are let out, whether or not any line's time has come.
    """
    blank = pd.DataFrame({"key": None, "service": None, "value": None, "attempt": 0, "copies": 0}, index=range(at_once + 1))
    calls = 0

    def hold(key, frames, state):
        now = state.getCurrentProcessingTimeMs()
        if state.hasTimedOut:
            service, value, mended, attempt, copies, _due = state.get
            state.remove()
            if copies:
                yield pd.DataFrame({"key": [key[0]], "service": [service], "value": [value if mended is None else mended],
                                    "attempt": [attempt + 1], "copies": [copies]})
            return
        service, value, mended, attempt, copies, due = state.get if state.exists else (None, None, None, 0, 0, now + 10 * delay_ms)
        for frame in frames:
            letters, mends = frame[frame["kind"] == "letter"], frame[frame["kind"] == "mend"]
            if len(mends):
                mended = mends["value"].iloc[-1]
            if len(letters):
                if not copies:
                    service, value, due = letters["service"].iloc[0], letters["value"].iloc[0], now + delay_ms
                    attempt = int(letters["attempt"].min())
                attempt = min(attempt, int(letters["attempt"].min()))
                copies += int(letters["copies"].sum())
        state.update((service, value, mended, attempt, copies, due))
        state.setTimeoutDuration(max(1, due - now))

    def run(key, frames, state):
        nonlocal calls
        yield from hold(key, frames, state)
        calls += 1
        if calls % at_once == 0:
            yield blank

    return run


def due_lines(letters: DataFrame, delay: float = RETRY_SECONDS) -> DataFrame:
    """``key, service, value, attempt, copies`` of lines whose time has come."""
    held = _hold(int(delay * 1000), LINES_AT_ONCE)
    return letters.groupBy("key").applyInPandasWithState(held, TRIED, HELD, "append", "ProcessingTimeTimeout").filter("key IS NOT NULL")


def _try(out: str, most: int | None):
    def write(batch: DataFrame, batch_id: int) -> None:
        tried = batch.persist()
        try:
            if tried.isEmpty():
                return
            copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
            events, _rejects = ingest_lines(tried.select("service", "value", copy.alias("copy")).drop("copy"))
            _events, rejects = ingest_lines(tried.select("service", "value").distinct())
            failed = tried.join(rejects.select("service", "value", "reject_reason").distinct(), ["service", "value"])
            last = F.lit(False) if most is None else F.col("attempt") >= most
            events.write.mode("overwrite").parquet(f"{out}/retried/batch={batch_id}")
            failed.where(last).write.mode("overwrite").parquet(f"{out}/given_up/batch={batch_id}")
            # Letters that may have been read already are not written anew when a batch is repeated.
            if not finished(f"{out}/again/batch={batch_id}"):
                failed.where(~last).write.mode("overwrite").parquet(f"{out}/again/batch={batch_id}")
        finally:
            tried.unpersist()

    return write


def start_retry(
    spark: SparkSession, out: str, checkpoint: str, delay: float = RETRY_SECONDS, most: int | None = None, period: str = "2 seconds",
    partitions: int | None = None,
) -> StreamingQuery:
    """Try the rejects of the ingest that writes to ``out`` every ``delay`` seconds, ``most`` times or until they pass.

    Events that pass are in ``out/retried``, lines given up with their reason, tries and copies in ``out/given_up``. The state
    lies in ``partitions`` parts, or as many as the session shuffles to; the number stays with the checkpoint.
    """
    writer = due_lines(waiting(spark, out), delay).writeStream.foreachBatch(_try(out, most))
    writer = writer.option("checkpointLocation", checkpoint).trigger(processingTime=period)
    settings = {"spark.sql.shuffle.partitions": str(partitions or spark.conf.get("spark.sql.shuffle.partitions")),
                "spark.sql.execution.arrow.maxRecordsPerBatch": str(LINES_AT_ONCE)}
    usual = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        # The query keeps the settings of its start.
        return writer.start()
    finally:
        for name, value in usual.items():
            spark.conf.set(name, value)


def settle(query: StreamingQuery, patience: float = 600.0) -> None:
    """Stop the query once it holds no letter and has found no new one twice in a row."""
    quiet, seen, until = 0, -1, time.time() + patience
    while quiet < 2 and time.time() < until and query.isActive:
        time.sleep(0.1)
        last = query.lastProgress
        if last is None or last["batchId"] == seen:
            continue
        seen = last["batchId"]
        held = sum(o["numRowsTotal"] for o in last["stateOperators"])
        quiet = quiet + 1 if held == 0 and last["numInputRows"] == 0 else 0
    query.stop()
    if query.exception() is not None:
        raise query.exception()
    if quiet < 2:
        raise TimeoutError("letters are still held")
