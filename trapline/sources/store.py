"""The stored event table: scan, flattening, labelled sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.functions.clock import parse_utc
from trapline.schema import CORE_COLUMNS, EVENT_PREFIX, PLAN_SERVICES

#: What a payload may hold besides the columns that the document itself gives.
PAYLOAD_FIELDS = [c for c in CORE_COLUMNS if c not in ("eventid", "timestamp", "session_id", "src_ip", "sensor")] + [
    "command", "query"]


def newest_first(logs: DataFrame, limit: int | None = None, before_id: int | None = None) -> DataFrame:
    """Stored events by descending id (S07); page with ``before_id``, not offsets."""
    if before_id is not None:
        logs = logs.filter(F.col("id") < before_id)
    ordered = logs.orderBy(F.desc("id"))
    return ordered if limit is None else ordered.limit(limit)


def service_counts(event_type: Column, active: Column) -> list[Column]:
    """Sensor count of the event's own service, 0 for all others."""
    prefix = F.split_part(event_type, F.lit("."), F.lit(1))
    return [
        F.when(prefix == EVENT_PREFIX[s], F.coalesce(active, F.lit(0))).otherwise(0).cast("int")
         .alias(f"{s}_honeypot_count")
        for s in PLAN_SERVICES
    ]


def flatten(logs: DataFrame, payload_fields: list[str] | None = None) -> DataFrame:
    """Stored JSON documents to flat events.

    Payload values replace ``timestamp`` and ``sensor``; for session, type and
    source the document's own value wins. A document that is not JSON gives an
    event without values; ``broken_documents`` lists those. ``payload`` keeps the
    whole payload as JSON text, so no field is lost.
    """
    fields = PAYLOAD_FIELDS if payload_fields is None else payload_fields
    doc = F.try_parse_json("raw_json")

    def text(path: str, kind: str = "string") -> Column:
        return F.try_variant_get("doc", path, kind)

    own_count = F.coalesce(
        F.when(F.col("active_honeypot_count") != 0, F.col("active_honeypot_count")),
        F.try_variant_get("doc", "$.active_honeypot_count", "int"),
        F.try_variant_get("doc", "$.payload.active_honeypot_count", "int"))
    eventid = text("$.event_type")
    parsed = logs.select("id", "active_honeypot_count", doc.alias("doc"))
    return parsed.select(
        "id", (-F.col("id")).alias("ord"),
        parse_utc(F.coalesce(text("$.payload.timestamp"), text("$.timestamp"))).alias("timestamp"),
        text("$.session_id").alias("session_id"),
        text("$.src_ip").alias("src_ip"),
        F.coalesce(text("$.payload.sensor"), text("$.sensor_id")).alias("sensor"),
        eventid.alias("eventid"),
        *[text(f"$.payload.{f}", CORE_COLUMNS.get(f, "string")).alias(f) for f in fields],
        text("$.payload").alias("payload"),
        *service_counts(eventid, own_count),
        F.lit("backend").alias("source"),
    )


def broken_documents(logs: DataFrame) -> DataFrame:
    """Stored rows whose document cannot be read, with the reason."""
    reason = F.when(F.col("raw_json").isNull(), "no document").when(F.try_parse_json("raw_json").isNull(), "not JSON")
    return logs.withColumn("reject_reason", reason).filter("reject_reason IS NOT NULL")


def from_canonical(events: DataFrame, payload_fields: list[str] | None = None) -> DataFrame:
    """Canonical events with their count snapshot to flat events.

    The newest event comes first in ``ord``, as in the stored feed. Shell and
    cache commands arrive as ``command``, queries as ``query``.
    """
    fields = PAYLOAD_FIELDS if payload_fields is None else payload_fields

    def text(name: str) -> Column:
        return F.try_element_at("payload", F.lit(name))

    return events.select(
        (-F.unix_micros("event_time")).alias("ord"), F.col("event_time").alias("timestamp"),
        "session_id", "src_ip", F.col("sensor_id").alias("sensor"), F.col("event_type").alias("eventid"),
        *[text(f).try_cast(CORE_COLUMNS.get(f, "string")).alias(f) for f in fields],
        *service_counts(F.col("event_type"), F.col("active_honeypot_count")),
        F.lit("sensor").alias("source"))


def labelled_sessions(sessions: DataFrame) -> DataFrame:
    """Labelled sessions with ``session_start`` as a timestamp."""
    if dict(sessions.dtypes).get("session_start") == "string":
        return sessions.withColumn("session_start", parse_utc(F.col("session_start")))
    return sessions
