"""From sensor lines and ingest events to canonical and flat events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.functions.classify import forwarder_severity, resolve_service
from trapline.functions.clock import hour_bucket, parse_utc
from trapline.functions.numbers import number
from trapline.functions.text import control_share
from trapline.schema import (
    CORE_COLUMNS,
    EVENT_FLAGS,
    EVENT_PREFIX,
    SERVICE_EVENT_FLAGS,
)

# --- fixed values -----------------------------------------------------------
# Shell events worth forwarding.
SHELL_KEEP = [
    "cowrie.session.connect", "cowrie.login.success", "cowrie.login.failed",
    "cowrie.command.input", "cowrie.session.file_download", "cowrie.session.closed",
    "cowrie.direct-tcpip.request", "cowrie.session.file_upload",
]
# Cache commands worth forwarding.
CACHE_COMMANDS = [
    "CONFIG", "SLAVEOF", "REPLICAOF", "DEBUG", "EVAL", "EVALSHA", "SCRIPT",
    "FLUSHALL", "FLUSHDB", "AUTH", "KEYS", "MODULE",
]
MAIL_SKIP = ["smtp.server.start", "smtp.command"]
BINARY_SHARE = 0.15
# --- end of fixed values ----------------------------------------------------

# Payload fields each service keeps.
PAYLOAD_FIELDS = {
    "ssh": ["username", "password", "command", "url", "destfile"],
    "http": ["method", "path", "page", "user_agent", "credentials", "probe_path"],
    "ftp": ["credentials", "username", "file"],
    "mysql": ["credentials", "username", "query"],
    "smtp": ["mail_from", "rcpt_to", "ehlo_host", "credentials", "body_preview", "body_size"],
    "redis": ["command", "args", "config_set", "technique", "password"],
}


def keep_sensor_line(service: Column) -> Column:
    """Which sensor lines are worth keeping, per service."""
    event_type = F.coalesce(F.col("event_type"), F.lit(""))
    shell_ok = F.coalesce(F.col("eventid"), F.lit("")).isin(SHELL_KEEP)
    cache_ok = (event_type != "redis.command") | F.coalesce(
        F.upper("command").isin(CACHE_COMMANDS), F.lit(False))
    mail_ok = ~event_type.isin(MAIL_SKIP)
    for name in ("command", "ehlo_host", "mail_from"):
        text = F.coalesce(F.col(name), F.lit(""))
        mail_ok = mail_ok & (control_share(text) < BINARY_SHARE)
    not_start = ~event_type.endswith(".server.start")
    return (F.when(service == "ssh", shell_ok)
            .when(service == "smtp", mail_ok)
            .when(service == "redis", not_start & cache_ok)
            .otherwise(not_start))


def normalise_sensor_lines(
    lines: DataFrame, service: str = "service", query_chars: int | None = None, body_chars: int | None = None,
    max_args: int | None = None, keep_raw: bool = False,
) -> DataFrame:
    """Sensor lines of all services to ingest events in one projection.

    ``lines`` has the columns of ``schema.SENSOR_LINE`` plus the service name. Query
    texts, mail bodies and argument lists stay whole unless a length is given;
    sensors that forward events over a wire use 500, 300 and 10. ``keep_raw``
    carries the column ``raw``, the line as it came.
    """
    def cut(text: Column, chars: int | None) -> Column:
        return text if chars is None else F.substring(text, 1, chars)

    args = F.coalesce(F.col("args"), F.array().cast("array<string>"))
    svc = F.col(service)
    shell = svc == "ssh"
    event_type = F.when(shell, F.col("eventid")).otherwise(
        F.coalesce(F.col("event_type"), F.lit("")))
    fields = {
        "command": F.when(shell, F.col("input")).otherwise(F.col("command")),
        "query": cut(F.coalesce(F.col("query"), F.lit("")), query_chars),
        "body_preview": cut(F.coalesce(F.col("body_preview"), F.lit("")), body_chars),
        "args": F.to_json(args if max_args is None else F.slice(args, 1, max_args)),
        "body_size": F.col("body_size").cast("string"),
    }

    carriers: dict[str, list[str]] = {}
    for name, kept in PAYLOAD_FIELDS.items():
        for field in kept:
            carriers.setdefault(field, []).append(name)
    entries = [
        entry for field, services in carriers.items()
        for entry in (F.lit(field), F.when(svc.isin(services), fields.get(field, F.col(field))))
    ]
    data = F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())
    has_session = svc.isin("ssh", "http")
    return lines.filter(keep_sensor_line(svc)).select(
        "timestamp",
        F.when(shell, F.col("src_ip")).otherwise(F.col("source_ip")).alias("source_ip"),
        F.when(shell, F.col("src_port")).otherwise(F.col("source_port")).alias("source_port"),
        event_type.alias("event_type"),
        F.when(shell, F.col("sensor")).otherwise(F.col("sensor_id")).alias("sensor_id"),
        svc.alias("honeypot_type"),
        forwarder_severity(event_type).alias("severity"),
        F.when(has_session, F.when(shell, F.col("session")).otherwise(F.col("session_id")))
         .alias("session_id"),
        data.alias("data"), *(["raw"] if keep_raw else []),
    ).filter(has_time_and_source())


def has_time_and_source() -> Column:
    """Timestamp and source present and not empty."""
    return (F.length("timestamp") > 0) & (F.length("source_ip") > 0)


def reject_reason() -> Column:
    """Why an ingest event fails validation; NULL when it passes."""
    return (F.when(F.col("timestamp").isNull(), "missing timestamp")
            .when(F.col("source_ip").isNull(), "missing source_ip")
            .when(F.col("event_type").isNull(), "missing event_type")
            .when(parse_utc(F.col("timestamp")).isNull(), "bad timestamp"))


def split_valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid events, and rejected ones with the reason."""
    marked = events.withColumn("reject_reason", reject_reason())
    return (marked.filter("reject_reason IS NULL").drop("reject_reason"),
            marked.filter("reject_reason IS NOT NULL"))


def session_key(src_ip: Column, event_type: Column, iso_time: Column) -> Column:
    """Deterministic id of one source, event type and hour."""
    hour = hour_bucket(iso_time, parse_utc(iso_time))
    return F.sha2(F.concat_ws(":", src_ip, event_type, hour), 256)


def canonical(events: DataFrame) -> DataFrame:
    """Ingest events to the canonical stored form.

    Port and severity stay, so nothing a sensor sent is lost.
    """
    given = F.when(F.length("session_id") > 0, F.col("session_id"))
    key = session_key(F.col("source_ip"), F.col("event_type"), F.col("timestamp"))
    extra = [c for c in ("source_port", "severity", "id") if c in events.columns]
    return events.select(
        *extra,
        "timestamp",
        parse_utc(F.col("timestamp")).alias("event_time"),
        F.col("source_ip").alias("src_ip"),
        F.lower(F.trim("event_type")).alias("event_type"),
        "sensor_id",
        F.coalesce(given, key).alias("session_id"),
        resolve_service(F.col("honeypot_type"), F.col("event_type")).alias("service"),
        F.coalesce(F.col("data"), F.create_map().cast("map<string,string>")).alias("payload"),
    )


def ensure_core_columns(events: DataFrame) -> DataFrame:
    """Add every core column that is missing, as NULL."""
    missing = {c: F.lit(None).cast(t) for c, t in CORE_COLUMNS.items() if c not in events.columns}
    return events.withColumns(missing) if missing else events


def coerce_types(events: DataFrame) -> DataFrame:
    """Lenient timestamp and number parsing; bad values become NULL."""
    types = dict(events.dtypes)
    changes = {c: number(F.col(c)) for c in ("dst_port", "duration", "size") if c in types}
    if types.get("timestamp") == "string":
        changes["timestamp"] = parse_utc(F.col("timestamp"))
    return events.withColumns(changes)


def protocol_fallback(events: DataFrame, fallback: str = "system_transport") -> DataFrame:
    """Use the fallback column where no row at all has a protocol."""
    if fallback not in events.columns:
        return events
    any_protocol = events.agg(F.max("protocol").isNotNull()).scalar()
    return events.withColumn(
        "protocol", F.when(any_protocol, F.col("protocol")).otherwise(F.col(fallback)))


def with_command(events: DataFrame, source: str = "input") -> DataFrame:
    """Set ``command`` from ``input``.

    ``source='coalesce'`` keeps a command that the sensor sent itself.
    """
    command = F.col("input")
    if source == "coalesce" and "command" in events.columns:
        command = F.coalesce(F.col("command"), command)
    return events.withColumn("command", command)


def event_flags(column: str = "eventid") -> dict[str, str]:
    """SQL of all 0/1 event flags over an event type column."""
    exact = {**EVENT_FLAGS, **SERVICE_EVENT_FLAGS}
    flags = {n: f"int({column} <=> '{e}')" for n, e in exact.items()}
    prefixes = {f"is_{s}": f"int(nvl(startswith({column}, '{p}.'), false))"
                for s, p in EVENT_PREFIX.items()}
    return {**flags, **prefixes}


def normalise_events(events: DataFrame, command_source: str = "input") -> DataFrame:
    """Flat events with all core columns, parsed types and flags."""
    out = coerce_types(ensure_core_columns(events))
    out = with_command(protocol_fallback(out), command_source)
    return out.selectExpr("*", *[f"{sql} AS {n}" for n, sql in event_flags().items()])


def is_command_event(eventid: Column) -> Column:
    """Event type mentions a command or a query."""
    return F.coalesce(eventid.rlike("(?i)command|query"), F.lit(False))
