"""Row filters over logs and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.functions.classify import is_public_source


def has_session(events: DataFrame) -> DataFrame:
    """Events that belong to a session."""
    return events.filter(F.col("session_id").isNotNull())


def has_timestamp(events: DataFrame) -> DataFrame:
    """Events with a usable timestamp."""
    return events.filter(F.col("timestamp").isNotNull())


def public_sources(events: DataFrame, ip: str = "src_ip") -> DataFrame:
    """Events from outside loopback and private networks."""
    return events.filter(is_public_source(F.col(ip)))


def contains_text(column: str | Column, needle: str | None) -> Column:
    """Substring test; an empty needle accepts every row."""
    needle = (needle or "").strip()
    if not needle:
        return F.lit(True)
    column = F.col(column) if isinstance(column, str) else column
    return F.contains(column, F.lit(needle))


def search_logs(logs: DataFrame, ip: str = "", event_type: str = "", session: str = "") -> DataFrame:
    """Logs whose fields contain the given texts."""
    return logs.filter(
        contains_text("src_ip", ip) & contains_text("event_type", event_type)
        & contains_text("session_id", session))


def session_events(logs: DataFrame, session_id: str) -> DataFrame:
    """All events of one session (F10); the predicate reaches the scan."""
    return logs.filter(F.col("session_id") == session_id)


def last_hours(logs: DataFrame, asof: Column, hours: int = 24, ts: str = "created_at") -> DataFrame:
    """Events of the hours before ``asof`` (F16)."""
    return logs.filter(F.col(ts) >= asof - F.make_dt_interval(hours=F.lit(hours)))
