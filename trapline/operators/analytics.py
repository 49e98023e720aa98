"""Report aggregates over the whole event and session tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trapline.functions.classify import display_service, map_severity, severity_rank
from trapline.functions.clock import age_text
from trapline.functions.text import command_text, joined
from trapline.operators.filters import contains_text, last_hours, public_sources, session_events
from trapline.operators.normalize import event_flags
from trapline.schema import EVENT_PREFIX, SEARCH_EVENT_TYPES, SERVICES

UNKNOWN = "unknown"

# --- fixed values: session depth bands --------------------------------------
DEPTH_BANDS = [
    ("1", "Hit & run", 1, 1),
    ("2-5", "Quick probe", 2, 5),
    ("6-15", "Exploration", 6, 15),
    ("16-50", "Sustained", 16, 50),
    ("51+", "Deep intrusion", 51, None),
]
DEEP_EVENTS = 51
SHOWN_TYPES = 8
MAX_TEXT = 64
COMMAND_COLUMNS = ["command", "input", "cmd", "message", "commands"]
# --- end of fixed values ----------------------------------------------------


def log_command(logs: DataFrame) -> Column:
    """Command text of a log row (N18); lists are joined."""
    kinds = {f.name: f.dataType for f in logs.schema.fields}
    return command_text(*[joined(F.col(c)) if isinstance(kinds[c], T.ArrayType) else F.col(c)
                          for c in COMMAND_COLUMNS if c in kinds])


def frequency(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Rows per value, most frequent first."""
    counts = df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
    return counts if limit is None else counts.limit(limit)


def relative_frequency(df: DataFrame, column: str) -> DataFrame:
    """Share of each value among all rows."""
    total = df.agg(F.count("*")).scalar()
    return df.groupBy(column).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / total)


def data_quality(events: DataFrame) -> DataFrame:
    """Missing ids, missing timestamps, distinct sessions."""
    return events.agg(
        F.count_if(F.col("session_id").isNull()).alias("missing_sessions"),
        F.count_if(F.col("timestamp").isNull()).alias("missing_timestamps"),
        F.count_distinct("session_id").alias("unique_sessions"))


def sessions_by_hour(sessions: DataFrame, start: str = "session_start") -> DataFrame:
    """Sessions per hour of day."""
    return sessions.groupBy(F.hour(start).alias("hour")).agg(F.count("*").alias("sessions"))


def login_outcomes(events: DataFrame) -> DataFrame:
    """Successful and failed shell logins."""
    prefix = "cowrie.login."
    wanted = F.col("eventid").isin(f"{prefix}success", f"{prefix}failed")
    return (events.filter(wanted)
            .groupBy(F.replace("eventid", F.lit(prefix), F.lit("")).alias("outcome"))
            .agg(F.count("*").alias("n")))


def events_per_hour(logs: DataFrame, ts: str = "ts", last: int | None = 24) -> DataFrame:
    """Events per hour; the newest non-empty hours."""
    hours = (logs.filter(F.col(ts).isNotNull())
             .groupBy(F.date_trunc("hour", ts).alias("hour")).agg(F.count("*").alias("events")))
    return hours if last is None else hours.orderBy(F.desc("hour")).limit(last)


def session_event_types(logs: DataFrame) -> DataFrame:
    """Events per session and type, with the oldest and newest row of each."""
    sid = F.coalesce("session_id", F.lit(UNKNOWN))
    etype = F.coalesce("event_type", F.lit(UNKNOWN))
    # Ids and times have a fixed width, so all rows combine in hash tables; texts are compared among few rows.
    first = logs.groupBy(sid.alias("session_id"), etype.alias("event_type"), "src_ip").agg(
        F.count("*").alias("n"),
        F.max("id").alias("last_id"), F.max_by("created_at", "id").alias("last_at"),
        F.min("id").alias("first_id"), F.min_by("created_at", "id").alias("first_at"))
    newest = F.struct(F.col("last_id").alias("id"), "src_ip", F.col("last_at").alias("created_at"))
    oldest = F.struct(F.col("first_id").alias("id"), F.col("first_at").alias("created_at"))
    return first.groupBy("session_id", "event_type").agg(
        F.sum("n").alias("n"), F.max(newest).alias("newest"), F.min(oldest).alias("oldest"))


def newest_commands(logs: DataFrame, keep: int = 5) -> DataFrame:
    """The ``keep`` most recently used distinct commands of every session."""
    sid = F.coalesce("session_id", F.lit(UNKNOWN)).alias("session_id")
    used = (logs.select(sid, "id", log_command(logs).alias("cmd")).filter("cmd IS NOT NULL")
            .groupBy("session_id", "cmd").agg(F.max("id").alias("id")))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("id")))
    best = used.withColumn("rank", rank).filter(F.col("rank") <= keep)
    listed = F.array_sort(F.collect_list(F.struct("rank", "cmd")))
    return best.groupBy("session_id").agg(F.transform(listed, lambda i: i["cmd"]).alias("commands"))


def session_summary(logs: DataFrame) -> DataFrame:
    """One row per session, newest values first.

    The list of types has one entry per distinct type of the session.
    """
    newest_first = F.sort_array(F.collect_list(F.struct("newest.id", "event_type")), asc=False)
    summary = session_event_types(logs).groupBy("session_id").agg(
        F.sum("n").alias("count"), F.max("newest").alias("newest"), F.min("oldest").alias("oldest"),
        F.transform(newest_first, lambda i: i["event_type"]).alias("event_types"))
    return summary.join(newest_commands(logs), "session_id", "left").select(
        "session_id", F.coalesce("newest.src_ip", F.lit(UNKNOWN)).alias("src_ip"), "count",
        F.col("newest.id").alias("newest_id"), F.col("newest.created_at").alias("newest_ts"),
        F.col("oldest.created_at").alias("oldest_ts"), "event_types",
        F.coalesce("commands", F.array().cast("array<string>")).alias("commands"))


def search_sessions(
    summary: DataFrame, ip: str = "", session: str = "", event_type: str = ""
) -> DataFrame:
    """Sessions whose ids or any of whose types contain the texts."""
    any_type = F.exists("event_types", lambda t: contains_text(t, event_type))
    return summary.filter(
        contains_text("src_ip", ip) & contains_text("session_id", session)
        & (any_type if event_type.strip() else F.lit(True)))


def session_depth(logs: DataFrame) -> DataFrame:
    """Sessions per depth band; empty bands show zero."""
    sizes = (logs.groupBy(F.coalesce("session_id", F.lit(UNKNOWN)).alias("session_id"))
             .agg(F.count("*").alias("n")))

    def inside(low: int, high: int | None) -> Column:
        return (F.col("n") >= low) & (F.lit(True) if high is None else F.col("n") <= high)

    one_row = sizes.agg(*[F.count_if(inside(lo, hi)).alias(r) for r, _, lo, hi in DEPTH_BANDS])
    bands = F.array(*[
        F.struct(F.lit(r).alias("range"), F.lit(name).alias("label"), F.col(f"`{r}`").alias("sessions"))
        for r, name, _, _ in DEPTH_BANDS])
    return one_row.select(F.inline(bands))


def service_mix(logs: DataFrame) -> DataFrame:
    """Events per display service without ``Other``, with percent share."""
    service = display_service(F.col("sensor_id"), F.col("protocol"), F.col("event_type"))
    counts = (logs.groupBy(service.alias("label")).agg(F.count("*").alias("value"))
              .filter("label <> 'Other'"))
    # At most one row per known service is left here.
    share = F.col("value") / F.sum("value").over(Window.partitionBy())
    return counts.withColumn("percent", F.floor(share * 100 + 0.5))


def distinct_items(logs: DataFrame) -> DataFrame:
    """Rows per distinct source, session and type, in one pass and one shuffle."""
    items = F.array(*[
        F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in {
            "ip": F.col("src_ip"),
            "session": F.coalesce("session_id", F.lit(UNKNOWN)),
            "type": F.coalesce("event_type", F.lit(UNKNOWN)),
        }.items()])
    return logs.select(F.inline(items)).groupBy("kind", "value").agg(F.count("*").alias("n"))


def kpis(logs: DataFrame) -> DataFrame:
    """Events, sources, sessions, deep sessions, attack types.

    A missing source counts as one source.
    """
    counts = distinct_items(logs)
    kind = F.col("kind")
    return counts.agg(
        F.coalesce(F.sum(F.when(kind == "ip", F.col("n"))), F.lit(0)).alias("events"),
        F.count_if(kind == "ip").alias("unique_ips"),
        F.count_if(kind == "session").alias("sessions"),
        F.count_if((kind == "session") & (F.col("n") >= DEEP_EVENTS)).alias("deep_sessions"),
        F.count_if(kind == "type").alias("attack_types"),
        F.least(F.count_if(kind == "type"), F.lit(SHOWN_TYPES)).alias("shown_types"))


def page_stats(logs: DataFrame) -> DataFrame:
    """Rows, sessions and known sources."""
    counts = distinct_items(logs)
    kind = F.col("kind")
    return counts.agg(
        F.coalesce(F.sum(F.when(kind == "session", F.col("n"))), F.lit(0)).alias("rows"),
        F.count_if(kind == "session").alias("sessions"),
        F.count_if((kind == "ip") & F.col("value").isNotNull()).alias("unique_ips"))


def service_totals(events: DataFrame) -> DataFrame:
    """Events of each service."""
    flags = event_flags()
    return events.agg(*[F.expr(f"sum({flags[f'is_{s}']}) AS {s}_events") for s in EVENT_PREFIX])


def top_labels(rows: DataFrame, label: Column, limit: int) -> DataFrame:
    """Most frequent labels; equal counts in order of newest occurrence."""
    return (rows.groupBy(label.alias("label"))
            .agg(F.count("*").alias("value"), F.max("id").alias("newest"))
            .orderBy(F.desc("value"), F.desc("newest")).limit(limit).drop("newest"))


def top_sources(logs: DataFrame, limit: int = 8) -> DataFrame:
    """Most active source addresses."""
    return top_labels(logs, F.coalesce("src_ip", F.lit(UNKNOWN)), limit)


def top_event_types(logs: DataFrame, limit: int = 8) -> DataFrame:
    """Most frequent event types."""
    return top_labels(logs, F.coalesce("event_type", F.lit(UNKNOWN)), limit)


def top_commands(logs: DataFrame, limit: int = 8) -> DataFrame:
    """Most frequent commands."""
    rows = logs.select("id", log_command(logs).alias("cmd")).filter("cmd IS NOT NULL")
    return top_labels(rows, F.col("cmd"), limit)


def top_credentials(logs: DataFrame, limit: int = 7, max_text: int | None = MAX_TEXT) -> DataFrame:
    """Most tried user names and passwords.

    The first known alias of each counts, if it is not empty and has fewer than
    ``max_text`` characters; None takes every length.
    """
    aliases = {"username": ["username", "user", "login"], "password": ["password", "passwd", "pass"]}

    def top(kind: str) -> DataFrame:
        known = [F.col(c) for c in aliases[kind] if c in logs.columns]
        rows = logs.select("id", F.coalesce(*known).alias("text")).filter(
            (F.length("text") > 0) & (F.lit(True) if max_text is None else F.length("text") < max_text))
        # Equal counts: plain numbers come first, by value, then newest first.
        number = F.when(F.col("label").rlike("^(0|[1-9][0-9]{0,8})$"), F.col("label").try_cast("long"))
        return (rows.groupBy(F.col("text").alias("label"))
                .agg(F.count("*").alias("value"), F.max("id").alias("newest"))
                .orderBy(F.desc("value"), number.asc_nulls_last(), F.desc("newest"))
                .limit(limit).select(F.lit(kind).alias("kind"), "label", "value"))

    return top("username").unionByName(top("password"))


def log_page(logs: DataFrame, page: int = 0, size: int = 50) -> DataFrame:
    """One page of logs, newest first.

    For deep pages at scale use ``newest_first(before_id=...)`` instead.
    """
    ordered = logs.orderBy(F.desc_nulls_last("created_at"), F.desc("id"))
    return ordered.offset(page * size).limit(size)


def recent_feed(logs: DataFrame, limit: int = 40) -> DataFrame:
    """Latest public events with map severity."""
    return (public_sources(logs).withColumn("severity", map_severity(F.col("event_type")))
            .orderBy(F.desc("created_at"), F.desc("id")).limit(limit))


def commands_per_session(logs: DataFrame) -> DataFrame:
    """Typed commands per session, most first."""
    return (logs.filter((F.col("event_type") == "cowrie.command.input") & F.col("session_id").isNotNull())
            .groupBy("session_id").agg(F.count("*").alias("commands"))
            .orderBy(F.desc("commands"), "session_id"))


def all_event_types(logs: DataFrame) -> DataFrame:
    """Known and observed event types, sorted."""
    known = logs.sparkSession.createDataFrame([(e,) for e in SEARCH_EVENT_TYPES], "event_type string")
    seen = logs.select("event_type").filter(F.length("event_type") > 0)
    return seen.union(known).distinct().orderBy("event_type")


def leaderboard(sources: DataFrame, size: int = 8) -> DataFrame:
    """Top sources with their percent of the maximum, at least 6.

    ``sources`` has ``src_ip, count, first_id``; equal counts go to the source
    that was seen first.
    """
    top = sources.orderBy(F.desc("count"), "first_id").limit(size)
    best = F.max("count").over(Window.partitionBy())
    percent = F.greatest(F.lit(6), F.floor(F.col("count") / best * 100 + 0.5))
    return top.withColumn("percent", percent)


def mean_per_hour(logs: DataFrame, asof: Column, hours: int = 24) -> DataFrame:
    """Mean events per hour over the last hours."""
    return last_hours(logs, asof, hours).agg((F.count("*") / hours).alias("per_hour"))


def session_detail(logs: DataFrame, session_id: str, asof: Column) -> DataFrame:
    """Events, source, distinct types and age of one session."""
    return session_events(logs, session_id).agg(
        F.count("*").alias("events"),
        F.coalesce(F.max_by("src_ip", "id"), F.lit(UNKNOWN)).alias("src_ip"),
        F.count_distinct("event_type").alias("event_types"),
        age_text(F.min_by("created_at", "id"), asof).alias("age"))


def source_stats(logs: DataFrame) -> DataFrame:
    """Events and highest map severity per public source (part of A30)."""
    rank = severity_rank(map_severity(F.col("event_type")))
    return public_sources(logs).groupBy("src_ip").agg(
        F.count("*").alias("count"), F.max(rank).alias("severity_rank"),
        F.min("id").alias("first_id"))


def composition(state: DataFrame) -> DataFrame:
    """Latest count per service in known order, unknown ones last, with total."""
    latest = state.groupBy("honeypot_type").agg(F.max(F.struct("updated_at", "cnt"))["cnt"].alias("cnt"))
    order = F.coalesce(
        F.nullif(F.array_position(F.array(*map(F.lit, SERVICES)), F.col("honeypot_type")), F.lit(0)),
        F.lit(len(SERVICES) + 1))
    # One row per service is left here.
    return latest.select("honeypot_type", "cnt", order.alias("position"),
                         F.sum("cnt").over(Window.partitionBy()).alias("total"))


def last_seen(logs: DataFrame, asof: Column, by: str = "sensor_id") -> DataFrame:
    """Last event of every source and the silence since, in seconds."""
    seen = logs.groupBy(by).agg(F.max("created_at").alias("last_seen"), F.count("*").alias("events"))
    silence = (F.unix_micros(asof) - F.unix_micros("last_seen")) / 1e6
    return seen.withColumn("silent_s", silence)


def per_ip_table(logs: DataFrame) -> DataFrame:
    """One row per source: events, sessions, types, first and last time (extra)."""
    per_session = logs.filter(F.col("src_ip").isNotNull()).groupBy("src_ip", "session_id").agg(
        F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return per_session.groupBy("src_ip").agg(
        F.sum("n").alias("events"), F.count("session_id").alias("sessions"),
        F.min("first").alias("first_seen"), F.max("last").alias("last_seen"))
