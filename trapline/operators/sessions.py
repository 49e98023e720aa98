"""Events to sessions.

The session table needs many counts, several distinct counts, first and last
values and password means. One pass lines up every event as short rows, one per
value it carries (type, user name, password, command, address, ...), and
pre-aggregates them by (session, kind, value) with fixed-width counters only. A
very long session is thereby spread over its values and combined before the
shuffle; distinct counts become plain counts, and password measures are computed
once per distinct password. A second aggregation over these few rows gives the
session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.functions.numbers import flag
from trapline.functions.text import COMMAND_TERMS, contains_any, password_metrics, shannon_entropy
from trapline.operators.filters import has_session, has_timestamp
from trapline.operators.normalize import event_flags, is_command_event
from trapline.schema import COUNT_COLUMNS

# Session column -> event flag that it sums.
FLAG_SUMS = {
    "login_success": "is_login_success",
    "login_fail": "is_login_failed",
    "ssh_events": "is_ssh",
    "http_events": "is_http",
    "mysql_events": "is_mysql",
    "redis_events": "is_redis",
    "ftp_events": "is_ftp",
    "smtp_events": "is_smtp",
    "http_login_attempts": "is_http_login_attempt",
    "http_page_visits": "is_http_page_visit",
    "mysql_queries": "is_mysql_query",
    "redis_commands": "is_redis_command",
    "downloads": "is_file_download",
    "uploads": "is_file_upload",
    "ftp_connects": "is_ftp_connect",
    "ftp_disconnects": "is_ftp_disconnect",
    "smtp_ehlo_count": "is_smtp_ehlo",
    "smtp_connects": "is_smtp_connect",
}

# Session column -> event column whose first known value it takes.
FIRST_VALUES = {
    "src_ip": "src_ip",
    "dst_ip": "dst_ip",
    "dst_port": "dst_port",
    "protocol": "protocol",
    "user_first": "username",
    "sensor": "sensor",
    "uuid": "uuid",
}

PASSWORD_MEANS = {
    "pw_entropy_per_char": "entropy_per_char",
    "pw_entropy_total": "entropy_total",
    "pw_normalized_entropy": "normalized_entropy",
    "pw_length_mean": "length",
    "pw_unique_chars_mean": "unique_chars",
    "pw_total_strength": "total_strength",
}


def seconds_between(start: Column, end: Column) -> Column:
    return F.greatest((F.unix_micros(end) - F.unix_micros(start)) / 1e6, F.lit(0.0))


def first_known(column: str, order: str = "ord") -> Column:
    """Value of the earliest row in which the column is known; ties take the least value."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.struct(order, column)))


def last_known(column: str, order: str = "ord") -> Column:
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(order, column)))


def bounds(events: DataFrame) -> DataFrame:
    """Start, end and length in seconds of every session."""
    return has_session(events).groupBy("session_id").agg(
        F.min("timestamp").alias("session_start"), F.max("timestamp").alias("session_end"),
    ).withColumn("duration", seconds_between(F.col("session_start"), F.col("session_end")))


def picked(events: DataFrame, columns: dict[str, str], last: bool = False) -> DataFrame:
    """First (or last) known value per session of each column; ``columns`` names source columns by output.

    The first step keeps one order number per (session, column, value), so events
    combine in hash tables before the shuffle; values are picked from those few rows.
    Equal order numbers give the least (or greatest) value, compared as text.
    """
    if not columns:
        return events.select("session_id").distinct()
    kinds = {n: events.schema[c].dataType for n, c in columns.items()}
    long = events.select("session_id", "ord", *[F.col(c).cast("string").alias(n) for n, c in columns.items()]).unpivot(
        ["session_id", "ord"], list(columns), "name", "value")
    edge = F.max if last else F.min
    short = long.groupBy("session_id", "name", "value").agg(edge("ord").alias("ord"))
    known = F.col("value").isNotNull()
    pick = F.max_by if last else F.min_by
    return short.groupBy("session_id").agg(*[
        pick("value", F.when(known & (F.col("name") == n), F.struct("ord", "value"))).cast(kind).alias(n)
        for n, kind in kinds.items()])


def network(events: DataFrame) -> DataFrame:
    """First known network values of every session."""
    present = {n: c for n, c in FIRST_VALUES.items() if c in events.columns}
    return picked(has_session(events), present)


def type_counts(events: DataFrame) -> DataFrame:
    """Events, distinct types and sums per service and type.

    Counting by (session, type) first leaves a handful of rows per session.
    """
    per_type = has_session(events).groupBy("session_id", "eventid").agg(F.count("*").alias("n"))
    flags = event_flags()
    return per_type.groupBy("session_id").agg(
        F.sum(F.when(F.col("eventid").isNotNull(), F.col("n")).otherwise(0)).alias("event_count"),
        F.count("eventid").alias("unique_event_types"),
        *[F.expr(f"sum({flags[f]} * n) AS {c}") for c, f in FLAG_SUMS.items()])


def sensor_counts(events: DataFrame, how: str = "last") -> DataFrame:
    """Sensor counts of the last row in feed order, or their maximum."""
    events = has_session(events)
    if how == "last":
        found = picked(events, {c: c for c in COUNT_COLUMNS}, last=True)
    else:
        found = events.groupBy("session_id").agg(*[F.max(c).alias(c) for c in COUNT_COLUMNS])
    return found.select("session_id", *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in COUNT_COLUMNS])


def session_items(events: DataFrame, command: str = "input") -> DataFrame:
    """One row per (session, kind, value): how often, when, and in which order."""
    events = has_session(events)
    columns = set(events.columns)
    kinds = {
        "type": F.col("eventid"), "user": F.col("username"), "pass": F.col("password"),
        "cmd": F.when(is_command_event(F.col("eventid")), F.col(command)),
        **{f"first_{n}": F.col(c).cast("string") for n, c in FIRST_VALUES.items() if c in columns},
    }
    counts = [F.col(c) for c in COUNT_COLUMNS if c in columns]
    if counts:
        kinds["counts"] = F.concat_ws(",", *[F.coalesce(c, F.lit(0)) for c in counts])
    rows = events.select(
        "session_id", "timestamp", "ord",
        (F.col("eventid") == "cowrie.command.failed").alias("failed"),
        (F.col("eventid") == "cowrie.command.input").alias("typed"),
        *[value.alias(kind) for kind, value in kinds.items()],
    ).unpivot(
        ["session_id", "timestamp", "ord", "failed", "typed"], list(kinds), "kind", "value",
    ).filter("value IS NOT NULL OR kind = 'type'")
    return rows.groupBy("session_id", "kind", "value").agg(
        F.count("*").alias("n"),
        F.min("timestamp").alias("min_ts"), F.max("timestamp").alias("max_ts"),
        F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"),
        F.count_if("failed").alias("n_failed"), F.count_if("typed").alias("n_typed"),
        F.min(F.when(F.col("failed"), F.col("ord"))).alias("first_failed_ord"),
        F.max(F.when(F.col("failed"), F.col("ord"))).alias("last_failed_ord"))


def sessions(events: DataFrame, command: str = "input") -> DataFrame:
    """The full session table.

    ``command`` names the column that holds command texts.
    """
    columns = set(events.columns)
    kind, value, n = F.col("kind"), F.col("value"), F.col("n")
    is_type, is_pass, is_cmd = kind == "type", kind == "pass", kind == "cmd"
    items = session_items(events, command).withColumn("metrics", F.when(is_pass, password_metrics(value)))
    flags = event_flags("value")

    def total(condition: Column, amount: Column = n) -> Column:
        return F.coalesce(F.sum(F.when(condition, amount)), F.lit(0)).cast("long")

    def pick(condition: Column, order: str, last: bool = False) -> Column:
        # The value breaks ties, so that equal order numbers give one answer.
        return (F.max_by if last else F.min_by)(value, F.when(condition, F.struct(order, "value")))

    firsts = {name: c for name, c in FIRST_VALUES.items() if c in columns}
    has_failed = is_cmd & (F.col("n_failed") > 0)
    aggs = [
        F.min("min_ts").alias("session_start"), F.max("max_ts").alias("session_end"),
        *[pick(kind == f"first_{name}", "first_ord").alias(name) for name in firsts],
        F.count_if(kind == "user").alias("unique_users"),
        F.count_if(is_pass).alias("unique_pass"),
        total(is_cmd).alias("cmd_count"), F.count_if(is_cmd).alias("unique_cmds"),
        pick(is_cmd, "first_ord").alias("first_cmd"),
        pick(is_cmd, "last_ord", last=True).alias("last_cmd"),
        total(is_cmd, F.col("n_failed")).alias("cmd_failed_count"),
        F.count_if(has_failed).alias("unique_failed_cmds"),
        pick(has_failed, "first_failed_ord").alias("first_failed_cmd"),
        pick(has_failed, "last_failed_ord", last=True).alias("last_failed_cmd"),
        total(is_type & value.isNotNull()).alias("event_count"),
        F.count_if(is_type & value.isNotNull()).alias("unique_event_types"),
        *[F.expr(f"nvl(sum(if(kind = 'type', {flags[f]} * n, 0)), 0) AS {c}")
          for c, f in FLAG_SUMS.items()],
        *[F.expr(f"nvl(try_divide(sum(metrics.{m} * n), sum(if(kind = 'pass', n, 0))), 0D) AS {c}")
          for c, m in PASSWORD_MEANS.items()],
        *[F.max(flag(is_cmd & (F.col("n_typed") > 0) & contains_any(value, terms))).alias(c)
          for c, terms in COMMAND_TERMS.items()],
        pick(kind == "counts", "last_ord", last=True).alias("last_counts"),
    ]
    out = items.groupBy("session_id").agg(*aggs)
    present = [c for c in COUNT_COLUMNS if c in columns]
    changes = {c: F.split("last_counts", ",")[i].cast("int") for i, c in enumerate(present)}
    if "dst_port" in firsts:
        changes["dst_port"] = F.col("dst_port").cast("double")
    changes["duration"] = seconds_between(F.col("session_start"), F.col("session_end"))
    return out.withColumns(changes).drop("last_counts")


def extended(events: DataFrame) -> DataFrame:
    """Reported durations, terminal log and transfer fields."""
    events = has_session(events)
    closed, log = "cowrie.session.closed", "cowrie.log.closed"
    down, up = "cowrie.session.file_download", "cowrie.session.file_upload"
    wanted = {
        "reported_session_duration": (closed, "duration"),
        "reported_tty_duration": (log, "duration"),
        "ttylog": (log, "ttylog"),
        "ttylog_size": (log, "size"),
        "ttylog_duplicate": (log, "duplicate"),
        "ttylog_shasum": (log, "shasum"),
        "first_download_url": (down, "url"),
        "first_download_outfile": (down, "outfile"),
        "first_upload_filename": (up, "filename"),
        "first_upload_outfile": (up, "outfile"),
        "first_upload_destfile": (up, "destfile"),
        "first_upload_url": (up, "url"),
    }
    present = {n: x for n, x in wanted.items() if x[1] in events.columns}
    hits = events.select("session_id", "ord", *[
        F.when(F.col("eventid") == eventid, F.col(c)).alias(n) for n, (eventid, c) in present.items()])
    counts = events.groupBy("session_id").agg(
        F.count_if(F.col("eventid") == down).alias("file_download_count"),
        F.count_if(F.col("eventid") == up).alias("file_upload_count"))
    found = counts.join(picked(hits, {n: n for n in present}), "session_id")
    value = {n: F.col(n) if n in present else F.lit(None).cast("string").alias(n) for n in wanted}
    names = list(wanted)
    return found.select(
        "session_id", *[value[n] for n in names[:6]], "file_download_count", *[value[n] for n in names[6:8]],
        "file_upload_count", *[value[n] for n in names[8:]])


ORDER_SPAN = 100_000
LIST_CHUNK = 1_000


def value_lists(values: DataFrame, span: int = ORDER_SPAN, chunk: int = LIST_CHUNK) -> DataFrame:
    """Ordered lists of values per session, cut into chunks.

    ``values`` has ``session_id, ord, value`` with a distinct integer ``ord``
    per row of a session. A session of any length is whole: positions come from
    blocks of at most ``span`` order numbers, offset by the counts of earlier
    blocks, and each output row holds up to ``chunk`` values.
    """
    from pyspark.sql import Window

    blocked = values.withColumn("block", F.floor(F.col("ord") / span))
    sizes = blocked.groupBy("session_id", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("session_id").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "session_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("session_id", "block").orderBy("ord")
    placed = (blocked.withColumn("rn", F.row_number().over(within))
              .join(offsets, ["session_id", "block"])
              .withColumn("pos", F.col("offset") + F.col("rn") - 1))
    return placed.groupBy("session_id", F.floor(F.col("pos") / chunk).alias("chunk")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda i: i["value"]
        ).alias("items"))


def compact(events: DataFrame, min_seconds: float = 0.5) -> DataFrame:
    """Four compact behaviour features per session."""
    events = has_timestamp(has_session(events))
    per_password = events.groupBy("session_id", "password").agg(
        F.count("*").alias("n"),
        F.count_if(F.contains("eventid", F.lit("cowrie.command"))).alias("commands"),
        F.min("timestamp").alias("start"), F.max("timestamp").alias("end"))
    known = F.col("password").isNotNull()
    entropy = F.when(known, shannon_entropy(F.col("password")) * F.col("n"))
    out = per_password.groupBy("session_id").agg(
        F.min("start").alias("start_time"), F.max("end").alias("end_time"),
        F.sum("commands").alias("command_count"),
        F.coalesce(F.sum(entropy) / F.sum(F.when(known, F.col("n"))), F.lit(0.0))
         .alias("avg_password_entropy"))
    seconds = seconds_between(F.col("start_time"), F.col("end_time"))
    rate = F.when(seconds == 0, 0.0).otherwise(
        F.col("command_count") / (F.greatest(seconds, F.lit(min_seconds)) / 60))
    return out.withColumns({"session_duration_s": seconds, "commands_per_min": rate})


def tallies(events: DataFrame, event_column: str = "event_type") -> DataFrame:
    """Commands and login outcomes of sessions that have any."""
    kinds = {
        "commands": "cowrie.command.input",
        "login_successes": "cowrie.login.success",
        "login_failures": "cowrie.login.failed",
    }
    event = F.col(event_column)
    return has_session(events).filter(event.isin(list(kinds.values()))).groupBy("session_id").agg(
        *[F.count_if(event == e).alias(n) for n, e in kinds.items()])
