"""Session table to model features: one projection, no further shuffle.

Each feature is a short SQL text over session columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.functions.classify import is_local_source
from trapline.schema import COUNT_COLUMNS, FEATURES, PRIMARY_SERVICE_ORDER

TINY = "1e-9D"
SERVICES = ["ssh", "http", "ftp", "smtp", "mysql", "redis"]


def _flag(condition: str) -> str:
    return f"int(nvl({condition}, false))"


# Commands and failures per minute (X03); a zero length gives huge rates by design.
RATES = {
    "cmds_per_min": f"cmd_count / (duration / 60D + {TINY})",
    "fails_per_min": f"login_fail / (duration / 60D + {TINY})",
    "cmd_failed_per_min": f"cmd_failed_count / (duration / 60D + {TINY})",
    "cmd_failed_ratio": f"cmd_failed_count / (cmd_count + {TINY})",
}

# Shares of services and transfers among the events.
RATIOS = {
    **{f"{s}_ratio": f"{s}_events / (event_count + {TINY})" for s in SERVICES},
    "download_ratio": f"downloads / (event_count + {TINY})",
    "upload_ratio": f"uploads / (event_count + {TINY})",
    "file_transfer_ratio": f"(downloads + uploads) / (event_count + {TINY})",
}

# Events per minute over at least one second.
PACE = {"events_per_min": "event_count / (greatest(duration, 1D) / 60D)"}

# Number of services with any event.
TOUCHED = {"services_touched": " + ".join(_flag(f"{s}_events > 0") for s in SERVICES)}

# Protocol name contains the service name.
PROTOCOL_FLAGS = {
    f"is_{s}_protocol": _flag(f"contains(lower(protocol), '{s}')") for s in SERVICES}

# Activity, login and command flags.
ACTIVITY = {
    **{f"has_{s}_activity": _flag(f"{s}_events > 0") for s in SERVICES if s != "ssh"},
    "has_successful_login": _flag("login_success > 0"),
    "has_any_commands": _flag("cmd_count > 0"),
    "has_failed_commands": _flag("cmd_failed_count > 0"),
}

# Service with most events; ties go to the earlier one.
PRIMARY = {"primary_service": "array_max(array(" + ", ".join(
    f"named_struct('n', {s}_events, 'rank', -{i}, 'name', '{s}')"
    for i, s in enumerate(PRIMARY_SERVICE_ORDER)) + ")).name"}


def add_behaviour(sessions: DataFrame) -> DataFrame:
    """All derived session columns."""
    if "protocol" not in sessions.columns:
        sessions = sessions.withColumn("protocol", F.lit(None).cast("string"))
    derived = {**RATES, **RATIOS, **PACE, **TOUCHED, **PROTOCOL_FLAGS, **ACTIVITY, **PRIMARY}
    return sessions.selectExpr("*", *[f"{sql} AS {name}" for name, sql in derived.items()]).withColumn(
        "is_local_src", is_local_source(F.col("src_ip")))


def finite_sql(column: str) -> str:
    """The number, or 0 for NULL, NaN and both infinities."""
    x = f"double({column})"
    return f"nvl(if(isnan({x}) OR abs({x}) = double('inf'), null, {x}), 0D)"


def feature_table(sessions: DataFrame, carry_all: bool = False) -> DataFrame:
    """Model features: finite numbers, no NULLs.

    ``carry_all`` keeps the four connection counters that scoring can use but
    the feature list leaves out.
    """
    out = add_behaviour(sessions)
    types = dict(out.dtypes)
    geo = [c for c, t in types.items() if c.startswith("geo_") and t in ("double", "int", "bigint")]
    extra = ["ftp_connects", "ftp_disconnects", "smtp_ehlo_count", "smtp_connects"]
    numeric = FEATURES + geo + (extra if carry_all else [])
    return out.selectExpr(
        "session_id", "src_ip", "session_start", "session_end",
        *[f"{finite_sql(c)} AS {c}" for c in numeric],
        *[f"nvl({c}, 0) AS {c}" for c in COUNT_COLUMNS if c in types])
