"""Fixed vocabulary and schemas shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# Sensor types, in the order used for capacity allocation.
SERVICES = ["ssh", "http", "redis", "mysql", "ftp", "smtp"]

# The same services in the order the deployment planner lists them.
PLAN_SERVICES = ["ssh", "http", "mysql", "redis", "ftp", "smtp"]

# Order that breaks ties when choosing the dominant service of a session.
PRIMARY_SERVICE_ORDER = ["ssh", "http", "ftp", "smtp", "mysql", "redis"]

# Event type prefix written by the sensors of each service.
EVENT_PREFIX = {
    "ssh": "cowrie",
    "http": "http",
    "mysql": "mysql",
    "redis": "redis",
    "ftp": "ftp",
    "smtp": "smtp",
}

# Columns every flat event has after normalisation.
CORE_COLUMNS = {
    "eventid": "string",
    "timestamp": "timestamp",
    "session_id": "string",
    "src_ip": "string",
    "dst_ip": "string",
    "dst_port": "double",
    "protocol": "string",
    "sensor": "string",
    "uuid": "string",
    "message": "string",
    "input": "string",
    "username": "string",
    "password": "string",
    "duration": "double",
    "ttylog": "string",
    "size": "double",
    "shasum": "string",
    "duplicate": "boolean",
    "url": "string",
    "outfile": "string",
    "filename": "string",
    "destfile": "string",
}

# Event types the search page always offers.
SEARCH_EVENT_TYPES = [
    "cowrie.command.input",
    "cowrie.direct-tcpip.request",
    "cowrie.login.success",
    "cowrie.session.closed",
    "cowrie.session.connect",
    "ftp.login.success",
    "ftp.session.connect",
    "ftp.session.disconnect",
    "http.page.visit",
    "http.scan.probe",
    "mysql.session.connect",
    "mysql.session.end",
    "redis.session.connect",
    "redis.session.disconnect",
    "smtp.ehlo",
    "smtp.login.attempt",
    "smtp.session.connect",
    "smtp.session.disconnect",
    "ssh.login.attempt",
]

# Event types the sensors are known to emit.
EVENT_TYPES = {
    "ssh": [
        "cowrie.session.connect", "cowrie.session.closed", "cowrie.login.success",
        "cowrie.login.failed", "cowrie.command.input", "cowrie.command.failed",
        "cowrie.client.version", "cowrie.client.kex", "cowrie.log.closed",
        "cowrie.session.file_download", "cowrie.session.file_upload",
        "cowrie.direct-tcpip.request",
    ],
    "http": [
        "http.page.visit", "http.login.attempt", "http.admin.probe",
        "http.api.probe", "http.file.probe", "http.scan.probe",
    ],
    "ftp": [
        "ftp.session.connect", "ftp.session.disconnect", "ftp.login.failed",
        "ftp.login.success", "ftp.file.download", "ftp.file.upload",
    ],
    "mysql": [
        "mysql.session.connect", "mysql.session.disconnect", "mysql.session.end",
        "mysql.login.attempt", "mysql.login.success", "mysql.query",
        "mysql.parse.error",
    ],
    "smtp": [
        "smtp.session.connect", "smtp.session.disconnect", "smtp.ehlo",
        "smtp.login.attempt", "smtp.relay.attempt", "smtp.message.received",
    ],
    "redis": [
        "redis.session.connect", "redis.session.disconnect", "redis.command",
        "redis.rce.attempt", "redis.slaveof.attempt", "redis.replicaof.attempt",
        "redis.debug.attempt", "redis.flush.attempt", "redis.auth.attempt",
    ],
}

# Flag name -> the one event type that raises it.
EVENT_FLAGS = {
    "is_command_input": "cowrie.command.input",
    "is_command_failed": "cowrie.command.failed",
    "is_login_success": "cowrie.login.success",
    "is_login_failed": "cowrie.login.failed",
    "is_session_closed": "cowrie.session.closed",
    "is_log_closed": "cowrie.log.closed",
    "is_file_download": "cowrie.session.file_download",
    "is_file_upload": "cowrie.session.file_upload",
}
SERVICE_EVENT_FLAGS = {
    "is_http_login_attempt": "http.login.attempt",
    "is_http_page_visit": "http.page.visit",
    "is_mysql_query": "mysql.query",
    "is_redis_command": "redis.command",
    "is_ftp_connect": "ftp.session.connect",
    "is_ftp_disconnect": "ftp.session.disconnect",
    "is_smtp_ehlo": "smtp.ehlo",
    "is_smtp_connect": "smtp.session.connect",
    "is_client_version": "cowrie.client.version",
    "is_client_kex": "cowrie.client.kex",
}

# Numeric inputs of the behaviour model, in model order.
FEATURES = [
    "duration", "cmd_count", "unique_cmds", "cmd_failed_count", "unique_failed_cmds",
    "cmds_per_min", "cmd_failed_per_min", "cmd_failed_ratio", "login_success",
    "login_fail", "fails_per_min", "unique_users", "unique_pass",
    "pw_entropy_per_char", "pw_entropy_total", "pw_normalized_entropy",
    "pw_length_mean", "pw_unique_chars_mean", "pw_total_strength",
    "has_successful_login", "has_any_commands", "has_failed_commands", "is_local_src",
    "contains_recon_cmds", "contains_install_cmds", "contains_nav_cmds",
    "contains_exit_cmd", "contains_persist_terms", "contains_exec_terms",
    "contains_kill_terms", "contains_network_terms",
    "event_count", "unique_event_types", "services_touched", "events_per_min",
    "ssh_events", "http_events", "mysql_events", "redis_events",
    "http_login_attempts", "http_page_visits", "mysql_queries", "redis_commands",
    "downloads", "uploads", "ftp_events", "smtp_events",
    "ssh_ratio", "http_ratio", "mysql_ratio", "redis_ratio", "ftp_ratio",
    "smtp_ratio", "download_ratio", "upload_ratio", "file_transfer_ratio",
    "is_ssh_protocol", "is_http_protocol", "is_ftp_protocol",
    "is_smtp_protocol", "is_mysql_protocol", "is_redis_protocol",
]
# --- end of fixed values ----------------------------------------------------

KNOWN_EVENT_TYPES = [e for group in EVENT_TYPES.values() for e in group]
COUNT_COLUMNS = [f"{s}_honeypot_count" for s in PLAN_SERVICES]

# A sensor line or an ingest event may carry any of these.
SENSOR_LINE = T.StructType(
    [T.StructField(n, T.StringType()) for n in (
        "timestamp", "sensor_id", "sensor", "event_type", "eventid", "severity",
        "source_ip", "src_ip", "session_id", "session", "method", "path", "page",
        "user_agent", "probe_path", "username", "password", "input", "command", "url",
        "destfile", "file", "query", "mail_from", "rcpt_to", "ehlo_host",
        "body_preview", "config_set", "technique", "credentials",
    )]
    + [
        T.StructField("source_port", T.LongType()),
        T.StructField("src_port", T.LongType()),
        T.StructField("body_size", T.LongType()),
        T.StructField("args", T.ArrayType(T.StringType())),
    ]
)

INGEST_EVENT = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("sensor_id", T.StringType()),
    T.StructField("honeypot_type", T.StringType()),
    T.StructField("data", T.MapType(T.StringType(), T.StringType())),
])

GEO = T.StructType([
    T.StructField("country_name", T.StringType()),
    T.StructField("city_name", T.StringType()),
    T.StructField("region_name", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("timezone", T.StringType()),
    T.StructField("location", T.StructType([
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
    ])),
])

# One event inside a nested session file.
NESTED_EVENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in (
        "eventid", "timestamp", "session_id", "src_ip", "dst_ip", "dst_port",
        "protocol", "sensor", "uuid", "message", "input", "username", "password",
        "duration", "ttylog", "size", "shasum", "duplicate", "url", "outfile",
        "filename", "destfile",
        "src_ip_identifier", "dst_ip_identifier", "dst_host_identifier", "src_port", "arch",
        "ssh_client_version", "hassh", "hasshAlgorithms", "kexAlgs", "keyAlgs", "encCS", "macCS",
        "compCS", "langCS", "fingerprint", "key", "type", "data",
    )]
    + [T.StructField("geolocation_data", GEO)]
)
