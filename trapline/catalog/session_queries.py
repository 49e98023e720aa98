"""Session aggregation and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from trapline.catalog.registry import micros, query, rounded, view
from trapline.fixtures import Tables
from trapline.functions.text import EXPLORATORY_TERMS, contains_any, password_metrics, shannon_entropy
from trapline.operators import features, sessions
from trapline.operators.normalize import is_command_event
from trapline.schema import COUNT_COLUMNS, FEATURES

# Flat events as the comparison engine sees them.
view("flat", """
SELECT id, -id AS ord, ts, session_id, src_ip, sensor_id AS sensor, event_type AS eventid, protocol,
  username, password, input, input AS command,
  CASE WHEN event_type LIKE 'cowrie.%' THEN active_honeypot_count ELSE 0 END AS ssh_honeypot_count,
  CASE WHEN event_type LIKE 'http.%' THEN active_honeypot_count ELSE 0 END AS http_honeypot_count,
  CASE WHEN event_type LIKE 'mysql.%' THEN active_honeypot_count ELSE 0 END AS mysql_honeypot_count,
  CASE WHEN event_type LIKE 'redis.%' THEN active_honeypot_count ELSE 0 END AS redis_honeypot_count,
  CASE WHEN event_type LIKE 'ftp.%' THEN active_honeypot_count ELSE 0 END AS ftp_honeypot_count,
  CASE WHEN event_type LIKE 'smtp.%' THEN active_honeypot_count ELSE 0 END AS smtp_honeypot_count,
  event_type LIKE '%command%' OR event_type LIKE '%query%' AS is_cmd
FROM raw_logs""", "raw_logs")

# Strength of every distinct password; characters are counted by splitting.
view("pw", """
SELECT p AS password, count(*) FILTER (WHERE n IS NOT NULL) AS u, coalesce(sum(n), 0) AS len,
  coalesce(sum(-(n / l) * log2(n / l)), 0.0) AS bits
FROM (SELECT p, c, CASE WHEN c IS NULL THEN NULL ELSE count(*) END::DOUBLE AS n, max(l)::DOUBLE AS l
      FROM (SELECT p, length(trim(p)) AS l,
                   unnest(CASE WHEN trim(p) = '' THEN [NULL] ELSE string_split(trim(p), '') END) AS c
            FROM (SELECT DISTINCT password AS p FROM raw_logs WHERE password IS NOT NULL))
      GROUP BY p, c)
GROUP BY p""", "raw_logs")

view("sess", """
SELECT session_id, min(ts) AS session_start, max(ts) AS session_end,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration,
  arg_min(src_ip, ord) FILTER (WHERE src_ip IS NOT NULL) AS src_ip,
  arg_min(protocol, ord) FILTER (WHERE protocol IS NOT NULL) AS protocol,
  arg_min(username, ord) FILTER (WHERE username IS NOT NULL) AS user_first,
  arg_min(sensor, ord) FILTER (WHERE sensor IS NOT NULL) AS sensor,
  count(*) FILTER (WHERE eventid = 'cowrie.login.success') AS login_success,
  count(*) FILTER (WHERE eventid = 'cowrie.login.failed') AS login_fail,
  count(DISTINCT username) AS unique_users, count(DISTINCT password) AS unique_pass,
  count(eventid) AS event_count, count(DISTINCT eventid) AS unique_event_types,
  count(*) FILTER (WHERE starts_with(eventid, 'cowrie.')) AS ssh_events,
  count(*) FILTER (WHERE starts_with(eventid, 'http.')) AS http_events,
  count(*) FILTER (WHERE starts_with(eventid, 'mysql.')) AS mysql_events,
  count(*) FILTER (WHERE starts_with(eventid, 'redis.')) AS redis_events,
  count(*) FILTER (WHERE starts_with(eventid, 'ftp.')) AS ftp_events,
  count(*) FILTER (WHERE starts_with(eventid, 'smtp.')) AS smtp_events,
  count(*) FILTER (WHERE eventid = 'http.login.attempt') AS http_login_attempts,
  count(*) FILTER (WHERE eventid = 'http.page.visit') AS http_page_visits,
  count(*) FILTER (WHERE eventid = 'mysql.query') AS mysql_queries,
  count(*) FILTER (WHERE eventid = 'redis.command') AS redis_commands,
  count(*) FILTER (WHERE eventid = 'cowrie.session.file_download') AS downloads,
  count(*) FILTER (WHERE eventid = 'cowrie.session.file_upload') AS uploads,
  count(*) FILTER (WHERE eventid = 'ftp.session.connect') AS ftp_connects,
  count(*) FILTER (WHERE eventid = 'ftp.session.disconnect') AS ftp_disconnects,
  count(*) FILTER (WHERE eventid = 'smtp.ehlo') AS smtp_ehlo_count,
  count(*) FILTER (WHERE eventid = 'smtp.session.connect') AS smtp_connects,
  count(command) FILTER (WHERE is_cmd) AS cmd_count,
  count(DISTINCT command) FILTER (WHERE is_cmd) AS unique_cmds,
  arg_min(command, ord) FILTER (WHERE is_cmd AND command IS NOT NULL) AS first_cmd,
  arg_max(command, ord) FILTER (WHERE is_cmd AND command IS NOT NULL) AS last_cmd,
  count(command) FILTER (WHERE eventid = 'cowrie.command.failed') AS cmd_failed_count,
  count(DISTINCT command) FILTER (WHERE eventid = 'cowrie.command.failed') AS unique_failed_cmds,
  arg_min(command, ord) FILTER (WHERE eventid = 'cowrie.command.failed' AND command IS NOT NULL) AS first_failed_cmd,
  arg_max(command, ord) FILTER (WHERE eventid = 'cowrie.command.failed' AND command IS NOT NULL) AS last_failed_cmd,
  arg_max(ssh_honeypot_count, ord)::INT AS ssh_honeypot_count,
  arg_max(http_honeypot_count, ord)::INT AS http_honeypot_count,
  arg_max(mysql_honeypot_count, ord)::INT AS mysql_honeypot_count,
  arg_max(redis_honeypot_count, ord)::INT AS redis_honeypot_count,
  arg_max(ftp_honeypot_count, ord)::INT AS ftp_honeypot_count,
  arg_max(smtp_honeypot_count, ord)::INT AS smtp_honeypot_count,
  coalesce(avg(bits), 0.0) AS pw_entropy_per_char,
  coalesce(avg(bits * len), 0.0) AS pw_entropy_total,
  coalesce(avg(CASE WHEN u > 1 THEN bits / log2(u) WHEN u IS NOT NULL THEN 0.0 END), 0.0) AS pw_normalized_entropy,
  coalesce(avg(len), 0.0) AS pw_length_mean,
  coalesce(avg(u), 0.0) AS pw_unique_chars_mean,
  coalesce(avg(bits * len + u + 0.5 * len), 0.0) AS pw_total_strength,
  string_agg(lower(command), ';') FILTER (WHERE eventid = 'cowrie.command.input') AS typed
FROM flat LEFT JOIN pw USING (password)
WHERE session_id IS NOT NULL GROUP BY session_id""", "flat", "pw")

view("feat_all", """
SELECT *,
  cmd_count / (duration / 60.0 + 1e-9::DOUBLE) AS cmds_per_min,
  login_fail / (duration / 60.0 + 1e-9::DOUBLE) AS fails_per_min,
  cmd_failed_count / (duration / 60.0 + 1e-9::DOUBLE) AS cmd_failed_per_min,
  cmd_failed_count / (cmd_count + 1e-9::DOUBLE) AS cmd_failed_ratio,
  (login_success > 0)::INT AS has_successful_login, (cmd_count > 0)::INT AS has_any_commands,
  (cmd_failed_count > 0)::INT AS has_failed_commands,
  coalesce(src_ip IN ('127.0.0.1', '::1'), false)::INT AS is_local_src,
  ssh_events / (event_count + 1e-9::DOUBLE) AS ssh_ratio, http_events / (event_count + 1e-9::DOUBLE) AS http_ratio,
  mysql_events / (event_count + 1e-9::DOUBLE) AS mysql_ratio, redis_events / (event_count + 1e-9::DOUBLE) AS redis_ratio,
  ftp_events / (event_count + 1e-9::DOUBLE) AS ftp_ratio, smtp_events / (event_count + 1e-9::DOUBLE) AS smtp_ratio,
  downloads / (event_count + 1e-9::DOUBLE) AS download_ratio, uploads / (event_count + 1e-9::DOUBLE) AS upload_ratio,
  (downloads + uploads) / (event_count + 1e-9::DOUBLE) AS file_transfer_ratio,
  event_count / (greatest(duration, 1.0) / 60) AS events_per_min,
  (ssh_events > 0)::INT + (http_events > 0)::INT + (ftp_events > 0)::INT + (smtp_events > 0)::INT
    + (mysql_events > 0)::INT + (redis_events > 0)::INT AS services_touched,
  (coalesce(protocol, '') ILIKE '%ssh%')::INT AS is_ssh_protocol, (coalesce(protocol, '') ILIKE '%http%')::INT AS is_http_protocol,
  (coalesce(protocol, '') ILIKE '%ftp%')::INT AS is_ftp_protocol, (coalesce(protocol, '') ILIKE '%smtp%')::INT AS is_smtp_protocol,
  (coalesce(protocol, '') ILIKE '%mysql%')::INT AS is_mysql_protocol, (coalesce(protocol, '') ILIKE '%redis%')::INT AS is_redis_protocol,
  (http_events > 0)::INT AS has_http_activity, (ftp_events > 0)::INT AS has_ftp_activity,
  (smtp_events > 0)::INT AS has_smtp_activity, (mysql_events > 0)::INT AS has_mysql_activity,
  (redis_events > 0)::INT AS has_redis_activity,
  CASE greatest(ssh_events, http_events, ftp_events, smtp_events, mysql_events, redis_events)
    WHEN ssh_events THEN 'ssh' WHEN http_events THEN 'http' WHEN ftp_events THEN 'ftp'
    WHEN smtp_events THEN 'smtp' WHEN mysql_events THEN 'mysql' ELSE 'redis' END AS primary_service,
  coalesce(regexp_matches(typed, 'ls|pwd|whoami|uname|id|ifconfig'), false)::INT AS contains_recon_cmds,
  coalesce(regexp_matches(typed, 'wget|curl|apt|yum|pip|scp'), false)::INT AS contains_install_cmds,
  coalesce(regexp_matches(typed, 'cd|mkdir|rm|mv|cp|touch'), false)::INT AS contains_nav_cmds,
  coalesce(regexp_matches(typed, 'exit|logout|quit'), false)::INT AS contains_exit_cmd,
  coalesce(regexp_matches(typed, 'crontab|systemctl|nohup'), false)::INT AS contains_persist_terms,
  coalesce(regexp_matches(typed, '\\./|sh|bash|python'), false)::INT AS contains_exec_terms,
  coalesce(regexp_matches(typed, 'kill|killall|pkill'), false)::INT AS contains_kill_terms,
  coalesce(regexp_matches(typed, 'ssh|telnet|nc|nmap|ping'), false)::INT AS contains_network_terms
FROM sess""", "sess")


@query("A01_session_bounds", """
SELECT session_id, epoch_us(session_start) AS session_start, epoch_us(session_end) AS session_end,
  round(duration, 6) AS duration FROM sess""", ["sess"])
def _(t: Tables):
    return rounded(sessions.bounds(t.flat).withColumns(
        {c: micros(c) for c in ("session_start", "session_end")}))


@query("A02_session_network", "SELECT session_id, src_ip, protocol, user_first, sensor FROM sess", ["sess"])
def _(t: Tables):
    return sessions.network(t.flat)


@query("A03_session_logins", """
SELECT session_id, login_success, login_fail, unique_users, unique_pass FROM sess""", ["sess"])
def _(t: Tables):
    return sessions.sessions(t.flat).select(
        "session_id", "login_success", "login_fail", "unique_users", "unique_pass")


EVENT_COLUMNS = [
    "session_id", "event_count", "unique_event_types", "ssh_events", "http_events", "mysql_events",
    "redis_events", "ftp_events", "smtp_events", "http_login_attempts", "http_page_visits",
    "mysql_queries", "redis_commands", "downloads", "uploads", "ftp_connects", "ftp_disconnects",
    "smtp_ehlo_count", "smtp_connects",
]


@query("A04_session_event_counts", f"SELECT {', '.join(EVENT_COLUMNS)} FROM sess", ["sess"])
def _(t: Tables):
    return sessions.type_counts(t.flat).select(*EVENT_COLUMNS)


@query("A05_session_commands", "SELECT session_id, cmd_count, unique_cmds, first_cmd, last_cmd FROM sess", ["sess"])
def _(t: Tables):
    return sessions.sessions(t.flat).select(
        "session_id", "cmd_count", "unique_cmds", "first_cmd", "last_cmd")


@query("A06_session_failed_commands", """
SELECT session_id, cmd_failed_count, unique_failed_cmds, first_failed_cmd, last_failed_cmd FROM sess""", ["sess"])
def _(t: Tables):
    return sessions.sessions(t.flat).select(
        "session_id", "cmd_failed_count", "unique_failed_cmds", "first_failed_cmd", "last_failed_cmd")


@query("A07_session_sensor_counts", f"SELECT session_id, {', '.join(COUNT_COLUMNS)} FROM sess", ["sess"])
def _(t: Tables):
    return sessions.sensor_counts(t.flat)


A08 = ["login_success", "login_fail", "unique_users", "unique_pass", "cmd_count", "unique_cmds",
       "cmd_failed_count", "unique_failed_cmds"]


@query("A08_session_null_counters", f"SELECT session_id, {' + '.join(f'({c} IS NULL)::INT' for c in A08)} AS nulls, "
       f"{' + '.join(A08)} AS total FROM sess", ["sess"])
def _(t: Tables):
    s = sessions.sessions(t.flat)
    nulls, total = F.lit(0), F.lit(0)
    for c in A08:
        nulls, total = nulls + F.col(c).isNull().cast("int"), total + F.col(c)
    return s.select("session_id", nulls.alias("nulls"), total.alias("total"))


PW = list(sessions.PASSWORD_MEANS)


@query("A09_session_password_means",
       f"SELECT session_id, {', '.join(f'round({c}, 6) AS {c}' for c in PW)} FROM sess", ["sess"])
def _(t: Tables):
    return rounded(sessions.sessions(t.flat).select("session_id", *PW))


TERMS = list(sessions.COMMAND_TERMS)


@query("A10_session_command_terms", f"SELECT session_id, {', '.join(TERMS)} FROM feat_all", ["feat_all"])
def _(t: Tables):
    return sessions.sessions(t.flat).select("session_id", *TERMS)


@query("A11_session_transfers", """
SELECT session_id, count(*) FILTER (WHERE eventid = 'cowrie.session.file_download') AS file_download_count,
  arg_min(src_ip, ord) FILTER (WHERE eventid = 'cowrie.session.file_download') AS first_download_url,
  count(*) FILTER (WHERE eventid = 'cowrie.session.file_upload') AS file_upload_count,
  arg_min(sensor, ord) FILTER (WHERE eventid = 'cowrie.session.file_upload') AS first_upload_filename
FROM flat WHERE session_id IS NOT NULL GROUP BY session_id""", ["flat"])
def _(t: Tables):
    # The test tables have no file columns; source and sensor stand in for them.
    events = t.flat.withColumns({"url": F.col("src_ip"), "filename": F.col("sensor")})
    return sessions.extended(events).select(
        "session_id", "file_download_count", "first_download_url", "file_upload_count",
        "first_upload_filename")


@query("A12_session_value_lists", """
SELECT session_id, 'password' AS kind, 0 AS chunk, string_agg(password, '|' ORDER BY ord) AS items
FROM flat WHERE session_id IS NOT NULL AND password IS NOT NULL GROUP BY session_id
UNION ALL SELECT session_id, 'command', 0, string_agg(command, '|' ORDER BY ord)
FROM flat WHERE session_id IS NOT NULL AND command IS NOT NULL AND eventid = 'cowrie.command.input' GROUP BY session_id
UNION ALL SELECT session_id, 'failed', 0, string_agg(command, '|' ORDER BY ord)
FROM flat WHERE session_id IS NOT NULL AND command IS NOT NULL AND eventid = 'cowrie.command.failed' GROUP BY session_id
""", ["flat"])
def _(t: Tables):
    def lists(kind: str, column: str, only):
        rows = t.flat.filter("session_id IS NOT NULL").filter(F.col(column).isNotNull() & only)
        return sessions.value_lists(
            rows.select("session_id", "ord", F.col(column).alias("value"))
        ).select("session_id", F.lit(kind).alias("kind"), "chunk", F.array_join("items", "|").alias("items"))

    return (lists("password", "password", F.lit(True))
            .unionByName(lists("command", "input", F.col("eventid") == "cowrie.command.input"))
            .unionByName(lists("failed", "input", F.col("eventid") == "cowrie.command.failed")))


view("pw_plain", """
SELECT p AS password, sum(-(n / l) * log2(n / l)) AS bits
FROM (SELECT p, c, count(*)::DOUBLE AS n, max(l)::DOUBLE AS l
      FROM (SELECT p, length(p) AS l, unnest(string_split(p, '')) AS c
            FROM (SELECT DISTINCT password AS p FROM raw_logs WHERE length(password) > 0)) GROUP BY p, c)
GROUP BY p""", "raw_logs")
view("compact", """
SELECT session_id, epoch_us(min(ts)) AS start_time, epoch_us(max(ts)) AS end_time,
  count(*) FILTER (WHERE contains(eventid, 'cowrie.command')) AS command_count,
  coalesce(avg(CASE WHEN password IS NOT NULL THEN coalesce(bits, 0.0) END), 0.0) AS avg_password_entropy,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS session_duration_s
FROM flat LEFT JOIN pw_plain USING (password) WHERE session_id IS NOT NULL AND ts IS NOT NULL GROUP BY session_id
""", "flat", "pw_plain")


@query("A13_compact_features", """
SELECT session_id, start_time, end_time, command_count, round(avg_password_entropy, 6) AS avg_password_entropy,
  round(session_duration_s, 6) AS session_duration_s,
  round(CASE WHEN session_duration_s = 0 THEN 0.0
             ELSE command_count / (greatest(session_duration_s, 0.5) / 60) END, 6) AS commands_per_min
FROM compact""", ["compact"])
def _(t: Tables):
    return rounded(sessions.compact(t.flat).withColumns(
        {c: micros(c) for c in ("start_time", "end_time")}))


@query("A21_session_tallies", """
SELECT session_id, count(*) FILTER (WHERE eventid = 'cowrie.command.input') AS commands,
  count(*) FILTER (WHERE eventid = 'cowrie.login.success') AS login_successes,
  count(*) FILTER (WHERE eventid = 'cowrie.login.failed') AS login_failures
FROM flat WHERE session_id IS NOT NULL
  AND eventid IN ('cowrie.command.input', 'cowrie.login.success', 'cowrie.login.failed') GROUP BY session_id""", ["flat"])
def _(t: Tables):
    return sessions.tallies(t.flat, "eventid")


J01 = ["src_ip", "protocol", "sensor", "event_count", "unique_users", "unique_pass", "cmd_count",
       "first_cmd", "last_cmd", "cmd_failed_count"]


@query("J01_session_table", f"""
SELECT session_id, epoch_us(session_start) AS session_start, round(duration, 6) AS duration,
  {', '.join(J01)} FROM sess""", ["sess"])
def _(t: Tables):
    return rounded(sessions.sessions(t.flat).select(
        "session_id", micros("session_start").alias("session_start"), "duration", *J01))


@query("J02_session_with_sensor_counts",
       f"SELECT session_id, event_count, {', '.join(COUNT_COLUMNS)} FROM sess", ["sess"])
def _(t: Tables):
    return sessions.sessions(t.flat).select("session_id", "event_count", *COUNT_COLUMNS)


@query("J03_session_extended", """
SELECT session_id, arg_min(sensor, ord) FILTER (WHERE eventid = 'cowrie.session.file_download') AS first_download_outfile,
  arg_min(input, ord) FILTER (WHERE eventid = 'cowrie.session.file_upload') AS first_upload_url,
  count(*) FILTER (WHERE eventid = 'cowrie.session.file_download') AS downloads,
  count(*) FILTER (WHERE eventid = 'cowrie.session.file_upload') AS uploads
FROM flat WHERE session_id IS NOT NULL GROUP BY session_id""", ["flat"])
def _(t: Tables):
    events = t.flat.withColumns({"outfile": F.col("sensor"), "url": F.col("input")})
    return sessions.extended(events).select(
        "session_id", "first_download_outfile", "first_upload_url",
        F.col("file_download_count").alias("downloads"), F.col("file_upload_count").alias("uploads"))


@query("J04_session_password_commands", f"""
SELECT session_id, unique_pass, round(pw_entropy_total, 6) AS pw_entropy_total, cmd_count,
  {' + '.join(TERMS)} AS term_families FROM feat_all""", ["feat_all"])
def _(t: Tables):
    families = F.lit(0)
    for c in TERMS:
        families = families + F.col(c)
    return rounded(sessions.sessions(t.flat).select(
        "session_id", "unique_pass", "pw_entropy_total", "cmd_count", families.alias("term_families")))


@query("X01_password_metrics", """
SELECT password, round(bits, 6) AS entropy_per_char, round(bits * len, 6) AS entropy_total,
  round(CASE WHEN u > 1 THEN bits / log2(u) ELSE 0.0 END, 6) AS normalized_entropy, len::DOUBLE AS length,
  u::DOUBLE AS unique_chars, round(bits * len + u + 0.5 * len, 6) AS total_strength FROM pw""", ["pw"])
def _(t: Tables):
    return rounded(t.raw_logs.filter("password IS NOT NULL").select("password").distinct()
                   .select("password", password_metrics(F.col("password")).alias("m"))
                   .select("password", "m.*"))


@query("X02_text_entropy", """
SELECT doc_id, round(sum(-(n / l) * log2(n / l)), 6) AS entropy
FROM (SELECT doc_id, c, count(*)::DOUBLE AS n, max(l)::DOUBLE AS l
      FROM (SELECT doc_id, length(text) AS l, unnest(string_split(text, '')) AS c FROM documents) GROUP BY doc_id, c)
GROUP BY doc_id""", [])
def _(t: Tables):
    return rounded(t.read("documents").select("doc_id", shannon_entropy(F.col("text")).alias("entropy")))


def _feature_query(name: str, columns: list[str]):
    listed = ", ".join(f"round({c}, 6) AS {c}" for c in columns)

    @query(name, f"SELECT session_id, {listed} FROM feat_all", ["feat_all"])
    def _(t: Tables):
        return rounded(features.add_behaviour(sessions.sessions(t.flat)).select("session_id", *columns))


_feature_query("X03_rates", ["cmds_per_min", "fails_per_min", "cmd_failed_per_min", "cmd_failed_ratio"])
_feature_query("X04_ratios", ["ssh_ratio", "http_ratio", "mysql_ratio", "redis_ratio", "ftp_ratio", "smtp_ratio",
                              "download_ratio", "upload_ratio", "file_transfer_ratio"])
_feature_query("X05_events_per_min", ["events_per_min"])


@query("X06_services_touched", "SELECT session_id, services_touched FROM feat_all", ["feat_all"])
def _(t: Tables):
    return features.add_behaviour(sessions.sessions(t.flat)).select("session_id", "services_touched")


X07 = [f"is_{p}_protocol" for p in features.SERVICES]


@query("X07_protocol_flags", f"SELECT session_id, {', '.join(X07)} FROM feat_all", ["feat_all"])
def _(t: Tables):
    return features.add_behaviour(sessions.sessions(t.flat)).select("session_id", *X07)


X08 = ["has_http_activity", "has_ftp_activity", "has_smtp_activity", "has_mysql_activity",
       "has_redis_activity", "has_successful_login", "has_any_commands", "has_failed_commands"]


@query("X08_activity_flags", f"SELECT session_id, {', '.join(X08)} FROM feat_all", ["feat_all"])
def _(t: Tables):
    return features.add_behaviour(sessions.sessions(t.flat)).select("session_id", *X08)


@query("X09_primary_service", "SELECT session_id, primary_service FROM feat_all", ["feat_all"])
def _(t: Tables):
    return features.add_behaviour(sessions.sessions(t.flat)).select("session_id", "primary_service")


@query("X10_exploratory_terms", """
SELECT id, regexp_matches(c, 'ls|pwd|whoami|uname|id|cat /etc/passwd|hostname|ifconfig|ip a|ip addr|ip route|netstat|ss|ps|ps aux|top|free|df|uptime|w|last|env|printenv|history|cat /proc/cpuinfo|cat /proc/meminfo')::INT AS contains_recon_cmds,
  regexp_matches(c, 'wget|curl|apt|apt-get|yum|pip|scp|ftp|tftp|dnf|pip3|git clone|chmod \\+x|tar|unzip|gunzip|gzip')::INT AS contains_install_cmds,
  regexp_matches(c, 'cd|mkdir|rm|mv|cp|touch|find|locate|tree|du|stat')::INT AS contains_nav_cmds,
  regexp_matches(c, 'exit|logout|quit')::INT AS contains_exit_cmd,
  regexp_matches(c, 'crontab|systemctl|service|nohup|screen|tmux')::INT AS contains_persist_terms,
  regexp_matches(c, '\\./bot|\\./a\\.out|sh|bash|python|perl|php|node')::INT AS contains_exec_terms,
  regexp_matches(c, 'kill|killall|pkill')::INT AS contains_kill_terms,
  regexp_matches(c, 'ssh|telnet|nc|netcat|nmap|ping')::INT AS contains_network_terms
FROM (SELECT id, lower(input) AS c FROM raw_logs WHERE input IS NOT NULL)""")
def _(t: Tables):
    return t.raw_logs.filter("input IS NOT NULL").select(
        "id", *[contains_any(F.col("input"), terms).cast("int").alias(n)
                for n, terms in EXPLORATORY_TERMS.items()])


FEATURE_SQL = ", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in FEATURES)
view("feat", f"""
SELECT session_id, src_ip, session_start, session_end, {', '.join(f'{c}::DOUBLE AS {c}' for c in FEATURES)},
  {', '.join(COUNT_COLUMNS)} FROM feat_all""", "feat_all")


@query("X11_feature_table", f"""
SELECT session_id, src_ip, {FEATURE_SQL}, {', '.join(COUNT_COLUMNS)} FROM feat""", ["feat"])
def _(t: Tables):
    return rounded(features.feature_table(sessions.sessions(t.flat))
                   .drop("session_start", "session_end"))


@query("J11_features_same_row", """
SELECT session_id, contains_recon_cmds + contains_install_cmds AS terms, has_any_commands, services_touched
FROM feat_all""", ["feat_all"])
def _(t: Tables):
    return features.add_behaviour(sessions.sessions(t.flat)).select(
        "session_id", (F.col("contains_recon_cmds") + F.col("contains_install_cmds")).alias("terms"),
        "has_any_commands", "services_touched")


@query("F06_command_events", """
SELECT event_type, count(*) AS n FROM raw_logs
WHERE regexp_matches(event_type, 'command|query', 'i') GROUP BY event_type""")
def _(t: Tables):
    return (t.raw_logs.filter(is_command_event(F.col("event_type")))
            .groupBy("event_type").agg(F.count("*").alias("n")))


@query("F13_local_source", "SELECT session_id, is_local_src FROM feat_all", ["feat_all"])
def _(t: Tables):
    return features.add_behaviour(sessions.sessions(t.flat)).select("session_id", "is_local_src")
