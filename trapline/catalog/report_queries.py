"""Reports: aggregates, top lists, windows, duplicates, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from trapline.catalog.ingest_queries import MAP_SEVERITY
from trapline.catalog.registry import micros, query, rounded, view
from trapline.fixtures import Tables
from trapline.operators import analytics, geo, lookup, quality, sessions
from trapline.sources import files

ASOF = "2024-01-30 00:00:00"


def asof():
    return F.lit(ASOF).cast("timestamp")


# --- frequencies and quality -------------------------------------------------
@query("A14_event_type_frequency", "SELECT event_type, count(*) AS n FROM raw_logs GROUP BY event_type")
def _(t: Tables):
    return analytics.frequency(t.raw_logs, "event_type")


@query("A14_top_sources_by_sessions", """
SELECT src_ip, count(*) AS n FROM sess GROUP BY src_ip ORDER BY n DESC, src_ip LIMIT 15""", ["sess"])
def _(t: Tables):
    return analytics.frequency(sessions.network(t.flat), "src_ip", 15)


@query("A15_data_quality", """
SELECT count(*) FILTER (WHERE session_id IS NULL) AS missing_sessions,
  count(*) FILTER (WHERE ts IS NULL) AS missing_timestamps, count(DISTINCT session_id) AS unique_sessions FROM flat""", ["flat"])
def _(t: Tables):
    return analytics.data_quality(t.flat)


@query("A22_sessions_by_hour", """
SELECT hour(session_start)::INT AS hour, count(*) AS sessions FROM sess GROUP BY 1""", ["sess"])
def _(t: Tables):
    return analytics.sessions_by_hour(sessions.bounds(t.flat))


@query("A23_login_outcomes", """
SELECT replace(eventid, 'cowrie.login.', '') AS outcome, count(*) AS n FROM flat
WHERE eventid IN ('cowrie.login.success', 'cowrie.login.failed') GROUP BY 1""", ["flat"])
def _(t: Tables):
    return analytics.login_outcomes(t.flat)


@query("A24_events_per_hour", """
SELECT epoch_us(date_trunc('hour', ts)) AS hour, count(*) AS events FROM raw_logs GROUP BY 1 ORDER BY 1 DESC LIMIT 24""")
def _(t: Tables):
    return analytics.events_per_hour(t.raw_logs).withColumn("hour", micros("hour"))


@query("A24_events_per_hour_all", """
SELECT epoch_us(date_trunc('hour', ts)) AS hour, count(*) AS events FROM raw_logs GROUP BY 1""")
def _(t: Tables):
    return analytics.events_per_hour(t.raw_logs, last=None).withColumn("hour", micros("hour"))


view("cmds", """
SELECT coalesce(session_id, 'unknown') AS session_id, nullif(trim(input), '') AS cmd, max(id) AS id
FROM raw_logs WHERE nullif(trim(input), '') IS NOT NULL GROUP BY 1, 2""", "raw_logs")
view("summary", """
SELECT s.session_id, s.src_ip, s.count, s.newest_id, s.newest_ts, s.oldest_ts, y.event_types, coalesce(c.commands, '') AS commands
FROM (SELECT coalesce(session_id, 'unknown') AS session_id, coalesce(arg_max(src_ip, id), 'unknown') AS src_ip,
        count(*) AS count, max(id) AS newest_id, epoch_us(arg_max(created_at, id)) AS newest_ts,
        epoch_us(arg_min(created_at, id)) AS oldest_ts FROM raw_logs GROUP BY 1) s
JOIN (SELECT session_id, string_agg(event_type, '|' ORDER BY id DESC) AS event_types
      FROM (SELECT coalesce(session_id, 'unknown') AS session_id, event_type, max(id) AS id FROM raw_logs GROUP BY 1, 2)
      GROUP BY session_id) y USING (session_id)
LEFT JOIN (SELECT session_id, string_agg(cmd, '|' ORDER BY id DESC) AS commands
      FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS rn FROM cmds) WHERE rn <= 5
      GROUP BY session_id) c USING (session_id)""", "raw_logs", "cmds")


def _shown(summary):
    return summary.withColumns({
        "newest_ts": micros("newest_ts"), "oldest_ts": micros("oldest_ts"),
        "event_types": F.array_join("event_types", "|"), "commands": F.array_join("commands", "|")})


@query("A25_session_summary", "SELECT * FROM summary", ["summary"])
def _(t: Tables):
    return _shown(analytics.session_summary(t.raw_logs))


@query("F09_session_search", """
SELECT * FROM summary WHERE contains(src_ip, '203.0.0.1') AND contains(session_id, 's1') AND contains(event_types, 'login')""",
       ["summary"])
def _(t: Tables):
    return _shown(analytics.search_sessions(
        analytics.session_summary(t.raw_logs), ip="203.0.0.1", session="s1", event_type="login"))


@query("A26_session_depth", """
SELECT b.range, b.label, (SELECT count(*) FROM (SELECT count(*) AS n FROM raw_logs GROUP BY coalesce(session_id, 'unknown'))
                          WHERE n BETWEEN b.lo AND b.hi) AS sessions
FROM (VALUES ('1', 'Hit & run', 1, 1), ('2-5', 'Quick probe', 2, 5), ('6-15', 'Exploration', 6, 15),
             ('16-50', 'Sustained', 16, 50), ('51+', 'Deep intrusion', 51, 1000000000)) AS b(range, label, lo, hi)""")
def _(t: Tables):
    return analytics.session_depth(t.raw_logs)


@query("A27_service_mix", """
SELECT label, value, floor(value / sum(value) OVER () * 100 + 0.5)::BIGINT AS percent FROM (
  SELECT CASE honeypot_type WHEN 'ssh' THEN 'SSH' WHEN 'http' THEN 'HTTP' WHEN 'redis' THEN 'Redis'
    WHEN 'mysql' THEN 'MySQL' WHEN 'ftp' THEN 'FTP' ELSE 'SMTP' END AS label, count(*) AS value
  FROM raw_logs GROUP BY 1)""")
def _(t: Tables):
    return analytics.service_mix(t.raw_logs)


@query("A28_kpis", """
SELECT count(*) AS events, count(DISTINCT coalesce(src_ip, '')) AS unique_ips,
  count(DISTINCT coalesce(session_id, 'unknown')) AS sessions,
  (SELECT count(*) FROM (SELECT 1 FROM raw_logs GROUP BY coalesce(session_id, 'unknown') HAVING count(*) >= 51)) AS deep_sessions,
  count(DISTINCT event_type) AS attack_types, least(8, count(DISTINCT event_type)) AS shown_types FROM raw_logs""")
def _(t: Tables):
    return analytics.kpis(t.raw_logs)


@query("A34_duplicate_count", """
SELECT count(*) - count(DISTINCT md5(concat_ws('|', epoch_us(ts), coalesce(src_ip, '~'), coalesce(session_id, '~'), event_type,
  coalesce(username, '~'), coalesce(password, '~'), coalesce(input, '~')))) AS dupes FROM raw_dup""", ["raw_dup"])
def _(t: Tables):
    return quality.duplicate_count(t.raw_dup)


@query("A35_worst_duplicates", """
SELECT min(id) AS keep_id, count(*) AS copies FROM raw_dup
GROUP BY ts, src_ip, session_id, event_type, username, password, input
HAVING count(*) > 1 ORDER BY copies DESC, keep_id LIMIT 10""", ["raw_dup"])
def _(t: Tables):
    return quality.worst_duplicates(t.raw_dup)


@query("W01_deduplicated", "SELECT id, epoch_us(ts) AS ts, event_type, session_id FROM raw_logs")
def _(t: Tables):
    return quality.deduplicate(t.raw_dup).select("id", micros("ts").alias("ts"), "event_type", "session_id")


@query("W01_deduplicated_documents", "SELECT id, event_type FROM raw_logs JOIN (SELECT DISTINCT id FROM raw_logs) USING (id)")
def _(t: Tables):
    # Copies carry the same fields in another key order.
    copies = t.stored.filter("id % 50 = 0").select(
        (F.col("id") + 1_000_000).alias("id"), "created_at",
        F.to_json(F.struct(
            *[F.get_json_object("raw_json", f"$.{c}").alias(c)
              for c in ("session_id", "sensor_id", "event_type", "src_ip", "timestamp")],
            F.try_parse_json(F.get_json_object("raw_json", "$.payload")).alias("payload"),
        )).alias("raw_json"), "active_honeypot_count")
    return quality.deduplicate_documents(t.stored.unionByName(copies)).select(
        "id", F.get_json_object("raw_json", "$.event_type").alias("event_type"))


@query("A38_service_totals", """
SELECT count(*) FILTER (WHERE eventid LIKE 'cowrie.%') AS ssh_events, count(*) FILTER (WHERE eventid LIKE 'http.%') AS http_events,
  count(*) FILTER (WHERE eventid LIKE 'mysql.%') AS mysql_events, count(*) FILTER (WHERE eventid LIKE 'redis.%') AS redis_events,
  count(*) FILTER (WHERE eventid LIKE 'ftp.%') AS ftp_events, count(*) FILTER (WHERE eventid LIKE 'smtp.%') AS smtp_events
FROM flat""", ["flat"])
def _(t: Tables):
    return analytics.service_totals(t.flat)


@query("A41_session_card", f"""
SELECT count(*) AS events, coalesce(arg_max(src_ip, id), 'unknown') AS src_ip, count(DISTINCT event_type) AS event_types,
  floor(((epoch_us(TIMESTAMP '{ASOF}') - epoch_us(arg_min(created_at, id))) // 3600000000) / 24 + 0.5)::BIGINT || 'd ago' AS age
FROM raw_logs WHERE session_id = 's7-2'""")
def _(t: Tables):
    return analytics.session_detail(t.raw_logs, "s7-2", asof())


@query("A42_page_stats", """
SELECT count(*) AS rows, count(DISTINCT coalesce(session_id, 'unknown')) AS sessions, count(DISTINCT src_ip) AS unique_ips
FROM raw_logs""")
def _(t: Tables):
    return analytics.page_stats(t.raw_logs)


@query("A44_composition", """
SELECT honeypot_type, cnt, position, sum(cnt) OVER ()::BIGINT AS total FROM (
  SELECT honeypot_type, arg_max(cnt, updated_at) AS cnt,
    CASE honeypot_type WHEN 'ssh' THEN 1 WHEN 'http' THEN 2 WHEN 'redis' THEN 3 WHEN 'mysql' THEN 4 WHEN 'ftp' THEN 5 ELSE 6 END AS position
  FROM state_history GROUP BY honeypot_type)""", ["state_history"])
def _(t: Tables):
    return analytics.composition(t.state_history)


@query("A31_mean_per_hour", f"""
SELECT count(*) / 24 AS per_hour FROM raw_logs WHERE created_at >= TIMESTAMP '{ASOF}' - INTERVAL 24 HOUR""")
def _(t: Tables):
    return analytics.mean_per_hour(t.raw_logs, asof())


@query("T09_source_liveness", f"""
SELECT sensor_id, epoch_us(max(created_at)) AS last_seen, count(*) AS events,
  round((epoch_us(TIMESTAMP '{ASOF}') - epoch_us(max(created_at))) / 1e6, 6) AS silent_s FROM raw_logs GROUP BY sensor_id""")
def _(t: Tables):
    return rounded(analytics.last_seen(t.raw_logs, asof()).withColumn("last_seen", micros("last_seen")))


@query("Q13_source_table", """
SELECT src_ip, count(*) AS events, count(DISTINCT session_id) AS sessions, epoch_us(min(ts)) AS first_seen,
  epoch_us(max(ts)) AS last_seen FROM raw_logs GROUP BY src_ip""")
def _(t: Tables):
    return analytics.per_ip_table(t.raw_logs).withColumns({c: micros(c) for c in ("first_seen", "last_seen")})


# --- top lists ---------------------------------------------------------------
def _top(name: str, column: str, limit: int, fn):
    @query(name, f"""
SELECT label, value FROM (SELECT coalesce({column}, 'unknown') AS label, count(*) AS value, max(id) AS newest
FROM raw_logs GROUP BY 1) ORDER BY value DESC, newest DESC LIMIT {limit}""")
    def _(t: Tables):
        return fn(t.raw_logs, limit)


_top("O01_top_sources", "src_ip", 8, analytics.top_sources)
_top("O02_top_event_types", "event_type", 8, analytics.top_event_types)


@query("O03_top_commands", """
SELECT label, value FROM (SELECT trim(input) AS label, count(*) AS value, max(id) AS newest
FROM raw_logs WHERE trim(input) <> '' GROUP BY 1) ORDER BY value DESC, newest DESC LIMIT 8""")
def _(t: Tables):
    return analytics.top_commands(t.raw_logs)


def _creds(kind: str) -> str:
    return f"""(SELECT '{kind}' AS kind, label, value FROM (SELECT {kind} AS label, count(*) AS value, max(id) AS newest
FROM raw_logs WHERE length({kind}) BETWEEN 1 AND 63 GROUP BY 1)
ORDER BY value DESC, CASE WHEN regexp_full_match(label, '0|[1-9][0-9]{{0,8}}') THEN label::BIGINT END NULLS LAST, newest DESC LIMIT 7)"""


@query("O04_top_credentials", f"SELECT * FROM {_creds('username')} UNION ALL SELECT * FROM {_creds('password')}")
def _(t: Tables):
    return analytics.top_credentials(t.raw_logs)


@query("O06_log_page", """
SELECT id, src_ip, event_type FROM raw_logs ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 100""")
def _(t: Tables):
    return analytics.log_page(t.raw_logs, page=2).select("id", "src_ip", "event_type")


@query("O07_recent_feed", f"""
SELECT id, src_ip, event_type, {MAP_SEVERITY} AS severity FROM raw_logs WHERE src_ip NOT LIKE '10.%'
ORDER BY created_at DESC, id DESC LIMIT 40""")
def _(t: Tables):
    return analytics.recent_feed(t.raw_logs).select("id", "src_ip", "event_type", "severity")


@query("O09_commands_per_session", """
SELECT session_id, count(*) AS commands FROM raw_logs
WHERE event_type = 'cowrie.command.input' AND session_id IS NOT NULL GROUP BY session_id""")
def _(t: Tables):
    return analytics.commands_per_session(t.raw_logs)


@query("U01_united_sources", """
SELECT source, count(*) AS n, count(session_id) AS sessions, count(payload) AS payloads FROM (
  SELECT 'a' AS source, session_id, NULL AS payload FROM raw_logs
  UNION ALL SELECT 'b', NULL, value FROM events) GROUP BY source""")
def _(t: Tables):
    a = files.with_source(t.raw_logs.select("session_id"), "a")
    b = files.with_source(t.events.select(F.col("value").alias("payload")), "b")
    return files.unite(a, b).groupBy("source").agg(
        F.count("*").alias("n"), F.count("session_id").alias("sessions"), F.count("payload").alias("payloads"))


@query("U02_all_event_types", """
SELECT DISTINCT event_type FROM (SELECT event_type FROM raw_logs WHERE length(event_type) > 0
  UNION ALL SELECT 'cowrie.command.input'
  UNION ALL SELECT 'cowrie.direct-tcpip.request'
  UNION ALL SELECT 'cowrie.login.success'
  UNION ALL SELECT 'cowrie.session.closed'
  UNION ALL SELECT 'cowrie.session.connect'
  UNION ALL SELECT 'ftp.login.success'
  UNION ALL SELECT 'ftp.session.connect'
  UNION ALL SELECT 'ftp.session.disconnect'
  UNION ALL SELECT 'http.page.visit'
  UNION ALL SELECT 'http.scan.probe'
  UNION ALL SELECT 'mysql.session.connect'
  UNION ALL SELECT 'mysql.session.end'
  UNION ALL SELECT 'redis.session.connect'
  UNION ALL SELECT 'redis.session.disconnect'
  UNION ALL SELECT 'smtp.ehlo'
  UNION ALL SELECT 'smtp.login.attempt'
  UNION ALL SELECT 'smtp.session.connect'
  UNION ALL SELECT 'smtp.session.disconnect'
  UNION ALL SELECT 'ssh.login.attempt')""")
def _(t: Tables):
    return analytics.all_event_types(t.raw_logs)


# --- joins and geography -----------------------------------------------------
@query("J06_state_at_event_time", """
SELECT e.id, e.honeypot_type, (SELECT arg_max(h.cnt, h.updated_at) FROM state_history h
  WHERE h.honeypot_type = e.honeypot_type AND h.updated_at <= e.ts) AS cnt FROM raw_logs e""", ["raw_logs", "state_history"])
def _(t: Tables):
    return lookup.as_of(
        t.raw_logs.select("id", "honeypot_type", "ts"), t.state_history, "honeypot_type", "ts",
        "updated_at", "cnt").select("id", "honeypot_type", "cnt")


view("located", """
SELECT ip, count, lat, lon, coalesce(city, '') AS city, coalesce(country, 'Unknown') AS country,
  CASE WHEN count >= 100 THEN '100+' WHEN count >= 20 THEN '20-99' WHEN count >= 5 THEN '5-19' ELSE '1-4' END AS band
FROM (SELECT src_ip AS ip, count(*) AS count FROM raw_logs WHERE src_ip <> '' GROUP BY 1) JOIN geo_dim USING (ip)""",
     "raw_logs", "geo_dim")


@query("J07_located_sources", "SELECT * FROM located", ["located"])
def _(t: Tables):
    return geo.located_sources(t.raw_logs, t.geo_dim)


@query("J08_located_events", f"""
SELECT id, src_ip, event_type, epoch_us(created_at) AS created_at, lat, lon,
  coalesce(city || ', ' || country, 'Unknown location') AS place, {MAP_SEVERITY} AS severity
FROM raw_logs LEFT JOIN geo_dim ON ip = src_ip WHERE src_ip NOT LIKE '10.%'""", ["raw_logs", "geo_dim"])
def _(t: Tables):
    return geo.located_events(t.raw_logs, t.geo_dim).withColumn("created_at", micros("created_at"))


@query("J09_sessions_with_geo", """
SELECT session_id, src_ip, n_nationkey FROM (
  SELECT session_id, src_ip, split_part(src_ip, '.', 1)::BIGINT * 16777216 + split_part(src_ip, '.', 2)::BIGINT * 65536
    + split_part(src_ip, '.', 3)::BIGINT * 256 + split_part(src_ip, '.', 4)::BIGINT AS ip FROM sess) s
LEFT JOIN geo_ranges r ON s.ip BETWEEN r.ip_start AND r.ip_end""", ["sess", "geo_ranges"])
def _(t: Tables):
    return geo.sessions_with_geo(sessions.network(t.flat).select("session_id", "src_ip"), t.geo_ranges)


@query("A29_attack_totals", "SELECT sum(count)::BIGINT AS attacks, count(DISTINCT country) AS countries FROM located", ["located"])
def _(t: Tables):
    return geo.attack_totals(t.raw_logs, t.geo_dim)


view("profiles_by_ip", f"""
SELECT src_ip, count, first_id, lat, lon, city, country, severity FROM (
  SELECT src_ip, count(*) AS count, min(id) AS first_id,
    CASE max(CASE {MAP_SEVERITY} WHEN 'high' THEN 3 WHEN 'med' THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'med' ELSE 'low' END AS severity
  FROM raw_logs WHERE src_ip NOT LIKE '10.%' GROUP BY src_ip) JOIN geo_dim ON ip = src_ip""", "raw_logs", "geo_dim")


@query("A30_source_profiles", "SELECT * FROM profiles_by_ip", ["profiles_by_ip"])
def _(t: Tables):
    return geo.source_profiles(t.raw_logs, t.geo_dim)


@query("W05_leaderboard", """
SELECT src_ip, count, greatest(6, floor(count / max(count) OVER () * 100 + 0.5)::BIGINT) AS percent
FROM (SELECT * FROM profiles_by_ip ORDER BY count DESC, first_id LIMIT 8)""", ["profiles_by_ip"])
def _(t: Tables):
    board = analytics.leaderboard(geo.source_profiles(t.raw_logs, t.geo_dim))
    return board.select("src_ip", "count", "percent")


@query("O08_top_located", "SELECT * FROM located ORDER BY count DESC, ip LIMIT 15", ["located"])
def _(t: Tables):
    return geo.top_located(t.raw_logs, t.geo_dim)
