"""Sources, normalisation and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from trapline.catalog.registry import micros, query, rounded, view
from trapline.fixtures import Tables
from trapline.functions import classify
from trapline.functions.clock import age_text, parse_utc
from trapline.functions.text import clean_label, control_share
from trapline.operators import analytics, filters, lookup, normalize
from trapline.schema import CORE_COLUMNS, COUNT_COLUMNS, SENSOR_LINE
from trapline.sources import files, sinks, store

COUNTS = ", ".join(COUNT_COLUMNS)

# What a sensor line says, as the comparison engine derives it.
view("lines", """
SELECT id, honeypot_type AS service, id % 100 = 0 AS broken,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS timestamp,
  CASE WHEN id % 60 <> 7 THEN src_ip END AS source_ip,
  CASE WHEN honeypot_type <> 'ssh' AND id % 40 = 1 THEN honeypot_type || '.server.start' ELSE event_type END AS event_type,
  sensor_id, CASE WHEN honeypot_type IN ('ssh', 'http') THEN session_id END AS session_id,
  username, CASE WHEN honeypot_type IN ('ssh', 'redis') THEN password END AS password, input,
  CASE WHEN honeypot_type = 'redis' THEN ['CONFIG', 'keys', 'PING', 'GET'][(id % 4 + 1)::INT] END AS command,
  CASE WHEN honeypot_type = 'mysql' THEN repeat(input, 100) END AS query,
  honeypot_type = 'smtp' AND id % 10 = 0 AS binary_host,
  CASE WHEN honeypot_type = 'smtp' THEN repeat('x', (id % 400)::INT) END AS body
FROM raw_logs""", "raw_logs")
view("kept", """
SELECT *, CASE
  WHEN event_type IN ('cowrie.login.success', 'cowrie.session.file_download', 'cowrie.session.file_upload',
    'http.login.attempt', 'http.admin.probe', 'ftp.login.success', 'ftp.file.download', 'ftp.file.upload',
    'mysql.login.success', 'mysql.query', 'smtp.login.attempt', 'smtp.message.received', 'redis.rce.attempt',
    'redis.slaveof.attempt', 'redis.replicaof.attempt', 'redis.debug.attempt', 'redis.flush.attempt') THEN 'high'
  WHEN event_type IN ('cowrie.session.connect', 'ftp.session.connect', 'ftp.session.disconnect',
    'smtp.session.connect', 'smtp.session.disconnect', 'smtp.ehlo', 'http.page.visit', 'http.api.probe',
    'http.scan.probe', 'redis.session.connect', 'redis.session.disconnect', 'mysql.session.connect') THEN 'low'
  ELSE 'medium' END AS severity
FROM lines WHERE NOT broken
  AND CASE service
    WHEN 'ssh' THEN event_type IN ('cowrie.session.connect', 'cowrie.login.success', 'cowrie.login.failed',
      'cowrie.command.input', 'cowrie.session.file_download', 'cowrie.session.closed',
      'cowrie.direct-tcpip.request', 'cowrie.session.file_upload')
    WHEN 'redis' THEN NOT ends_with(event_type, '.server.start')
      AND (event_type <> 'redis.command' OR upper(command) IN ('CONFIG', 'KEYS'))
    WHEN 'smtp' THEN event_type NOT IN ('smtp.server.start', 'smtp.command') AND NOT binary_host
    ELSE NOT ends_with(event_type, '.server.start') END""", "lines")
view("ingest", """
SELECT id, ts,
  CASE WHEN id % 89 = 0 THEN 'not-a-timestamp' WHEN id % 97 = 0 THEN NULL
       WHEN id % 3 = 0 THEN strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S.%f') || '+05:30'
       ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' END AS timestamp,
  CASE WHEN id % 83 <> 0 THEN src_ip END AS source_ip,
  CASE WHEN id % 5 = 0 THEN '  ' || upper(event_type) || ' ' ELSE event_type END AS event_type,
  CASE WHEN id % 11 = 0 THEN '' ELSE session_id END AS session_id, sensor_id,
  CASE WHEN id % 2 = 0 THEN honeypot_type END AS honeypot_type, username
FROM raw_logs""", "raw_logs")
view("canon", """
SELECT id, timestamp, epoch_us(ts) AS event_time, source_ip AS src_ip, lower(trim(event_type)) AS event_type, sensor_id,
  coalesce(nullif(session_id, ''),
    sha256(source_ip || ':' || event_type || ':' || regexp_replace(timestamp[:13], '[^0-9]', '', 'g'))) AS session_id,
  CASE WHEN lower(trim(coalesce(nullif(honeypot_type, ''), split_part(event_type, '.', 1))))
            IN ('ssh', 'http', 'redis', 'mysql', 'ftp', 'smtp')
       THEN lower(trim(coalesce(nullif(honeypot_type, ''), split_part(event_type, '.', 1)))) END AS service,
  username
FROM ingest
WHERE timestamp IS NOT NULL AND timestamp <> 'not-a-timestamp' AND source_ip IS NOT NULL""", "ingest")


# --- sources ----------------------------------------------------------------
@query("S01_sensor_line_scan", """
SELECT service, count(*) FILTER (WHERE NOT broken) AS parsed, count(*) FILTER (WHERE broken) AS malformed,
  count(DISTINCT event_type) FILTER (WHERE NOT broken) AS types FROM lines GROUP BY service""", ["lines"])
def _(t: Tables):
    good, bad = files.read_sensor_lines(t.spark, t.sensor_files())
    etype = F.coalesce("eventid", "event_type")
    rows = files.unite(good.select("service", etype.alias("event_type"), F.lit(1).alias("ok")),
                       bad.select("service", F.lit(0).alias("ok")))
    return rows.groupBy("service").agg(
        F.count_if(F.col("ok") == 1).alias("parsed"), F.count_if(F.col("ok") == 0).alias("malformed"),
        F.count_distinct("event_type").alias("types"))


@query("S02_json_any_scan", """
SELECT count(*) AS events, count(*) AS tagged, count(DISTINCT event_type) AS types
FROM lines WHERE NOT broken""", ["lines"])
def _(t: Tables):
    df = files.read_json_any(t.spark, t.sensor_files(), SENSOR_LINE)
    etype = F.coalesce("eventid", "event_type")
    tagged = F.count_if(F.length("_source_file") > 0)
    return df.filter(etype.isNotNull()).agg(
        F.count("*").alias("events"), tagged.alias("tagged"), F.count_distinct(etype).alias("types"))


@query("S02_broken_records", "SELECT 'not JSON' AS reject_reason, count(*) AS n, count(*) AS tagged FROM lines WHERE broken", ["lines"])
def _(t: Tables):
    broken = files.broken_json(t.spark, t.sensor_files(), SENSOR_LINE)
    return broken.groupBy("reject_reason").agg(F.count("*").alias("n"), F.count_if(F.length("_source_file") > 0).alias("tagged"))


NESTED = """
SELECT id, session_id, event_type AS eventid, epoch_us(ts) AS ts, src_ip, username, password, 'XX' AS geo_country,
  sensor_id AS geo_city, id::DOUBLE AS geo_loc_lat, 'cowrie' AS source
FROM raw_logs WHERE session_id IS NOT NULL"""


@query("S03_nested_session_files", NESTED)
def _(t: Tables):
    return files.read_nested(t.spark, t.nested_files()).select(
        F.col("message").cast("long").alias("id"), "session_id", "eventid",
        micros(parse_utc(F.col("timestamp"))).alias("ts"), "src_ip", "username", "password",
        "geo_country", "geo_city", "geo_loc_lat", "source")


@query("S03_unlisted_fields", """
SELECT id, id AS relay_number, sensor_id AS relay_sensor FROM raw_logs WHERE session_id IS NOT NULL""")
def _(t: Tables):
    return files.read_nested(t.spark, t.nested_files()).select(
        F.col("message").cast("long").alias("id"), F.get_json_object("rest", "$.relay.number").cast("long").alias("relay_number"),
        F.get_json_object("rest", "$.relay.sensor").alias("relay_sensor"))


@query("S04_nested_with_cap", "SELECT least(500, count(*)) AS events FROM raw_logs WHERE session_id IS NOT NULL")
def _(t: Tables):
    # The cap is the feature here: a load of at most so many events.
    return files.read_nested(t.spark, t.nested_files(), max_events=500).agg(F.count("*").alias("events"))


@query("S05_dataset_folder", """
SELECT 'events' AS dataset, count(*) AS events, count(DISTINCT session_id) AS sessions
FROM raw_logs WHERE session_id IS NOT NULL""")
def _(t: Tables):
    folder = t.nested_files()
    listed = files.read_datasets(t.spark, folder, pattern="*.txt")
    # Part files of one writer form one dataset here.
    name = F.when(F.col("dataset").startswith("part-"), "events").otherwise(F.col("dataset"))
    return listed.groupBy(name.alias("dataset")).agg(
        F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"))


@query("S06_second_source", """
SELECT source, count(*) AS events, count(session_id) AS with_session FROM (
  SELECT 'backend' AS source, session_id FROM raw_logs
  UNION ALL SELECT 'other', session_id FROM raw_logs WHERE session_id IS NOT NULL) GROUP BY source""")
def _(t: Tables):
    other = files.with_source(files.read_nested(t.spark, t.nested_files()), "other")
    return files.unite(t.flat, other).groupBy("source").agg(
        F.count("*").alias("events"), F.count("session_id").alias("with_session"))


@query("S07_newest_logs", """
SELECT id, src_ip, event_type, session_id FROM raw_logs ORDER BY id DESC LIMIT 200""")
def _(t: Tables):
    return store.newest_first(t.raw_logs, 200).select("id", "src_ip", "event_type", "session_id")


@query("S08_flat_events", f"""
SELECT id, epoch_us(ts) AS timestamp, session_id, src_ip, sensor, eventid, protocol, username, password, input,
  '/item/' || id AS url, id::DOUBLE AS size, NULL::VARCHAR AS filename, {COUNTS}, 'backend' AS source FROM flat""", ["flat"])
def _(t: Tables):
    flat = store.flatten(t.stored).withColumn("timestamp", micros("timestamp"))
    return flat.drop("ord", "payload", *[c for c in store.PAYLOAD_FIELDS if c not in (
        "protocol", "username", "password", "input", "url", "size", "filename")])


@query("S09_flow_csv", """
SELECT source_file AS file, count(*) AS flows, round(sum(flow_duration_us), 2) AS duration, count(DISTINCT label) AS labels
FROM flows GROUP BY source_file""", ["flows"])
def _(t: Tables):
    from trapline.session import scratch_path

    path = scratch_path(t.spark, "flows")
    padded = t.flows.select(
        F.col("source_file").alias("file"), F.col("flow_duration_us").alias(" Flow Duration"),
        F.col("label").alias(" Label"))
    padded.write.option("header", True).csv(path)
    flows = files.read_flow_csv(t.spark, path, underscores=True)
    return rounded(flows.groupBy("file").agg(
        F.count("*").alias("flows"), F.sum(F.col("Flow_Duration").try_cast("double")).alias("duration"),
        F.count_distinct("Label").alias("labels")), 2)


@query("S10_reduced_events", """
SELECT event_type, count(*) AS n, count(timestamp) AS timed, count(*) FILTER (WHERE source_ip = 'unknown') AS unknown_sources
FROM (SELECT timestamp, CASE WHEN service = 'ssh' THEN event_type ELSE 'unknown' END AS event_type,
             CASE WHEN service = 'ssh' THEN coalesce(source_ip, 'unknown') ELSE 'unknown' END AS source_ip
      FROM lines WHERE NOT broken) GROUP BY event_type""", ["lines"])
def _(t: Tables):
    return files.reduced(t.sensor_lines).groupBy("event_type").agg(
        F.count("*").alias("n"), F.count("timestamp").alias("timed"),
        F.count_if(F.col("source_ip") == "unknown").alias("unknown_sources"))


@query("S11_table_sinks", """
SELECT f AS format, count(*) AS events, count(session_id) AS with_session, min(strftime(ts, '%Y-%m-%d %H:%M:%S.%f')) AS first_time
FROM flat CROSS JOIN (SELECT unnest(['parquet', 'csv', 'json']) AS f) GROUP BY f""", ["flat"])
def _(t: Tables):
    from trapline.session import scratch_path

    events = t.flat.select("id", "timestamp", "session_id", "eventid")
    back = []
    for fmt in ("parquet", "csv", "json"):
        path = sinks.write_table(events, scratch_path(t.spark, f"sink-{fmt}"), fmt)
        df = t.spark.read.option("header", True).schema(events.schema).format(fmt).load(path)
        back.append(df.withColumn("format", F.lit(fmt)))
    return files.unite(*back).groupBy("format").agg(
        F.count("*").alias("events"), F.count("session_id").alias("with_session"),
        F.date_format(F.min("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first_time"))


# --- normalisation ----------------------------------------------------------
@query("N01_canonical_events", """
SELECT id, timestamp, event_time, src_ip, event_type, sensor_id, username FROM canon""", ["canon"])
def _(t: Tables):
    valid, _rejected = normalize.split_valid(t.ingest)
    return normalize.canonical(valid).select(
        "id", "timestamp", micros("event_time").alias("event_time"), "src_ip", "event_type", "sensor_id",
        F.try_element_at("payload", F.lit("username")).alias("username"))


@query("N02_session_key", "SELECT id, session_id FROM canon", ["canon"])
def _(t: Tables):
    valid, _rejected = normalize.split_valid(t.ingest)
    return normalize.canonical(valid).select("id", "session_id")


@query("N03_resolved_service", "SELECT id, service FROM canon", ["canon"])
def _(t: Tables):
    valid, _rejected = normalize.split_valid(t.ingest)
    return normalize.canonical(valid).select("id", "service")


AS_OF = """
SELECT c.id, c.service, CASE WHEN c.service IS NULL THEN 1 ELSE coalesce(
  (SELECT arg_max(h.cnt, h.updated_at) FROM state_history h
   WHERE h.honeypot_type = c.service AND epoch_us(h.updated_at) <= c.event_time), 0) END::INT AS active_honeypot_count
FROM canon c"""


@query("N04_active_count", AS_OF, ["canon", "state_history"])
def _(t: Tables):
    valid, _rejected = normalize.split_valid(t.ingest)
    events = normalize.canonical(valid)
    return lookup.active_count(events, t.state_history).select("id", "service", "active_honeypot_count")


def _parsed_lines(t: Tables):
    good, _bad = files.parse_lines(t.sensor_lines)
    return good


@query("N05_sensor_normalisers", """
SELECT source_ip, event_type, sensor_id, service AS honeypot_type, severity, session_id, timestamp,
  CASE WHEN service IN ('ssh', 'ftp', 'mysql') THEN username END AS username, password,
  CASE WHEN service = 'ssh' THEN input ELSE command END AS command,
  CASE WHEN service = 'mysql' THEN coalesce(query, '')[:500] END AS query,
  CASE WHEN service = 'smtp' THEN length(body[:300]) END AS body_chars,
  CASE WHEN service = 'redis' THEN 10 END AS args
FROM kept WHERE source_ip IS NOT NULL""", ["kept"])
def _(t: Tables):
    events = normalize.normalise_sensor_lines(_parsed_lines(t), query_chars=500, body_chars=300, max_args=10)

    def field(name):
        return F.try_element_at("data", F.lit(name))

    return events.select(
        "source_ip", "event_type", "sensor_id", "honeypot_type", "severity", "session_id", "timestamp",
        *[field(f).alias(f) for f in ("username", "password", "command", "query")],
        F.length(field("body_preview")).alias("body_chars"),
        F.json_array_length(field("args")).alias("args"))


@query("N06_core_columns", f"""
SELECT {', '.join(f"count({c}) AS {c}" if c in ('session_id', 'src_ip', 'protocol', 'username', 'password', 'input')
                  else f"count(*) AS {c}" if c in ('eventid', 'timestamp', 'sensor') else f"0 AS {c}"
                  for c in CORE_COLUMNS)} FROM raw_logs""")
def _(t: Tables):
    full = normalize.ensure_core_columns(t.flat)
    return full.agg(*[F.count(c).alias(c) for c in CORE_COLUMNS])


@query("N07_type_coercion", """
SELECT id, CASE WHEN timestamp <> 'not-a-timestamp' THEN epoch_us(ts) END AS timestamp,
  CASE WHEN id % 7 <> 0 THEN (id % 65536)::DOUBLE END AS dst_port,
  CASE WHEN id % 6 <> 0 THEN (id % 50) / 2 END AS duration FROM ingest""", ["ingest"])
def _(t: Tables):
    k = F.col("id")
    text = t.ingest.select(
        "id", "timestamp",
        F.when(k % 7 == 0, "n/a").otherwise((k % 65536).cast("string")).alias("dst_port"),
        F.when(k % 6 == 0, "").otherwise((k % 50 / 2).cast("string")).alias("duration"))
    return normalize.coerce_types(text).withColumn("timestamp", micros("timestamp"))


@query("N08_protocol_fallback", """
SELECT 'some' AS has, protocol, count(*) AS n FROM raw_logs GROUP BY protocol
UNION ALL SELECT 'none', honeypot_type, count(*) FROM raw_logs GROUP BY honeypot_type""")
def _(t: Tables):
    tagged = t.raw_logs.select("protocol", F.col("honeypot_type").alias("system_transport"))
    bare = tagged.withColumn("protocol", F.lit(None).cast("string"))

    def counted(df, name):
        return (normalize.protocol_fallback(df).groupBy("protocol").agg(F.count("*").alias("n"))
                .withColumn("has", F.lit(name)))

    return counted(tagged, "some").unionByName(counted(bare, "none"))


@query("N09_command_from_input", """
SELECT id, input AS by_input, coalesce(username, input) AS by_coalesce FROM raw_logs""")
def _(t: Tables):
    # The user name stands in for a command that the sensor sent itself.
    events = t.raw_logs.withColumn("command", F.col("username"))
    both = normalize.with_command(
        normalize.with_command(events, "coalesce").withColumnRenamed("command", "by_coalesce"))
    return both.select("id", F.col("command").alias("by_input"), "by_coalesce")


def _flag_query(name: str, sql: dict[str, str]):
    @query(name, "SELECT id, " + ", ".join(f"({cond})::INT AS {n}" for n, cond in sql.items()) + " FROM flat", ["flat"])
    def _(t: Tables):
        flags = normalize.event_flags()
        return t.flat.selectExpr("id", *[f"{flags[n]} AS {n}" for n in sql])


_flag_query("N10_event_flags", {
    "is_command_input": "eventid = 'cowrie.command.input'", "is_command_failed": "eventid = 'cowrie.command.failed'",
    "is_login_success": "eventid = 'cowrie.login.success'", "is_login_failed": "eventid = 'cowrie.login.failed'",
    "is_session_closed": "eventid = 'cowrie.session.closed'", "is_log_closed": "eventid = 'cowrie.log.closed'",
    "is_file_download": "eventid = 'cowrie.session.file_download'",
    "is_file_upload": "eventid = 'cowrie.session.file_upload'"})
_flag_query("N11_service_flags", {
    "is_ssh": "eventid LIKE 'cowrie.%'", "is_http": "eventid LIKE 'http.%'", "is_mysql": "eventid LIKE 'mysql.%'",
    "is_redis": "eventid LIKE 'redis.%'", "is_ftp": "eventid LIKE 'ftp.%'", "is_smtp": "eventid LIKE 'smtp.%'"})
_flag_query("N12_service_event_flags", {
    "is_http_login_attempt": "eventid = 'http.login.attempt'", "is_http_page_visit": "eventid = 'http.page.visit'",
    "is_mysql_query": "eventid = 'mysql.query'", "is_redis_command": "eventid = 'redis.command'",
    "is_ftp_connect": "eventid = 'ftp.session.connect'", "is_ftp_disconnect": "eventid = 'ftp.session.disconnect'",
    "is_smtp_ehlo": "eventid = 'smtp.ehlo'", "is_smtp_connect": "eventid = 'smtp.session.connect'",
    "is_client_version": "eventid = 'cowrie.client.version'", "is_client_kex": "eventid = 'cowrie.client.kex'"})


@query("N13_ingest_validation", """
SELECT coalesce(CASE WHEN timestamp IS NULL THEN 'missing timestamp' WHEN source_ip IS NULL THEN 'missing source_ip'
  WHEN timestamp = 'not-a-timestamp' THEN 'bad timestamp' END, 'valid') AS outcome, count(*) AS n, sum(id)::BIGINT AS ids
FROM ingest GROUP BY 1""", ["ingest"])
def _(t: Tables):
    valid, rejected = normalize.split_valid(t.ingest)
    both = files.unite(valid.withColumn("reject_reason", F.lit("valid")), rejected)
    return both.groupBy(F.col("reject_reason").alias("outcome")).agg(
        F.count("*").alias("n"), F.sum("id").alias("ids"))


view("classed", """
SELECT *, coalesce(
  CASE WHEN regexp_matches(s, 'ssh|cowrie|telnet', 'i') THEN 'SSH' WHEN regexp_matches(s, 'http|\\bweb\\b', 'i') THEN 'HTTP'
       WHEN s ILIKE '%redis%' THEN 'Redis' WHEN s ILIKE '%mysql%' THEN 'MySQL' WHEN s ILIKE '%ftp%' THEN 'FTP'
       WHEN s ILIKE '%smtp%' THEN 'SMTP' END,
  CASE WHEN regexp_matches(p, 'ssh|cowrie|telnet', 'i') THEN 'SSH' WHEN regexp_matches(p, 'http|\\bweb\\b', 'i') THEN 'HTTP' END,
  CASE split_part(event_type, '.', 1) WHEN 'cowrie' THEN 'SSH' WHEN 'http' THEN 'HTTP' WHEN 'redis' THEN 'Redis'
    WHEN 'mysql' THEN 'MySQL' WHEN 'ftp' THEN 'FTP' WHEN 'smtp' THEN 'SMTP' END, 'Other') AS label
FROM (SELECT *, CASE id % 6 WHEN 0 THEN sensor_id WHEN 1 THEN 'my web box' WHEN 2 THEN 'Telnet-1' WHEN 3 THEN 'sftp-9'
                     WHEN 4 THEN NULL ELSE 'webserver' END AS s, protocol AS p FROM raw_logs)""", "raw_logs")


@query("N14_display_service", "SELECT id, label FROM classed", ["classed"])
def _(t: Tables):
    k = F.col("id") % 6
    sensor = (F.when(k == 0, F.col("sensor_id")).when(k == 1, "my web box").when(k == 2, "Telnet-1")
              .when(k == 3, "sftp-9").when(k == 5, "webserver"))
    return t.raw_logs.select(
        "id", classify.display_service(sensor, F.col("protocol"), F.col("event_type")).alias("label"))


@query("N15_forwarder_severity", """
SELECT service, severity, count(*) AS n FROM kept GROUP BY service, severity""", ["kept"])
def _(t: Tables):
    lines = _parsed_lines(t)
    kept = lines.filter(normalize.keep_sensor_line(F.col("service")))
    severity = classify.forwarder_severity(F.coalesce("eventid", "event_type"))
    return kept.groupBy("service", severity.alias("severity")).agg(F.count("*").alias("n"))


@query("N16_sensor_severity", """
SELECT event_type, CASE
  WHEN event_type IN ('http.login.attempt', 'ftp.login.success', 'ftp.file.download', 'ftp.file.upload', 'mysql.login.success',
    'mysql.query', 'smtp.login.attempt', 'smtp.message.received', 'redis.rce.attempt', 'redis.slaveof.attempt',
    'redis.replicaof.attempt') THEN 'high'
  WHEN event_type IN ('http.admin.probe', 'http.file.probe', 'ftp.login.failed', 'mysql.login.attempt', 'smtp.relay.attempt',
    'redis.auth.attempt', 'redis.flush.attempt', 'redis.debug.attempt') THEN 'medium' ELSE 'low' END AS severity,
  count(*) AS n FROM raw_logs GROUP BY 1, 2""")
def _(t: Tables):
    return t.raw_logs.groupBy(
        "event_type", classify.sensor_severity(F.col("event_type")).alias("severity")
    ).agg(F.count("*").alias("n"))


MAP_SEVERITY = """CASE
  WHEN contains(event_type, 'login.success') OR contains(event_type, 'command') OR contains(event_type, 'upload') THEN 'high'
  WHEN contains(event_type, 'login.failed') OR contains(event_type, 'login.attempt') OR contains(event_type, 'auth') THEN 'med'
  ELSE 'low' END"""


@query("N17_map_severity", f"SELECT event_type, {MAP_SEVERITY} AS severity, count(*) AS n FROM raw_logs GROUP BY 1, 2")
def _(t: Tables):
    return t.raw_logs.groupBy(
        "event_type", classify.map_severity(F.col("event_type")).alias("severity")
    ).agg(F.count("*").alias("n"))


@query("N18_command_text", """
SELECT id, coalesce(nullif(trim(password), ''), nullif(trim(input), ''), username || ', ' || coalesce(session_id, '—')) AS cmd FROM raw_logs""")
def _(t: Tables):
    # A password that may be blank stands in for the first candidate, a list of two columns for the last.
    pair = F.when(F.col("username").isNotNull(), F.array("username", "session_id"))
    logs = t.raw_logs.withColumn("command", F.col("password")).withColumn("commands", pair)
    return logs.select("id", analytics.log_command(logs).alias("cmd"))


@query("N19_volume_band", """
SELECT src_ip, CASE WHEN count(*) >= 100 THEN '100+' WHEN count(*) >= 20 THEN '20-99' WHEN count(*) >= 5 THEN '5-19'
  ELSE '1-4' END AS band FROM raw_logs GROUP BY src_ip""")
def _(t: Tables):
    counts = t.raw_logs.groupBy("src_ip").agg(F.count("*").alias("n"))
    return counts.select("src_ip", classify.volume_band(F.col("n")).alias("band"))


# --- filters ----------------------------------------------------------------
@query("F01_keep_list", """
SELECT service, event_type, count(*) AS n FROM kept WHERE service <> 'redis' GROUP BY 1, 2""", ["kept"])
def _(t: Tables):
    lines = _parsed_lines(t).filter("service <> 'redis'")
    kept = lines.filter(normalize.keep_sensor_line(F.col("service")))
    return kept.groupBy("service", F.coalesce("eventid", "event_type").alias("event_type")).agg(
        F.count("*").alias("n"))


@query("F02_cache_noise", """
SELECT event_type, upper(command) AS command, count(*) AS n FROM kept WHERE service = 'redis' GROUP BY 1, 2""", ["kept"])
def _(t: Tables):
    lines = _parsed_lines(t).filter("service = 'redis'")
    kept = lines.filter(normalize.keep_sensor_line(F.col("service")))
    return kept.groupBy("event_type", F.upper("command").alias("command")).agg(F.count("*").alias("n"))


@query("F03_control_characters", """
SELECT doc_id, round(length(regexp_replace(text, '[^\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')) / length(text), 6) AS share,
  length(regexp_replace(text, '[^\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')) / length(text) < 0.15 AS clean
FROM documents WHERE length(text) > 0""", [])
def _(t: Tables):
    shares = t.read("documents").filter(F.length("text") > 0).select("doc_id", control_share(F.col("text")).alias("share"))
    return rounded(shares.select("doc_id", "share", (F.col("share") < normalize.BINARY_SHARE).alias("clean")))


@query("F04_time_and_source", "SELECT count(*) AS n, count(DISTINCT source_ip) AS sources FROM kept WHERE source_ip <> ''", ["kept"])
def _(t: Tables):
    return normalize.normalise_sensor_lines(_parsed_lines(t)).agg(
        F.count("*").alias("n"), F.count_distinct("source_ip").alias("sources"))


@query("F05_session_and_time", """
SELECT count(*) FILTER (WHERE session_id IS NOT NULL) AS with_session,
  count(*) FILTER (WHERE timestamp IS NOT NULL AND timestamp <> 'not-a-timestamp') AS with_time FROM ingest""", ["ingest"])
def _(t: Tables):
    events = normalize.coerce_types(t.ingest)
    with_session = filters.has_session(events).agg(F.count("*").alias("n")).scalar()
    return filters.has_timestamp(events).agg(
        with_session.alias("with_session"), F.count("*").alias("with_time"))


@query("F07_public_sources", "SELECT id, src_ip FROM raw_logs WHERE src_ip NOT LIKE '10.%'")
def _(t: Tables):
    return filters.public_sources(t.raw_logs).select("id", "src_ip")


@query("F08_log_search", """
SELECT id, src_ip, event_type, session_id FROM raw_logs
WHERE contains(src_ip, '203.0.0.1') AND contains(event_type, 'login') AND contains(session_id, '-2')""")
def _(t: Tables):
    return filters.search_logs(t.raw_logs, "203.0.0.1", " login ", "-2").select(
        "id", "src_ip", "event_type", "session_id")


@query("F10_session_detail", """
SELECT id, src_ip, event_type FROM raw_logs WHERE session_id = 's7-2'""")
def _(t: Tables):
    return filters.session_events(t.raw_logs, "s7-2").select("id", "src_ip", "event_type")


@query("F16_last_day", """
SELECT id FROM raw_logs WHERE created_at >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 24 HOUR""")
def _(t: Tables):
    asof = F.lit("2024-01-30 00:00:00").cast("timestamp")
    return filters.last_hours(t.raw_logs, asof).select("id")


# --- text and time functions -------------------------------------------------
@query("X15_label_cleanup", """
SELECT DISTINCT replace(replace('Web  Attack � ' || label, '�', '-'), '  ', ' ') AS label FROM flows""", ["flows"])
def _(t: Tables):
    return t.flows.select(
        clean_label(F.concat(F.lit("Web  Attack � "), F.col("label"))).alias("label")).distinct()


@query("X16_utc_parse", """
SELECT id, CASE WHEN timestamp <> 'not-a-timestamp' THEN epoch_us(ts) END AS with_zone, epoch_us(ts) AS naive
FROM ingest""", ["ingest"])
def _(t: Tables):
    naive = t.raw_logs.select("id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("naive"))
    return t.ingest.join(naive, "id").select(
        "id", micros(parse_utc(F.col("timestamp"))).alias("with_zone"),
        micros(parse_utc(F.col("naive"))).alias("naive"))


@query("X17_age_text", """
SELECT id, CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago'
  ELSE floor((s // 3600) / 24 + 0.5)::BIGINT || 'd ago' END AS age
FROM (SELECT id, floor((epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(created_at)) / 1e6)::BIGINT AS s FROM raw_logs)""")
def _(t: Tables):
    asof = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return t.raw_logs.select("id", age_text(F.col("created_at"), asof).alias("age"))
