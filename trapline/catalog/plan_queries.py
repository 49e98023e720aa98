"""Attacker profiles and placement plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from trapline.catalog.registry import micros, query, rounded, view
from trapline.fixtures import Tables
from trapline.operators import analytics, features, lookup, normalize, sessions
from trapline.plans import deploy, profiles
from trapline.schema import PLAN_SERVICES, SERVICES
from trapline.session import materialise
from trapline.sources import sinks, store
from trapline.streaming.ingest import ingest_lines

view("feat0", """
SELECT * EXCLUDE (ftp_connects, ftp_disconnects, smtp_connects, smtp_ehlo_count), 0 AS ftp_connects, 0 AS ftp_disconnects,
  0 AS smtp_connects, 0 AS smtp_ehlo_count, false AS is_anomaly FROM feat_all""", "feat_all")
# Long sessions stand in for anomalies, so that the rules about them fire.
view("feat1", "SELECT *, event_count >= 9 AS is_anomaly FROM feat_all", "feat_all")

SCORES = """
SELECT session_id, session_start, ssh_honeypot_count, http_honeypot_count, mysql_honeypot_count,
  redis_honeypot_count, ftp_honeypot_count, smtp_honeypot_count,
  round_even((least(login_fail / 20, 1) + least(unique_pass / 20, 1) + least(fails_per_min / 20, 1)) / 3.0::DOUBLE, 3) AS c1,
  round_even((least(unique_users / 10, 1) + least(unique_pass / 10, 1) + least(login_fail / 20, 1)) / 3.0::DOUBLE, 3) AS c2,
  round_even((least(cmd_count / 10, 1) + least(unique_cmds / 5, 1) + least(duration / 300, 1) + least(login_success, 1)
    + CASE WHEN is_anomaly AND (cmd_count > 0 OR login_success > 0) THEN 0.25 ELSE 0 END::DOUBLE)
    / (4 + CASE WHEN is_anomaly AND (cmd_count > 0 OR login_success > 0) THEN 0.25 ELSE 0 END::DOUBLE), 3) AS c3,
  round_even((least(services_touched / 4, 1) + least(event_count / 20, 1) + contains_recon_cmds + contains_network_terms * 0.5::DOUBLE
    + contains_nav_cmds * 0.25::DOUBLE) / (2.0::DOUBLE + contains_recon_cmds + contains_network_terms * 0.5::DOUBLE
    + contains_nav_cmds * 0.25::DOUBLE), 3) AS c4,
  round_even((least(http_events / 10, 1) + least(http_page_visits / 10, 1) + least(http_login_attempts / 10, 1)) / 3.0::DOUBLE, 3) AS c5,
  round_even((least(downloads, 1) + least(download_ratio, 1) + contains_install_cmds
    + CASE WHEN contains_exec_terms = 1 AND downloads > 0 THEN 0.5 ELSE 0 END::DOUBLE)
    / (2.0::DOUBLE + contains_install_cmds + CASE WHEN contains_exec_terms = 1 AND downloads > 0 THEN 0.5 ELSE 0 END::DOUBLE), 3) AS c6,
  round_even((least(uploads, 1) + least(upload_ratio, 1) + least(file_transfer_ratio / 0.5::DOUBLE, 1) * 0.5::DOUBLE) / 2.5::DOUBLE, 3) AS c7,
  round_even((least(ftp_events / 5, 1) + least(ftp_ratio, 1) + least(ftp_connects / 5, 1)
    + CASE WHEN ftp_connects > 0 AND ftp_disconnects > 0 THEN least(ftp_connects / greatest(ftp_disconnects, 1) / 5, 1) * 0.5::DOUBLE ELSE 0 END)
    / (3.0::DOUBLE + CASE WHEN ftp_connects > 0 AND ftp_disconnects > 0 THEN 0.5 ELSE 0 END::DOUBLE), 3) AS c8,
  round_even((least(smtp_events / 5, 1) + least(smtp_ratio, 1) + least(smtp_connects / 5, 1) + least(smtp_ehlo_count / 5, 1)) / 4.0::DOUBLE, 3) AS c9,
  round_even(least(mysql_events / 5, 1)::DOUBLE, 3) AS c10,
  round_even((least(mysql_queries / 10, 1) + CASE WHEN is_anomaly AND mysql_queries > 0 THEN 0.5 ELSE 0 END::DOUBLE)
    / (1.0::DOUBLE + CASE WHEN is_anomaly AND mysql_queries > 0 THEN 0.5 ELSE 0 END::DOUBLE), 3) AS c11,
  round_even((least(redis_events / 5, 1) + least(redis_commands / 10, 1) + least(redis_ratio, 1)
    + CASE WHEN is_anomaly AND redis_commands > 0 THEN 0.5 ELSE 0 END::DOUBLE)
    / (3.0::DOUBLE + CASE WHEN is_anomaly AND redis_commands > 0 THEN 0.5 ELSE 0 END::DOUBLE), 3) AS c12,
  coalesce(round_even((CASE WHEN event_count >= 10 THEN least(events_per_min / 100, 1) ELSE 0 END
    + CASE WHEN cmd_count >= 5 THEN least(cmds_per_min / 20, 1) ELSE 0 END)::DOUBLE
    / nullif((event_count >= 10)::INT + (cmd_count >= 5)::INT, 0), 3), 0) AS c13,
  coalesce(round_even((CASE WHEN ssh_events > 0 THEN least(ssh_ratio, 1) ELSE 0 END
    + CASE WHEN ssh_events > 0 AND cmd_count = 0 AND login_success > 0 THEN 0.75 ELSE 0 END::DOUBLE
    + CASE WHEN ssh_events > 0 AND cmd_count = 0 AND event_count <= 5 THEN 0.5 ELSE 0 END::DOUBLE
    + CASE WHEN ssh_events > 0 AND cmd_count = 0 AND unique_event_types <= 4 THEN 0.25 ELSE 0 END::DOUBLE)
    / nullif((ssh_events > 0)::INT + CASE WHEN ssh_events > 0 AND cmd_count = 0 AND login_success > 0 THEN 0.75 ELSE 0 END::DOUBLE
      + CASE WHEN ssh_events > 0 AND cmd_count = 0 AND event_count <= 5 THEN 0.5 ELSE 0 END::DOUBLE
      + CASE WHEN ssh_events > 0 AND cmd_count = 0 AND unique_event_types <= 4 THEN 0.25 ELSE 0 END::DOUBLE, 0), 3), 0) AS c14,
  login_fail, unique_pass, fails_per_min, unique_users, cmd_count, unique_cmds, duration, login_success, is_anomaly,
  services_touched, event_count, contains_recon_cmds, contains_network_terms, contains_nav_cmds, http_events,
  http_page_visits, http_login_attempts, downloads, contains_install_cmds, contains_exec_terms, uploads, ftp_events,
  ftp_connects, ftp_disconnects, smtp_events, smtp_connects, smtp_ehlo_count, mysql_events, mysql_queries,
  redis_events, redis_commands, events_per_min, cmds_per_min, ssh_events, unique_event_types
FROM """
view("scores0", SCORES + "feat0", "feat0")
view("scores1", SCORES + "feat1", "feat1")

CONF = ", ".join(f"c{i}" for i in range(1, 15))
LABELS = """
SELECT *, CASE best WHEN c1 THEN 'Brute Force Attack' WHEN c2 THEN 'Credential Stuffing' WHEN c3 THEN 'Interactive Attacker'
    WHEN c4 THEN 'Recon Scanner' WHEN c5 THEN 'Web Scanner' WHEN c6 THEN 'Malware Downloader' WHEN c7 THEN 'File Exfiltration'
    WHEN c8 THEN 'FTP Abuse' WHEN c9 THEN 'Email Abuse' WHEN c10 THEN 'Database Recon' WHEN c11 THEN 'Database Attack'
    WHEN c12 THEN 'Redis Attack' WHEN c13 THEN 'Automated Bot' ELSE 'Low-Interaction SSH Probe' END AS profile,
  best AS profile_confidence
FROM (SELECT *, greatest({conf}) AS best FROM {scores})"""
view("labels0", LABELS.format(conf=CONF, scores="scores0"), "scores0")
view("labels1", LABELS.format(conf=CONF, scores="scores1"), "scores1")


def labelled(t: Tables, rich: bool = False):
    table = sessions.sessions(t.flat)
    if not rich:
        return profiles.label_profiles(features.feature_table(table))
    return profiles.label_profiles(
        features.feature_table(table, carry_all=True).withColumn("is_anomaly", F.col("event_count") >= 9))


def _scores(name: str, which: int):
    @query(name, f"SELECT session_id, {CONF} FROM scores{which}", [f"scores{which}"])
    def _(t: Tables):
        table = labelled(t, rich=bool(which))
        return table.select("session_id", *[
            F.element_at("profile_scores", F.lit(p)).alias(f"c{i}")
            for i, p in enumerate(profiles.PROFILES, 1)])


_scores("D01_profile_scores", 0)
_scores("D01_profile_scores_all_rules", 1)

REASONS = """list_filter(CASE profile
  WHEN 'Brute Force Attack' THEN [CASE WHEN login_fail > 0 THEN 'Many failed logins' END, CASE WHEN unique_pass > 0 THEN 'Many unique passwords' END,
    CASE WHEN fails_per_min > 0 THEN 'High failed-login rate' END]
  WHEN 'Credential Stuffing' THEN [CASE WHEN unique_users > 0 THEN 'Many unique usernames' END, CASE WHEN unique_pass > 0 THEN 'Many unique passwords' END,
    CASE WHEN login_fail > 0 THEN 'Repeated failed logins' END]
  WHEN 'Interactive Attacker' THEN [CASE WHEN cmd_count > 0 THEN 'High command activity' END, CASE WHEN unique_cmds > 0 THEN 'Multiple unique commands' END,
    CASE WHEN duration > 0 THEN 'Longer session duration' END, CASE WHEN login_success > 0 THEN 'Successful authentication' END,
    CASE WHEN is_anomaly AND (cmd_count > 0 OR login_success > 0) THEN 'Anomalous interactive session' END]
  WHEN 'Recon Scanner' THEN [CASE WHEN services_touched > 0 THEN 'Multiple services touched' END, CASE WHEN event_count > 0 THEN 'Elevated event count' END,
    CASE WHEN contains_recon_cmds = 1 THEN 'Recon command observed' END, CASE WHEN contains_network_terms = 1 THEN 'Network probing command observed' END,
    CASE WHEN contains_nav_cmds = 1 THEN 'Filesystem navigation command observed' END]
  WHEN 'Web Scanner' THEN [CASE WHEN http_events > 0 THEN 'HTTP activity' END, CASE WHEN http_page_visits > 0 THEN 'HTTP page visits' END,
    CASE WHEN http_login_attempts > 0 THEN 'HTTP login attempts' END]
  WHEN 'Malware Downloader' THEN [CASE WHEN downloads > 0 THEN 'File download observed' END, CASE WHEN downloads > 0 THEN 'Download-heavy session' END,
    CASE WHEN contains_install_cmds = 1 THEN 'Install/download command observed' END,
    CASE WHEN contains_exec_terms = 1 AND downloads > 0 THEN 'Downloaded file may have been executed' END]
  WHEN 'File Exfiltration' THEN [CASE WHEN uploads > 0 THEN 'File upload observed' END, CASE WHEN uploads > 0 THEN 'Upload-heavy session' END,
    CASE WHEN downloads + uploads > 0 THEN 'High file-transfer share' END]
  WHEN 'FTP Abuse' THEN [CASE WHEN ftp_events > 0 THEN 'FTP activity' END, CASE WHEN ftp_events > 0 THEN 'FTP-dominant session' END,
    CASE WHEN ftp_connects > 0 THEN 'FTP connection attempts' END, CASE WHEN ftp_connects > 0 AND ftp_disconnects > 0 THEN 'High FTP connection churn' END]
  WHEN 'Email Abuse' THEN [CASE WHEN smtp_events > 0 THEN 'SMTP activity' END, CASE WHEN smtp_events > 0 THEN 'SMTP-dominant session' END,
    CASE WHEN smtp_connects > 0 THEN 'SMTP connection attempts' END, CASE WHEN smtp_ehlo_count > 0 THEN 'SMTP EHLO probing' END]
  WHEN 'Database Recon' THEN [CASE WHEN mysql_events > 0 THEN 'MySQL activity' END]
  WHEN 'Database Attack' THEN [CASE WHEN mysql_queries > 0 THEN 'MySQL queries' END, CASE WHEN is_anomaly AND mysql_queries > 0 THEN 'Anomalous MySQL activity' END]
  WHEN 'Redis Attack' THEN [CASE WHEN redis_events > 0 THEN 'Redis activity' END, CASE WHEN redis_commands > 0 THEN 'Redis commands' END,
    CASE WHEN redis_events > 0 THEN 'Redis-dominant session' END, CASE WHEN is_anomaly AND redis_commands > 0 THEN 'Anomalous Redis activity' END]
  WHEN 'Automated Bot' THEN [CASE WHEN event_count >= 10 AND events_per_min > 0 THEN 'High event rate' END,
    CASE WHEN cmd_count >= 5 AND cmds_per_min > 0 THEN 'High command rate' END]
  ELSE [CASE WHEN ssh_events > 0 THEN 'SSH-dominant session' END,
    CASE WHEN ssh_events > 0 AND cmd_count = 0 AND login_success > 0 THEN 'Successful login without commands' END,
    CASE WHEN ssh_events > 0 AND cmd_count = 0 AND event_count <= 5 THEN 'Short low-activity session' END,
    CASE WHEN ssh_events > 0 AND cmd_count = 0 AND unique_event_types <= 4 THEN 'Few event types' END] END, lambda x: x IS NOT NULL)"""


def _labels(name: str, which: int):
    @query(name, f"""
SELECT session_id, profile, profile_confidence, round(1 - profile_confidence, 3) AS unknown,
  coalesce(nullif(array_to_string(({REASONS})[:3], '|'), ''), 'Low-confidence evidence') AS reasons
FROM labels{which}""", [f"labels{which}"])
    def _(t: Tables):
        return labelled(t, rich=bool(which)).select(
            "session_id", "profile", "profile_confidence",
            F.round(F.element_at("profile_scores", F.lit("Unknown")), 3).alias("unknown"),
            F.array_join("profile_reasons", "|").alias("reasons"))


_labels("D02_session_profiles", 0)
_labels("D02_session_profiles_all_rules", 1)


@query("W02_top_profile", f"SELECT session_id, greatest({CONF}) AS top FROM scores1", ["scores1"])
def _(t: Tables):
    table = sessions.sessions(t.flat)
    rich = features.feature_table(table, carry_all=True).withColumn("is_anomaly", F.col("event_count") >= 9)
    return profiles.score_profiles(rich).select(
        "session_id", F.array_max("evidence")["confidence"].alias("top"))


@query("A14_profile_frequency", "SELECT profile, count(*) AS n FROM labels0 GROUP BY profile", ["labels0"])
def _(t: Tables):
    return analytics.frequency(labelled(t), "profile")


@query("A20_mean_confidence", """
SELECT profile, round(avg(profile_confidence), 6) AS mean_confidence FROM labels0 GROUP BY profile""", ["labels0"])
def _(t: Tables):
    return rounded(labelled(t).groupBy("profile").agg(F.avg("profile_confidence").alias("mean_confidence")))


@query("F11_trusted_sessions", """
SELECT session_id, profile FROM labels0 WHERE profile_confidence >= 0.30""", ["labels0"])
def _(t: Tables):
    return deploy.trusted(labelled(t)).select("session_id", "profile")


SERVICE_OF = """CASE profile WHEN 'Web Scanner' THEN 'http' WHEN 'FTP Abuse' THEN 'ftp' WHEN 'Email Abuse' THEN 'smtp'
  WHEN 'Database Recon' THEN 'mysql' WHEN 'Database Attack' THEN 'mysql' WHEN 'Redis Attack' THEN 'redis' ELSE 'ssh' END"""


@query("F12_mapped_profiles", "SELECT count(*) AS n, count(DISTINCT profile) AS profiles FROM labels0", ["labels0"])
def _(t: Tables):
    mapped = deploy.profile_services(labelled(t).withColumn(
        "profile", F.when(F.col("profile_confidence") >= 0, F.col("profile")).otherwise("none")))
    return mapped.agg(F.count("*").alias("n"), F.count_distinct("profile").alias("profiles"))


@query("J05_profile_services", f"SELECT session_id, profile, {SERVICE_OF} AS service FROM labels0", ["labels0"])
def _(t: Tables):
    return deploy.profile_services(labelled(t)).select("session_id", "profile", "service")


# --- plans -------------------------------------------------------------------
view("planned", """
SELECT *, concat('p', CAST(floor((day(session_start) - 1) / 3) AS INT)) AS plan_id FROM labels0""", "labels0")
view("picked", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY session_start DESC NULLS FIRST, session_id) AS rn
               FROM planned) WHERE rn <= 100""", "planned")
view("long_counts", f"""
SELECT h.plan_id, s.service, s.pos, s.api_pos, h.total_sessions, h.selected_sessions, h.trusted_sessions,
  count(*) FILTER (WHERE p.profile_confidence >= 0.30 AND {SERVICE_OF} = s.service) AS raw,
  greatest(round_even(avg(CASE s.service WHEN 'ssh' THEN ssh_honeypot_count WHEN 'http' THEN http_honeypot_count
    WHEN 'mysql' THEN mysql_honeypot_count WHEN 'redis' THEN redis_honeypot_count WHEN 'ftp' THEN ftp_honeypot_count
    ELSE smtp_honeypot_count END), 0), 1)::INT AS current
FROM (SELECT plan_id, count(*) AS total_sessions, (SELECT count(*) FROM picked q WHERE q.plan_id = planned.plan_id) AS selected_sessions,
        (SELECT count(*) FROM picked q WHERE q.plan_id = planned.plan_id AND profile_confidence >= 0.30) AS trusted_sessions
      FROM planned GROUP BY plan_id) h
JOIN picked p USING (plan_id)
CROSS JOIN (VALUES ('ssh', 0, 0), ('http', 1, 1), ('mysql', 2, 3), ('redis', 3, 2), ('ftp', 4, 4), ('smtp', 5, 5)) AS s(service, pos, api_pos)
GROUP BY ALL""", "picked", "planned")
view("plan_rows", """
SELECT plan_id, service, pos, api_pos, total_sessions, selected_sessions, trusted_sessions, current, hold,
  CASE WHEN hold THEN 0 ELSE raw END AS raw, CASE WHEN hold THEN 0 ELSE raw / current END AS demand,
  CASE WHEN hold THEN 0 ELSE 1 + floor(share * 6)::INT
    + (row_number() OVER (PARTITION BY plan_id ORDER BY share * 6 - floor(share * 6) DESC, pos)
       <= 6 - sum(floor(share * 6)) OVER (PARTITION BY plan_id))::INT END AS recommended,
  CASE WHEN hold THEN 0 ELSE round_even(raw / mapped, 3) END AS distribution,
  CASE WHEN hold THEN 0 ELSE share END AS demand_share, CASE WHEN NOT hold THEN mapped END AS mapped_sessions
FROM (SELECT *, selected_sessions < 100 OR trusted_sessions = 0 AS hold, sum(raw) OVER (PARTITION BY plan_id)::BIGINT AS mapped,
        (raw / current) / list_sum(list(raw / current) OVER (PARTITION BY plan_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS share
      FROM long_counts)""", "long_counts")


def sessions_of_plans(t: Tables):
    """Labelled sessions, stored once: plans read them twice."""
    bucket = F.floor((F.dayofmonth("session_start") - 1) / 3).cast("int")
    return materialise(labelled(t).withColumn("plan_id", F.concat(F.lit("p"), bucket)), "labelled")


@query("O05_latest_sessions", "SELECT plan_id, session_id FROM picked", ["picked"])
def _(t: Tables):
    return deploy.latest_sessions(sessions_of_plans(t)).select("plan_id", "session_id")


@query("A36_current_counts", "SELECT plan_id, service, current FROM long_counts", ["long_counts"])
def _(t: Tables):
    headers = deploy.plan_headers(sessions_of_plans(t))
    names = F.array(*map(F.lit, PLAN_SERVICES))
    return headers.select("plan_id", F.inline(F.arrays_zip(names.alias("service"), "current")))


@query("D03_plan_counts", """
SELECT plan_id, service, total_sessions, selected_sessions, trusted_sessions, raw FROM long_counts""", ["long_counts"])
def _(t: Tables):
    headers = deploy.plan_headers(sessions_of_plans(t))
    names = F.array(*map(F.lit, PLAN_SERVICES))
    return headers.select("plan_id", "total_sessions", "selected_sessions", "trusted_sessions",
                          F.inline(F.arrays_zip(names.alias("service"), "raw")))


@query("D04_demand", "SELECT plan_id, service, round(raw / current, 6) AS demand FROM long_counts", ["long_counts"])
def _(t: Tables):
    headers = deploy.with_demand(deploy.plan_headers(sessions_of_plans(t)))
    names = F.array(*map(F.lit, PLAN_SERVICES))
    return rounded(headers.select("plan_id", F.inline(F.arrays_zip(names.alias("service"), "demand"))))


def _plan_rows(t: Tables):
    return deploy.plan_table(deploy.build_plans(sessions_of_plans(t)))


@query("D05_flexible_slots", """
SELECT plan_id, service, CASE WHEN hold THEN 0 ELSE recommended - 1 END AS flexible FROM plan_rows""", ["plan_rows"])
def _(t: Tables):
    rows = _plan_rows(t)
    return rows.select("plan_id", "service", F.greatest(F.col("recommended") - 1, F.lit(0)).alias("flexible"))


@query("W03_largest_remainder", """
SELECT plan_id, service, floor(w * 10)::INT + (row_number() OVER (PARTITION BY plan_id ORDER BY w * 10 - floor(w * 10) DESC, pos)
  <= 10 - sum(floor(w * 10)) OVER (PARTITION BY plan_id))::INT AS slots
FROM (SELECT plan_id, service, pos, raw / sum(raw) OVER (PARTITION BY plan_id) AS w FROM long_counts)""", ["long_counts"])
def _(t: Tables):
    headers = deploy.plan_headers(sessions_of_plans(t))
    total = F.aggregate("raw", F.lit(0).cast("bigint"), lambda a, v: a + v)
    shares = headers.withColumn("w", F.transform("raw", lambda r: r / total))
    names = F.array(*map(F.lit, PLAN_SERVICES))
    return shares.select("plan_id", F.inline(F.arrays_zip(
        names.alias("service"), deploy.largest_remainder(F.col("w"), 10).alias("slots"))))


@query("W04_demand_share", """
SELECT plan_id, service, round(demand_share, 6) AS demand_share FROM plan_rows""", ["plan_rows"])
def _(t: Tables):
    return rounded(_plan_rows(t).select("plan_id", "service", "demand_share"))


@query("D06_recommended_counts", """
SELECT plan_id, CASE WHEN hold THEN 'hold' ELSE 'recommend' END AS action, service, raw, current,
  round(demand, 6) AS demand, recommended, distribution FROM plan_rows""", ["plan_rows"])
def _(t: Tables):
    return rounded(_plan_rows(t).drop("demand_share"))


@query("D06_plan_reasons", """
SELECT plan_id, mapped_sessions, string_agg(printf('%s_honeypot: %d sessions / %d current honeypot = %.2f normalized demand ->%d honeypots',
  service, raw, current, demand, recommended), '|' ORDER BY pos) FILTER (WHERE demand > 0) AS reasons
FROM plan_rows WHERE NOT hold GROUP BY plan_id, mapped_sessions""", ["plan_rows"])
def _(t: Tables):
    plans = deploy.build_plans(sessions_of_plans(t)).filter("action = 'recommend'")
    return plans.select("plan_id", "mapped_sessions", F.array_join("reasons", "|").alias("reasons"))


@query("D07_hold_cases", """
SELECT plan_id, 'hold' AS action, least(total_sessions, 60) AS selected_sessions, 0 AS recommended,
  'Only ' || least(total_sessions, 60) || ' sessions selected; need at least 100 before scaling.' AS reason
FROM (SELECT DISTINCT plan_id, total_sessions FROM long_counts)""", ["long_counts"])
def _(t: Tables):
    # A window of 60 sessions never reaches the minimum, so every plan holds.
    plans = deploy.build_plans(sessions_of_plans(t), limit=60)
    return plans.select(
        "plan_id", "action", "selected_sessions",
        F.aggregate("recommended", F.lit(0), lambda a, v: a + v).alias("recommended"),
        F.get("reasons", F.lit(0)).alias("reason"))


view("adapted", """
SELECT plan_id, service, api_pos, CASE WHEN total > 0 THEN w / total ELSE w END AS weight FROM (
  SELECT *, sum(w) OVER (PARTITION BY plan_id) AS total FROM (
    SELECT *, CASE WHEN service = 'ftp' THEN 0 ELSE distribution::DOUBLE
      + max(CASE WHEN service = 'ftp' THEN distribution::DOUBLE END) OVER (PARTITION BY plan_id) / 5 END AS w FROM plan_rows))""",
     "plan_rows")


def _adapted(t: Tables):
    return deploy.adapt_distribution(deploy.plan_weights(deploy.build_plans(sessions_of_plans(t))))


@query("D08_adapted_weights", "SELECT plan_id, service, round(weight, 6) AS weight FROM adapted", ["adapted"])
def _(t: Tables):
    names = F.array(*map(F.lit, SERVICES))
    return rounded(_adapted(t).select("plan_id", F.inline(F.arrays_zip(
        names.alias("service"), F.col("weights").alias("weight")))))


view("targets", """
SELECT plan_id, service, 1 + floor(weight * 6)::INT
  + (row_number() OVER (PARTITION BY plan_id ORDER BY round(weight * 6 - floor(weight * 6), 9) DESC, api_pos)
     <= 6 - sum(floor(weight * 6)) OVER (PARTITION BY plan_id))::INT AS target FROM adapted""", "adapted")


@query("D09_allocation", "SELECT plan_id, service, target FROM targets", ["targets"])
def _(t: Tables):
    good, _bad = deploy.allocate(_adapted(t))
    return deploy.target_table(good).drop("replicas")


@query("D09_impossible_totals", """
SELECT plan_id, 'total is smaller than the base allocation' AS error FROM targets GROUP BY plan_id""", ["targets"])
def _(t: Tables):
    _good, bad = deploy.allocate(_adapted(t), total=5)
    return bad.select("plan_id", "error")


@query("D10_redistribution", """
SELECT plan_id, service, cnt AS current, target, target - cnt AS delta FROM targets
JOIN (SELECT honeypot_type AS service, arg_max(cnt, updated_at) AS cnt FROM state_history GROUP BY 1) USING (service)""",
       ["targets", "state_history"])
def _(t: Tables):
    good, _bad = deploy.allocate(_adapted(t))
    return deploy.redistribute(deploy.target_table(good), t.state_history)


@query("D11_replica_cap", """
SELECT plan_id, service, CASE WHEN service = 'ftp' THEN least(target, 1) ELSE target END AS replicas FROM targets""", ["targets"])
def _(t: Tables):
    good, _bad = deploy.allocate(_adapted(t))
    return deploy.target_table(good).drop("target")


# Overrides come from the state reports: every fourth is invalid in some way.
view("overrides", """
SELECT updated_at AS set_at, updated_at + INTERVAL 30 HOUR AS expires_at, bucket, CASE bucket % 4
  WHEN 0 THEN 'telnet' ELSE 'ssh' END AS first_type, CASE bucket % 4 WHEN 1 THEN -1.0 ELSE 2.0 END::DOUBLE AS first_weight
FROM (SELECT CAST(floor((day(ts) - 1) / 3) AS INT) AS bucket, min(ts) AS updated_at FROM events GROUP BY 1)""")


def _overrides(t: Tables):
    bucket = F.floor((F.dayofmonth("ts") - 1) / 3).cast("int")
    starts = t.events.groupBy(bucket.alias("bucket")).agg(F.min("ts").cast("timestamp").alias("set_at"))
    kind = F.when(F.col("bucket") % 4 == 0, "telnet").otherwise("ssh")
    weight = F.when(F.col("bucket") % 4 == 1, -1.0).otherwise(2.0)
    return starts.select(
        "bucket", "set_at", (F.col("set_at") + F.expr("interval 30 hours")).alias("expires_at"),
        F.create_map(kind, weight, F.lit("ftp"), F.lit(1.0)).alias("weights"))


@query("D12_override_validation", """
SELECT bucket, CASE bucket % 4 WHEN 0 THEN 'unknown type' WHEN 1 THEN 'negative weight' ELSE 'ok' END AS outcome FROM overrides""",
       ["overrides"])
def _(t: Tables):
    good, bad = deploy.check_overrides(_overrides(t))
    return (good.select("bucket", F.lit("ok").alias("outcome"))
            .unionByName(bad.select("bucket", F.col("reject_reason").alias("outcome"))))


view("reports", """
SELECT CASE WHEN id % 7 = 0 THEN 'telnet' ELSE honeypot_type END AS honeypot_type,
  CASE WHEN id % 5 = 0 THEN -1 ELSE active_honeypot_count END AS cnt, ts AS updated_at FROM raw_logs""", "raw_logs")


def _reports(t: Tables):
    k = F.col("id")
    return t.raw_logs.select(
        F.when(k % 7 == 0, "telnet").otherwise(F.col("honeypot_type")).alias("honeypot_type"),
        F.when(k % 5 == 0, -1).otherwise(F.col("active_honeypot_count")).alias("cnt"),
        F.col("ts").alias("updated_at"))


@query("D13_latest_state", """
SELECT honeypot_type, arg_max(cnt, updated_at) AS cnt, epoch_us(max(updated_at)) AS updated_at
FROM reports WHERE honeypot_type <> 'telnet' AND cnt >= 0 GROUP BY honeypot_type""", ["reports"])
def _(t: Tables):
    return deploy.latest_state(_reports(t)).withColumn("updated_at", micros("updated_at"))


@query("D13_rejected_reports", """
SELECT CASE WHEN honeypot_type = 'telnet' THEN 'unknown type' ELSE 'negative count' END AS reject_reason, count(*) AS n
FROM reports WHERE honeypot_type = 'telnet' OR cnt < 0 GROUP BY 1""", ["reports"])
def _(t: Tables):
    _good, bad = deploy.check_state(_reports(t))
    return bad.groupBy("reject_reason").agg(F.count("*").alias("n"))


@query("J12_effective_weights", """
SELECT epoch_us(m.moment) AS moment, m.plan_id, w.service,
  CASE WHEN o.set_at IS NOT NULL THEN 'override' WHEN a.weight IS NOT NULL THEN 'plan' ELSE 'uniform' END AS origin,
  round(CASE WHEN o.set_at IS NOT NULL THEN CASE w.service WHEN 'ftp' THEN 0.0 WHEN 'ssh' THEN 2.2 / 3 ELSE 0.2 / 3 END::DOUBLE
       ELSE coalesce(a.weight, 1 / 6) END, 6) AS weight
FROM (SELECT DISTINCT date_trunc('hour', ts) AS moment,
        CASE WHEN day(ts) <= 27 THEN concat('p', CAST(floor((day(ts) - 1) / 3) AS INT)) ELSE 'none' END AS plan_id FROM raw_logs) m
CROSS JOIN (SELECT unnest(['ssh', 'http', 'redis', 'mysql', 'ftp', 'smtp']) AS service) w
LEFT JOIN (SELECT set_at, least(expires_at, lead(set_at) OVER (ORDER BY set_at)) AS until FROM overrides
           WHERE first_type = 'ssh' AND first_weight > 0) o ON m.moment >= o.set_at AND m.moment < coalesce(o.until, m.moment + INTERVAL 1 HOUR)
LEFT JOIN adapted a ON a.plan_id = m.plan_id AND a.service = w.service""", ["adapted", "overrides", "raw_logs"])
def _(t: Tables):
    bucket = F.floor((F.dayofmonth("ts") - 1) / 3).cast("int")
    plan = F.when(F.dayofmonth("ts") <= 27, F.concat(F.lit("p"), bucket)).otherwise("none")
    moments = t.raw_logs.select(
        F.date_trunc("hour", "ts").alias("moment"), plan.alias("plan_id")).distinct()
    rows = deploy.effective_weights(moments, _adapted(t), _overrides(t).drop("bucket"))
    names = F.array(*map(F.lit, SERVICES))
    return rounded(rows.select(
        micros("moment").alias("moment"), "plan_id", "origin",
        F.inline(F.arrays_zip(names.alias("service"), F.col("weights").alias("weight")))))


# An override holds at the first moment, and has run out at the second.
REFRESHED = ["2024-01-07 12:00:00", "2024-01-08 12:00:00"]


view("refreshed", f"SELECT unnest({REFRESHED})::TIMESTAMP AS moment")
view("valid_overrides", "SELECT * FROM overrides WHERE first_type = 'ssh' AND first_weight > 0", "overrides")


@query("T10_plan_refresh", """
SELECT epoch_us(moment) AS moment, plan_id, count(*) AS total_sessions, least(count(*), 100) AS selected_sessions
FROM refreshed JOIN planned ON session_start <= moment
WHERE moment NOT IN (
  SELECT moment FROM (SELECT moment, max(set_at) AS set_at FROM refreshed JOIN valid_overrides ON set_at <= moment GROUP BY moment)
  JOIN valid_overrides USING (set_at) WHERE expires_at > moment)
GROUP BY moment, plan_id""", ["planned", "refreshed", "valid_overrides"])
def _(t: Tables):
    known, overrides = sessions_of_plans(t), _overrides(t).drop("bucket")
    first, second = (deploy.refresh_plans(known, F.lit(m).cast("timestamp"), overrides).select(
        micros("asof").alias("moment"), "plan_id", "total_sessions", "selected_sessions") for m in REFRESHED)
    return first.unionByName(second)


@query("S13_plan_sink", "SELECT plan_id, service, recommended FROM plan_rows", ["plan_rows"])
def _(t: Tables):
    from trapline.session import scratch_path

    rows = _plan_rows(t).select("plan_id", "service", "recommended")
    path = sinks.write_plans(rows, scratch_path(t.spark, "plans"))
    return t.spark.read.schema(rows.schema).json(path)


@query("S14_labelled_sessions", """
SELECT session_id, profile, epoch_us(session_start) AS session_start FROM labels0""", ["labels0"])
def _(t: Tables):
    from trapline.session import scratch_path

    rows = labelled(t).select("session_id", "profile", "session_start")
    path = sinks.write_table(rows, scratch_path(t.spark, "labelled"), "json")
    text = t.spark.read.schema("session_id string, profile string, session_start string").json(path)
    return store.labelled_sessions(text).withColumn("session_start", micros("session_start"))


@query("S08_sessions_from_sensor_lines", """
SELECT session_id, count(*) AS event_count, count(*) FILTER (WHERE event_type = 'cowrie.login.failed') AS login_fail,
  count(DISTINCT username) AS unique_users, count(command) FILTER (WHERE contains(event_type, 'command')) AS cmd_count,
  max(src_ip) AS src_ip
FROM (SELECT coalesce(nullif(session_id, ''), sha256(source_ip || ':' || event_type || ':'
          || regexp_replace(timestamp[:13], '[^0-9]', '', 'g'))) AS session_id,
        event_type, source_ip AS src_ip, CASE WHEN service IN ('ssh', 'ftp', 'mysql') THEN username END AS username,
        CASE WHEN service = 'ssh' THEN input ELSE command END AS command
      FROM kept WHERE source_ip IS NOT NULL) GROUP BY session_id""", ["kept"])
def _(t: Tables):
    events, _rejects = ingest_lines(t.sensor_lines)
    flat = store.from_canonical(lookup.active_count(events, t.state_history))
    # Forwarded commands count here, so the coalescing variant is in use.
    ready = normalize.with_command(flat, "coalesce")
    return sessions.sessions(ready, command="command").select(
        "session_id", "event_count", "login_fail", "unique_users", "cmd_count", "src_ip")
