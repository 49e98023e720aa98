from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trapline.plans import deploy, profiles
from trapline.schema import PLAN_SERVICES, SERVICES


def scored(spark, **values):
    row = {"session_id": "s", **values}
    schema = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'string' if isinstance(v, str) else 'double'}"
                       for k, v in row.items())
    data = [tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in row.values())]
    return profiles.label_profiles(spark.createDataFrame(data, schema)).first()


def test_no_evidence_gives_the_first_profile_and_no_confidence(spark):
    row = scored(spark, login_fail=0)
    assert (row["profile"], row["profile_confidence"], row["profile_reasons"]) == (
        "Brute Force Attack", 0.0, ["Low-confidence evidence"])
    assert row["profile_scores"]["Unknown"] == 1.0 and len(row["profile_scores"]) == 15


def test_brute_force(spark):
    row = scored(spark, login_fail=40, unique_pass=20, fails_per_min=10)
    assert (row["profile"], row["profile_confidence"]) == ("Brute Force Attack", 0.833)
    assert row["profile_reasons"] == ["Many failed logins", "Many unique passwords", "High failed-login rate"]
    assert row["profile_scores"]["Credential Stuffing"] == 0.667


def test_conditional_evidence_raises_the_maximum(spark):
    calm = scored(spark, cmd_count=10, unique_cmds=5, duration=300)
    odd = scored(spark, cmd_count=10, unique_cmds=5, duration=300, is_anomaly=True)
    assert calm["profile_scores"]["Interactive Attacker"] == 0.75
    assert odd["profile_scores"]["Interactive Attacker"] == pytest.approx(round(3.25 / 4.25, 3))


def test_bot_and_churn(spark):
    row = scored(spark, event_count=10, events_per_min=50, cmd_count=5, cmds_per_min=20)
    assert row["profile_scores"]["Automated Bot"] == 0.75
    few = scored(spark, event_count=9, events_per_min=50)
    assert few["profile_scores"]["Automated Bot"] == 0.0
    churn = scored(spark, ftp_events=5, ftp_ratio=1, ftp_connects=10, ftp_disconnects=2)
    assert churn["profile_scores"]["FTP Abuse"] == 1.0
    assert churn["profile_reasons"] == ["FTP activity", "FTP-dominant session", "FTP connection attempts"]


def test_quiet_shell_probe(spark):
    row = scored(spark, ssh_events=2, ssh_ratio=0.5, event_count=4, unique_event_types=2, login_success=1)
    assert row["profile_scores"]["Low-Interaction SSH Probe"] == pytest.approx(round(2.0 / 2.5, 3))


def weights_frame(spark, *maps):
    return spark.createDataFrame([(f"p{i}", m) for i, m in enumerate(maps)], "plan_id string, weights map<string,double>")


def test_adapted_weights_golden(spark):
    raw = {"ssh_honeypot": 0.041, "http_honeypot": 0.0, "mysql_honeypot": 0.061, "redis_honeypot": 0.082,
           "ftp_honeypot": 0.286, "smtp_honeypot": 0.531}
    got = dict(zip(SERVICES, deploy.adapt_distribution(weights_frame(spark, raw)).first()["weights"]))
    assert got["ftp"] == 0.0 and sum(got.values()) == pytest.approx(1.0)
    assert got["http"] == pytest.approx((0.286 / 5) / 1.001) and max(got, key=got.get) == "smtp"


def allocated(spark, weights, total=12):
    df = spark.createDataFrame([("p", [float(w) for w in weights])], "plan_id string, weights array<double>")
    good, bad = deploy.allocate(df, total)
    return good, bad


def test_allocation_golden(spark):
    good, _ = allocated(spark, [1 / 6] * 6)
    assert good.first()["target"] == [2] * 6
    good, _ = allocated(spark, [1, 0, 0, 0, 0, 0])
    assert good.first()["target"] == [7, 1, 1, 1, 1, 1]
    # No weight at all: the leftovers go round once.
    good, _ = allocated(spark, [0] * 6)
    assert good.first()["target"] == [2] * 6
    good, bad = allocated(spark, [1 / 6] * 6, total=5)
    assert good.count() == 0 and bad.count() == 1


def python_remainder(weights, slots):
    raw = [w * slots for w in weights]
    counts = [int(r) for r in raw]
    order = sorted(range(len(raw)), key=lambda i: raw[i] - counts[i], reverse=True)
    for i in order[:slots - sum(counts)]:
        counts[i] += 1
    return counts


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 40), min_size=6, max_size=6), min_size=20, max_size=40), st.integers(6, 30))
def test_allocation_properties(spark, counts, total):
    weights = [[c / sum(row) if sum(row) else 0.0 for c in row] for row in counts]
    df = spark.createDataFrame([(str(i), w) for i, w in enumerate(weights)], "plan_id string, weights array<double>")
    good, _ = deploy.allocate(df, total)
    for r in good.collect():
        w = weights[int(r["plan_id"])]
        if sum(w) or total - 6 <= 6:
            assert sum(r["target"]) == total
        assert min(r["target"]) >= 1
        assert r["target"] == [1 + n for n in python_remainder(w, total - 6)]


def sessions_frame(spark, n, profile="Web Scanner", confidence=0.9, plan="p"):
    counts = [f"{2 if s == 'http' else 1} AS {s}_honeypot_count" for s in PLAN_SERVICES]
    return spark.range(n).selectExpr(
        f"'{plan}' AS plan_id", "concat('s', id) AS session_id", "timestamp_seconds(id) AS session_start",
        f"'{profile}' AS profile", f"{confidence}D AS profile_confidence", *counts)


def test_plan_for_one_profile(spark):
    plan = deploy.build_plans(sessions_frame(spark, 150)).first()
    by = dict(zip(PLAN_SERVICES, plan["recommended"]))
    assert by == {"ssh": 1, "http": 7, "mysql": 1, "redis": 1, "ftp": 1, "smtp": 1}
    assert (plan["action"], plan["total_sessions"], plan["selected_sessions"], plan["total_recommended"]) == (
        "recommend", 150, 100, 12)
    assert plan["reasons"] == ["http_honeypot: 100 sessions / 2 current honeypot = 50.00 normalized demand ->7 honeypots"]
    assert dict(zip(PLAN_SERVICES, plan["distribution"]))["http"] == 1.0


def test_holds(spark):
    few = deploy.build_plans(sessions_frame(spark, 99)).first()
    assert few["action"] == "hold" and sum(few["recommended"]) == 0
    assert few["reasons"] == ["Only 99 sessions selected; need at least 100 before scaling."]
    unsure = deploy.build_plans(sessions_frame(spark, 120, confidence=0.2)).first()
    assert unsure["reasons"] == ["No sessions met the minimum confidence threshold of 0.3."]


def test_unknown_start_counts_as_newest(spark):
    df = sessions_frame(spark, 5).withColumn(
        "session_start", F.when(F.col("session_id") != "s0", F.col("session_start")))
    got = {r["session_id"] for r in deploy.latest_sessions(df, 2).collect()}
    assert got == {"s0", "s4"}


def test_override_validation_and_replacement(spark):
    rows = spark.sql("""
        SELECT * FROM VALUES
          (TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-05 00:00:00', map('ssh', 1.0D)),
          (TIMESTAMP '2024-01-02 00:00:00', TIMESTAMP '2024-01-03 00:00:00', map('smtp', 2.0D)),
          (TIMESTAMP '2024-01-04 00:00:00', TIMESTAMP '2024-01-05 00:00:00', map('telnet', 1.0D)),
          (TIMESTAMP '2024-01-04 00:00:00', TIMESTAMP '2024-01-05 00:00:00', map('ssh', -1.0D, 'ftp', 3.0D)),
          (TIMESTAMP '2024-01-04 00:00:00', TIMESTAMP '2024-01-05 00:00:00', map('ssh', 0.0D))
        AS t(set_at, expires_at, weights)""")
    good, bad = deploy.check_overrides(rows)
    assert good.count() == 2
    assert sorted(r["reject_reason"] for r in bad.collect()) == ["negative weight", "no positive total", "unknown type"]
    moments = spark.sql("""
        SELECT moment, 'p' AS plan_id FROM VALUES (TIMESTAMP '2024-01-01 12:00:00'), (TIMESTAMP '2024-01-02 00:00:00'),
          (TIMESTAMP '2024-01-04 00:00:00') AS t(moment) UNION ALL SELECT TIMESTAMP '2024-01-04 00:00:00', 'other'""")
    plans = spark.createDataFrame([("p", [0.2, 0.2, 0.2, 0.2, 0.0, 0.2])], "plan_id string, weights array<double>")
    got = {(r["moment"].day, r["plan_id"]): (r["origin"], r["weights"][SERVICES.index("smtp")])
           for r in deploy.effective_weights(moments, plans, rows).collect()}
    # The second override ended the first for good.
    assert got == {(1, "p"): ("override", 0.0), (2, "p"): ("override", 1.0), (4, "p"): ("plan", 0.2),
                   (4, "other"): ("uniform", pytest.approx(1 / 6))}


def test_refresh_is_repeatable_and_held_by_overrides(spark):
    df = sessions_frame(spark, 150)
    asof = F.timestamp_seconds(F.lit(120))
    first, second = (deploy.refresh_plans(df, asof).collect() for _ in range(2))
    assert first == second and first[0]["total_sessions"] == 121
    held = spark.sql("SELECT TIMESTAMP '1970-01-01' AS set_at, TIMESTAMP '1970-01-02' AS expires_at, map('ssh', 1.0D) AS weights")
    assert deploy.refresh_plans(df, asof, held).count() == 0


def test_state_reports(spark):
    rows = [("ssh", 1, 10), ("ssh", 4, 20), ("telnet", 1, 30), ("http", -1, 30), (None, 1, 1)]
    df = spark.createDataFrame(rows, "honeypot_type string, cnt int, s long").withColumn(
        "updated_at", F.timestamp_seconds("s"))
    good, bad = deploy.check_state(df)
    assert (good.count(), bad.count()) == (2, 3)
    assert [(r["honeypot_type"], r["cnt"]) for r in deploy.latest_state(df).collect()] == [("ssh", 4)]


def test_redistribution_deltas_sum_up(spark):
    random.seed(2)
    good, _ = allocated(spark, [1 / 6] * 6)
    state = spark.createDataFrame([("ssh", 12, 1)], "honeypot_type string, cnt int, s long").withColumn(
        "updated_at", F.timestamp_seconds("s"))
    rows = deploy.redistribute(deploy.target_table(good), state).collect()
    assert sum(r["delta"] for r in rows) == 0
    assert {r["service"]: r["delta"] for r in rows}["ssh"] == -10
    assert {r["service"]: r["replicas"] for r in deploy.target_table(good).collect()}["ftp"] == 1


def test_a_replaced_override_no_longer_holds(spark, monkeypatch):
    from datetime import datetime

    monkeypatch.setattr(deploy, "build_plans", lambda known: known.select("session_id"))
    sessions = spark.createDataFrame([("s", datetime(2024, 1, 1))], "session_id string, session_start timestamp")
    asof = F.lit("2024-01-05 00:00:00").cast("timestamp")

    def plans(*rows):
        overrides = spark.createDataFrame([(a, b, {"ssh": 1.0}) for a, b in rows], "set_at timestamp, expires_at timestamp, weights map<string,double>")
        return deploy.refresh_plans(sessions, asof, overrides).count()

    first = (datetime(2024, 1, 1), datetime(2024, 1, 10))
    assert plans(first) == 0
    assert plans(first, (datetime(2024, 1, 2), datetime(2024, 1, 3))) == 1
    assert plans((datetime(2024, 1, 2), None)) == 0
    assert plans() == 1


def test_a_clear_event_ends_an_override(spark, monkeypatch):
    from datetime import datetime

    monkeypatch.setattr(deploy, "build_plans", lambda known: known.select("session_id"))
    sessions = spark.createDataFrame([("s", datetime(2024, 1, 1))], "session_id string, session_start timestamp")
    overrides = spark.createDataFrame(
        [(datetime(2024, 1, 2), datetime(2024, 1, 9), {"ssh": 1.0}), (datetime(2024, 1, 4), None, None)],
        "set_at timestamp, expires_at timestamp, weights map<string,double>")
    counts = [deploy.refresh_plans(sessions, F.lit(f"2024-01-0{d} 00:00:00").cast("timestamp"), overrides).count() for d in (1, 3, 5)]
    assert counts == [1, 0, 1]
    moments = spark.createDataFrame([(datetime(2024, 1, d), "p") for d in (1, 3, 5)], "moment timestamp, plan_id string")
    plans = spark.createDataFrame([], "plan_id string, weights array<double>")
    got = deploy.effective_weights(moments, plans, overrides).orderBy("moment").collect()
    assert [r["origin"] for r in got] == ["uniform", "override", "uniform"]
