from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trapline.operators import lookup, normalize
from trapline.schema import INGEST_EVENT, SENSOR_LINE
from trapline.sources import files, store


def ingest_rows(spark, *rows):
    full = [{f.name: r.get(f.name) for f in INGEST_EVENT.fields} for r in rows]
    return spark.createDataFrame(full, INGEST_EVENT)


BASE = {"timestamp": "2024-03-01T10:15:00+00:00", "source_ip": "1.2.3.4", "event_type": "http.login.attempt"}


def test_type_is_trimmed_and_lowered(spark):
    row = normalize.canonical(ingest_rows(spark, {**BASE, "event_type": "  SSH_Login  "})).first()
    assert row["event_type"] == "ssh_login"


@pytest.mark.parametrize("session_id", [None, ""])
def test_missing_session_gets_a_fixed_id(spark, session_id):
    row = normalize.canonical(ingest_rows(spark, {**BASE, "session_id": session_id})).first()
    want = hashlib.sha256(b"1.2.3.4:http.login.attempt:2024030110").hexdigest()
    assert row["session_id"] == want


def test_id_uses_the_type_as_sent_and_the_own_hour(spark):
    row = normalize.canonical(ingest_rows(
        spark, {**BASE, "event_type": " A ", "timestamp": "2024-03-01T23:15:00-05:00"})).first()
    assert row["session_id"] == hashlib.sha256(b"1.2.3.4: A :2024030123").hexdigest()
    assert row["event_type"] == "a"


def test_payload_defaults_to_empty(spark):
    rows = normalize.canonical(ingest_rows(spark, BASE, {**BASE, "data": {"a": "b"}})).collect()
    assert [r["payload"] for r in rows] == [{}, {"a": "b"}]


def test_invalid_events_carry_a_reason(spark):
    events = ingest_rows(
        spark, BASE, {**BASE, "timestamp": None}, {}, {**BASE, "timestamp": "not-a-timestamp"},
        {**BASE, "event_type": None})
    valid, rejected = normalize.split_valid(events)
    assert valid.count() == 1
    assert sorted(r["reject_reason"] for r in rejected.collect()) == [
        "bad timestamp", "missing event_type", "missing timestamp", "missing timestamp"]


def test_count_snapshot(spark):
    events = normalize.canonical(ingest_rows(
        spark, BASE, {**BASE, "event_type": "other.x"}, {**BASE, "timestamp": "2024-02-01T00:00:00Z"}))
    history = spark.sql("""
        SELECT * FROM VALUES ('http', 3, TIMESTAMP '2024-02-20 00:00:00'), ('http', 5, TIMESTAMP '2024-04-01 00:00:00')
        AS t(honeypot_type, cnt, updated_at)""")
    got = {(r["event_type"], r["timestamp"][:7]): r["active_honeypot_count"]
           for r in lookup.active_count(events, history).collect()}
    # Unknown service: 1; known service before its first report: 0.
    assert got == {("http.login.attempt", "2024-03"): 3, ("other.x", "2024-03"): 1,
                   ("http.login.attempt", "2024-02"): 0}


def lines(spark, *rows):
    return spark.createDataFrame([(s, v if isinstance(v, str) else json.dumps(v)) for s, v in rows],
                                 "service string, value string")


def test_lines_split_into_parsed_and_malformed(spark):
    good, bad = files.parse_lines(lines(spark, ("ssh", {"eventid": "x"}), ("ssh", '{"eventid": '), ("ssh", "  ")))
    assert (good.count(), bad.count()) == (1, 1)


def test_sensor_normalisers(spark):
    t = {"timestamp": "2024-01-01T00:00:00Z", "source_ip": "9.9.9.9", "sensor_id": "s"}
    good, _ = files.parse_lines(lines(
        spark,
        ("ssh", {"eventid": "cowrie.command.input", "timestamp": "2024-01-01T00:00:00Z", "src_ip": "9.9.9.9",
                 "session": "abc", "input": "ls", "sensor": "s"}),
        ("ssh", {"eventid": "cowrie.client.kex", "timestamp": "2024-01-01T00:00:00Z", "src_ip": "9.9.9.9"}),
        ("redis", {**t, "event_type": "redis.command", "command": "config", "args": [str(i) for i in range(20)]}),
        ("redis", {**t, "event_type": "redis.command", "command": "PING"}),
        ("mysql", {**t, "event_type": "mysql.query", "query": "x" * 900, "session_id": "dropped"}),
        ("mysql", {**t, "event_type": "mysql.server.start"}),
        ("smtp", {**t, "event_type": "smtp.message.received", "body_preview": "y" * 500}),
        ("smtp", {**t, "event_type": "smtp.ehlo", "ehlo_host": "\x01\x02\x03"}),
        ("smtp", {**t, "event_type": "smtp.command"}),
        ("http", {**t, "event_type": "http.page.visit", "session_id": "h1"}),
        ("ftp", {**t, "event_type": "ftp.login.failed", "source_ip": ""}),
    ))
    out = {r["event_type"]: r for r in normalize.normalise_sensor_lines(
        good, query_chars=500, body_chars=300, max_args=10).collect()}
    assert set(out) == {"cowrie.command.input", "redis.command", "mysql.query", "smtp.message.received", "http.page.visit"}
    assert out["cowrie.command.input"]["data"]["command"] == "ls"
    assert out["cowrie.command.input"]["session_id"] == "abc"
    assert json.loads(out["redis.command"]["data"]["args"]) == [str(i) for i in range(10)]
    assert len(out["mysql.query"]["data"]["query"]) == 500 and out["mysql.query"]["session_id"] is None
    assert len(out["smtp.message.received"]["data"]["body_preview"]) == 300
    assert out["http.page.visit"]["session_id"] == "h1"
    whole = {r["event_type"]: r["data"] for r in normalize.normalise_sensor_lines(good).collect()}
    assert (len(whole["mysql.query"]["query"]), len(json.loads(whole["redis.command"]["args"]))) == (900, 20)
    assert {e: r["severity"] for e, r in out.items()} == {
        "cowrie.command.input": "medium", "redis.command": "medium", "mysql.query": "high",
        "smtp.message.received": "high", "http.page.visit": "low"}


def test_flatten_precedence(spark):
    doc = {"timestamp": "2024-01-01T00:00:00Z", "src_ip": "1.1.1.1", "session_id": "s", "sensor_id": "a",
           "event_type": "http.page.visit",
           "payload": {"timestamp": "2024-01-02T00:00:00Z", "sensor": "b", "session_id": "x", "src_ip": "y",
                       "eventid": "z", "username": "root", "url": "u", "dst_port": 22, "odd": [1]}}
    logs = spark.createDataFrame([(1, json.dumps(doc), 4), (2, "{}", 2)],
                                 "id long, raw_json string, active_honeypot_count int")
    a, b = store.flatten(logs).orderBy("id").collect()
    assert (a["sensor"], a["session_id"], a["src_ip"], a["eventid"], a["username"]) == (
        "b", "s", "1.1.1.1", "http.page.visit", "root")
    assert (a["url"], a["dst_port"], json.loads(a["payload"])["odd"], b["payload"]) == ("u", 22.0, [1], None)
    assert a["timestamp"].day == 2 and a["http_honeypot_count"] == 4 and a["ssh_honeypot_count"] == 0
    assert sum(b[f"{s}_honeypot_count"] for s in ("ssh", "http", "mysql", "redis", "ftp", "smtp")) == 0


def test_core_columns_and_flags(spark):
    df = spark.createDataFrame([("cowrie.login.failed", "x"), (None, None)], "eventid string, input string")
    out = normalize.normalise_events(df).orderBy(F.asc_nulls_last("eventid")).collect()
    assert out[0]["is_login_failed"] == 1 and out[0]["is_ssh"] == 1 and out[0]["command"] == "x"
    assert out[1]["is_login_failed"] == 0 and out[1]["is_ssh"] == 0
    assert out[0]["geo"] if "geo" in out[0] else out[0]["destfile"] is None


def test_broken_records_are_listed(spark, tmp_path):
    schema = "eventid string, n int"
    good = ['{"eventid": "a"}', '[{"eventid": "b"}, {"eventid": "c"}]', "  "]
    broken = ['{"eventid": ', "plain words", "[1, 2]"]
    (tmp_path / "a.json").write_text("\n".join(good + broken) + "\n")
    (tmp_path / "b.json").write_text('{"eventid":\n"d"')
    schema = T._parse_datatype_string(schema)
    got = files.broken_json(spark, str(tmp_path / "a.json"), schema).collect()
    assert {r["value"]: r["reject_reason"] for r in got} == {broken[0]: "not JSON", broken[1]: "not JSON", broken[2]: "not records"}
    whole = files.broken_json(spark, str(tmp_path / "b.json"), schema, documents=True).collect()
    assert [r["reject_reason"] for r in whole] == ["not JSON"] and whole[0]["_source_file"].endswith("b.json")


def test_nested_files(spark, tmp_path):
    event = {"eventid": "e", "timestamp": "t", "geolocation_data": {"country_name": "X", "location": {"lat": 1.0, "lon": 2.0}}}
    (tmp_path / "a.json").write_text(json.dumps([{"s1": [event, event]}, {"s2": [event]}], indent=2))
    (tmp_path / "b.json").write_text(json.dumps({"s3": [{"eventid": "f"}]}))
    (tmp_path / "c.json").write_text("{ broken")
    out = files.read_datasets(spark, str(tmp_path), whole=True)
    got = sorted((r["dataset"], r["session_id"], r["eventid"], r["geo_country"], r["geo_loc_lon"]) for r in out.collect())
    assert got == [("a", "s1", "e", "X", 2.0)] * 2 + [("a", "s2", "e", "X", 2.0), ("b", "s3", "f", None, None)]
    assert files.read_nested(spark, str(tmp_path / "a.json"), whole=True, max_events=2).count() == 2


def test_nested_fields_without_a_column_come_back(spark, tmp_path):
    events = [{"eventid": "e", "retries": 5, "via": {"hop": ["a", 1.5]}, "flag": None}, {"eventid": "f", "input": "x"}, None, "odd"]
    (tmp_path / "a.json").write_text(json.dumps([{"s1": events[:2], "s2": [events[0]]}, {"s1": events[1:3]}]) + "\n" + json.dumps({"s3": events[:1]}) + "\n")
    got = files.read_nested(spark, str(tmp_path / "a.json")).select("session_id", "eventid", "rest").collect()
    rest = {"retries": 5, "via": {"hop": ["a", 1.5]}, "flag": None}
    want = [("s1", "e", rest), ("s1", "f", None), ("s2", "e", rest), ("s1", "f", None), ("s1", None, None), ("s3", "e", rest)]
    plain = sorted(((r[0], r[1], json.loads(r[2]) if r[2] else None) for r in got), key=repr)
    assert plain == sorted(want, key=repr)
    without = files.read_nested(spark, str(tmp_path / "a.json"), rest=False)
    assert "rest" not in without.columns and sorted(map(repr, without.select("session_id", "eventid").collect())) == sorted(
        repr(r) for r in files.read_nested(spark, str(tmp_path / "a.json")).select("session_id", "eventid").collect())


def test_nested_cap_takes_the_first(spark, tmp_path):
    for name in "bac":
        (tmp_path / f"{name}.json").write_text("\n".join(
            json.dumps([{f"{name}{i}": [{"eventid": f"{name}{i}{j}", "hassh": "h", "kexAlgs": ["k"]} for j in range(2)]}]) for i in range(2)))
    first = files.read_nested(spark, f"{tmp_path}/*.json", max_events=5)
    assert sorted(r["eventid"] for r in first.collect()) == ["a00", "a01", "a10", "a11", "b00"]
    assert {(r["hassh"], r["kexAlgs"]) for r in first.collect()} == {("h", '["k"]')}


def test_an_empty_folder_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_datasets(spark, str(tmp_path)).count()


def test_json_lines_and_documents(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"eventid": "a"}\nnot json\n[{"eventid": "b"}, {"eventid": "c"}]\n\n')
    (tmp_path / "d.json").write_text(json.dumps([{"eventid": "a"}, {"eventid": "b"}], indent=1))
    by_line = files.read_json_any(spark, str(tmp_path / "l.jsonl"), SENSOR_LINE)
    whole = files.read_json_any(spark, str(tmp_path / "d.json"), SENSOR_LINE, documents=True)
    assert sorted(r["eventid"] for r in by_line.filter("eventid IS NOT NULL").collect()) == ["a", "b", "c"]
    assert sorted((r["eventid"], r["_source_file"]) for r in whole.collect()) == [("a", "d.json"), ("b", "d.json")]


def test_flow_csv_names(spark, tmp_path):
    (tmp_path / "f.csv").write_text(" Flow Duration, Label\n5,BENIGN\n")
    df = files.read_flow_csv(spark, str(tmp_path / "f.csv"), underscores=True)
    assert df.columns == ["Flow_Duration", "Label", "_source_file"]
    assert tuple(df.first()) == ("5", "BENIGN", "f.csv")


def test_reduced_defaults_only_for_absent_keys(spark):
    df = spark.createDataFrame([('{"timestamp": "t"}',), ('{"src_ip": null, "eventid": "e"}',), ("bad",)], "value string")
    assert [tuple(r) for r in files.reduced(df).collect()] == [("t", "unknown", "unknown"), (None, None, "e")]


def test_lines_to_plan(spark):
    """The whole chain, from sensor lines to a placement plan."""
    from trapline.operators import features, sessions
    from trapline.plans import deploy, profiles
    from trapline.streaming.ingest import ingest_lines

    docs = [("http", {"event_type": "http.page.visit", "timestamp": f"2024-01-01T{i % 24:02d}:{n:02d}:00Z",
                      "source_ip": f"8.8.{i}.{n}", "session_id": f"s{i}", "sensor_id": "x"})
            for i in range(120) for n in range(12)]
    events, rejects = ingest_lines(lines(spark, *docs))
    assert rejects.count() == 0
    history = spark.sql("SELECT 'http' AS honeypot_type, 3 AS cnt, TIMESTAMP '2023-12-01 00:00:00' AS updated_at")
    flat = store.from_canonical(lookup.active_count(events, history))
    labelled = profiles.label_profiles(features.feature_table(sessions.sessions(flat)))
    assert {r["profile"] for r in labelled.select("profile").distinct().collect()} == {"Web Scanner"}
    plan = deploy.build_plans(labelled.withColumn("plan_id", F.lit("p"))).first()
    by = dict(zip(deploy.PLAN_SERVICES, plan["current"]))
    assert by["http"] == 3 and plan["raw"][deploy.PLAN_SERVICES.index("http")] == 100
    assert sum(plan["recommended"]) == 12


def test_a_broken_stored_document_does_not_end_the_job(spark):
    from trapline.sources import store

    rows = [(1, 0, '{"event_type": "ssh.login", "payload": {"username": "a"}}'), (2, 0, "{broken"), (3, 0, None)]
    logs = spark.createDataFrame(rows, "id long, active_honeypot_count int, raw_json string")
    flat = {r.id: (r.eventid, r.username) for r in store.flatten(logs).collect()}
    assert flat == {1: ("ssh.login", "a"), 2: (None, None), 3: (None, None)}
    assert {r.id: r.reject_reason for r in store.broken_documents(logs).collect()} == {2: "not JSON", 3: "no document"}


def test_broken_nested_documents_are_listed(spark, tmp_path):
    good = '{"s1": [{"eventid": "a"}]}'
    docs = [good, "[" + good + "]", '{"s2": [{"eventid": "b"}', "[" + good + ", {", '{"s3": 5}', "7", "", "  "]
    (tmp_path / "lines.json").write_text("\n".join(docs))
    (tmp_path / "whole.json").write_text('{\n"s4": [\n')
    broken = files.broken_nested(spark, str(tmp_path / "lines.json")).collect()
    assert {r.value: r.reject_reason for r in broken} == {
        docs[2]: "not JSON", docs[3]: "not JSON", docs[4]: "not sessions with lists of events", docs[5]: "not sessions with lists of events"}
    assert files.read_nested(spark, str(tmp_path / "lines.json")).count() == 2
    whole = files.broken_nested(spark, str(tmp_path / "whole.json"), whole=True).collect()
    assert [(r._source_file, r.reject_reason) for r in whole] == [("whole.json", "not JSON")]
