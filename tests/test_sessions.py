from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from trapline.operators import analytics, features, quality, sessions

SCHEMA = ("ord long, timestamp timestamp, session_id string, src_ip string, eventid string, protocol string, "
          "username string, password string, input string, sensor string")


def events(spark, *rows):
    base = spark.createDataFrame(
        [(o, s, sid, ip, e, None, u, p, c, "x") for o, s, sid, ip, e, u, p, c in rows],
        SCHEMA.replace("timestamp timestamp", "seconds double"))
    return base.withColumn("timestamp", F.timestamp_micros((F.col("seconds") * 1e6).cast("long"))).drop("seconds")


@pytest.fixture(scope="module")
def sample(spark):
    return events(
        spark,
        (3, 0.0, "a", None, "cowrie.session.connect", None, None, None),
        (1, 30.0, "a", "1.1.1.1", "cowrie.login.failed", "root", "123", None),
        (2, 60.0, "a", "2.2.2.2", "cowrie.login.success", "root", "  ", None),
        (5, 61.0, "a", None, "cowrie.command.input", None, None, "WGET x; ls"),
        (6, 62.0, "a", None, "cowrie.command.failed", None, None, "nope"),
        (7, 62.5, "a", None, "cowrie.command.failed", None, None, "nope"),
        (4, 5.0, "b", "3.3.3.3", "redis.command", None, None, None),
        (9, 5.0, None, "3.3.3.3", "redis.command", None, None, None),
    )


def test_session_values(sample):
    rows = {r["session_id"]: r for r in features.add_behaviour(sessions.sessions(sample)).collect()}
    a, b = rows["a"], rows["b"]
    assert set(rows) == {"a", "b"}
    # First values follow ord, not time.
    assert a["src_ip"] == "1.1.1.1" and a["duration"] == 62.5
    assert (a["login_success"], a["login_fail"], a["unique_users"], a["unique_pass"]) == (1, 1, 1, 2)
    assert (a["cmd_count"], a["unique_cmds"], a["first_cmd"], a["last_cmd"]) == (3, 2, "WGET x; ls", "nope")
    assert (a["cmd_failed_count"], a["unique_failed_cmds"], a["first_failed_cmd"]) == (2, 1, "nope")
    assert (a["event_count"], a["unique_event_types"], a["ssh_events"]) == (6, 5, 6)
    # A blank password counts in the mean with zeros.
    assert a["pw_length_mean"] == 1.5
    assert (a["contains_install_cmds"], a["contains_recon_cmds"], a["contains_kill_terms"]) == (1, 1, 0)
    assert (b["cmd_count"], b["first_cmd"], b["redis_commands"], b["primary_service"]) == (0, None, 1, "redis")


def test_sessions_without_length(sample):
    rows = {r["session_id"]: r for r in features.add_behaviour(sessions.sessions(sample)).collect()}
    assert rows["b"]["duration"] == 0.0
    assert rows["b"]["events_per_min"] == pytest.approx(60.0)
    assert rows["b"]["cmds_per_min"] == 0.0


def test_parts_agree_with_the_full_table(sample):
    full = sessions.sessions(sample)
    for part in (sessions.bounds(sample), sessions.network(sample), sessions.type_counts(sample)):
        same = full.select(part.columns)
        assert same.exceptAll(part.select(same.columns)).count() == 0


def test_order_and_partitions_do_not_matter(spark):
    random.seed(5)
    kinds = ["cowrie.command.input", "cowrie.login.failed", "http.page.visit", "mysql.query", None]
    # Order numbers repeat, so ties must be broken the same way every time.
    rows = [(i // 3, random.random() * 1e5, f"s{random.randint(0, 20) if random.random() < .6 else 0}",
             random.choice([None, "1.1.1.1", "2.2.2.2"]), random.choice(kinds), random.choice([None, "u", "v"]),
             random.choice([None, "p", " "]), random.choice([None, "ls", "cd x"])) for i in range(800)]
    first = sessions.sessions(events(spark, *rows).coalesce(1))
    random.shuffle(rows)
    second = sessions.sessions(events(spark, *rows).repartition(64)).select(first.columns)
    rounded = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in first.dtypes]
    assert first.select(rounded).exceptAll(second.select(rounded)).count() == 0
    assert first.count() == second.count()


@pytest.mark.parametrize("span, chunk", [(10, 7), (1000, 3), (1, 1)])
def test_value_lists_are_whole_and_ordered(spark, span, chunk):
    random.seed(7)
    rows = [(f"s{0 if random.random() < .4 else random.randint(1, 5)}", o, f"v{o}") for o in random.sample(range(-300, 300), 250)]
    out = sessions.value_lists(spark.createDataFrame(rows, "session_id string, ord long, value string"), span, chunk)
    got: dict[str, list] = {}
    for r in sorted(out.collect(), key=lambda r: (r["session_id"], r["chunk"])):
        assert len(r["items"]) <= chunk
        got.setdefault(r["session_id"], []).extend(r["items"])
    want: dict[str, list] = {}
    for s, o, v in sorted(rows, key=lambda r: r[1]):
        want.setdefault(s, []).append(v)
    assert got == want


def test_primary_service_ties(spark):
    columns = {"ssh": 0, "http": 2, "ftp": 2, "smtp": 0, "mysql": 2, "redis": 1}
    df = spark.range(1).select(*[F.lit(n).alias(f"{s}_events") for s, n in columns.items()])
    assert df.selectExpr(features.PRIMARY["primary_service"]).first()[0] == "http"


def logs(spark, *rows):
    return spark.createDataFrame(
        rows, "id long, session_id string, src_ip string, event_type string, input string").withColumn(
        "created_at", F.timestamp_seconds("id"))


def test_session_summary_lists(spark):
    rows = [(i, "a", f"1.1.1.{i}", t, c) for i, (t, c) in enumerate(
        [("x", "c1"), ("y", "c2"), ("x", "c3"), ("z", "c1"), ("x", "c4"), ("y", "c5"), ("x", "c6"), ("x", " ")])]
    got = analytics.session_summary(logs(spark, *rows, (99, None, None, "q", None))).collect()
    a = next(r for r in got if r["session_id"] == "a")
    assert a["event_types"] == ["x", "y", "z"]
    assert a["commands"] == ["c6", "c5", "c4", "c1", "c3"]
    assert (a["count"], a["newest_id"], a["src_ip"]) == (8, 7, "1.1.1.7")
    unknown = next(r for r in got if r["session_id"] == "unknown")
    assert (unknown["src_ip"], unknown["commands"]) == ("unknown", [])


def test_depth_bands_show_zero(spark):
    rows = [(i, "a", "i", "t", None) for i in range(6)] + [(9, "b", "i", "t", None)]
    got = {r["range"]: r["sessions"] for r in analytics.session_depth(logs(spark, *rows)).collect()}
    assert got == {"1": 1, "2-5": 0, "6-15": 1, "16-50": 0, "51+": 0}


def test_top_list_ties_go_to_the_newest(spark):
    rows = [(1, "a", "x", "t", None), (2, "a", "y", "t", None), (3, "a", "z", "t", None)]
    assert [r["label"] for r in analytics.top_sources(logs(spark, *rows), 2).collect()] == ["z", "y"]


def test_deduplicate_is_idempotent_and_handles_nulls(spark):
    df = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, "a", "b"), (4, None, None)], "id long, x string, y string")
    once = quality.deduplicate(df)
    assert sorted(r["id"] for r in once.collect()) == [1, 2, 4]
    assert sorted(r["id"] for r in quality.deduplicate(once).collect()) == [1, 2, 4]
    assert quality.duplicate_count(df).first()[0] == 1


def test_documents_equal_but_for_key_order(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": {"c": 2, "d": 3}}'), (2, '{"b": {"d": 3, "c": 2}, "a": 1}'), (3, "bad")],
                               "id long, raw_json string")
    assert sorted(r["id"] for r in quality.deduplicate_documents(df).collect()) == [1, 3]


def test_copies_of_a_document_with_one_key_leave_one_row(spark):
    df = spark.createDataFrame([(1, "{}", "a"), (1, "{ }", "a"), (2, None, "b"), (5, None, "b"), (None, "[1]", "c")],
                               "id long, raw_json string, note string")
    kept = quality.deduplicate_documents(df).collect()
    assert sorted((r["id"] or 0, r["note"]) for r in kept) == [(0, "c"), (1, "a"), (2, "b")]


def test_first_values_combine_in_hash_tables(spark):
    df = spark.createDataFrame(
        [("s", 3, None, 22.5), ("s", 1, None, None), ("s", 2, "x", 7.0), ("s", 2, "b", None), ("t", 1, None, None), (None, 1, "q", 1.0)],
        "session_id string, ord long, src_ip string, dst_port double")
    out = sessions.network(df)
    assert sorted((r["session_id"], r["src_ip"], r["dst_port"]) for r in out.collect()) == [("s", "b", 7.0), ("t", None, None)]
    plan = out._jdf.queryExecution().sparkPlan().toString().splitlines()
    steps = [line for line in plan if "Aggregate" in line]
    # The steps nearest to the scan come last: two of hash tables, for all rows, before any sort.
    assert all("HashAggregate" in line for line in steps[-2:])


def test_command_column_can_be_chosen(spark, sample):
    named = sample.withColumn("command", F.when(F.col("eventid") == "redis.command", "CONFIG"))
    rows = {r["session_id"]: r["cmd_count"] for r in sessions.sessions(named, command="command").collect()}
    assert rows == {"a": 0, "b": 1}
