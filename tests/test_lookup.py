from __future__ import annotations

from datetime import datetime

import random

import pytest
from pyspark.sql import functions as F

from trapline.operators import lookup


@pytest.fixture(params=["10MB", "-1"], ids=["broadcast", "shuffled"])
def size_limit(request, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_as_of_matches_a_direct_search(spark, size_limit):
    random.seed(1)
    day = 86400
    history = [(k, random.randint(0, 30 * day), i) for k in "ab" for i in range(40)]
    history = list({(k, t): (k, t, v) for k, t, v in history}.values())
    facts = [(i, "a" if random.random() < .7 else random.choice("abc"), random.randint(-day, 31 * day)) for i in range(400)]
    h = spark.createDataFrame(history, "k string, s long, v int").select("k", F.timestamp_seconds("s").alias("at"), "v")
    f = spark.createDataFrame(facts, "id int, k string, s long").withColumn("t", F.timestamp_seconds("s"))
    want = {}
    for i, k, s in facts:
        past = [(t, v) for hk, t, v in history if hk == k and t <= s]
        want[i] = max(past)[1] if past else None
    for slot in (lookup.SLOT, 1_000_000, 10**15):
        assert {r["id"]: r["v"] for r in lookup.as_of(f, h, "k", "t", "at", "v", slot).collect()} == want
    latest = lookup.latest_at(f, h, ["k"], "t", "at", ["v"])
    assert {r["id"]: r["v"] for r in latest.collect()} == want and latest.columns == ["id", "k", "s", "t", "at", "v"]


def test_as_of_ties_nulls_and_repeated_facts(spark, size_limit):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    history = spark.createDataFrame([("a", at(5), 1), ("a", at(5), 2), ("a", at(9), None), (None, at(1), 7), ("a", None, 8)], "k string, at timestamp, v int")
    facts = spark.createDataFrame(
        [(1, "a", at(5)), (2, "a", at(5)), (2, "a", at(5)), (3, "a", at(4)), (4, "a", at(9)), (5, None, at(9)), (6, "a", None), (7, "b", at(9))],
        "id int, k string, t timestamp").withColumn("m", F.create_map(F.lit("x"), F.col("id")))
    out = lookup.as_of(facts, history, "k", "t", "at", "v")
    assert sorted((r["id"], r["v"]) for r in out.collect()) == [(1, 2), (2, 2), (2, 2), (3, None), (4, None), (5, None), (6, None), (7, None)]
    empty = lookup.as_of(facts, history.limit(0), "k", "t", "at", "v")
    assert empty.filter("v IS NULL").count() == 8 and lookup.as_of(facts.limit(0), history, "k", "t", "at", "v").count() == 0


def test_intervals_match_a_direct_search(spark, size_limit):
    rng = random.Random(5)
    starts = [rng.randint(-3 * 10**9, 4 * 10**9) for _ in range(60)]
    spans = [(i, rng.choice("ab"), s, s + rng.choice([0, 1, 59, 61, 3600, 86400 * 40, 10**9])) for i, s in enumerate(starts)]
    spans += [(60, "a", 5, None), (61, "b", -(10**9), 2 * 10**11)]
    facts = [(i, rng.choice("ab"), rng.choice([s[2], (s[3] or 0) - 1, s[3] or 0, rng.randint(-(10**9), 5 * 10**9)])) for i, s in enumerate(rng.choices(spans, k=300))]
    time = F.timestamp_seconds
    f = spark.createDataFrame(facts, "id int, k string, s long").withColumn("t", time("s")).drop("s")
    d = spark.createDataFrame(spans, "n int, k string, a long, b long").select("n", "k", time("a").alias("since"), time("b").alias("until"))
    want = []
    for i, k, s in facts:
        hits = [n for n, dk, a, b in spans if dk == k and a <= s and (b is None or (s < b and a < b))]
        want += [(i, n) for n in hits] or [(i, -1)]
    joined = lookup.interval_join(f, d, ["k"], "t", "since", "until").collect()
    assert sorted((r["id"], -1 if r["n"] is None else r["n"]) for r in joined) == sorted(want)


def test_a_far_interval_takes_few_nodes(spark):
    rows = spark.createDataFrame(
        [(datetime(2024, 5, 17, 13, 7), datetime(9999, 12, 31, 23, 59)), (datetime(1, 1, 3, 0, 1), datetime(9999, 12, 31, 23, 59))], "a timestamp, b timestamp")
    minutes = rows.select(*[F.floor(lookup._since_year_1(c) / lookup.MINUTE).alias(c) for c in "ab"])
    for r in minutes.select("a", "b", lookup._span_nodes("a", "b", lookup.MINUTE_LEVELS).alias("n")).collect():
        assert len(r["n"]) < 100 and sum(4 ** x["level"] for x in r["n"]) == r["b"] - r["a"]


def test_building_a_plan_starts_no_job(spark):
    key = (F.col("id") % 3).cast("string").alias("k")
    facts = spark.range(50).select(F.col("id"), key, F.timestamp_seconds("id").alias("t"))
    history = spark.range(5).select(key, F.timestamp_seconds("id").alias("at"), F.col("id").alias("v"))
    spans = history.select("at", "v", F.timestamp_seconds(F.col("v") + 3).alias("to"))
    spark.sparkContext.setJobGroup("plans", "plans")
    try:
        frames = [
            lookup.lookup_join(facts, history, ["k"]), lookup.as_of(facts, history, "k", "t", "at", "v"),
            lookup.latest_at(facts, history.drop("k"), [], "t", "at", ["v"]), lookup.interval_join(facts, spans, [], "t", "at", "to")]
        plans = [f._jdf.queryExecution().executedPlan().toString() for f in frames]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plans")
    assert not any(word in p for p in plans for word in ("SinglePartition", "CartesianProduct", "NestedLoop"))


def test_ranges_across_prefixes(spark, size_limit):
    ranges = spark.createDataFrame(
        [(65536 * 256 - 10, 65536 * 256 + 65536 * 2 + 5, "wide"), (16909060, 16909060, "one")],
        "ip_start long, ip_end long, name string")
    facts = spark.createDataFrame(
        [("0.255.255.250",), ("1.0.0.0",), ("1.2.0.5",), ("1.2.0.6",), ("1.2.3.4",), ("127.0.0.1",), ("::1",), (None,)],
        "src_ip string")
    got = {r["src_ip"]: r["name"] for r in lookup.geo_by_range(facts, ranges).collect()}
    assert got == {"0.255.255.250": "wide", "1.0.0.0": "wide", "1.2.0.5": "wide", "1.2.0.6": None,
                   "1.2.3.4": "one", "127.0.0.1": None, "::1": None, None: None}


def test_hot_key_keeps_every_row(spark, size_limit):
    facts = spark.range(900).select("id", F.when(F.col("id") % 3 != 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    dim = spark.createDataFrame([("hot", 1), ("3", 2)], "k string, v int")
    out = lookup.lookup_join(facts, dim, ["k"])
    assert out.count() == 900 and out.filter("v = 1").count() == 600 and out.filter("v = 2").count() == 1
    assert set(out.columns) == {"id", "k", "v"}


def test_facts_may_carry_maps(spark, size_limit):
    facts = spark.range(10).select("id", F.lit("a").alias("k"), F.create_map(F.lit("x"), F.col("id")).alias("m"))
    dim = spark.createDataFrame([("a", 1)], "k string, v int")
    assert lookup.lookup_join(facts, dim, ["k"]).filter("v = 1").count() == 10


def test_intervals_without_end_and_with_a_far_one(spark):
    facts = spark.createDataFrame([(i, datetime(2024, 1, i)) for i in (1, 5, 9)], "n int, moment timestamp")
    spans = spark.createDataFrame(
        [("far", datetime(2024, 1, 4), datetime(9999, 1, 1)), ("open", datetime(2024, 1, 8), None), ("past", datetime(2020, 1, 1), datetime(2020, 1, 2))],
        "name string, since timestamp, until timestamp")
    joined = lookup.interval_join(facts, spans, [], "moment", "since", "until")
    assert sorted((r.n, r.name or "") for r in joined.collect()) == [(1, ""), (5, "far"), (9, "far"), (9, "open")]
