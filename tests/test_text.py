from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trapline.functions import classify, clock, numbers, text


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0


def test_password_metrics_match_a_direct_count(spark):
    random.seed(3)
    alphabet = "abAB12!$äé漢😀 "
    words = ["", "  ", "aaaa", " pad ", "\t\n", "x"] + [
        "".join(random.choices(alphabet, k=random.randint(1, 30))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(words)), "i int, p string")
    out = {r["i"]: r["m"] for r in df.select("i", text.password_metrics(F.col("p")).alias("m")).collect()}
    for i, word in enumerate(words):
        s = word.strip()
        e, n, u = entropy(s), len(s), len(set(s))
        want = (e, e * n, e / math.log2(u) if u > 1 else 0.0, n, u, e * n + u + 0.5 * n)
        assert tuple(out[i]) == pytest.approx(want, abs=1e-9), word


def test_entropy_keeps_white_space(spark):
    df = spark.createDataFrame([("a a",), (None,), ("",)], "p string")
    got = [r[0] for r in df.select(text.shannon_entropy(F.col("p"))).collect()]
    assert got == pytest.approx([entropy("a a"), 0.0, 0.0])


def test_entropy_of_many_characters(spark):
    """Every pass goes over what the ones before it left, not over the whole text again."""
    random.seed(5)
    words = ["".join(chr(random.choice([97, 98, 0x4E00 + random.randrange(900), 0x1F600 + random.randrange(50)])) for _ in range(4000)),
             "a" * 500 + "".join(map(chr, range(0x4E00, 0x4E00 + 300))), "x", "zz", ".*$1\\", "\ud7ff\ue000 \n\x00"]
    df = spark.createDataFrame(list(enumerate(words)), "i int, p string").select("i", text.shannon_entropy(F.col("p")).alias("e"))
    assert {r["i"]: r["e"] for r in df.collect()} == pytest.approx({i: entropy(w) for i, w in enumerate(words)}, abs=1e-9)
    plan = df.select("e")._jdf.queryExecution().analyzed().toString()
    assert "replace(" in plan and "replace(p#" not in plan


def test_control_share_reads_a_text_once(spark):
    """The few control characters are picked, not all others removed, and the share is made once."""
    from trapline import catalog

    random.seed(7)
    words = ["".join(random.choices("\x00\x08\t\n\x0b\x0c\r\x0e\x1f\x20\x7fa漢😀", k=random.randint(1, 60))) for _ in range(80)]
    bad = {chr(c) for c in [*range(9), 11, 12, *range(14, 32)]}
    df = spark.createDataFrame(list(enumerate(words)), "i int, s string")
    got = {r["i"]: r["c"] for r in df.select("i", text.control_share(F.col("s")).alias("c")).collect()}
    assert got == pytest.approx({i: sum(c in bad for c in w) / len(w) for i, w in enumerate(words)})
    plan = catalog.queries()["F03_control_characters"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_") == 1 and "[^" not in plan


def test_control_share(spark):
    df = spark.createDataFrame([("\x01\x02ab",), ("a\tb\nc",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(text.control_share(F.col("s"))).collect()] == [0.5, 0.0, 0.0, 0.0]


def test_terms_are_substrings_not_patterns(spark):
    df = spark.createDataFrame([("Ab./x",), ("a/x",), ("CLS",)], "s string")
    got = [tuple(r) for r in df.select(
        text.contains_any(F.col("s"), ["./"]), text.contains_any(F.col("s"), ["ls"])).collect()]
    assert got == [(True, False), (False, False), (False, True)]


def test_command_text_takes_the_first_filled_candidate(spark):
    df = spark.createDataFrame([("  ", None, ["a", None]), (None, " x ", []), (None, None, [])],
                               "a string, b string, c array<string>")
    got = [r[0] for r in df.select(text.command_text(F.col("a"), F.col("b"), text.joined(F.col("c")))).collect()]
    assert got == ["a, —", "x", None]


def test_service_patterns_decide_in_order(spark):
    df = spark.createDataFrame(
        [("sftp-1", None, "x"), (None, "http", "ssh.x"), (None, None, "smtp.ehlo"), ("webs", None, "none"),
         ("my web box", None, "none")], "s string, p string, e string")
    got = [r[0] for r in df.select(classify.display_service(F.col("s"), F.col("p"), F.col("e"))).collect()]
    assert got == ["FTP", "HTTP", "SMTP", "Other", "HTTP"]


def test_service_resolution(spark):
    df = spark.createDataFrame(
        [("SSH ", "http.x"), (None, "http.login"), ("", "redis.command"), (None, "cowrie.login.failed"),
         ("telnet", "http.x")], "h string, e string")
    got = [r[0] for r in df.select(classify.resolve_service(F.col("h"), F.col("e"))).collect()]
    assert got == ["ssh", "http", "redis", None, None]


def test_private_sources(spark):
    ips = ["127.0.0.1", "10.1.2.3", "192.168.0.1", "172.16.0.1", "172.32.0.1", "8.8.8.8", "", None, "100.1.1.1"]
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    got = [r[0] for r in df.select(classify.is_public_source(F.col("ip"))).collect()]
    assert got == [False, False, False, False, True, True, False, False, True]


def test_ipv4_numbers(spark):
    df = spark.createDataFrame([("1.2.3.4",), ("::1",), ("1.2.3",), (None,)], "ip string")
    assert [r[0] for r in df.select(classify.ipv4_number(F.col("ip"))).collect()] == [16909060, None, None, None]


def test_times_without_offset_are_utc(spark):
    df = spark.createDataFrame([("2024-01-01T05:30:00+05:30",), ("2024-01-01 00:00:00",),
                                ("2024-01-01T00:00:00.000Z",), ("nope",), (None,)], "t string")
    got = [r[0] for r in df.select(F.unix_timestamp(clock.parse_utc(F.col("t")))).collect()]
    assert got == [1704067200] * 3 + [None, None]


def test_hour_is_read_in_the_own_offset(spark):
    df = spark.createDataFrame([("2024-01-01T05:30:00+05:30",), ("2024-01-01 23:59:00",)], "t string")
    got = [r[0] for r in df.select(clock.hour_bucket(F.col("t"), clock.parse_utc(F.col("t")))).collect()]
    assert got == ["2024010105", "2024010123"]


@pytest.mark.parametrize("seconds, want", [(0, "0s ago"), (59, "59s ago"), (60, "1m ago"), (3599, "59m ago"),
                                           (3600, "1h ago"), (86399, "23h ago"), (129600, "2d ago")])
def test_ages(spark, seconds, want):
    row = spark.range(1).select(clock.age_text(F.timestamp_seconds(F.lit(0)), F.timestamp_seconds(F.lit(seconds)))).first()
    assert row[0] == want


def test_numbers_are_lenient_and_finite(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("Infinity",), ("NaN",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(numbers.number(F.col("s"))).collect()] == [1.5] + [None] * 5
