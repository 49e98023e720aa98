"""Dimension lookups: equality, validity intervals, latest rows and address ranges.

Every lookup meets its dimension on equal keys, so the engine picks the join by the sizes it
finds: it sends a small dimension to all tasks and splits the facts of a frequent key.
Times become equal keys through nodes of a tree: a node of level ``l`` holds ``4 ** l`` units of
time, so any span is a few nodes of each level and any moment lies in one node of each. Building a plan
starts no job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapline.functions.classify import ipv4_number

#: Microseconds from year 1 to the epoch, so that places in time are never negative.
EPOCH = 62_135_596_800_000_000
MINUTE = 60_000_000
MINUTE_LEVELS, MICRO_LEVELS = 17, 30
SLOT = 3_600_000_000


def lookup_join(facts: DataFrame, dim: DataFrame, on: list[str], condition: Column | None = None, how: str = "left") -> DataFrame:
    """Join facts to a dimension on equal names plus an optional condition.

    Dimension columns must not repeat fact names other than ``on``.
    """
    right = dim.withColumnsRenamed({c: f"_dim_{c}" for c in on})
    matched = F.lit(True) if condition is None else condition
    for c in on:
        matched = matched & (F.col(c) == F.col(f"_dim_{c}"))
    return facts.join(right, matched, how).drop(*[f"_dim_{c}" for c in on])


def _since_year_1(moment: str) -> Column:
    return F.unix_micros(F.col(moment).cast("timestamp")) + EPOCH


def _span_nodes(first: str, stop: str, levels: int) -> Column:
    """The least set of nodes ``(level, node)`` that fill ``first`` to ``stop`` (without it): at most six of a level."""
    low = lambda level: f"shiftright({first} + shiftleft(1L, 2 * ({level})) - 1, 2 * ({level}))"
    high = lambda level: f"shiftright({stop}, 2 * ({level}))"
    above = f"{low('l + 1')} < {high('l + 1')}"
    near = f"concat(sequence({low('l')}, {low('l')} + 5), sequence(4 * {high('l + 1')}, 4 * {high('l + 1')} + 2))"
    own = f"x >= {low('l')} AND x < {high('l')} AND NOT ({above} AND x >= 4 * {low('l + 1')} AND x < 4 * {high('l + 1')})"
    return F.expr(f"flatten(transform(sequence(0, {levels - 1}), l -> transform(filter(array_distinct({near}), x -> {own}), "
                  f"x -> struct(l AS level, x AS node))))")


def interval_join(
    facts: DataFrame,
    intervals: DataFrame,
    on: list[str],
    moment: str,
    start: str,
    end: str,
    how: str = "left",
) -> DataFrame:
    """Match ``start <= moment < end`` for closed intervals; one without an end stays open.

    An interval is written out as at most 98 nodes, however far it reaches, and each distinct moment of a key
    asks one node of each of 17 levels. Interval columns must not repeat fact names other than ``on``.
    """
    inside = F.coalesce(F.col(start) < F.col(end), F.col(start).isNotNull())
    last = F.lit(2 * 4 ** (MINUTE_LEVELS - 1))
    spans = intervals.filter(inside).withColumns({
        "_first": F.floor(_since_year_1(start) / MINUTE), "_stop": F.coalesce(F.floor((_since_year_1(end) - 1) / MINUTE) + 1, last)})
    spans = spans.withColumn("_n", F.explode(_span_nodes("_first", "_stop", MINUTE_LEVELS))).select(
        *intervals.columns, F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node"))
    asked = facts.select(*on, moment).filter(F.col(moment).isNotNull()).distinct()
    level = F.explode(F.sequence(F.lit(0), F.lit(MINUTE_LEVELS - 1)))
    asked = asked.withColumn("_minute", F.floor(_since_year_1(moment) / MINUTE)).withColumn("_level", level)
    asked = asked.withColumn("_node", F.expr("shiftright(_minute, 2 * _level)"))
    within = (F.col(moment) >= F.col(start)) & F.coalesce(F.col(moment) < F.col(end), F.lit(True))
    hits = lookup_join(asked, spans, [*on, "_level", "_node"], within, "inner").drop("_minute", "_level", "_node")
    return lookup_join(facts, hits, [*on, moment], how=how)


def latest_at(facts: DataFrame, rows: DataFrame, on: list[str], moment: str, start: str, values: list[str]) -> DataFrame:
    """Add ``start`` and ``values`` of the latest row at or before each moment, or NULL.

    A row is its node of each of 30 levels; a node keeps the latest of its rows (of those at one time the
    one with the largest values). What lies before a moment are at most three nodes of each level. So
    no key's rows are put in order, and there need not be a key.
    """
    place = F.expr(f"transform(sequence(0, {MICRO_LEVELS - 1}), l -> struct(l AS level, shiftright(_at, 2 * l) AS node))")
    tree = rows.filter(F.col(start).isNotNull()).withColumn("_at", _since_year_1(start)).withColumn("_n", F.explode(place))
    tree = tree.groupBy(*on, F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node")).agg(
        F.max(F.struct(start, *values)).alias("_latest"))
    asked = facts.select(*on, moment).filter(F.col(moment).isNotNull()).distinct().withColumn("_at", _since_year_1(moment))
    before = F.expr(
        f"concat(array(struct(0 AS level, _at AS node)), flatten(transform(sequence(0, {MICRO_LEVELS - 1}), l -> transform(filter(sequence(0, 2), "
        "j -> 4 * shiftright(_at, 2 * l + 2) + j < shiftright(_at, 2 * l)), j -> struct(l AS level, 4 * shiftright(_at, 2 * l + 2) + j AS node)))))")
    asked = asked.withColumn("_n", F.explode(before)).select(*on, moment, F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node"))
    found = lookup_join(asked, tree, [*on, "_level", "_node"], how="inner").groupBy(*on, moment).agg(F.max("_latest").alias("_latest"))
    joined = lookup_join(facts, found, [*on, moment])
    return joined.select(*[F.col(f"`{c}`") for c in facts.columns], "_latest.*")


def as_of(
    facts: DataFrame, history: DataFrame, key: str, moment: str, start: str, value: str, slot: int = SLOT
) -> DataFrame:
    """Add the latest ``value`` of the key at or before ``moment`` (J06); of reports at one time the largest.

    Facts and reports are put in order within their key and slot of time (microseconds). What holds when a slot
    opens comes from a scan of one row for each key and slot, so no task takes the history of a key.
    Facts without key or moment get NULL.
    """
    def timed(df: DataFrame, at: str, *columns: Column) -> DataFrame:
        place = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / slot)
        return df.select(F.col(key).alias("_key"), F.col(at).alias("_at"), place.alias("_slot"), *columns)

    reports = timed(history, start, F.struct(F.col(value)).alias("_set")).filter("_key IS NOT NULL AND _at IS NOT NULL")
    asking = timed(facts, moment, F.struct(*[F.col(f"`{c}`") for c in facts.columns]).alias("_fact"))
    # Facts that nothing can match stand alone instead of in one group.
    lone = F.col("_key").isNull() | F.col("_slot").isNull()
    asking = asking.withColumn("_slot", F.when(lone, F.monotonically_increasing_id()).otherwise(F.col("_slot")))
    order = Window.partitionBy("_key", "_slot").orderBy("_at", F.col("_fact").isNotNull(), "_set")
    rows = asking.unionByName(reports, allowMissingColumns=True)
    rows = rows.withColumn("_inside", F.last("_set", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    slots = timed(facts, moment).filter("_key IS NOT NULL AND _slot IS NOT NULL").unionByName(reports, allowMissingColumns=True)
    closing = F.max(F.when(F.col("_set").isNotNull(), F.struct("_at", "_set")))["_set"]
    slots = slots.groupBy("_key", "_slot").agg(closing.alias("_close"))
    earlier = Window.partitionBy("_key").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    opened = slots.select("_key", "_slot", F.last("_close", ignorenulls=True).over(earlier).alias("_open"))
    out = lookup_join(rows.filter("_fact IS NOT NULL"), opened, ["_key", "_slot"])
    out = out.filter("_fact IS NOT NULL").withColumn("_found", F.coalesce("_inside", "_open"))
    return out.select("_fact.*", F.col("_found")[value].alias(value))


def active_count(events: DataFrame, history: DataFrame) -> DataFrame:
    """Running sensors of the event's service when it happened.

    An unknown service counts as 1; a known one without any report as 0.
    """
    states = history.select(
        F.col("honeypot_type").alias("service"), F.col("updated_at").alias("_at"),
        F.col("cnt").alias("_cnt"))
    out = as_of(events, states, "service", "event_time", "_at", "_cnt")
    count = F.when(F.col("service").isNull(), 1).otherwise(F.coalesce("_cnt", F.lit(0)))
    return out.withColumn("active_honeypot_count", count.cast("int")).drop("_cnt")


def geo_by_range(facts: DataFrame, ranges: DataFrame, ip: str = "src_ip") -> DataFrame:
    """Add the attributes of the address range that holds the IP.

    ``ranges`` has disjoint ``ip_start``..``ip_end``. Both sides meet on the
    leading 16 bits; ranges that span several prefixes are listed under each.
    Loopback and malformed addresses match nothing.
    """
    prefixes = F.sequence(F.shiftright("ip_start", 16), F.shiftright("ip_end", 16))
    by_prefix = ranges.withColumn("_prefix", F.explode(prefixes))
    number = F.when(F.col(ip) != "127.0.0.1", ipv4_number(F.col(ip)))
    numbered = facts.withColumn("_ip", number).withColumn("_prefix", F.shiftright("_ip", 16))
    inside = F.col("_ip").between(F.col("ip_start"), F.col("ip_end"))
    return lookup_join(numbered, by_prefix, ["_prefix"], inside).drop(
        "_prefix", "_ip", "ip_start", "ip_end")
