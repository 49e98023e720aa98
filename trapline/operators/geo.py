"""Sources on the map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.functions.classify import map_severity, volume_band
from trapline.operators.analytics import source_stats
from trapline.operators.filters import public_sources
from trapline.operators.lookup import geo_by_range, lookup_join


def source_counts(logs: DataFrame) -> DataFrame:
    return (logs.filter(F.length("src_ip") > 0).groupBy(F.col("src_ip").alias("ip"))
            .agg(F.count("*").alias("count")))


def located_sources(logs: DataFrame, geo: DataFrame) -> DataFrame:
    """Events per source with its place; sources without one are dropped.

    Events are counted before the join, so each source is looked up once.
    """
    return source_counts(logs).join(geo, "ip", "inner").select(
        "ip", "count", "lat", "lon", F.coalesce("city", F.lit("")).alias("city"),
        F.coalesce("country", F.lit("Unknown")).alias("country"),
        volume_band(F.col("count")).alias("band"))


def located_events(logs: DataFrame, geo: DataFrame) -> DataFrame:
    """Public events with their place, or ``Unknown location``."""
    events = public_sources(logs).withColumn("ip", F.col("src_ip"))
    place = F.when(F.length("city") > 0, F.concat_ws(", ", "city", "country"))
    return lookup_join(events, geo, ["ip"]).select(
        "id", "src_ip", "event_type", "created_at", "lat", "lon",
        F.coalesce(place, F.lit("Unknown location")).alias("place"),
        map_severity(F.col("event_type")).alias("severity"))


def attack_totals(logs: DataFrame, geo: DataFrame) -> DataFrame:
    """Attacks of located sources and the countries they come from."""
    return located_sources(logs, geo).agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("attacks"),
        F.count_distinct("country").alias("countries"))


def top_located(logs: DataFrame, geo: DataFrame, limit: int = 15) -> DataFrame:
    """Most active located sources."""
    return located_sources(logs, geo).orderBy(F.desc("count"), "ip").limit(limit)


def source_profiles(logs: DataFrame, geo: DataFrame) -> DataFrame:
    """Count, place and highest severity per located source."""
    names = F.array(F.lit("low"), F.lit("med"), F.lit("high"))
    located = source_stats(logs).join(geo.withColumnRenamed("ip", "src_ip"), "src_ip", "inner")
    return located.withColumn("severity", F.get(names, F.col("severity_rank") - 1)).drop("severity_rank")


def sessions_with_geo(sessions: DataFrame, ranges: DataFrame) -> DataFrame:
    """Sessions with the attributes of their source's address range."""
    return geo_by_range(sessions, ranges)
