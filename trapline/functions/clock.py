"""Timestamp parsing and ages relative to a given moment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = r"(?i)(Z|[+-]\d{2}:?\d{2})$"


def parse_utc(text: Column) -> Column:
    """ISO text to timestamp. Text without an offset means UTC; bad text is NULL."""
    text = F.trim(text)
    return F.try_to_timestamp(F.when(text.rlike(ZONE), text).otherwise(F.concat(text, F.lit("Z"))))


def hour_bucket(iso_text: Column, parsed: Column) -> Column:
    """yyyyMMddHH in the timestamp's own offset, read off the ISO text."""
    digits = F.regexp_replace(F.substring(iso_text, 1, 13), "[^0-9]", "")
    return F.when(F.length(digits) == 10, digits).otherwise(F.date_format(parsed, "yyyyMMddHH"))


def age_text(moment: Column, asof: Column) -> Column:
    """Age such as ``5m ago``; the largest fitting unit of s, m, h and d."""
    seconds = F.floor((F.unix_micros(asof) - F.unix_micros(moment)) / 1000000)
    minutes = F.floor(seconds / 60)
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24 + 0.5)
    amount = (F.when(seconds < 60, F.concat(seconds, F.lit("s")))
              .when(minutes < 60, F.concat(minutes, F.lit("m")))
              .when(hours < 24, F.concat(hours, F.lit("h")))
              .otherwise(F.concat(days, F.lit("d"))))
    return F.when(moment.isNull(), F.lit("—")).otherwise(F.concat(amount, F.lit(" ago")))
