"""Places of pattern matches, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pieces(text: Column, pattern: str, group: int = 0) -> Column:
    """``(gap, match, value)`` for each match, leftmost and non-overlapping.

    ``gap`` is the text since the match before, so places are running sums of
    lengths; ``value`` is the group. Null if nothing matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("match"), value.alias("value"))
    return F.when(text.rlike(pattern), zipped)
