"""Duplicate rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(df: DataFrame, key: str = "id") -> Column:
    """Hash of all columns but the key, in name order, NULLs included."""
    names = sorted(c for c in df.columns if c != key)
    return F.md5(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}))


def duplicate_count(df: DataFrame, key: str = "id") -> DataFrame:
    """Rows that repeat an earlier row."""
    groups = df.select(content_hash(df, key).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    return groups.agg(F.sum(F.col("n") - 1).alias("dupes"))


def worst_duplicates(df: DataFrame, limit: int = 10, key: str = "id") -> DataFrame:
    """Largest groups of equal rows: the row to keep and the copies."""
    return (df.select(key, content_hash(df, key).alias("h")).groupBy("h")
            .agg(F.min(key).alias("keep_id"), F.count("*").alias("copies"))
            .filter("copies > 1").orderBy(F.desc("copies"), "keep_id").limit(limit).drop("h"))


def deduplicate(df: DataFrame, key: str = "id") -> DataFrame:
    """Keep the row with the lowest key of each group of equal rows.

    The rows of a group are equal but for the key, so the lowest key is all
    the group has to carry: a group of any size combines before the shuffle.
    """
    others = [c for c in df.columns if c != key]
    return df.groupBy(*others).agg(F.min(key).alias(key)).select(*df.columns)


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys and no spacing; NULL when malformed."""
    return F.to_json(F.try_parse_json(text))


def deduplicate_documents(logs: DataFrame, document: str = "raw_json", key: str = "id") -> DataFrame:
    """Keep the lowest key per JSON document, whatever its key order."""
    text = F.coalesce(canonical_json(F.col(document)), F.col(document))
    marked = logs.withColumn("_doc", F.unhex(F.md5(text)))
    least = marked.groupBy(F.col("_doc").alias("_mark")).agg(F.min(key).alias("_least"))
    same = F.col("_doc").eqNullSafe(F.col("_mark")) & F.col(key).eqNullSafe(F.col("_least"))
    # Only short marks are grouped; rows that share document and key are copies, of which one stays.
    return marked.join(least, same, "left_semi").dropDuplicates(["_doc"]).select(*logs.columns)
