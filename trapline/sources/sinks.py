"""Distributed writers; every format is a folder of part files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def _flat_for_text(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without nesting."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    changes = {f.name: F.to_json(f.name) for f in df.schema.fields if isinstance(f.dataType, nested)}
    return df.withColumns(changes) if changes else df


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "error",
    partition_by: list[str] | None = None,
) -> str:
    """Write as parquet, csv or json with ISO timestamps."""
    out = _flat_for_text(df) if fmt == "csv" else df
    writer = out.write.mode(mode).partitionBy(*(partition_by or []))
    if fmt == "csv":
        writer = writer.option("header", True)
    if fmt in ("csv", "json"):
        writer = writer.option("timestampFormat", ISO)
    writer.format(fmt).save(path)
    return path


def write_model_outputs(
    path: str, modelled: DataFrame, profiles: DataFrame, explanations: DataFrame
) -> dict[str, str]:
    """Modelled rows, anomalies, cluster profiles and explanations."""
    parts = {
        "modeled": (modelled, ["attack_cluster"]),
        "anomalies": (modelled.filter("is_anomaly"), None),
        "cluster_profiles": (profiles, None),
        "anomaly_explanations": (explanations, None),
    }
    return {n: write_table(df, f"{path}/{n}", partition_by=by) for n, (df, by) in parts.items()}


def write_plans(plans: DataFrame, path: str) -> str:
    """Placement plans as JSON records."""
    return write_table(plans, path, "json")
