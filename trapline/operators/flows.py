"""Network flow tables: clean-up and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.functions.numbers import finite, finite_or_zero, log1p_clipped, number
from trapline.functions.text import clean_label

# --- fixed values -----------------------------------------------------------
BENIGN = "BENIGN"
MIN_RATE_SECONDS = 0.01
PASSTHROUGH = [
    "Flow Bytes/s", "Flow Packets/s", "Flow IAT Mean", "Flow IAT Std", "SYN Flag Count",
    "RST Flag Count", "FIN Flag Count", "Packet Length Mean", "Packet Length Std",
    "Down/Up Ratio",
]
LOG_COLUMNS = [
    "session_duration_s", "packet_count", "packets_per_min", "Flow Bytes/s", "Flow Packets/s"]

# Identity, time and port columns that would let a model memorise.
IDENTITY_COLUMNS = [
    "Flow_ID", "Timestamp", "Src_IP", "Dst_IP", "Source_IP", "Destination_IP",
    "Src_Port", "Dst_Port", "Source_Port", "Destination_Port",
]
# --- end of fixed values ----------------------------------------------------


def clean_labels(flows: DataFrame, label: str = "Label") -> DataFrame:
    """Repair class names and drop rows without one."""
    return flows.withColumn(label, clean_label(F.col(label))).filter(F.col(label).isNotNull())


def finite_columns(flows: DataFrame) -> DataFrame:
    """Infinite and NaN numbers become NULL."""
    doubles = [c for c, t in flows.dtypes if t in ("double", "float")]
    return flows.withColumns({c: finite(F.col(f"`{c}`")) for c in doubles})


def flow_features(flows: DataFrame) -> DataFrame:
    """Behaviour-like features of flows (X14); missing columns read as 0."""
    present = set(flows.columns)

    def value(name: str):
        return number(F.col(f"`{name}`").cast("string")) if name in present else F.lit(None).cast("double")

    seconds = value("Flow Duration") / 1e6
    packets = (F.coalesce(value("Total Fwd Packets"), F.lit(0.0))
               + F.coalesce(value("Total Backward Packets"), F.lit(0.0)))
    rate = F.when(seconds >= MIN_RATE_SECONDS, packets / (seconds / 60)).otherwise(0.0)
    keep = [c for c in ("flow_id", "Label", "_source_file") if c in present]
    return flows.select(
        *keep, finite_or_zero(seconds).alias("session_duration_s"),
        finite_or_zero(packets).alias("packet_count"), finite_or_zero(rate).alias("packets_per_min"),
        *[finite_or_zero(value(c)).alias(c) for c in PASSTHROUGH],
        F.lit(0.0).alias("avg_password_entropy"))


def log_flow_features(features: DataFrame) -> DataFrame:
    """Heavy-tailed flow columns as log(1 + x)."""
    return features.withColumns({c: log1p_clipped(F.col(f"`{c}`")) for c in LOG_COLUMNS})


def guard_leakage(flows: DataFrame, extra: tuple[str, ...] = ("_source_file",)) -> DataFrame:
    """Drop columns that identify a flow rather than describe it."""
    return flows.drop(*IDENTITY_COLUMNS, *extra)


def class_balance(flows: DataFrame, label: str = "Label") -> DataFrame:
    """Labelled rows and attack classes."""
    counts = flows.groupBy(label).agg(F.count("*").alias("n")).filter(F.col(label).isNotNull())
    return counts.agg(
        F.sum("n").alias("labelled"), F.count_if(F.col(label) != BENIGN).alias("attack_classes"))


def split_balance(flows: DataFrame, split: str = "split", label: str = "Label") -> DataFrame:
    """Rows per split and class."""
    return flows.groupBy(split, label).agg(F.count("*").alias("n"))


def mean_scores(scored: DataFrame, score: str, label: str = "Label") -> DataFrame:
    """Mean score of benign and other rows."""
    benign = F.upper(label) == BENIGN
    return scored.groupBy(benign.alias("is_benign")).agg(F.avg(score).alias("mean_score"))
