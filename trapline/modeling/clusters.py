"""Reports over clustered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.modeling.stats import quantile_table, quoted
from trapline.operators.lookup import lookup_join

# --- fixed values: cluster naming rules ---------------------------------------
SCANNER, STUFFING = "Scanner / Probe", "Brute Force / Credential Stuffing"
BOT, MANUAL = "High Automation Bot", "Interactive / Manual"
# --- end of fixed values ----------------------------------------------------


def cluster_profiles(df: DataFrame, columns: list[str], cluster: str = "attack_cluster") -> DataFrame:
    """Mean of each feature per cluster."""
    return df.groupBy(cluster).agg(*[F.avg(quoted(c)).alias(c) for c in columns])


def cluster_anomalies(df: DataFrame, cluster: str = "attack_cluster") -> DataFrame:
    """Normal and anomalous rows per cluster."""
    return df.groupBy(cluster).pivot("is_anomaly", [False, True]).count().select(
        cluster, F.coalesce("false", F.lit(0)).alias("normal"),
        F.coalesce("true", F.lit(0)).alias("anomalous"))


def cluster_summary(df: DataFrame, columns: list[str], cluster: str = "attack_cluster") -> DataFrame:
    """Count, mean and median of each feature per cluster (A19); ``df`` should be stored."""
    values = df.select(cluster, *[F.col(quoted(c)).cast("double").alias(c) for c in columns])
    means = values.unpivot([cluster], [quoted(c) for c in columns], "feature", "value").groupBy(
        cluster, "feature").agg(F.count("value").alias("count"), F.avg("value").alias("mean"))
    medians = quantile_table(values, columns, [0.5], [cluster]).select(
        F.col(cluster).alias("_cluster"), F.col("name").alias("_feature"), F.col("value").alias("median"))
    same = F.col(cluster).eqNullSafe(F.col("_cluster")) & (F.col("feature") == F.col("_feature"))
    return means.join(medians, same, "left").drop("_cluster", "_feature")


def name_clusters(profiles: DataFrame, cluster: str = "attack_cluster") -> DataFrame:
    """Name of each cluster from its mean features."""
    name = (F.when(F.col("command_count") < 2, SCANNER)
            .when(F.col("avg_password_entropy") > 3, STUFFING)
            .when(F.col("commands_per_min") > 10, BOT).otherwise(MANUAL))
    return profiles.select(cluster, name.alias("attack_type"))


def with_cluster_names(df: DataFrame, names: DataFrame, cluster: str = "attack_cluster") -> DataFrame:
    """Add each row's cluster name."""
    return lookup_join(df, names, [cluster])
