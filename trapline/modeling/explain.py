"""Why a row is anomalous: its most deviating features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.modeling.scale import Scaler
from trapline.modeling.stats import column_stats, quoted


def explain_anomalies(df: DataFrame, scaler: Scaler, top: int = 3) -> DataFrame:
    """Top features of each anomaly by absolute scaled value.

    ``df`` has the features, ``scaled``, ``is_anomaly``, ``anomaly_score`` and
    ``attack_cluster``. All work is within the row.
    """
    means = {c: s.mean for c, s in column_stats(df, scaler.columns).items()}
    entries = ", ".join(
        f"named_struct('z', abs(scaled[{i}]), 'rank', -{i}, 'feature', '{c}', 'up', scaled[{i}] > 0, "
        f"'value', double({quoted(c)}), 'average', {means[c]!r}D)"
        for i, c in enumerate(scaler.columns))
    best = F.slice(F.sort_array(F.expr(f"array({entries})"), asc=False), 1, top)
    reasons = F.transform(best, lambda e: F.struct(
        e["feature"].alias("feature"), F.when(e["up"], "high").otherwise("low").alias("direction"),
        F.round(e["z"], 2).alias("z_score"), F.round(e["value"], 2).alias("value"),
        F.round(e["average"], 2).alias("average")))
    return df.filter("is_anomaly").select(
        "session_id", F.round("anomaly_score", 4).alias("anomaly_score"), "attack_cluster",
        reasons.alias("reasons"))
