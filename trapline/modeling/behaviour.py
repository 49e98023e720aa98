"""The behaviour model of sessions, from features to clusters and anomalies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.modeling.clusters import cluster_profiles
from trapline.modeling.explain import explain_anomalies
from trapline.modeling.iforest import TREES, flag_anomalies
from trapline.modeling.kmeans import MIN_ROWS, RESTARTS, Sweep, assign, sweep
from trapline.modeling.pca import Components, fit_components
from trapline.modeling.scale import Scaler, fit_scaler, model_columns
from trapline.session import materialise


@dataclass(frozen=True)
class Reduced:
    table: DataFrame
    rows: int
    scaler: Scaler
    components: Components


def reduce_features(features: DataFrame, with_counts: bool = True) -> Reduced:
    """Scaled values, components for 95 % of the variance, and two map coordinates.

    The result is stored, because fits read it many times.
    """
    table = materialise(features, "features")
    scaler = fit_scaler(table, model_columns(table, with_counts))
    scaled = scaler.transform(table)
    parts = fit_components(scaled, "scaled", len(scaler.columns))
    k = max(parts.width(), 2)
    reduced = parts.transform(scaled, "scaled", "reduced", k).withColumns({
        "pca1": F.get("reduced", F.lit(0)), "pca2": F.get("reduced", F.lit(1))})
    if parts.width() < k:
        reduced = reduced.withColumn("reduced", F.slice("reduced", 1, parts.width()))
    stored = materialise(reduced, "reduced")
    return Reduced(stored, stored.count(), scaler, parts)


def cluster(reduced: Reduced, restarts: int = RESTARTS) -> tuple[DataFrame, Sweep]:
    """Add ``attack_cluster`` by the best k."""
    chosen = sweep(reduced.table, "reduced", restarts=restarts)
    return assign(reduced.table, chosen.fits[chosen.best_k], "reduced"), chosen


@dataclass(frozen=True)
class Modelled:
    table: DataFrame
    profiles: DataFrame
    explanations: DataFrame
    sweep: Sweep
    components: Components


def model_sessions(features: DataFrame, restarts: int = RESTARTS, trees: int = TREES) -> Modelled | None:
    """Clusters, map coordinates, anomalies and their explanations.

    Too few sessions give no model.
    """
    if features.limit(MIN_ROWS).count() < MIN_ROWS:
        return None
    reduced = reduce_features(features)
    clustered, chosen = cluster(reduced, restarts)
    table = flag_anomalies(clustered, "reduced", reduced.rows, "session_id", trees)
    return Modelled(
        table.drop("scaled", "reduced"), cluster_profiles(table, reduced.scaler.columns),
        explain_anomalies(table, reduced.scaler), chosen, reduced.components)
