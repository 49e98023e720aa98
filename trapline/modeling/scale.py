"""Feature selection, winsorising, log and standard scaling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.modeling.stats import column_stats, quantiles, quoted, varying_columns
from trapline.schema import COUNT_COLUMNS

# --- fixed values: never model inputs ----------------------------------------
EXCLUDED = [
    "session", "session_id", "src_ip", "session_start", "session_end", "source",
    "attack_cluster", "pca1", "pca2", "is_anomaly", "anomaly_score",
]
UPPER_QUANTILE = 0.99
CLIP = 5.0
# --- end of fixed values ----------------------------------------------------


def model_columns(df: DataFrame, with_counts: bool = True) -> list[str]:
    """Numeric columns that may enter the model."""
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
    names = [c for c, t in df.dtypes if t in numeric and c not in EXCLUDED]
    return names if with_counts else [c for c in names if c not in COUNT_COLUMNS]


@dataclass(frozen=True)
class Scaler:
    """Fitted scaling: clip to [0, upper], log(1 + x), standardise, clip."""

    columns: list[str]
    upper: dict[str, float]
    mean: dict[str, float]
    std: dict[str, float]

    def _log(self, c: str) -> str:
        return f"log1p(least(greatest(nvl(double({quoted(c)}), 0D), 0D), {self.upper[c]!r}D))"

    def scaled_sql(self, c: str) -> str:
        z = f"({self._log(c)} - {self.mean[c]!r}D) / {self.std[c]!r}D"
        return f"least(greatest({z}, -{CLIP}D), {CLIP}D)"

    def transform(self, df: DataFrame, output: str = "scaled") -> DataFrame:
        """Add the scaled values as one array, in column order."""
        values = ", ".join(self.scaled_sql(c) for c in self.columns)
        return df.withColumn(output, F.expr(f"array({values})"))


def fit_scaler(df: DataFrame, columns: list[str] | None = None, winsorise: bool = True) -> Scaler:
    """Fit on the whole table: ranges, upper quantiles, then moments of the logs."""
    columns = model_columns(df) if columns is None else columns
    clean = df.selectExpr(*[f"greatest(nvl(double({quoted(c)}), 0D), 0D) AS {quoted(c)}" for c in columns])
    kept = varying_columns(column_stats(clean, columns))
    if winsorise:
        upper = {c: q[0] for c, q in quantiles(clean, kept, [UPPER_QUANTILE]).items()}
    else:
        upper = dict.fromkeys(kept, float("1e308"))
    logs = clean.selectExpr(*[f"log1p(least({quoted(c)}, {upper[c]!r}D)) AS {quoted(c)}" for c in kept])
    moments = column_stats(logs, kept)
    # A column without spread scales by 1, so that it becomes 0.
    std = {c: (m.std_pop if m.std_pop and m.std_pop > 1e-15 else 1.0) for c, m in moments.items()}
    return Scaler(kept, upper, {c: m.mean for c, m in moments.items()}, std)


def winsorise(df: DataFrame, columns: list[str], low: float, high: float) -> DataFrame:
    """Clip columns to their quantiles."""
    bounds = quantiles(df, columns, [low, high])
    return df.withColumns({
        c: F.expr(f"least(greatest(double({quoted(c)}), {bounds[c][0]!r}D), {bounds[c][1]!r}D)")
        for c in columns})


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fill NULL with the column's median."""
    medians = quantiles(df, columns, [0.5])
    return df.withColumns({
        c: F.coalesce(F.col(quoted(c)).cast("double"), F.lit(medians[c][0])) for c in columns})


def standardise(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Subtract the mean and divide by the population deviation."""
    stats = column_stats(df if fit_on is None else fit_on, columns)
    return df.withColumns({
        c: (F.col(quoted(c)).cast("double") - F.lit(s.mean)) / F.lit(s.std_pop or 1.0)
        for c, s in stats.items()})


def to_vector(df: DataFrame, array: str, output: str) -> DataFrame:
    return df.withColumn(output, array_to_vector(F.col(array).cast("array<double>")))
