"""Principal components with centring and fixed signs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import PCA
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.ml.functions import vector_to_array

from trapline.modeling.scale import to_vector


@dataclass(frozen=True)
class Components:
    """A fitted model; arrays are as wide as the input has columns."""

    model: object
    offset: list[float]
    sign: list[float]
    explained: list[float]

    def width(self, share: float = 0.95) -> int:
        """Fewest components that explain more than ``share``."""
        total = 0.0
        for k, part in enumerate(self.explained, 1):
            total += part
            if total > share:
                return k
        return len(self.explained)

    def transform(self, df: DataFrame, array: str, output: str, k: int) -> DataFrame:
        """Add the first ``k`` coordinates as an array.

        The library model projects without centring; the projected mean is
        subtracted afterwards.
        """
        shift = F.array(*map(F.lit, self.offset))
        flip = F.array(*map(F.lit, self.sign))
        projected = vector_to_array(F.col("_components"))
        centred = F.transform(
            F.slice(projected, 1, k), lambda v, i: (v - F.get(shift, i)) * F.get(flip, i))
        vectors = to_vector(df, array, "_vector")
        return (self.model.transform(vectors).withColumn(output, centred)
                .drop("_vector", "_components"))


def fit_components(df: DataFrame, array: str, width: int) -> Components:
    """Fit all components of an array column of the given width."""
    vectors = to_vector(df.select(array), array, "_vector")
    model = PCA(k=width, inputCol="_vector", outputCol="_components").fit(vectors)
    mean = vectors.select(Summarizer.mean(F.col("_vector"))).first()[0].toArray()
    loadings = model.pc.toArray()
    sign = [1.0 if col[abs(col).argmax()] >= 0 else -1.0 for col in loadings.T]
    return Components(
        model, [float(v) for v in mean @ loadings], sign,
        [float(v) for v in model.explainedVariance.toArray()])
