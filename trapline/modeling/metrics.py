"""Quality measures of classifiers and scores."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(predicted: DataFrame, label: str = "label", prediction: str = "predicted") -> DataFrame:
    """Rows per true and predicted class."""
    return predicted.groupBy(label, prediction).agg(F.count("*").alias("n"))


def class_report(predicted: DataFrame, label: str = "label", prediction: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    cells = confusion(predicted, label, prediction).select(
        F.explode(F.array(
            F.struct(F.col(label).alias("class"), F.lit(True).alias("is_true")),
            F.struct(F.col(prediction).alias("class"), F.lit(False).alias("is_true")))).alias("e"),
        "n", (F.col(label) == F.col(prediction)).alias("hit"))
    per_class = cells.groupBy(F.col("e.class").alias("class")).agg(
        F.sum(F.when(F.col("e.is_true"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("e.is_true"), F.col("n")).otherwise(0)).alias("given"),
        F.sum(F.when(F.col("e.is_true") & F.col("hit"), F.col("n")).otherwise(0)).alias("hits"))
    precision = F.coalesce(F.try_divide("hits", "given"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(precision * recall * 2, precision + recall), F.lit(0.0))
    return per_class.select(
        "class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


def accuracy(predicted: DataFrame, label: str = "label", prediction: str = "predicted") -> DataFrame:
    """Share of correct rows."""
    return predicted.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def auc(scored: DataFrame, score: str, positive: str) -> float:
    """Area under the ROC curve, exact.

    The evaluator sorts and integrates in parallel; equal scores count half.
    """
    return BinaryClassificationEvaluator(
        rawPredictionCol=score, labelCol=positive, metricName="areaUnderROC", numBins=0).evaluate(
        scored.withColumn(positive, F.col(positive).cast("double")))
