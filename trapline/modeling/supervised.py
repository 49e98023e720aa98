"""Flow classification: splits, estimators, baseline anomaly score."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapline.modeling.iforest import Forest, fit_forest
from trapline.modeling.scale import standardise, winsorise
from trapline.modeling.stats import column_stats, quantiles, quoted
from trapline.operators.lookup import lookup_join
from trapline.session import materialise, spread

# --- fixed values -----------------------------------------------------------
TEST_SHARE = 0.20
SEED = 42
MAX_ITER = 2000
FOREST_TREES = 300
BASELINE_TREES = 400
LOW_QUANTILE, HIGH_QUANTILE = 0.001, 0.999
# --- end of fixed values ----------------------------------------------------

BUCKET_BITS = 16
#: What a task of a forest keeps and reads again for every level: each row with its values and its draws by every tree.
TASK_BYTES = 256 << 20
#: Rows that one task scores.
SCORED_ROWS = 200_000


def row_hash(df: DataFrame, key: list[str] | None = None, seed: int = SEED) -> Column:
    return F.xxhash64(*[F.col(quoted(c)) for c in (key or df.columns)], F.lit(seed))


def _cuts(hashed: DataFrame, label: str, wanted_rows: list[Column]) -> DataFrame:
    """Hash up to which so many rows of a class lie, per class; the numbers are of its ``total``.

    Hash buckets are counted first; only the bucket that holds a cut is looked
    at value by value, so no class is ever sorted.
    """
    bucket = F.shiftright("_h", 64 - BUCKET_BITS)
    counts = hashed.groupBy(label, bucket.alias("_b")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(label).orderBy("_b")
    totals = counts.withColumns({
        "upto": F.sum("n").over(upto), "total": F.sum("n").over(Window.partitionBy(label))})
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("cut"), n.alias("want")) for i, n in enumerate(wanted_rows)]))
    edges = (totals.select("*", wanted.alias("w")).withColumn("want", F.col("w.want"))
             .filter((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want")))
             .select(F.col(label), "_b", F.col("w.cut").alias("cut"), "want",
                     (F.col("upto") - F.col("n")).alias("before")))
    near = lookup_join(hashed.withColumn("_b", bucket), edges, [label, "_b"], how="inner")
    values = near.groupBy(label, "cut", "want", "before", "_h").agg(F.count("*").alias("n"))
    within = Window.partitionBy(label, "cut").orderBy("_h")
    ranked = values.withColumn("rank", F.col("before") + F.sum("n").over(within))
    return (ranked.filter(F.col("rank") - F.col("n") < F.col("want"))
            .groupBy(label).pivot("cut", list(range(len(wanted_rows)))).agg(F.max("_h")))


def _share(rows: Column, share: float) -> Column:
    """Test rows are rounded up, as in a usual split."""
    return F.ceil(F.round(rows * share, 6))


def stratified_split(df: DataFrame, label: str = "label", key: list[str] | None = None,
                     test: float = TEST_SHARE) -> DataFrame:
    """Add ``split``: test, val or train, in equal shares per class.

    The same rows always get the same split. Rows with equal keys stay
    together, so copies cannot leak from training into the test.
    """
    hashed = df.withColumn("_h", row_hash(df, key))
    wanted = [_share(F.col("total"), share) for share in (test, test + (1 - test) * test)]
    cuts = materialise(_cuts(hashed.select(label, "_h"), label, wanted), "cuts")
    joined = lookup_join(hashed, cuts, [label])
    split = (F.when(F.col("_h") <= F.col("0"), "test")
             .when(F.col("_h") <= F.col("1"), "val").otherwise("train"))
    return joined.withColumn("split", split).drop("_h", "0", "1")


def group_split(df: DataFrame, group: str, test: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Add ``split`` by whole groups, such as source files.

    Groups are cut by their hash as rows of a class are, so they are never put in order.
    """
    hashed = df.withColumn("_h", F.xxhash64(F.col(quoted(group)), F.lit(seed)))
    groups = hashed.select(F.lit(0).alias("_all"), F.col("_h")).distinct()
    n_test = _share(F.col("total"), test)
    cuts = materialise(_cuts(groups, "_all", [n_test, n_test + _share(F.col("total") - n_test, test)]), "cuts")
    upto = [cuts.select(c).scalar() for c in ("0", "1")]
    split = F.when(F.col("_h") <= upto[0], "test").when(F.col("_h") <= upto[1], "val").otherwise("train")
    return hashed.withColumn("split", split).drop("_h")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Add ``weight``: rows / (classes * rows of the class)."""
    counts = materialise(df.groupBy(label).agg(F.count("*").alias("_n")), "classes")
    shared = counts.agg(F.sum("_n").alias("rows"), F.count("*").alias("classes")).first()
    weight = F.lit(float(shared["rows"])) / (F.lit(float(shared["classes"])) * F.col("_n"))
    return lookup_join(df, counts.select(label, weight.alias("weight")), [label], how="inner")


def prepare(df: DataFrame, columns: list[str], fit_on: DataFrame) -> DataFrame:
    """Median imputation and standard scaling, fitted on the training rows."""
    medians = quantiles(fit_on, columns, [0.5])

    def fill(frame: DataFrame) -> DataFrame:
        return frame.withColumns({
            c: F.coalesce(F.col(quoted(c)).cast("double"), F.lit(medians[c][0])) for c in columns})

    return standardise(fill(df), columns, fit_on=fill(fit_on))


def _classifier(name: str, rows: int, trees: int, depth: int):
    if name == "lr":
        return LogisticRegression(
            maxIter=MAX_ITER, family="multinomial", regParam=1.0 / max(rows, 1), standardization=False,
            featuresCol="features", labelCol="label_index")
    return RandomForestClassifier(
        numTrees=trees, maxDepth=depth, seed=SEED, weightCol="weight",
        featuresCol="features", labelCol="label_index")


def train_classifier(train: DataFrame, columns: list[str], label: str = "label", model: str = "rf",
                     trees: int = FOREST_TREES, depth: int = 30) -> PipelineModel:
    """Fit a logistic regression or a balanced random forest.

    Trees grow until their leaves are pure, or to ``depth``, whose default is the
    most the library allows.
    """
    rows = train.count()
    if model == "rf":
        row_bytes = 4 * trees + 8 * len(columns) + 64
        train = class_weights(spread(train, rows, most=max(1, TASK_BYTES // row_bytes)), label)
    else:
        train = spread(train, rows)
    indexer = StringIndexer(inputCol=label, outputCol="label_index").setHandleInvalid("keep").fit(train)
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels)
    stages = [
        indexer, VectorAssembler(inputCols=columns, outputCol="features"),
        _classifier(model, rows, trees, depth), back]
    return Pipeline(stages=stages).fit(train)


def fit_baseline(benign: DataFrame, columns: list[str], trees: int = BASELINE_TREES):
    """Forest over winsorised, scaled benign rows; returns forest and moments."""
    tight = winsorise(benign, columns, LOW_QUANTILE, HIGH_QUANTILE)
    moments = column_stats(tight, columns)
    rows = moments[columns[0]].count
    stored = materialise(scale_with(tight, columns, moments), "baseline")
    return fit_forest(stored.select("scaled"), "scaled", rows, trees=trees), moments


def scale_with(df: DataFrame, columns: list[str], moments) -> DataFrame:
    values = ", ".join(
        f"(double({quoted(c)}) - {moments[c].mean!r}D) / {(moments[c].std_pop or 1.0)!r}D" for c in columns)
    return df.withColumn("scaled", F.expr(f"array({values})"))


def baseline_scores(
    df: DataFrame, columns: list[str], forest: Forest, moments, rows: int
) -> DataFrame:
    """Score every row against the benign baseline; higher is worse."""
    scored = forest.score(spread(scale_with(df, columns, moments), rows), "scaled", "_score")
    return scored.withColumn("baseline_anomaly_score", -F.col("_score")).drop("_score", "scaled")
