"""Isolation forest: samples drawn and scores computed by Spark.

Each tree sees at most 256 rows, so only tree building runs per group; the
sample per tree is fixed by hashes of the row key and does not depend on
partitioning.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trapline.modeling.stats import quantiles
from trapline.session import materialise, spread

# Executors need not have this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- fixed values -----------------------------------------------------------
TREES = 100
SAMPLE = 256
SEED = 42
CONTAMINATION = 0.05
EULER = 0.5772156649015329
# --- end of fixed values ----------------------------------------------------

OVERSAMPLE = 4
BLOCK_ROWS = 128  # rows that go through all trees together
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, length double"


def mean_path(n: float) -> float:
    """Average depth of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def grow_tree(rows: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Random splits until rows are single, equal or at the depth limit."""
    nodes: list[tuple] = []
    pending = [(0, rows, 0)]
    used = 1
    while pending:
        node, part, depth = pending.pop()
        spread = part.max(axis=0) > part.min(axis=0)
        if len(part) <= 1 or depth >= limit or not spread.any():
            nodes.append((node, -1, 0.0, -1, -1, depth + mean_path(len(part))))
            continue
        feature = int(rng.choice(np.flatnonzero(spread)))
        low, high = part[:, feature].min(), part[:, feature].max()
        threshold = float(rng.uniform(low, high))
        below = part[:, feature] <= threshold
        if below.all():
            threshold = float(low)
            below = part[:, feature] <= threshold
        nodes.append((node, feature, threshold, used, used + 1, 0.0))
        pending += [(used, part[below], depth + 1), (used + 1, part[~below], depth + 1)]
        used += 2
    return nodes


def path_lengths(nodes: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Mean path length of each row over all trees.

    All trees of a block of rows go down a level at a time. A leaf is its own child, so nothing has to be
    told apart on the way.
    """
    rows = np.ascontiguousarray(rows)
    leaf = nodes["feature"] < 0
    own = np.arange(len(leaf))
    feature = np.where(leaf, 0, nodes["feature"])
    # The child of node i for a value at most the threshold is at 2 i + 1, the other one at 2 i.
    child = np.column_stack([np.where(leaf, own, nodes["right"]), np.where(leaf, own, nodes["left"])]).astype(np.intp).ravel()
    total = np.zeros(len(rows))
    for begin in range(0, len(rows), BLOCK_ROWS):
        block = rows[begin:begin + BLOCK_ROWS]
        values = block.ravel()
        first = np.arange(len(block)) * block.shape[1]
        at = np.repeat(np.asarray(nodes["root"], dtype=np.intp)[:, None], len(block), axis=1)
        while not leaf.take(at).all():
            below = values.take(feature.take(at) + first) <= nodes["threshold"].take(at)
            at = child.take(2 * at + below)
        total[begin:begin + BLOCK_ROWS] = nodes["length"].take(at).sum(axis=0)
    return total / len(nodes["root"])


@dataclass(frozen=True)
class Forest:
    """Fitted trees; at most 511 nodes each."""

    nodes: dict[str, np.ndarray]
    trees: int
    sample: int
    offset: float | None = None

    def score(self, df: DataFrame, array: str, output: str) -> DataFrame:
        """Add the score: -1 is most abnormal, 0 most normal."""
        shared = df.sparkSession.sparkContext.broadcast(self.nodes)
        scale = mean_path(self.sample) or 1.0

        @F.pandas_udf("double")
        def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            nodes = shared.value
            for batch in batches:
                rows = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, 1))
                yield pd.Series(-np.power(2.0, -path_lengths(nodes, rows) / scale))

        return df.withColumn(output, udf(F.col(array)))


def fit_forest(df: DataFrame, array: str, rows: int, key: str | None = None, trees: int = TREES,
               sample: int = SAMPLE, seed: int = SEED) -> Forest:
    """Fit on the whole table (M10, M11); ``rows`` is its row count.

    With a unique ``key`` the sample does not depend on partitioning. Without
    one, each row of the stored table draws on its own, so that any number of
    equal rows is sampled in proportion.
    """
    identity = F.monotonically_increasing_id() if key is None else F.col(key)
    size = min(sample, rows)
    # Each row joins a few random trees, so that every tree gets about
    # OVERSAMPLE * size candidates; rows of large inputs join one or none.
    per_row = OVERSAMPLE * size * trees / max(rows, 1)
    joins = trees if rows <= size else min(trees, max(1, math.ceil(per_row)))
    draw = F.abs(F.xxhash64("row_key", F.lit(seed), F.lit("pool")).cast("double")) / float(2 ** 63)
    slots = F.sequence(F.lit(0), F.lit(joins - 1))
    if joins < trees:
        slots = F.array_distinct(F.transform(
            slots, lambda j: F.pmod(F.xxhash64("row_key", F.lit(seed), j), F.lit(trees)).cast("int")))
    chosen = (
        df.select(identity.alias("row_key"), F.col(array).alias("x"))
        .filter(draw <= min(1.0, per_row))
        .withColumn("tree", F.explode(slots))
        .withColumn("h", F.xxhash64("row_key", F.lit(seed), F.lit("rank"), "tree")))
    order = Window.partitionBy("tree").orderBy("h", "row_key")
    drawn = chosen.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= size)
    limit = math.ceil(math.log2(max(size, 2)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        tree = int(pdf["tree"].iloc[0])
        grown = grow_tree(np.stack(pdf["x"].to_numpy()), np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(grown, columns=["node", "feature", "threshold", "left", "right", "length"])
        out.insert(0, "tree", tree)
        return out

    # At most trees * (2 * sample - 1) short rows reach the driver.
    table = drawn.select("tree", "rn", "x").groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()
    table = table.sort_values(["tree", "node"])
    counts = table.groupby("tree").size()
    roots = np.concatenate([[0], np.cumsum(counts.to_numpy())[:-1]])
    base = np.repeat(roots, counts.to_numpy())
    nodes = {
        "root": roots, "feature": table["feature"].to_numpy(), "threshold": table["threshold"].to_numpy(),
        "left": table["left"].to_numpy() + base, "right": table["right"].to_numpy() + base,
        "length": table["length"].to_numpy()}
    return Forest(nodes, len(counts), size)


def flag_anomalies(df: DataFrame, array: str, rows: int, key: str | None = None,
                   trees: int = TREES, contamination: float = CONTAMINATION) -> DataFrame:
    """Add ``anomaly_score`` (negative is abnormal) and ``is_anomaly``.

    The offset is the contamination quantile of the scores; they are stored
    once, since both the quantile and the result read them.
    """
    forest = fit_forest(df, array, rows, key, trees)
    scored = materialise(forest.score(spread(df, rows), array, "_score"), "scores")
    offset = quantiles(scored, ["_score"], [contamination])["_score"][0]
    score = F.col("_score") - F.lit(offset)
    return scored.withColumns({"anomaly_score": score, "is_anomaly": score < 0}).drop("_score")
