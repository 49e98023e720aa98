"""Cluster sweeps: every k and every restart in the same passes over the table.

Equal points combine into one row with a weight first. Each pass compares a block of rows with the
centres of all fits that still move, and leaves one short row for each centre and task, which Spark adds
up; the driver holds centres, never rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trapline.session import materialise, spread

# Executors need not have this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- fixed values -----------------------------------------------------------
SEED = 42
RESTARTS = 10
MIN_ROWS = 5
MAX_CLUSTERS = 8
MIN_SHARE = 0.02
# --- end of fixed values ----------------------------------------------------

SEED_ROUNDS = 3
MOST_PASSES = 20
TOLERANCE = 1e-4
BLOCK = 2_048


@dataclass(frozen=True)
class Fit:
    k: int
    centres: np.ndarray
    cost: float
    sizes: list[int]

    @property
    def smallest_share(self) -> float:
        """A fit with fewer centres than asked for has an empty cluster."""
        return (min(self.sizes) if len(self.sizes) == self.k else 0) / max(sum(self.sizes), 1)


@dataclass(frozen=True)
class Points:
    """Distinct points with their weights, stored, and what they add up to."""

    table: DataFrame
    width: int
    rows: int
    mean: np.ndarray

    @classmethod
    def of(cls, df: DataFrame, array: str) -> Points:
        """Rows without an array take no part."""
        grouped = df.select(F.col(array).cast("array<double>").alias("x")).filter("x IS NOT NULL").groupBy("x").agg(F.count("*").alias("w"))
        stored = materialise(grouped, "points")
        # Tables too small to fill the cores are dealt out, so that a pass uses them all.
        found = stored.agg(F.count("*"), F.sum("w"), F.max(F.size("x"))).first()
        width = found[2] or 0
        points = cls(spread(stored, found[0]), width, found[1] or 0, np.zeros(width))
        if not points.rows:
            return points
        sums = points.added(lambda x, w: {0: (w.sum(), (x * w[:, None]).sum(axis=0))})
        return cls(points.table, width, points.rows, sums[0][1] / sums[0][0])

    def blocks(self, batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Points as stored and their weights."""
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, self.width)
            w = batch.column("w").to_numpy()
            for i in range(0, len(w), BLOCK):
                yield x[i:i + BLOCK], w[i:i + BLOCK]

    def _shipped(self) -> Points:
        """What tasks need of this; they get the rows from Spark."""
        return Points(None, self.width, self.rows, self.mean)

    def added(self, part: Callable[[np.ndarray, np.ndarray], dict[int, tuple[float, np.ndarray]]]) -> dict[int, tuple[float, np.ndarray]]:
        """One pass: ``part`` gives a number and a point for each key of a block; both are added up by key.

        It sees points from their mean, which keeps sums of squares small.
        """
        points, width = self._shipped(), self.width

        def run(batches):
            totals: dict[int, list] = {}
            for x, w in points.blocks(batches):
                for key, (n, s) in part(x - points.mean, w).items():
                    held = totals.setdefault(key, [0.0, np.zeros(width)])
                    held[0] += float(n)
                    held[1] += s
            columns = [pa.array(list(totals), pa.int32()), pa.array([n for n, _ in totals.values()], pa.float64())]
            sums = np.array([s for _, s in totals.values()], dtype=np.float64).reshape(len(totals), width)
            columns += [pa.array(sums[:, i]) for i in range(width)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", *[f"s{i}" for i in range(width)]])

        names = [f"s{i}" for i in range(width)]
        parts = self.table.mapInArrow(run, ", ".join(["key int", "n double", *[f"{c} double" for c in names]]))
        rows = parts.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).collect()
        return {r["key"]: (r["n"], np.array(r[2:], dtype=np.float64)) for r in rows}


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres."""
    out = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ centres.T) + (centres * centres).sum(axis=1)
    return np.maximum(out, 0.0)


def _draws(x: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) for each row, by its coordinates and the salt alone."""
    bits = np.ascontiguousarray(x + 0.0).view(np.uint64)
    out = np.full(len(x), np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(salt))
    with np.errstate(over="ignore"):
        for column in bits.T:
            out = (out ^ column) * np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(29)
        out *= np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(32)
    return ((out >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _candidates(points: Points, seeds: list[int], wanted: int) -> dict[int, np.ndarray]:
    """For each seed a point, then ``wanted`` more a round, drawn in proportion to their squared distance from those there."""
    found = {s: np.zeros((0, points.width)) for s in seeds}
    shipped = points._shipped()
    for turn in range(SEED_ROUNDS + 1):
        take = wanted if turn else 1

        def run(batches, found=found, turn=turn, take=take):
            best = {s: (np.zeros(0), np.zeros((0, shipped.width))) for s in found}
            for x, w in shipped.blocks(batches):
                for s, there in found.items():
                    far = _squared(x, there).min(axis=1) if len(there) else np.ones(len(x))
                    # The least of these are a weighted draw without putting back.
                    with np.errstate(divide="ignore"):
                        key = -np.log(_draws(x, s * 1_000 + turn)) / (w * far)
                    keys, rows = np.concatenate([best[s][0], key[far > 1e-18]]), np.concatenate([best[s][1], x[far > 1e-18]])
                    first = np.argsort(keys, kind="stable")[:take]
                    best[s] = keys[first], rows[first]
            for s, (keys, rows) in best.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s] * len(keys), pa.int64()), pa.array(keys), pa.array(list(rows), pa.list_(pa.float64()))], ["seed", "key", "x"])

        order = Window.partitionBy("seed").orderBy("key", "x")
        drawn = points.table.mapInArrow(run, "seed long, key double, x array<double>").withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= take)
        for r in drawn.orderBy("seed", "rn").collect():
            found[r["seed"]] = np.vstack([found[r["seed"]], r["x"]])
    return {s: there - points.mean for s, there in found.items()}


def _weighted_start(candidates: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` of the candidates far from one another, then moved to the means of the candidates near them."""
    rng = np.random.default_rng([seed, k])
    picked = [int(rng.choice(len(candidates), p=weight / weight.sum()))]
    while len(picked) < min(k, len(candidates)):
        chance = _squared(candidates, candidates[picked]).min(axis=1) * weight
        chance[picked] = 0
        if chance.sum() <= 0:
            break
        picked.append(int(rng.choice(len(candidates), p=chance / chance.sum())))
    centres = candidates[picked]
    for _ in range(MOST_PASSES):
        near = _squared(candidates, centres).argmin(axis=1)
        total = np.bincount(near, weight, len(centres))
        sums = np.stack([np.bincount(near, weight * c, len(centres)) for c in candidates.T], axis=1)
        centres = np.where(total[:, None] > 0, sums / np.maximum(total, 1e-300)[:, None], centres)
    return centres


def _near(x: np.ndarray, centres: np.ndarray, firsts: list[int]) -> np.ndarray:
    """The nearest centre of each fit, a column each; ``firsts`` says where fits begin (plus the end)."""
    d = _squared(x, centres)
    return np.stack([d[:, a:b].argmin(axis=1) + a for a, b in zip(firsts, firsts[1:])], axis=1)


def fit_points(points: Points, ks: list[int], restarts: int = RESTARTS) -> dict[int, Fit]:
    """Best of several restarts for every k (M05, M07), in about ``SEED_ROUNDS + MOST_PASSES`` passes for all of them."""
    seeds = [SEED + r for r in range(restarts)]
    candidates = _candidates(points, seeds, 2 * max(ks))
    base = np.cumsum([0, *[len(candidates[s]) for s in seeds]]).tolist()
    flat = np.vstack([candidates[s] for s in seeds])

    def nearest(x, w, centres=flat, firsts=base):
        near = _near(x, centres, firsts)
        held = np.bincount(near.ravel(), np.repeat(w, near.shape[1]), len(centres))
        return {i: (held[i], 0.0) for i in np.flatnonzero(held).tolist()}

    weights = np.zeros(len(flat))
    for i, (n, _) in points.added(nearest).items():
        weights[i] = n
    fits = [(k, s) for k in ks for s in seeds]
    centres = {}
    for k, s in fits:
        at = slice(base[seeds.index(s)], base[seeds.index(s) + 1])
        centres[k, s] = _weighted_start(flat[at], weights[at], k, s)
    moving = list(fits)
    for _ in range(MOST_PASSES):
        if not moving:
            break
        firsts = np.cumsum([0, *[len(centres[f]) for f in moving]]).tolist()
        now = np.vstack([centres[f] for f in moving])

        def means(x, w, centres=now, firsts=firsts):
            near = _near(x, centres, firsts)
            share = np.zeros((len(x), len(centres)))
            share[np.arange(len(x))[:, None], near] = w[:, None]
            sums, held = share.T @ x, share.sum(axis=0)
            return {i: (held[i], sums[i]) for i in np.flatnonzero(held).tolist()}

        found = points.added(means)
        # A centre that no row is near stays where it is.
        after = np.stack([found[i][1] / found[i][0] if i in found else now[i] for i in range(len(now))])
        still = []
        for f, a, b in zip(moving, firsts, firsts[1:]):
            centres[f] = after[a:b]
            if np.sqrt(((after[a:b] - now[a:b]) ** 2).sum(axis=1).max()) > TOLERANCE:
                still.append(f)
        moving = still
    costs = _costs(points, [centres[f] for f in fits])
    best: dict[int, Fit] = {}
    for (k, s), (cost, sizes) in zip(fits, costs):
        if k not in best or cost < best[k].cost:
            best[k] = Fit(k, centres[k, s] + points.mean, cost, sizes)
    return best


def _costs(points: Points, fits: list[np.ndarray]) -> list[tuple[float, list[int]]]:
    """Sum of squared distances and cluster sizes of each fit, from the differences themselves."""
    firsts = np.cumsum([0, *map(len, fits)]).tolist()
    flat = np.vstack(fits)

    def parts(x, w):
        near = _near(x, flat, firsts)
        held = np.bincount(near.ravel(), np.repeat(w, near.shape[1]), len(flat))
        out = {i: (held[i], 0.0) for i in np.flatnonzero(held).tolist()}
        for i in range(len(fits)):
            out[-1 - i] = (float((((x - flat[near[:, i]]) ** 2).sum(axis=1) * w).sum()), 0.0)
        return out

    found = points.added(parts)
    size = lambda i: int(found[i][0]) if i in found else 0
    return [(found[-1 - i][0] if found else 0.0, [size(j) for j in range(a, b)]) for i, (a, b) in enumerate(zip(firsts, firsts[1:]))]


def silhouettes(points: Points, fits: list[Fit]) -> list[float]:
    """Mean silhouette with squared Euclidean distance of each fit (M06), in two passes for all of them."""
    firsts = np.cumsum([0, *[len(f.centres) for f in fits]]).tolist()
    flat = np.vstack([f.centres - points.mean for f in fits])

    def moments(x, w):
        near = _near(x, flat, firsts)
        share = np.zeros((len(x), len(flat)))
        share[np.arange(len(x))[:, None], near] = w[:, None]
        sums, held, squares = share.T @ x, share.sum(axis=0), share.T @ (x * x).sum(axis=1)
        out = {i: (held[i], sums[i]) for i in np.flatnonzero(held).tolist()}
        return out | {-1 - i: (squares[i], 0.0) for i in list(out)}

    found = points.added(moments)
    size = np.array([found[i][0] if i in found else 0.0 for i in range(len(flat))])
    sums = np.stack([found[i][1] if i in found else np.zeros(points.width) for i in range(len(flat))])
    squares = np.array([found[-1 - i][0] if i in found else 0.0 for i in range(len(flat))])

    def scores(x, w):
        near = _near(x, flat, firsts)
        # Sum of squared distances of each row to all rows of a cluster.
        total = np.maximum((x * x).sum(axis=1)[:, None] * size - 2.0 * (x @ sums.T) + squares, 0.0)
        out, every = {}, np.arange(len(x))
        for i, (a, b) in enumerate(zip(firsts, firsts[1:])):
            own = total[every, near[:, i]] / np.maximum(size[near[:, i]] - 1, 1)
            others = np.where(size[a:b] > 0, total[:, a:b] / np.maximum(size[a:b], 1), np.inf)
            others[every, near[:, i] - a] = np.inf
            other = others.min(axis=1)
            top = np.maximum(own, other)
            score = np.where((size[near[:, i]] > 1) & np.isfinite(other) & (top > 0), (other - own) / np.where(top > 0, top, 1), 0.0)
            out[i] = (float((score * w).sum()), 0.0)
        return out

    added = points.added(scores)
    return [added[i][0] / points.rows if i in added else 0.0 for i in range(len(fits))]


def silhouette(df: DataFrame, array: str, cluster: str) -> float:
    """Mean silhouette of given clusters with squared Euclidean distance, in linear time."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = df.select(array_to_vector(F.col(array).cast("array<double>")).alias("x"), F.col(cluster).cast("double").alias("c"))
    return ClusteringEvaluator(
        featuresCol="x", predictionCol="c", metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(rows)


@dataclass(frozen=True)
class Sweep:
    best_k: int
    fits: dict[int, Fit]
    scores: dict[int, float]


def sweep(df: DataFrame, array: str, max_k: int = MAX_CLUSTERS, min_share: float = MIN_SHARE, restarts: int = RESTARTS) -> Sweep:
    """Choose k by silhouette; a k with a tiny cluster is out.

    Falls back to two clusters when every k is out.
    """
    points = Points.of(df, array)
    ks = list(range(2, min(max_k, points.rows - 1) + 1))
    if not ks:
        raise ValueError("a sweep needs three rows")
    fits = fit_points(points, ks, restarts)
    open_ = [k for k in ks if fits[k].smallest_share >= min_share]
    scores = dict(zip(open_, silhouettes(points, [fits[k] for k in open_]))) if open_ else {}
    best = max(scores, key=lambda k: (scores[k], -k)) if scores else 2
    return Sweep(best, fits, scores)


def assign(df: DataFrame, fit: Fit, array: str, output: str = "attack_cluster") -> DataFrame:
    """Add the nearest centre's cluster; ids follow the first coordinate of the centres."""
    def far(centre: np.ndarray):
        parts = F.zip_with(F.col(array).cast("array<double>"), F.array(*[F.lit(float(c)) for c in centre]), lambda x, c: (x - c) * (x - c))
        return F.aggregate(parts, F.lit(0.0), lambda total, part: total + part)

    distances = F.array(*[far(c) for c in sorted(fit.centres, key=tuple)])
    named = df.withColumn("_far", F.when(F.col(array).isNotNull(), distances))
    return named.withColumn(output, (F.array_position("_far", F.array_min("_far")) - 1).cast("int")).drop("_far")


def elbow(df: DataFrame, array: str, ks: list[int], restarts: int = RESTARTS) -> DataFrame:
    """Within-cluster cost and silhouette per k (M07); one k gives the fixed choice."""
    points = Points.of(df, array)
    fits = fit_points(points, ks, restarts)
    scores = silhouettes(points, [fits[k] for k in ks])
    return df.sparkSession.createDataFrame(
        [(k, float(fits[k].cost), float(score)) for k, score in zip(ks, scores)], "k int, inertia double, silhouette double")
