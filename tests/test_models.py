from __future__ import annotations

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from trapline.catalog import model_queries
from trapline.fixtures import Tables
from trapline.modeling import clusters, iforest, kmeans, metrics, pca, scale, stats, supervised
from trapline.operators import flows


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    a = np.round(rng.gamma(1.0, 5.0, 20000), 3)
    b = rng.integers(0, 4, 20000).astype(float)
    rows = [(i, float(x), None if i % 11 == 0 else float(y), 7.0) for i, (x, y) in enumerate(zip(a, b))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(6)


def arrays(table):
    pdf = table.toPandas()
    return pdf["a"].to_numpy(), pdf["b"].dropna().to_numpy()


def test_quantiles_are_exact(table):
    a, b = arrays(table)
    probs = [0.0, 0.001, 0.25, 0.5, 0.99, 0.999, 1.0]
    got = stats.quantiles(table, ["a", "b", "c"], probs)
    assert got["a"] == pytest.approx(list(np.quantile(a, probs)), rel=1e-14)
    assert got["b"] == pytest.approx(list(np.quantile(b, probs)), rel=1e-14)
    assert got["c"] == [7.0] * 7


def test_quantiles_of_awkward_values(spark):
    tiny, huge = 5e-324, 1.7976931348623157e308
    x = [0.0, -0.0, tiny, -tiny, 2.2250738585072014e-308, -2.2250738585072009e-308, huge, -huge, float("inf"), float("-inf"), 1.0,
         1.0000000000000002, 0.9999999999999999, 2.0, 4.0, 8.0, 3.9999999999999996, -1.5, -1.5, 1e-200, 1e200]
    rng = np.random.default_rng(8)
    x += [float(v) for v in rng.integers(0, 2**63, 300, dtype=np.int64).view(np.float64) if np.isfinite(v)]
    df = spark.createDataFrame([(v,) for v in x] + [(None,)], "x double").repartition(3)
    order = sorted(x)
    probs = [i / (len(x) - 1) for i in range(len(x))]
    got = stats.quantiles(df, ["x"], probs)["x"]
    for p, v in zip(probs, got):
        low, high = order[int(np.floor(p * (len(x) - 1)))], order[int(np.ceil(p * (len(x) - 1)))]
        assert v == low or low <= v <= high
    ranks = spark.createDataFrame([(v,) for v in x], "x double").selectExpr("x", f"{stats._ordered('x')} AS bits")
    by_bits = [r["x"] for r in ranks.orderBy("bits").collect()]
    assert by_bits == order
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "x double")
    assert stats.quantiles(nan, ["x"], [0.0, 0.5])["x"] == [1.0, 2.0] and np.isnan(stats.quantiles(nan, ["x"], [1.0])["x"][0])
    nothing = spark.createDataFrame([(None, None)], "x double, y double")
    assert stats.quantiles(nothing, ["x", "y"], [0.5]) == {"x": [None], "y": [None]}


def jobs_of(spark, run):
    tracker, group = spark.sparkContext.statusTracker(), uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(tracker.getJobIdsForGroup(group))


def test_group_quantiles_take_as_many_jobs_for_any_number_of_groups(spark, table):
    rows = table.withColumn("g", F.when(F.col("id") % 50 > 0, F.col("id") % 50))
    got = {(r["g"], r["name"], r["prob"]): r["value"] for r in stats.quantile_table(rows, ["a", "b"], [0.25, 0.5], ["g"]).collect()}
    pdf = table.toPandas()
    pdf["g"] = pdf["id"] % 50
    for g, part in pdf.groupby("g"):
        for c in ("a", "b"):
            for p in (0.25, 0.5):
                assert got[(g or None, c, p)] == pytest.approx(np.quantile(part[c].dropna(), p), rel=1e-14)
    assert len(got) == 200

    def jobs(n):
        stored = table.withColumn("g", F.col("id") % n)
        return jobs_of(spark, lambda: stats.quantile_table(stored, ["a"], [0.5], ["g"]).collect())

    # Adaptive execution counts each stage as a job; a round has a few.
    assert jobs(400) <= jobs(2) + 4


def test_column_statistics(table):
    a, b = arrays(table)
    got = stats.column_stats(table, ["a", "b", "c"])
    assert got["a"].mean == pytest.approx(a.mean()) and got["a"].std_pop == pytest.approx(a.std())
    assert got["b"].count == len(b) and got["b"].std_samp == pytest.approx(b.std(ddof=1))
    assert stats.varying_columns(got) == ["a", "b"]


def test_histogram_matches(table):
    a, _ = arrays(table)
    want, _edges = np.histogram(a, bins=40)
    got = {r["bin"]: r["n"] for r in stats.histogram(table, ["a", "c"], 40).filter("feature = 'a'").collect()}
    assert [got.get(i, 0) for i in range(40)] == list(want)


def test_scaler_matches_numpy(table):
    a, _ = arrays(table)
    scaler = scale.fit_scaler(table.select("a", "c"), ["a", "c"])
    assert scaler.columns == ["a"]
    logs = np.log1p(np.minimum(a, np.quantile(a, 0.99)))
    want = np.clip((logs - logs.mean()) / logs.std(), -5, 5)
    got = scaler.transform(table).select("a", F.get("scaled", F.lit(0)).alias("z")).toPandas()
    assert np.allclose(np.sort(got["z"]), np.sort(want))


def test_components_match_a_decomposition(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) + 3.0
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "id int, x array<double>")
    parts = pca.fit_components(df, "x", 5)
    centred = x - x.mean(axis=0)
    u, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert parts.explained == pytest.approx(list(s ** 2 / (s ** 2).sum()))
    signs = [1 if row[np.abs(row).argmax()] >= 0 else -1 for row in vt]
    want = centred @ vt.T * signs
    got = np.array([r["p"] for r in parts.transform(df, "x", "p", 3).orderBy("id").collect()])
    assert np.allclose(got, want[:, :3])
    k = parts.width()
    assert sum(parts.explained[:k]) > 0.95 >= sum(parts.explained[:k - 1])


def test_silhouette_matches_a_direct_count(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 1, (40, 3)) for c in (0, 3, 6)])
    labels = np.repeat([0, 1, 2], 40)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    want = []
    for i in range(len(x)):
        means = [d[i][labels == c].sum() / ((labels == c).sum() - (labels[i] == c)) for c in range(3)]
        own = means[labels[i]]
        other = min(m for c, m in enumerate(means) if c != labels[i])
        want.append((other - own) / max(own, other))
    df = spark.createDataFrame([(list(map(float, r)), int(c)) for r, c in zip(x, labels)], "x array<double>, c int")
    assert kmeans.silhouette(df, "x", "c") == pytest.approx(np.mean(want))
    points = kmeans.Points.of(df, "x")
    fit = kmeans.fit_points(points, [3], 4)[3]
    near = ((x[:, None] - fit.centres[None]) ** 2).sum(-1).argmin(axis=1)
    own = [[d[i][near == c].sum() / ((near == c).sum() - (near[i] == c)) for c in range(3)] for i in range(len(x))]
    pairs = [(m[near[i]], min(m[c] for c in range(3) if c != near[i])) for i, m in enumerate(own)]
    score = [(other - here) / max(other, here) for here, other in pairs]
    assert kmeans.silhouettes(points, [fit]) == pytest.approx([np.mean(score)])


def test_sweep_finds_the_groups(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.3, (60, 2)) for c in (0, 5, 10)])
    df = spark.createDataFrame([(list(map(float, r)),) for r in x], "x array<double>").repartition(3)
    chosen = kmeans.sweep(df, "x", max_k=4, restarts=3)
    assert chosen.best_k == 3
    rows = kmeans.assign(df, chosen.fits[3], "x")
    sizes = rows.groupBy("attack_cluster").agg(
        F.count("*").alias("n"), F.avg(F.get("x", F.lit(0))).alias("m")).orderBy("attack_cluster").collect()
    assert [r["n"] for r in sizes] == [60] * 3
    assert [round(r["m"]) for r in sizes] == [0, 5, 10]
    cost = sum(((part - part.mean(axis=0)) ** 2).sum() for part in np.split(x, 3))
    assert chosen.fits[3].cost == pytest.approx(cost) and sorted(chosen.fits[3].sizes) == [60] * 3
    # The draw follows the coordinates, not the layout.
    again = kmeans.sweep(df.repartition(7), "x", max_k=4, restarts=3)
    for k in (2, 3, 4):
        assert np.allclose(again.fits[k].centres, chosen.fits[k].centres)


def best_cost_on_a_line(points, weight, k):
    """Clusters on a line are runs, so the least cost is found by where runs end."""
    def run(i, j):
        p, w = points[i:j], weight[i:j]
        return (w * (p - (p * w).sum() / w.sum()) ** 2).sum()

    costs = [0.0] + [np.inf] * len(points)
    for _ in range(k):
        costs = [np.inf] + [min(costs[i] + run(i, j) for i in range(j)) for j in range(1, len(points) + 1)]
    return costs[-1]


def test_every_k_reaches_the_least_cost_on_a_line(spark):
    at = np.array([0.0, 1.0, 10.0, 12.0, 100.0, 130.0, 1000.0, 1001.5])
    weight = np.array([50, 3, 20, 20, 7, 9, 1, 30])
    df = spark.createDataFrame([([float(p)],) for p, w in zip(at, weight) for _ in range(w)], "x array<double>").repartition(5)
    for r in kmeans.elbow(df, "x", [2, 3, 4, 5, 6, 8]).collect():
        assert r["inertia"] == pytest.approx(best_cost_on_a_line(at, weight, r["k"]), abs=1e-9)


def test_a_sweep_takes_as_many_jobs_for_any_number_of_restarts(spark, monkeypatch):
    monkeypatch.setattr(kmeans, "TOLERANCE", -1.0)
    monkeypatch.setattr(kmeans, "MOST_PASSES", 3)
    df = spark.createDataFrame([([float(i % 17), float(i % 5)],) for i in range(500)], "x array<double>")
    one = jobs_of(spark, lambda: kmeans.sweep(df, "x", max_k=2, restarts=1))
    many = jobs_of(spark, lambda: kmeans.sweep(df, "x", max_k=8, restarts=10))
    assert many <= one + 6


def test_clusters_of_awkward_tables(spark):
    same = spark.createDataFrame([([1.0, 2.0],)] * 9 + [(None,)], "x array<double>")
    found = kmeans.sweep(same, "x", max_k=3, restarts=2)
    assert found.best_k == 2 and found.fits[2].cost == 0 and sum(found.fits[2].sizes) == 9
    rows = kmeans.assign(same, found.fits[2], "x").groupBy("attack_cluster").count().collect()
    assert {r[0]: r[1] for r in rows} == {0: 9, None: 1}
    with pytest.raises(ValueError, match="three rows"):
        kmeans.sweep(spark.createDataFrame([], "x array<double>"), "x")


def test_planted_outliers_score_worst(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 4))
    x[:40] += 9
    df = spark.createDataFrame([(f"s{i}", list(map(float, r))) for i, r in enumerate(x)], "session_id string, x array<double>")
    out = iforest.flag_anomalies(df, "x", 2000, "session_id", contamination=0.05)
    planted = F.regexp_extract("session_id", r"(\d+)", 1).cast("int") < 40
    assert out.filter("is_anomaly").count() == 100
    assert out.filter(planted & F.col("is_anomaly")).count() == 40
    # The sample follows the key, not the layout.
    again = iforest.flag_anomalies(df.repartition(7), "x", 2000, "session_id")
    joined = out.join(again.select("session_id", F.col("anomaly_score").alias("other")), "session_id")
    assert joined.agg(F.max(F.abs(F.col("anomaly_score") - F.col("other")))).first()[0] < 1e-12


def test_mean_path_length():
    assert iforest.mean_path(1) == 0 and iforest.mean_path(2) == 1
    assert iforest.mean_path(256) == pytest.approx(10.244770920116851)


def test_copies_are_sampled_in_proportion(spark):
    # Two thirds of the rows are copies of one row.
    rng = np.random.default_rng(5)
    rows = [([float(v) for v in rng.normal(size=2)],) for _ in range(1000)] + [([0.0, 0.0],)] * 2000
    df = spark.createDataFrame(rows, "x array<double>").repartition(5)
    forest = iforest.fit_forest(df, "x", 3000, trees=30)
    scores = forest.score(df, "x", "s")
    copies = F.col("x") == F.array(F.lit(0.0), F.lit(0.0))
    means = {r[0]: r[1] for r in scores.groupBy(copies.alias("c")).agg(F.avg("s")).collect()}
    assert means[True] > means[False]


def test_split_is_even_per_class_and_stable(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 < 8, "BENIGN").when(F.col("id") % 10 == 8, "DoS").otherwise("Probe").alias("label"))
    first = supervised.stratified_split(df)
    counts = {(r["label"], r["split"]): r["count"] for r in first.groupBy("label", "split").count().collect()}
    assert counts == {("BENIGN", "test"): 800, ("BENIGN", "val"): 640, ("BENIGN", "train"): 2560,
                      ("DoS", "test"): 100, ("DoS", "val"): 80, ("DoS", "train"): 320,
                      ("Probe", "test"): 100, ("Probe", "val"): 80, ("Probe", "train"): 320}
    second = supervised.stratified_split(df.repartition(9))
    assert first.exceptAll(second).count() == 0


def test_copies_stay_in_one_split(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("x"), F.lit("a").alias("label"))
    out = supervised.stratified_split(df)
    assert out.count() == 3000
    assert out.filter("x = 0").select("split").distinct().count() == 1


def test_group_split(spark):
    df = spark.range(1000).select("id", F.concat(F.lit("f"), F.col("id") % 10).alias("g"))
    out = supervised.group_split(df, "g").groupBy("g").agg(F.collect_set("split").alias("s")).collect()
    assert all(len(r["s"]) == 1 for r in out)
    assert sorted(r["s"][0] for r in out) == ["test"] * 2 + ["train"] * 6 + ["val"] * 2


def test_class_weights_balance(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "label string")
    got = {r["label"]: r["weight"] for r in supervised.class_weights(df, "label").collect()}
    assert got == {"a": pytest.approx(4 / 6), "b": 2.0}


def test_report_and_auc(spark):
    rows = [("a", "a", 0.9, 1), ("a", "b", 0.5, 1), ("b", "b", 0.5, 0), ("b", "b", 0.1, 0), ("c", "a", 0.7, 0)]
    df = spark.createDataFrame(rows, "label string, predicted string, s double, y int")
    got = {r["class"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in metrics.class_report(df).collect()}
    assert got["a"] == (0.5, 0.5, 0.5, 2)
    assert got["b"] == (pytest.approx(2 / 3), 1.0, pytest.approx(0.8), 2) and got["c"] == (0.0, 0.0, 0.0, 1)
    assert metrics.accuracy(df).first()[0] == pytest.approx(0.6)
    # Pairs: 0.9 beats all three; 0.5 beats one, ties one, loses one.
    assert metrics.auc(df, "s", "y") == pytest.approx(4.5 / 6)


def test_classifiers_learn_a_simple_rule(spark):
    df = spark.range(400).select(
        (F.col("id") % 20).cast("double").alias("f0"), (F.col("id") % 7).cast("double").alias("f1"),
        F.when(F.col("id") % 20 >= 10, "DoS").otherwise("BENIGN").alias("label"))
    for model in ("lr", "rf"):
        ready = supervised.prepare(df, ["f0", "f1"], df)
        fitted = supervised.train_classifier(ready, ["f0", "f1"], model=model, trees=10, depth=4)
        assert metrics.accuracy(fitted.transform(ready)).first()[0] > 0.95


def test_tasks_of_a_forest_grow_in_number(spark, monkeypatch):
    df = spark.range(400, numPartitions=2).select(
        (F.col("id") % 20).cast("double").alias("x"), F.when(F.col("id") % 20 < 5, "a").otherwise("b").alias("label"))
    dealt = []
    weigh = supervised.class_weights
    monkeypatch.setattr(supervised, "class_weights", lambda train, label: dealt.append(train) or weigh(train, label))
    monkeypatch.setattr(supervised, "TASK_BYTES", 50 * (4 * 3 + 8 + 64))
    fitted = supervised.train_classifier(df, ["x"], trees=3, depth=2)
    # Eight tasks of about 50 rows, more than the four cores.
    sizes = dealt[0].groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and sum(r["count"] for r in sizes) == 400 and max(r["count"] for r in sizes) <= 60
    assert fitted.transform(df).filter("predicted <> label").count() == 0


def test_scored_flows_are_dealt_into_tasks(spark, monkeypatch):
    monkeypatch.setattr(supervised, "SCORED_ROWS", 200, raising=False)
    scored = model_queries._trained(Tables(spark, "/root/testdata/sf0.001"), "rf", trees=2, depth=2)
    sizes = [r["count"] for r in scored.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) > 2000 and len(sizes) >= sum(sizes) // 200 and max(sizes) <= 250


def test_imputation_and_cluster_reports(spark, table):
    filled = scale.impute_median(table, ["b"])
    _, b = arrays(table)
    assert filled.filter("b IS NULL").count() == 0
    assert filled.filter("id = 0").first()["b"] == np.median(b)
    tagged = table.withColumn("attack_cluster", (F.col("id") % 3).cast("int"))
    pdf = tagged.toPandas()
    for r in clusters.cluster_summary(tagged, ["a", "b"]).collect():
        values = pdf[pdf["attack_cluster"] == r["attack_cluster"]][r["feature"]].dropna()
        assert (r["count"], r["mean"], r["median"]) == (len(values), pytest.approx(values.mean()), pytest.approx(values.median()))


def test_flow_features(spark):
    df = spark.createDataFrame(
        [("6000000", "2", "3", "Infinity", "BENIGN"), ("5000", "2", None, "4", "DoS"), ("x", None, None, None, "DoS")],
        "`Flow Duration` string, `Total Fwd Packets` string, `Total Backward Packets` string, `Flow Bytes/s` string, Label string")
    rows = flows.flow_features(df).collect()
    assert [(r["session_duration_s"], r["packet_count"], r["packets_per_min"], r["Flow Bytes/s"]) for r in rows] == [
        (6.0, 5.0, pytest.approx(50.0), 0.0), (0.005, 2.0, 0.0, 4.0), (0.0, 0.0, 0.0, 0.0)]


def test_path_lengths_equal_a_walk_down_every_tree(monkeypatch):
    monkeypatch.setattr(iforest, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(3)
    nodes, total = {k: [] for k in ("root", "feature", "threshold", "left", "right", "length")}, 0
    for _ in range(5):
        grown = sorted(iforest.grow_tree(rng.normal(size=(40, 3)), rng, 6))
        nodes["root"].append(total)
        for _node, feature, threshold, left, right, length in grown:
            for name, value in zip(("feature", "threshold", "left", "right", "length"), (feature, threshold, left + total, right + total, length)):
                nodes[name].append(value)
        total += len(grown)
    nodes = {k: np.array(v) for k, v in nodes.items()}

    def walk(row, at):
        while nodes["feature"][at] >= 0:
            at = nodes["left" if row[nodes["feature"][at]] <= nodes["threshold"][at] else "right"][at]
        return nodes["length"][at]

    rows = rng.normal(size=(30, 3))
    rows[0, 0] = np.nan
    want = [np.mean([walk(row, root) for root in nodes["root"]]) for row in rows]
    np.testing.assert_allclose(iforest.path_lengths(nodes, rows), want)
    assert len(iforest.path_lengths(nodes, rows[:0])) == 0
