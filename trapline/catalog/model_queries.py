"""Behaviour models, flow models and statistics.

Fitted models depend on random draws, so their queries either report counts and
shares that must hold for any fit, or have no comparison SQL. Steps around the
fits take a fixed stand-in for clusters and anomalies and compare in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.catalog.registry import query, rounded, view
from trapline.fixtures import Tables
from trapline.functions.numbers import log1p_clipped
from trapline.modeling import behaviour, clusters, explain, kmeans, metrics, pca, scale, stats, supervised
from trapline.operators import analytics, features, flows, sessions
from trapline.schema import COUNT_COLUMNS, FEATURES
from trapline.session import materialise, spread
from trapline.sources import sinks

CHECKED = ["duration", "event_count", "login_fail", "ssh_ratio", "pw_entropy_total", "services_touched"]
ALL = FEATURES + COUNT_COLUMNS


def feature_rows(t: Tables) -> DataFrame:
    return features.feature_table(sessions.sessions(t.flat))


def stored_features(t: Tables) -> DataFrame:
    """The feature table written once, for queries that read it several times."""
    return materialise(feature_rows(t), "features")


def stand_in(df: DataFrame) -> DataFrame:
    """Fixed clusters and anomalies, so that reports can be compared."""
    return df.withColumns({
        "attack_cluster": (F.col("event_count") % 4).cast("int"),
        "is_anomaly": F.col("event_count") >= 9,
        "anomaly_score": (8.5 - F.col("event_count")) / 10})


view("modelled", """
SELECT *, (event_count % 4)::INT AS attack_cluster, event_count >= 9 AS is_anomaly, (8.5::DOUBLE - event_count) / 10 AS anomaly_score
FROM feat""", "feat")
view("long_feat", f"""
SELECT * FROM (SELECT session_id, {', '.join(f'{c}::DOUBLE AS {c}' for c in ALL)} FROM feat)
UNPIVOT (value FOR feature IN ({', '.join(ALL)}))""", "feat")


# --- statistics --------------------------------------------------------------
@query("M01_model_columns", """
SELECT feature AS name, count(*) AS n, round(sum(value), 4) AS total FROM long_feat GROUP BY feature""", ["long_feat"])
def _(t: Tables):
    rows = feature_rows(t)
    values = stats.long_values(rows, scale.model_columns(rows))
    return rounded(values.groupBy("name").agg(F.count("x").alias("n"), F.sum("x").alias("total")), 4)


@query("F15_varying_columns", """
SELECT feature FROM long_feat GROUP BY feature HAVING count(DISTINCT value) > 1 AND stddev_samp(value) >= 1e-6""", ["long_feat"])
def _(t: Tables):
    kept = stats.varying_columns(stats.column_stats(feature_rows(t), ALL))
    return t.spark.createDataFrame([(c,) for c in kept], "feature string")


@query("U03_dropped_columns", """
SELECT feature FROM long_feat GROUP BY feature HAVING NOT (count(DISTINCT value) > 1 AND stddev_samp(value) >= 1e-6)""", ["long_feat"])
def _(t: Tables):
    found = stats.column_stats(feature_rows(t), ALL)
    return t.spark.createDataFrame([(c,) for c, s in found.items() if s.is_constant], "feature string")


@query("A32_describe", """
SELECT feature, count(*) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min,
  round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75,
  round(max(value), 6) AS max FROM long_feat GROUP BY feature""", ["long_feat"])
def _(t: Tables):
    return rounded(stats.describe(stored_features(t), ALL))


@query("A33_histogram", """
SELECT feature, least(floor((value - lo) / w * 50), 49)::INT AS bin, count(*) AS n
FROM long_feat JOIN (SELECT feature, CASE WHEN max(value) > min(value) THEN min(value) ELSE min(value) - 0.5 END AS lo,
  CASE WHEN max(value) > min(value) THEN max(value) - min(value) ELSE 1 END AS w FROM long_feat GROUP BY feature) USING (feature)
WHERE feature IN ('duration', 'cmd_count', 'login_fail', 'pw_entropy_total') GROUP BY 1, 2""", ["long_feat"])
def _(t: Tables):
    return stats.histogram(stored_features(t), ["duration", "cmd_count", "login_fail", "pw_entropy_total"], 50)


@query("A39_largest_maxima", """
SELECT feature, round(max(value), 6) AS maximum FROM long_feat GROUP BY feature ORDER BY max(value) DESC, feature LIMIT 20""", ["long_feat"])
def _(t: Tables):
    return rounded(stats.largest_maxima(feature_rows(t), ALL))


@query("A40_bad_values", """
SELECT 'ratio' AS feature, count(*) FILTER (WHERE bwd_packets = 1) AS infinite, count(*) FILTER (WHERE bwd_packets = 2) AS nan FROM flows""", ["flows"])
def _(t: Tables):
    ratio = (F.when(F.col("bwd_packets") == 1, float("inf")).when(F.col("bwd_packets") == 2, float("nan"))
             .otherwise(F.col("iat_mean")))
    return stats.bad_values(t.flows.withColumn("ratio", ratio), ["ratio", "iat_std", "fwd_packets"])


@query("X12_log_features", """
SELECT session_id, round(ln(1 + greatest(duration, 0)), 6) AS duration, round(ln(1 + event_count), 6) AS event_count FROM feat""", ["feat"])
def _(t: Tables):
    return rounded(feature_rows(t).select(
        "session_id", *[log1p_clipped(F.col(c)).alias(c) for c in ("duration", "event_count")]))


@query("X13_winsorised", f"""
SELECT session_id, {', '.join(f'round(least({c}, q_{c}), 6) AS {c}' for c in CHECKED)}
FROM feat JOIN (SELECT {', '.join(f'quantile_cont({c}, 0.99) AS q_{c}' for c in CHECKED)} FROM feat) ON true""", ["feat"])
def _(t: Tables):
    return rounded(scale.winsorise(stored_features(t), CHECKED, 0.0, 0.99).select("session_id", *CHECKED))


LOGS = ", ".join(f"ln(1 + least({c}, q_{c})) AS {c}" for c in CHECKED)
view("logs", f"""
SELECT session_id, {LOGS}
FROM feat JOIN (SELECT {', '.join(f'quantile_cont({c}, 0.99) AS q_{c}' for c in CHECKED)} FROM feat) ON true""", "feat")
view("z", f"""
SELECT session_id, {', '.join(f'greatest(-5, least(5, (l.{c} - m_{c}) / s_{c})) AS {c}' for c in CHECKED)} FROM logs l
JOIN (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in CHECKED)} FROM logs) ON true""", "logs")


@query("M02_scaled_features", f"SELECT session_id, {', '.join(f'round({c}, 6) AS {c}' for c in CHECKED)} FROM z", ["z"])
def _(t: Tables):
    rows = stored_features(t)
    scaler = scale.fit_scaler(rows)
    picked = [F.get("scaled", F.lit(scaler.columns.index(c))).alias(c) for c in CHECKED]
    return rounded(scaler.transform(rows.select("session_id", *scaler.columns)).select("session_id", *picked))


@query("M14_median_imputation", """
SELECT id, coalesce(CASE WHEN id % 7 <> 0 THEN (id % 1000)::DOUBLE END,
  (SELECT quantile_cont((id % 1000)::DOUBLE, 0.5) FROM raw_logs WHERE id % 7 <> 0)) AS value FROM raw_logs""")
def _(t: Tables):
    # Every seventh value is missing.
    gaps = t.raw_logs.select("id", F.when(F.col("id") % 7 != 0, (F.col("id") % 1000).cast("double")).alias("value"))
    return scale.impute_median(gaps, ["value"])


# --- cluster reports ----------------------------------------------------------
@query("A16_anomaly_share", """
SELECT is_anomaly, count(*) AS n, round(count(*) / (SELECT count(*) FROM modelled), 6) AS share FROM modelled GROUP BY is_anomaly""", ["modelled"])
def _(t: Tables):
    return rounded(analytics.relative_frequency(stand_in(feature_rows(t)), "is_anomaly"))


@query("A17_cluster_profiles", f"""
SELECT attack_cluster, {', '.join(f'round(avg({c}), 6) AS {c}' for c in CHECKED)} FROM modelled GROUP BY attack_cluster""", ["modelled"])
def _(t: Tables):
    return rounded(clusters.cluster_profiles(stand_in(feature_rows(t)), CHECKED))


@query("A18_cluster_anomalies", """
SELECT attack_cluster, count(*) FILTER (WHERE NOT is_anomaly) AS normal, count(*) FILTER (WHERE is_anomaly) AS anomalous
FROM modelled GROUP BY attack_cluster""", ["modelled"])
def _(t: Tables):
    return clusters.cluster_anomalies(stand_in(feature_rows(t)))


@query("A19_cluster_summary", f"""
SELECT attack_cluster, feature, count(*) AS count, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median
FROM modelled JOIN long_feat USING (session_id) WHERE feature IN ({', '.join(f"'{c}'" for c in CHECKED)}) GROUP BY 1, 2""",
       ["modelled", "long_feat"])
def _(t: Tables):
    return rounded(clusters.cluster_summary(stand_in(stored_features(t)), CHECKED))


NAMES = """
SELECT cluster, CASE WHEN avg(command_count) < 2 THEN 'Scanner / Probe' WHEN avg(avg_password_entropy) > 3 THEN 'Brute Force / Credential Stuffing'
  WHEN avg(commands_per_min) > 10 THEN 'High Automation Bot' ELSE 'Interactive / Manual' END AS attack_type
FROM (SELECT *, least(command_count, 4)::INT AS cluster,
        CASE WHEN session_duration_s = 0 THEN 0 ELSE command_count / (greatest(session_duration_s, 0.5) / 60) END AS commands_per_min FROM compact)
GROUP BY cluster"""


def _named(t: Tables):
    rows = sessions.compact(t.flat).withColumn("cluster", F.least("command_count", F.lit(4)).cast("int"))
    means = clusters.cluster_profiles(
        rows, ["command_count", "commands_per_min", "avg_password_entropy"], "cluster")
    return rows, clusters.name_clusters(means, "cluster")


@query("M09_cluster_names", NAMES, ["compact"])
def _(t: Tables):
    return _named(t)[1]


@query("J10_sessions_with_cluster_names", f"""
SELECT session_id, n.attack_type FROM compact JOIN ({NAMES}) n ON n.cluster = least(command_count, 4)""", ["compact"])
def _(t: Tables):
    rows, names = _named(t)
    return clusters.with_cluster_names(rows, names, "cluster").select("session_id", "attack_type")


TOP3 = f"""
SELECT session_id, round(anomaly_score, 4) AS anomaly_score, attack_cluster,
  string_agg(feature || ':' || direction || ':' || printf('%.2f', value) || ':' || printf('%.2f', average), '|' ORDER BY rn) AS reasons
FROM (SELECT m.session_id, m.anomaly_score, m.attack_cluster, u.feature, CASE WHEN u.zv > 0 THEN 'high' ELSE 'low' END AS direction,
        l.value, a.average, row_number() OVER (PARTITION BY m.session_id ORDER BY round(abs(u.zv), 9) DESC, p.pos) AS rn
      FROM modelled m JOIN (UNPIVOT z ON {', '.join(CHECKED)} INTO NAME feature VALUE zv) u USING (session_id)
      JOIN long_feat l USING (session_id, feature) JOIN (SELECT feature, avg(value) AS average FROM long_feat GROUP BY feature) a USING (feature)
      JOIN (VALUES {', '.join(f"('{c}', {i})" for i, c in enumerate(CHECKED))}) p(feature, pos) USING (feature)
      WHERE m.is_anomaly) WHERE rn <= 3 GROUP BY ALL"""


def _explained(t: Tables):
    rows = stand_in(stored_features(t))
    scaler = scale.fit_scaler(rows, CHECKED)
    return explain.explain_anomalies(scaler.transform(rows), scaler)


@query("M13_anomaly_reasons", TOP3, ["modelled", "z", "long_feat"])
def _(t: Tables):
    parts = F.transform("reasons", lambda r: F.concat_ws(
        ":", r["feature"], r["direction"], F.format_string("%.2f", r["value"]), F.format_string("%.2f", r["average"])))
    return _explained(t).withColumn("reasons", F.array_join(parts, "|"))


@query("W06_top_features", """
SELECT session_id, 3 AS reasons, round(greatest(abs(duration), abs(event_count), abs(login_fail), abs(ssh_ratio),
  abs(pw_entropy_total), abs(services_touched)), 2) AS largest
FROM z JOIN modelled USING (session_id) WHERE is_anomaly""".replace("abs(", "abs(z."), ["modelled", "z"])
def _(t: Tables):
    return _explained(t).select(
        "session_id", F.size("reasons").alias("reasons"),
        F.get("reasons", F.lit(0))["z_score"].alias("largest"))


@query("S12_model_outputs", """
SELECT 'modeled' AS output, count(*) AS n FROM modelled
UNION ALL SELECT 'anomalies', count(*) FROM modelled WHERE is_anomaly
UNION ALL SELECT 'cluster_profiles', count(DISTINCT attack_cluster) FROM modelled
UNION ALL SELECT 'anomaly_explanations', count(*) FROM modelled WHERE is_anomaly""", ["modelled"])
def _(t: Tables):
    from trapline.session import scratch_path

    rows = stand_in(stored_features(t))
    paths = sinks.write_model_outputs(
        scratch_path(t.spark, "model"), rows, clusters.cluster_profiles(rows, CHECKED), _explained(t))
    out = None
    for name, path in paths.items():
        part = t.spark.read.parquet(path).agg(F.lit(name).alias("output"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


# --- fitted models ------------------------------------------------------------
def _vectors(t: Tables) -> DataFrame:
    return t.read("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")


@query("M03_reduced_components", """
SELECT count(*) AS n, true AS enough, true AS fewest FROM embeddings""", [])
def _(t: Tables):
    rows = _vectors(t)
    parts = pca.fit_components(rows, "x", 64)
    k = parts.width()
    done = parts.transform(rows, "x", "reduced", k)
    return done.agg(
        F.count_if(F.size("reduced") == k).alias("n"),
        F.lit(sum(parts.explained[:k]) > 0.95).alias("enough"),
        F.lit(sum(parts.explained[:k - 1]) <= 0.95).alias("fewest"))


@query("M04_map_coordinates", """
SELECT count(*) AS n, 0.0::DOUBLE AS mean1, 0.0::DOUBLE AS mean2, 0.0::DOUBLE AS correlation FROM embeddings""", [])
def _(t: Tables):
    rows = _vectors(t)
    done = pca.fit_components(rows, "x", 64).transform(rows, "x", "p", 2)
    first, second = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    return rounded(done.agg(
        F.count("*").alias("n"), (F.avg(first) + 0.0).alias("mean1"), (F.avg(second) + 0.0).alias("mean2"),
        F.corr(first, second).alias("correlation")).withColumns(
            {c: F.abs(F.round(c, 6)) for c in ("mean1", "mean2", "correlation")}))


@query("M21_explained_variance", """
SELECT 64 AS parts, 1.0::DOUBLE AS total, round(sum(v), 6) AS variance FROM (
  SELECT i, var_samp(x) AS v FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i)""", [])
def _(t: Tables):
    rows = _vectors(t)
    parts = pca.fit_components(rows, "x", 64)
    done = parts.transform(rows, "x", "p", 64)
    spread = done.select(F.posexplode("p")).groupBy("pos").agg(F.var_samp("col").alias("v"))
    return rounded(spread.agg(
        F.lit(len(parts.explained)).alias("parts"), F.lit(float(sum(parts.explained))).alias("total"),
        F.sum("v").alias("variance")))


@query("M06_silhouette", """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), sizes AS (SELECT label, count(*) AS n FROM e GROUP BY label),
d AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.x, b.x) ** 2) AS s FROM e a JOIN e b ON true GROUP BY 1, 2, 3),
m AS (SELECT vec_id, d.label, other, CASE WHEN d.label = other THEN s / nullif(n - 1, 0) ELSE s / n END AS mean, n
      FROM d JOIN sizes ON sizes.label = other),
ab AS (SELECT vec_id, max(mean) FILTER (WHERE label = other) AS a, min(mean) FILTER (WHERE label <> other) AS b FROM m GROUP BY vec_id)
SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM ab""", [])
def _(t: Tables):
    return rounded(t.spark.createDataFrame([(float(kmeans.silhouette(_vectors(t), "x", "label")),)], "silhouette double"))


def _fitted(table: DataFrame, array: str, chosen: kmeans.Sweep, min_share: float = kmeans.MIN_SHARE) -> DataFrame:
    """What a sweep must satisfy, whatever it drew: rows far from their nearest centre, costs and sizes as told
    against those of the rows, ks that score better than the one chosen among those without tiny clusters."""
    fit = chosen.fits[chosen.best_k]
    centre = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in sorted(fit.centres, key=tuple)])
    far = lambda c: F.aggregate(F.zip_with(array, c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, b: a + b)
    rows = table.select(far(F.get(centre, F.col("attack_cluster"))).alias("own"), F.array_min(F.transform(centre, far)).alias("least"), "attack_cluster")
    sizes = rows.groupBy("attack_cluster").agg(
        F.count("*").alias("n"), F.sum("own").alias("cost"), F.count_if(F.col("own") > F.col("least") + 1e-9).alias("misplaced"))
    allowed = [k for k, f in chosen.fits.items() if f.smallest_share >= min_share]
    better = sum(chosen.scores[k] > chosen.scores[chosen.best_k] for k in allowed) if allowed else 0
    told = sorted(n for n in fit.sizes if n)
    return sizes.agg(
        F.sum("n").alias("sessions"), F.sum("misplaced").alias("misplaced"),
        F.round(F.abs(F.sum("cost") / fit.cost - 1), 6).alias("cost_error"),
        (F.array_sort(F.collect_list("n")) != F.array(*[F.lit(x).cast("long") for x in told])).cast("int").alias("size_error"),
        F.lit(better).alias("better_ks"), F.lit(sorted(chosen.fits) != sorted(range(2, max(chosen.fits) + 1))).cast("int").alias("gaps"))


@query("M05_behaviour_clusters", """
SELECT count(*) AS sessions, 0::BIGINT AS misplaced, 0.0::DOUBLE AS cost_error, 0 AS size_error, 0 AS better_ks, 0 AS gaps FROM feat""", ["feat"])
def _(t: Tables):
    reduced = behaviour.reduce_features(feature_rows(t))
    table, chosen = behaviour.cluster(reduced)
    return _fitted(table, "reduced", chosen)


# Points by a rule whose best clusters are plain: four groups on a grid, well apart, with a little spread inside.
PLANTED = """
SELECT flow_id, CAST(flow_id % 10 % 4 AS INT) AS planted,
  CAST(100 * (flow_id % 10 % 2) + iat_mean * 10 AS DOUBLE) AS x, CAST(70 * CAST(floor(flow_id % 10 % 4 / 2) AS INT) + iat_std * 10 AS DOUBLE) AS y FROM {flows}"""
view("planted", PLANTED.replace("{flows}", "flows"), "flows")
view("planted_means", """
SELECT planted, count(*) AS n, avg(x) AS cx, avg(y) AS cy, sum(x) AS sx, sum(y) AS sy, sum(x * x + y * y) AS q FROM planted GROUP BY planted""", "planted")
view("planted_scores", """
SELECT (SELECT sum((x - cx) ** 2 + (y - cy) ** 2) FROM planted JOIN planted_means USING (planted)) AS cost, round(avg((b - a) / greatest(a, b)), 6) AS silhouette
FROM (SELECT planted, place, max(far / (n - 1)) FILTER (planted = other) AS a, min(far / n) FILTER (planted <> other) AS b
      FROM (SELECT p.planted, p.place, (p.x * p.x + p.y * p.y) * c.n - 2 * (p.x * c.sx + p.y * c.sy) + c.q AS far, c.planted AS other, c.n
            FROM (SELECT *, row_number() OVER () AS place FROM planted) p, planted_means c) GROUP BY ALL)""", "planted", "planted_means")


def _planted(t: Tables) -> DataFrame:
    return t.sql(PLANTED, flows=t.flows).selectExpr("flow_id", "planted", "array(double(x), double(y)) AS p")


@query("M05_planted_clusters", """
SELECT row_number() OVER (ORDER BY cx, cy) - 1 AS cluster, n, round(cx, 6) AS cx, round(cy, 6) AS cy, (SELECT count(*) FROM planted_means) AS best_k,
  silhouette, round(cost, 4) AS cost FROM planted_means, planted_scores""", ["planted_means", "planted_scores"])
def _(t: Tables):
    rows = materialise(_planted(t), "planted")
    chosen = kmeans.sweep(rows, "p")
    fit = chosen.fits[chosen.best_k]
    named = kmeans.assign(rows, fit, "p").groupBy(F.col("attack_cluster").cast("long").alias("cluster")).agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("p")[0]), 6).alias("cx"), F.round(F.avg(F.col("p")[1]), 6).alias("cy"))
    return named.withColumns({
        "best_k": F.lit(chosen.best_k).cast("long"), "silhouette": F.round(F.lit(chosen.scores[chosen.best_k]), 6), "cost": F.round(F.lit(fit.cost), 4)})


# Clusters on a line are runs of its points, so the least cost for every k follows from where the runs end.
SPOTS = [0, 1, 10, 12, 100, 130, 1000]
_RUN = "a.i AS i, b.i AS j, b.w - a.w + a.own AS w, b.s - a.s + a.own * a.x AS s, b.q - a.q + a.own * a.x * a.x AS q"
_STEPS = " ".join(f", d{k} AS (SELECT r.j, min(d{k - 1}.cost + r.cost) AS cost FROM r JOIN d{k - 1} ON d{k - 1}.j = r.i - 1 GROUP BY r.j)" for k in range(2, 7))


@query("M07_elbow", f"""
WITH o AS (SELECT l_linenumber AS i, [{', '.join(map(str, SPOTS))}][l_linenumber]::DOUBLE AS x, count(*)::DOUBLE AS own FROM lineitem GROUP BY 1, 2),
p AS (SELECT i, x, own, sum(own) OVER (ORDER BY i) AS w, sum(own * x) OVER (ORDER BY i) AS s, sum(own * x * x) OVER (ORDER BY i) AS q FROM o),
r AS (SELECT i, j, q - s * s / w AS cost FROM (SELECT {_RUN} FROM p a JOIN p b ON a.i <= b.i)),
d1 AS (SELECT j, cost FROM r WHERE i = 1){_STEPS}
{' UNION ALL '.join(f"SELECT {k} AS k, round(cost, 3) AS inertia FROM d{k} WHERE j = 7" for k in range(2, 7))}""", [])
def _(t: Tables):
    spot = F.element_at(F.array(*[F.lit(float(x)) for x in SPOTS]), F.col("l_linenumber").cast("int"))
    rows = t.read("lineitem").select(F.array(spot).alias("p"))
    return kmeans.elbow(rows, "p", list(range(2, 7))).select("k", F.round("inertia", 3).alias("inertia"))


@query("M07_fixed_k", """
SELECT 4 AS k, round(cost, 4) AS inertia, silhouette FROM planted_scores""", ["planted_scores"])
def _(t: Tables):
    found = kmeans.elbow(materialise(_planted(t), "planted"), "p", [4])
    return found.select("k", F.round("inertia", 4).alias("inertia"), F.round("silhouette", 6).alias("silhouette"))


@query("M08_compact_clusters", """
SELECT count(*) AS sessions, 0::BIGINT AS misplaced, 0.0::DOUBLE AS cost_error, 0 AS size_error, 0 AS better_ks, 0 AS gaps FROM compact""", ["compact"])
def _(t: Tables):
    columns = ["session_duration_s", "command_count", "commands_per_min", "avg_password_entropy"]
    rows = materialise(sessions.compact(t.flat), "compact")
    table = materialise(scale.fit_scaler(rows, columns, winsorise=False).transform(rows).select("scaled"), "scaled")
    chosen = kmeans.sweep(table, "scaled", max_k=9, min_share=0.0, restarts=1)
    return _fitted(kmeans.assign(table, chosen.fits[chosen.best_k], "scaled"), "scaled", chosen, 0.0)


@query("M10_anomalies", """
SELECT count(*) AS sessions, count(DISTINCT session_id) AS ids, true AS share_holds, true AS scores_split FROM feat""", ["feat"])
def _(t: Tables):
    from trapline.modeling.iforest import CONTAMINATION, flag_anomalies

    reduced = behaviour.reduce_features(feature_rows(t))
    table = flag_anomalies(reduced.table, "reduced", reduced.rows, "session_id")
    share = F.avg(F.col("is_anomaly").cast("double"))
    return table.agg(
        F.count("*").alias("sessions"), F.count_distinct("session_id").alias("ids"),
        (F.abs(share - CONTAMINATION) < 0.01).alias("share_holds"),
        (F.max(F.when(F.col("is_anomaly"), F.col("anomaly_score"))) < 0).alias("scores_split"))


# --- flows ---------------------------------------------------------------------
view("flow_feat", """
SELECT flow_id, label AS "Label", flow_duration_us / 1e6 AS session_duration_s, fwd_packets + bwd_packets AS packet_count,
  CASE WHEN flow_duration_us / 1e6 >= 0.01 THEN (fwd_packets + bwd_packets) / (flow_duration_us / 1e6 / 60) ELSE 0 END AS packets_per_min,
  flow_bytes_s AS bytes_s, iat_mean, iat_std FROM flows""", "flows")


def _flows(t: Tables) -> DataFrame:
    return t.flows.select(
        "flow_id", F.col("flow_duration_us").cast("double").alias("Flow Duration"),
        F.col("fwd_packets").alias("Total Fwd Packets"), F.col("bwd_packets").alias("Total Backward Packets"),
        F.col("flow_bytes_s").alias("Flow Bytes/s"), F.col("iat_mean").alias("Flow IAT Mean"),
        F.col("iat_std").alias("Flow IAT Std"), F.col("label").alias("Label"),
        F.col("source_file").alias("_source_file"))


FLOW_COLUMNS = ["session_duration_s", "packet_count", "packets_per_min", "Flow Bytes/s", "Flow IAT Mean", "Flow IAT Std"]


@query("X14_flow_features", """
SELECT flow_id, "Label" AS label, round(session_duration_s, 6) AS session_duration_s, packet_count, round(packets_per_min, 4) AS packets_per_min,
  bytes_s, iat_mean, iat_std, 0.0::DOUBLE AS avg_password_entropy FROM flow_feat""", ["flow_feat"])
def _(t: Tables):
    return flows.flow_features(_flows(t)).select(
        "flow_id", F.col("Label").alias("label"), F.round("session_duration_s", 6).alias("session_duration_s"),
        "packet_count", F.round("packets_per_min", 4).alias("packets_per_min"), F.col("`Flow Bytes/s`").alias("bytes_s"),
        F.col("Flow IAT Mean").alias("iat_mean"), F.col("Flow IAT Std").alias("iat_std"), "avg_password_entropy")


@query("F14_finite_labelled_flows", """
SELECT count(*) AS flows, count(*) FILTER (WHERE bwd_packets = 1) AS emptied FROM flows WHERE label <> 'Probe'""", ["flows"])
def _(t: Tables):
    dirty = _flows(t).withColumns({
        "Label": F.when(F.col("Label") != "Probe", F.col("Label")),
        "Flow IAT Mean": F.when(F.col("Total Backward Packets") == 1, float("inf")).otherwise(F.col("Flow IAT Mean"))})
    clean = flows.clean_labels(flows.finite_columns(dirty))
    return clean.agg(F.count("*").alias("flows"), F.count_if(F.col("Flow IAT Mean").isNull()).alias("emptied"))


@query("A37_mean_scores", """
SELECT "Label" = 'BENIGN' AS is_benign, round(avg(bytes_s), 4) AS mean_score FROM flow_feat GROUP BY 1""", ["flow_feat"])
def _(t: Tables):
    return rounded(flows.mean_scores(flows.flow_features(_flows(t)), "`Flow Bytes/s`"), 4)


@query("A43_class_balance", "SELECT count(label) AS labelled, count(DISTINCT label) FILTER (WHERE label <> 'BENIGN') AS attack_classes FROM flows", ["flows"])
def _(t: Tables):
    return flows.class_balance(_flows(t))


@query("A14_label_frequency", 'SELECT label AS "Label", count(*) AS n FROM flows GROUP BY 1', ["flows"])
def _(t: Tables):
    return analytics.frequency(_flows(t), "Label")


@query("M15_stratified_split", """
SELECT label AS "Label", count(*) AS n, true AS test_share, true AS val_share FROM flows GROUP BY 1""", ["flows"])
def _(t: Tables):
    split = supervised.stratified_split(_flows(t), "Label")
    counts = flows.split_balance(split).groupBy("Label").pivot("split", ["train", "val", "test"]).sum("n")
    total = F.col("train") + F.col("val") + F.col("test")
    # Copies of a row stay together, so a share can miss by a few rows.
    return counts.select(
        "Label", total.alias("n"), (F.abs(F.col("test") - total * 0.2) <= 5).alias("test_share"),
        (F.abs(F.col("val") - total * 0.16) <= 5).alias("val_share"))


@query("M16_group_split", """
SELECT count(*) AS flows, 1 AS test_groups, 1 AS val_groups, 0 AS split_groups FROM flows""", ["flows"])
def _(t: Tables):
    split = supervised.group_split(_flows(t), "_source_file")
    per_group = split.groupBy("_source_file").agg(
        F.count("*").alias("n"), F.min("split").alias("a"), F.max("split").alias("b"))
    return per_group.agg(
        F.sum("n").alias("flows"), F.count_if(F.col("a") == "test").alias("test_groups"),
        F.count_if(F.col("a") == "val").alias("val_groups"), F.count_if(F.col("a") != F.col("b")).alias("split_groups"))


@query("M17_leakage_guard", """
SELECT count(*) AS flows, round(sum(fwd_packets), 4) AS packets, 0 AS identity_columns FROM flows""", ["flows"])
def _(t: Tables):
    named = _flows(t).withColumns({"Src_IP": F.lit("x"), "Timestamp": F.lit("y")}).withColumnRenamed("flow_id", "Flow_ID")
    safe = flows.guard_leakage(named)
    left = [c for c in safe.columns if c in (*flows.IDENTITY_COLUMNS, "_source_file")]
    return rounded(safe.agg(
        F.count("*").alias("flows"), F.sum("Total Fwd Packets").alias("packets"), F.lit(len(left)).alias("identity_columns")), 4)


RULE = "CASE WHEN fwd_packets > 40 THEN 'DoS' WHEN bwd_packets > 5 THEN 'Probe' ELSE 'BENIGN' END"


def _ruled(t: Tables) -> DataFrame:
    """Predictions by a fixed rule, so that the report can be compared."""
    return t.flows.withColumn("predicted", F.expr(RULE))


@query("M20_class_report", f"""
SELECT class, round(coalesce(hits / nullif(given, 0), 0), 6) AS precision, round(coalesce(hits / nullif(support, 0), 0), 6) AS recall,
  round(coalesce(2 * hits / nullif(given + support, 0), 0), 6) AS f1, support
FROM (SELECT class, count(*) FILTER (WHERE class = label) AS support, count(*) FILTER (WHERE class = predicted) AS given,
        count(*) FILTER (WHERE class = label AND class = predicted) AS hits
      FROM (SELECT label, {RULE} AS predicted, unnest(['BENIGN', 'DoS', 'Probe']) AS class FROM flows) GROUP BY class)""", ["flows"])
def _(t: Tables):
    return rounded(metrics.class_report(_ruled(t)))


@query("M20_confusion", f"SELECT label, {RULE} AS predicted, count(*) AS n FROM flows GROUP BY 1, 2", ["flows"])
def _(t: Tables):
    return metrics.confusion(_ruled(t))


@query("M20_accuracy", f"SELECT round(avg((label = {RULE})::INT), 6) AS accuracy FROM flows", ["flows"])
def _(t: Tables):
    return rounded(metrics.accuracy(_ruled(t)))


@query("M12_roc_auc", """
SELECT round((sum(r) FILTER (WHERE label <> 'BENIGN') - p * (p + 1) / 2) / (p * n), 6) AS auc
FROM (SELECT label, (rank() OVER (ORDER BY fwd_packets) + count(*) OVER (PARTITION BY fwd_packets) / 2 - 0.5)::DOUBLE AS r,
        count(*) FILTER (WHERE label <> 'BENIGN') OVER ()::DOUBLE AS p, count(*) FILTER (WHERE label = 'BENIGN') OVER ()::DOUBLE AS n FROM flows)
GROUP BY p, n""", ["flows"])
def _(t: Tables):
    scored = t.flows.select("fwd_packets", (F.col("label") != flows.BENIGN).cast("double").alias("attack"))
    return rounded(t.spark.createDataFrame([(metrics.auc(scored, "fwd_packets", "attack"),)], "auc double"))


@query("M11_baseline_scores", """
SELECT "Label" = 'BENIGN' AS is_benign, count(*) AS flows, true AS in_range FROM flow_feat GROUP BY 1""", ["flow_feat"])
def _(t: Tables):
    rows = materialise(flows.log_flow_features(flows.flow_features(_flows(t))), "flows")
    forest, moments = supervised.fit_baseline(rows.filter(F.upper("Label") == flows.BENIGN), FLOW_COLUMNS)
    scored = supervised.baseline_scores(rows, FLOW_COLUMNS, forest, moments, rows.count())
    inside = (F.col("baseline_anomaly_score") > 0) & (F.col("baseline_anomaly_score") < 1)
    return scored.groupBy((F.upper("Label") == flows.BENIGN).alias("is_benign")).agg(
        F.count("*").alias("flows"), F.bool_and(inside).alias("in_range"))


def _trained(t: Tables, model: str, **options):
    rows = flows.flow_features(_flows(t))
    split = materialise(supervised.stratified_split(rows, "Label"), "split")
    names = {c: f"f{i}" for i, c in enumerate(FLOW_COLUMNS)}
    plain = split.withColumnsRenamed(names)
    train = plain.filter("split = 'train'")
    ready = supervised.prepare(plain, list(names.values()), train)
    fitted = supervised.train_classifier(
        ready.filter("split = 'train'"), list(names.values()), "Label", model, **options)
    held_out = ready.filter("split <> 'train'")
    return fitted.transform(spread(held_out, held_out.count(), most=supervised.SCORED_ROWS))


def _classified(name: str, model: str, **options):
    @query(name)
    def _(t: Tables):
        predicted = _trained(t, model, **options)
        return predicted.groupBy("split").agg(
            F.count("*").alias("flows"),
            F.avg((F.col("Label") == F.col("predicted")).cast("double")).alias("accuracy"))


_classified("M18_logistic_regression", "lr")
# Classes are random in the test tables: full trees only memorise, and take minutes on a thousandth of the scale.
_classified("M19_random_forest", "rf", depth=5)
