"""Column statistics in few passes; results are one short row per column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trapline.session import materialise

def quoted(column: str) -> str:
    return f"`{column}`"


@dataclass(frozen=True)
class ColumnStats:
    count: int
    mean: float | None
    std_pop: float | None
    std_samp: float | None
    low: float | None
    high: float | None

    @property
    def is_constant(self) -> bool:
        """At most one distinct value, or next to no spread."""
        return self.low == self.high or (self.std_samp or 0.0) < 1e-6


def long_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per value: ``name, x``."""
    plain = df.select([F.col(quoted(c)).cast("double").alias(c) for c in columns])
    return plain.unpivot([], [quoted(c) for c in columns], "name", "x")


def column_stats(df: DataFrame, columns: list[str]) -> dict[str, ColumnStats]:
    """Count, mean, spread and range of every column in one pass.

    Values are lined up by column name first: a handful of aggregates over many
    short rows compiles and runs faster than hundreds over a wide row, and
    combines to one row per column before the shuffle.
    """
    rows = long_values(df, columns).groupBy("name").agg(
        F.count("x"), F.avg("x"), F.stddev_pop("x"), F.stddev_samp("x"), F.min("x"), F.max("x")).collect()
    found = {r[0]: ColumnStats(*r[1:]) for r in rows}
    return {c: found.get(c, ColumnStats(0, None, None, None, None, None)) for c in columns}


def varying_columns(stats: dict[str, ColumnStats]) -> list[str]:
    """Columns left after dropping constant and near-constant ones."""
    return [c for c, s in stats.items() if not s.is_constant]


def _ordered(x: str) -> str:
    """A long that orders as the double ``x`` does: its sign times exponent and fraction; NaN is largest, both zeros are 0."""
    size, unit = f"abs({x})", "4503599627370496"
    power = f"floor(log2({size}))"
    exponent = f"greatest({power} + int({size} >= pow(2D, {power} + 1)) - int({size} < pow(2D, {power})), -1022)"
    digits = f"({exponent} + 1022) * {unit} + bigint({size} / pow(2D, {exponent}) * {unit}D)"
    return (f"CASE WHEN isnan({x}) THEN {2047 * 2**52 + 1} WHEN {size} = double('inf') THEN bigint(sign({x})) * {2047 * 2**52} "
            f"WHEN {x} = 0 THEN 0 ELSE bigint(sign({x})) * ({digits}) END")


def quantile_table(df: DataFrame, columns: list[str], probs: list[float], by: list[str] | None = None) -> DataFrame:
    """``*by, name, prob, value``: linearly interpolated quantiles, exact, of every column in every group.

    Values are looked at as ordered 64-bit numbers, 16 bits a round. A round counts the values
    that share their bits so far with a wanted one by their next bits, for all columns,
    probabilities and groups at once, and keeps the bucket that each wanted rank falls in.
    A bucket of one value is an answer, so there are at most four rounds, each one scan of ``df``, which should be
    stored. No task sees more than 65,536 counts of a bucket in order, and nothing is sorted.
    NULL values do not count; a group without values has no row; NaN is larger than any other value.
    """
    by = by or []
    value = F.posexplode(F.array(*[F.col(quoted(c)).cast("double") for c in columns])).alias("column", "x")
    values = df.select(*[F.col(quoted(c)).alias(f"by{i}") for i, c in enumerate(by)], value).filter("x IS NOT NULL")
    values = values.withColumn("bits", F.expr(_ordered("x")))
    keys = [*[f"by{i}" for i in range(len(by))], "column"]
    sums = [F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")]

    def placed(counts: DataFrame, group: list[str]) -> DataFrame:
        order = Window.partitionBy(*group).orderBy("bucket")
        upto = counts.withColumn("upto", F.sum("n").over(order))
        return upto.withColumn("before", F.col("upto") - F.col("n"))

    first = placed(values.groupBy(*keys, F.shiftright("bits", 48).alias("bucket")).agg(*sums), keys)
    first = first.withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    position = [F.lit(p) * (F.col("total") - 1) for p in probs]
    wanted = F.explode(F.array(*[
        F.struct(F.lit(j).alias("j"), F.lit(side).alias("side"), rank.alias("rank"), at.alias("position"))
        for j, at in enumerate(position) for side, rank in enumerate((F.floor(at), F.ceil(at)))]))
    hit = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("upto"))
    answer = [*keys, "j", "side", "position", (F.col("rank") - F.col("before")).alias("rank"), "bucket", "low", "high"]
    found = materialise(first.select("*", wanted.alias("w")).select("*", "w.*").filter(hit).select(answer), "ranks")
    for shift in (32, 16, 0):
        unsure = found.filter("low < high")
        left = [r[0] for r in unsure.select("column").distinct().collect()]
        if not left:
            break
        asked = unsure.select(*keys, "j", "side", "position", "rank", F.col("bucket").alias("parent"))
        parents = asked.select(*keys, "parent").distinct()
        inside = values.filter(F.col("column").isin(left)).withColumn("parent", F.shiftright("bits", shift + 16))
        inside = _same(inside, parents, [*keys, "parent"])
        counts = inside.groupBy(*keys, "parent", F.shiftright("bits", shift).alias("bucket")).agg(*sums)
        hits = _same(placed(counts, [*keys, "parent"]), asked, [*keys, "parent"]).filter(hit).select(answer)
        found = materialise(found.filter("NOT low < high").unionByName(hits), "ranks")
    ends = found.groupBy(*keys, "j", "position").agg(
        F.max(F.when(F.col("side") == 0, F.col("low"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("low"))).alias("b"))
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.expr("a * (1 - (position - floor(position))) + b * (position - floor(position))"))
    pick = lambda items, at: F.get(F.array(*map(F.lit, items)), F.col(at))
    return ends.select(*[F.col(f"by{i}").alias(c) for i, c in enumerate(by)],
                       pick(columns, "column").alias("name"), pick(probs, "j").alias("prob"), between.alias("value"))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join on equal keys, NULL being equal to NULL; the keys come from the left."""
    named = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(named, on).drop(*[f"_{k}" for k in keys])


def quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Quantiles of whole columns (see ``quantile_table``); None where a column has no values."""
    found = {(r["name"], r["prob"]): r["value"] for r in quantile_table(df, columns, probs).collect()} if columns else {}
    return {c: [found.get((c, p)) for p in probs] for c in columns}


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, spread, range and quartiles of every column."""
    stats = column_stats(df, columns)
    quarts = quantiles(df, columns, [0.25, 0.5, 0.75])
    rows = [(c, s.count, s.mean, s.std_samp, s.low, *quarts[c], s.high) for c, s in stats.items()]
    return df.sparkSession.createDataFrame(
        rows, "feature string, count long, mean double, std double, min double, "
        "q25 double, q50 double, q75 double, max double")


def histogram(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """Rows per equal-width bin (A33); the maximum belongs to the last bin."""
    stats = column_stats(df, columns)
    picks = []
    for c in columns:
        s = stats[c]
        if s.low is None:
            continue
        low, width = (s.low, s.high - s.low) if s.high > s.low else (s.low - 0.5, 1.0)
        x = f"double({quoted(c)})"
        picks.append(f"if({x} IS NULL, null, named_struct('feature', '{c}', 'bin', "
                     f"int(least(floor(({x} - {low!r}D) / {width!r}D * {bins}), {bins - 1}))))")
    rows = df.select(F.expr(f"explode(array({', '.join(picks)}))").alias("r")).filter("r IS NOT NULL")
    return rows.select("r.*").groupBy("feature", "bin").agg(F.count("*").alias("n"))


def largest_maxima(df: DataFrame, columns: list[str], limit: int = 20) -> DataFrame:
    """Columns with the largest maxima."""
    pairs = ", ".join(f"'{c}', double(max({quoted(c)}))" for c in columns)
    top = df.agg(F.expr(f"map({pairs})").alias("m")).select(F.explode("m").alias("feature", "maximum"))
    return top.orderBy(F.desc("maximum"), "feature").limit(limit)


def bad_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Infinite and NaN values per column that has any."""
    inf = ", ".join(
        f"named_struct('feature', '{c}', 'infinite', count_if(abs(double({quoted(c)})) = double('inf')), "
        f"'nan', count_if(isnan(double({quoted(c)}))))" for c in columns)
    return df.agg(F.expr(f"array({inf})").alias("a")).select(F.inline("a")).filter("infinite + nan > 0")
