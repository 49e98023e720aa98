"""Named queries with their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline import fixtures
from trapline.fixtures import Tables, plain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, tuple[str, list[str]]] = {}

# Views the comparison SQL may read, each with the views it reads itself.
VIEWS: dict[str, tuple[str, list[str]]] = {
    "raw_logs": (plain(fixtures.RAW_LOGS), []),
    "raw_dup": (plain(fixtures.RAW_DUP), ["raw_logs"]),
    "state_history": (fixtures.STATE_HISTORY, []),
    "geo_dim": (plain(fixtures.GEO_DIM), []),
    "geo_ranges": (plain(fixtures.GEO_RANGES), []),
    "flows": (plain(fixtures.FLOWS), []),
}


def view(name: str, sql: str, *needs: str) -> None:
    VIEWS[name] = (sql, list(needs))


def _expand(needs: list[str], seen: list[str]) -> list[str]:
    for name in needs:
        if name not in seen:
            _expand(VIEWS[name][1], seen)
            seen.append(name)
    return seen


def comparison_sql(sql: str, needs: list[str]) -> str:
    """The statement with all views it needs, each computed once."""
    views = _expand(needs, [])
    head = ", ".join(f"{v} AS MATERIALIZED ({VIEWS[v][0]})" for v in views)
    return (f"WITH {head} {sql}" if head else sql).strip()


def query(name: str, sql: str | None = None, needs: list[str] | None = None):
    """Register ``fn(tables) -> DataFrame`` and its comparison SQL."""
    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = (sql, ["raw_logs"] if needs is None else needs)
        return fn

    return register


def micros(column: str | Column) -> Column:
    """Timestamps as epoch microseconds, so both engines print them alike."""
    return F.unix_micros(F.col(column) if isinstance(column, str) else column)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round double columns, so summation order does not show."""
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles}) if doubles else df
