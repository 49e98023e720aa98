"""Every query with comparison SQL gives the same rows in both engines."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points

FOLDER = os.environ.get("TRAPLINE_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
# Fits take long; the full run includes them.
SLOW = {"M05", "M07", "M08", "M10", "M11", "M18", "M19"}
FULL = os.environ.get("TRAPLINE_FULL") == "1"
ORACLES = entry_points.oracle_sql()
QUERIES = entry_points.queries()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, (bool, int, float)):
        return float(value)
    return str(value)


def rows(frame: pd.DataFrame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(([plain(v) for v in r] for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if FULL or n.split("_")[0] not in SLOW))
def test_same_rows(spark, duck, name):
    ours = QUERIES[name](spark, FOLDER).toPandas()
    theirs = duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_one_row_per_session(spark):
    frame = entry_points.entry(spark)
    assert frame.count() == frame.select("session_id").distinct().count() > 0
