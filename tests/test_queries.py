"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from galeframe.plans import QUERIES as PLANS

DATA = os.environ.get("TEST_SF_DIR", entry_points.SMALL)
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
QUERIES = {name: entry_points.queries()[name] for name in PLANS}
SQL = {name: sql for name, sql in entry_points.oracle_sql().items() if name in PLANS}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def comparable(table):
    """Column names in order and rows as sorted text, floats in full."""
    names = sorted(table.column_names)

    def cell(value):
        if value is None or isinstance(value, float) and math.isnan(value):
            return "null"
        return repr(value + 0.0) if isinstance(value, float) else str(value)

    columns = [table.column(n).to_pylist() for n in names]
    return names, sorted(tuple(map(cell, row)) for row in zip(*columns))


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA).toArrow()
    assert got.num_rows > 0
    assert comparable(got) == comparable(duck.sql(SQL[name]).to_arrow_table())


@pytest.mark.parametrize("name", ["enrich_track", "merge_track", "time_interpolate", "cone_polygon", "storm_document", "advisory_movement", "series_payload", "value_range_p5_p95", "color_norm", "contour_levels", "rain_visual_scale"])
def test_query_matches_sql_with_hot_keys(spark, duck, hot, name):
    assert comparable(QUERIES[name](spark, DATA).toArrow()) == comparable(duck.sql(SQL[name]).to_arrow_table())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
