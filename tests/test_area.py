"""Cells laid out by area: same rows, and reads that skip most of the table."""

from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from galeframe.sources import grids

LAT, LON = (10.0, 14.0), (100.0, 108.0)


@pytest.fixture(scope="module")
def world(spark):
    """Three frames of the whole earth in steps of one degree."""
    cells = spark.range(3 * 181 * 360).selectExpr(
        "'rain' AS map_type", "'basic' AS product", "CAST(id % 3 AS INT) AS fff",
        "CAST(id DIV 3 DIV 360 AS INT) AS lat_idx", "CAST(id DIV 3 % 360 AS INT) AS lon_idx", "CAST(id AS DOUBLE) AS value",
    )
    return cells.withColumn("lat", 90.0 - F.col("lat_idx")).withColumn("lon", F.col("lon_idx") - 180.0)


def touched(path, rows_of):
    """Share of the rows that stand in files which an area touches by their statistics."""
    hit = total = 0
    for file in Path(path).rglob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            found = {group.column(c).path_in_schema: group.column(c).statistics for c in range(group.num_columns)}
            total += group.num_rows
            if all(found[n].min <= high and found[n].max >= low for n, (low, high) in rows_of.items()):
                hit += group.num_rows
    return hit / total


def test_an_area_touches_few_files(spark, world, tmp_path):
    path = str(tmp_path / "cells")
    grids.write_cells_by_area(world, path, file_cells=4096)
    got = grids.read_area(spark, path, LAT, LON, "rain")
    inside = world.where(F.col("lat").between(*LAT) & F.col("lon").between(*LON))
    assert got.count() == inside.count() == 3 * 5 * 9
    assert got.select(world.columns).exceptAll(inside).isEmpty()
    assert spark.read.parquet(path).count() == world.count()
    assert touched(path, {"lat": LAT, "lon": LON}) < 0.1
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = grids.read_area(spark, path, LAT, LON, "rain")._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :]
    assert all(f in pushed for f in ("GreaterThanOrEqual(lat,10.0)", "LessThanOrEqual(lon,108.0)"))


def test_rows_by_latitude_touch_more(world, tmp_path):
    path = str(tmp_path / "cells")
    grids.write_cells(world, path)
    assert touched(path, {"lat": LAT, "lon": LON}) > 0.1


def test_places_on_the_curve(spark):
    rows = [(0.0, 190.0), (0.0, -170.0), (90.0, 179.999), (-90.0, -180.0), (None, 1.0), (1.0, None)]
    at = spark.createDataFrame(rows, "lat double, lon double").select(grids.curve_position(F.col("lat"), F.col("lon"))).collect()
    at = [r[0] for r in at]
    assert at[0] == at[1] and at[2] == (1 << 32) - 1 and at[3] == 0 and at[4] is None and at[5] is None


def test_one_place_with_many_frames_and_no_place(spark, tmp_path):
    many = spark.range(9000).selectExpr(
        "'m' AS map_type", "'p' AS product", "CAST(id AS INT) AS fff", "0 AS lat_idx", "0 AS lon_idx",
        "IF(id % 100 = 0, NULL, 10.0D) AS lat", "100.0D AS lon", "1.0D AS value",
    )
    path = str(tmp_path / "one")
    grids.write_cells_by_area(many, path, file_cells=1000)
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in Path(path).rglob("*.parquet")]
    assert sum(sizes) == 9000 and len(sizes) >= 6 and max(sizes) <= 1000
    assert grids.read_area(spark, path, (9.0, 11.0), (99.0, 101.0)).count() == 8910
    none = str(tmp_path / "none")
    grids.write_cells_by_area(many.limit(0), none)
    assert spark.read.schema(many.schema).parquet(none).count() == 0
