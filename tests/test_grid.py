"""Grid operators against numpy on small frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from galeframe import sinks
from galeframe.operators import grid_select, grid_stats, layers, resample, stencil
from galeframe.sources import grids

RNG = np.random.default_rng(3)


def frame(spark, grid, **extra):
    """One frame as cells; NaN becomes null."""
    h, w = grid.shape
    data = [
        (y, x, 24.0 - 0.25 * y, 102.0 + 0.25 * x, None if np.isnan(grid[y, x]) else float(grid[y, x]))
        for y in range(h) for x in range(w)
    ]
    df = spark.createDataFrame(data, "lat_idx int, lon_idx int, lat double, lon double, value double")
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return df


def array(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["lat_idx"], r["lon_idx"]] = np.nan if r["value"] is None else r["value"]
    return out


def gather_blur(grid):
    wide = np.pad(grid, 1, mode="edge")
    h, w = grid.shape
    return sum(wide[y : y + h, x : x + w] for y in range(3) for x in range(3)) / 9


def gather_gauss(grid, sigma):
    weights = stencil.gaussian_weights(sigma)
    r = len(weights) // 2
    for axis in (0, 1):
        n = grid.shape[axis]
        wide = np.take(grid, [(i % (2 * n)) if (i % (2 * n)) < n else 2 * n - 1 - (i % (2 * n)) for i in range(-r, n + r)], axis)
        grid = sum(w * np.take(wide, range(k, k + n), axis) for k, w in enumerate(weights))
    return grid


@pytest.mark.parametrize("strategy", ["scatter", "tile"])
def test_box_blur(spark, strategy):
    grid = RNG.normal(size=(7, 5))
    got = array(stencil.box_blur(frame(spark, grid, fff=0), ["fff"], (7, 5), strategy=strategy), (7, 5))
    np.testing.assert_allclose(got, gather_blur(grid), atol=1e-12)


@pytest.mark.parametrize("strategy", ["scatter", "tile"])
def test_blur_spreads_missing_values(spark, strategy):
    grid = np.ones((6, 6))
    grid[2, 3] = np.nan
    got = array(stencil.box_blur(frame(spark, grid, fff=0), ["fff"], (6, 6), strategy=strategy), (6, 6))
    assert np.isnan(got).sum() == 9 and np.nanmax(got) == pytest.approx(1.0)


@pytest.mark.parametrize("strategy", ["scatter", "tile"])
@pytest.mark.parametrize("sigma", [1.0, 3.2])
def test_gaussian(spark, strategy, sigma):
    grid = RNG.normal(size=(7, 5))
    got = array(stencil.gaussian(frame(spark, grid, fff=0), ["fff"], sigma, (7, 5), strategy), (7, 5))
    np.testing.assert_allclose(got, gather_gauss(grid, sigma), atol=1e-12)
    assert got.sum() == pytest.approx(grid.sum())


def test_constant_field_stays_constant(spark):
    flat = frame(spark, np.full((5, 4), 7.5), fff=0)
    for out in (
        stencil.box_blur(flat, ["fff"], (5, 4), passes=2),
        stencil.gaussian(flat, ["fff"], 1.2, (5, 4)),
        resample.bicubic_upsample(flat, ["fff"], (5, 4), 3),
    ):
        assert {round(r["value"], 9) for r in out.collect()} == {7.5}


def cubic(d):
    d = abs(d)
    if d < 1:
        return 1.5 * d**3 - 2.5 * d**2 + 1
    return -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d < 2 else 0.0


def stretch(grid, factor, axis):
    n = grid.shape[axis]
    rows = []
    for t in range(n * factor):
        w = np.array([cubic((t + 0.5) / factor - (i + 0.5)) for i in range(n)])
        rows.append(np.tensordot(w / w.sum(), grid, axes=(0, axis)))
    return np.stack(rows, axis=axis) if axis == 0 else np.stack(rows, axis=1)


@pytest.mark.parametrize("strategy", ["scatter", "tile"])
def test_bicubic(spark, strategy):
    grid = RNG.normal(size=(6, 7))
    got = array(resample.bicubic_upsample(frame(spark, grid, fff=0), ["fff"], (6, 7), 10, strategy), (60, 70))
    np.testing.assert_allclose(got, stretch(stretch(grid, 10, 0), 10, 1), atol=1e-12)


def test_bicubic_strategies_agree_on_missing_cells(spark):
    grid = RNG.normal(size=(8, 8))
    grid[2, 5] = np.nan
    cells = frame(spark, grid, fff=0)
    one, two = (array(resample.bicubic_upsample(cells, ["fff"], (8, 8), 3, s), (24, 24)) for s in ("scatter", "tile"))
    assert 0 < np.isnan(one).sum() < 24 * 24
    np.testing.assert_allclose(one, two, atol=1e-12)


@pytest.mark.parametrize("tile", [1, 6, 8, 23])
def test_tiles_equal_the_whole_frame(spark, tile):
    shape = (23, 17)
    grid = RNG.normal(size=shape)
    cells = frame(spark, grid, fff=0)
    smooth = array(stencil.gaussian(cells, ["fff"], 1.2, shape, tile=tile), shape)
    np.testing.assert_allclose(smooth, gather_gauss(grid, 1.2), atol=1e-12)
    blurred = array(stencil.box_blur(cells, ["fff"], shape, 3, "tile", tile), shape)
    np.testing.assert_allclose(blurred, gather_blur(gather_blur(gather_blur(grid))), atol=1e-12)
    dense = array(resample.bicubic_upsample(cells, ["fff"], shape, 2, tile=2 * tile), (46, 34))
    np.testing.assert_allclose(dense, stretch(stretch(grid, 2, 0), 2, 1), atol=1e-12)
    smooth = gather_gauss(grid, 1.0)
    sharp = np.maximum(smooth + 0.45 * np.maximum(smooth - gather_gauss(smooth, 2.6), 0), 0)
    np.testing.assert_allclose(array(layers.unsharp(cells, ["fff"], shape, tile), shape), sharp, atol=1e-12)


def test_tiles_without_cells_and_null_keys(spark):
    """A single cell of a frame of 40 x 30, whose key is null, and no frame at all."""
    one = spark.createDataFrame([(None, 3, 4, 2.0)], "fff int, lat_idx int, lon_idx int, value double")
    rows = stencil.gaussian(one, ["fff"], 1.2, (40, 30), tile=8).collect()
    assert len(rows) == len({(r["lat_idx"], r["lon_idx"]) for r in rows}) == 1200
    assert {r["fff"] for r in rows} == {None} and sum(r["value"] for r in rows) == pytest.approx(2.0)
    assert stencil.gaussian(one.limit(0), ["fff"], 1.2, (40, 30), tile=8).count() == 0
    assert stencil.gaussian(one, [], 1.2, (9, 9), tile=8).count() == 81


@pytest.mark.parametrize("strategy", ["scatter", "tile"])
def test_bicubic_with_a_default_for_missing_cells(spark, strategy):
    """Absent cells, nulls and NaN count as the default; a frame of nulls is made too."""
    rows = [("a", 1, 2, 4.0), ("a", 9, 0, -1.5), ("a", 3, 3, None), ("a", 4, 4, float("nan")), ("b", 0, 0, None)]
    cells = spark.createDataFrame(rows, "k string, lat_idx int, lon_idx int, value double")
    grid = np.full((10, 6), 0.5)
    grid[1, 2], grid[9, 0] = 4.0, -1.5
    got = resample.bicubic_upsample(cells, ["k"], (10, 6), 3, strategy, tile=12, default=0.5)
    np.testing.assert_allclose(array(got.where("k = 'a'"), (30, 18)), stretch(stretch(grid, 3, 0), 3, 1), atol=1e-12)
    np.testing.assert_allclose(array(got.where("k = 'b'"), (30, 18)), np.full((30, 18), 0.5), atol=1e-12)


def test_cells_of_many_frames_are_made_by_many_tasks(spark):
    cells = spark.range(400).selectExpr("id AS k", "0 AS lat_idx", "0 AS lon_idx", "1D AS value")
    made = stencil.every_cell(cells, ["k"], (5, 4)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in made) == 8000 and len(made) > 1 and max(r["count"] for r in made) < 6000


def test_upsample_stats(spark):
    crop = frame(spark, RNG.normal(size=(6, 6)), fff=0)
    row = resample.upsample_stats(crop, resample.bicubic_upsample(crop, ["fff"], (6, 6), 10), ["fff"]).first()
    assert (row["original"], row["denser"], row["added"], row["ratio"]) == (36, 3600, 3564, 100.0)


def test_percentiles_match_numpy(spark):
    grid = RNG.normal(size=(20, 20))
    grid[3, 4] = np.nan
    row = grid_stats.value_range(frame(spark, grid, fff=0), ["fff"]).first()
    assert row["range_low"] == pytest.approx(np.nanpercentile(grid, 5))
    assert row["range_high"] == pytest.approx(np.nanpercentile(grid, 95))
    row = grid_stats.value_range(frame(spark, np.full((3, 3), 2.0), fff=0), ["fff"]).first()
    assert (row["range_low"], row["range_high"]) == (2.0, 2.0)


def test_contours_of_a_dry_field(spark):
    levels = grid_stats.contour_levels(frame(spark, np.zeros((3, 3)), fff=0), ["fff"])
    assert [r["level"] for r in levels.orderBy("level_no").collect()] == [0.1, 0.2, 0.3, 0.5]


def test_accumulation(spark):
    data = [(i * 3, 0, 0, float(v)) for i, v in enumerate([1, 3, 3, 2, 5])]
    cells = spark.createDataFrame(data, "fff int, lat_idx int, lon_idx int, value double")
    total = lambda **k: layers.rain_accumulate(cells, ["lat_idx", "lon_idx"], **k).first()["total"]
    assert total() == 5.0
    assert total(reset="add") == 7.0
    assert total(reset="add", include_first=True) == 8.0


def test_rain_source(spark):
    data = [("a", 0, "APCP"), ("a", 3, "tp"), ("b", 0, "tp"), ("b", 3, "TCDC"), ("c", 0, "u")]
    chosen = layers.rain_source(spark.createDataFrame(data, "series string, fff int, variable string"), ["series"])
    got = {r["series"]: (r["source"], r["valid"]) for r in chosen.collect()}
    assert got == {"a": ("APCP/tp", True), "b": ("TCDC-proxy", True), "c": (None, False)}


def test_longitudes_wrap_only_past_180(spark):
    data = [(g, 0.0, lon) for g, lons in ((0, [0.0, 90.0, 180.0, 270.0]), (1, [-90.0, 0.0, 90.0])) for lon in lons]
    df = spark.createDataFrame([(*d, 1.0) for d in data], "g int, lat double, lon double, value double")
    out = grid_select.normalize_longitude(df, ["g"]).orderBy("g", "lon_idx").collect()
    assert [(r["g"], r["lon"], r["lon_idx"]) for r in out] == [
        (0, -180.0, 0), (0, -90.0, 1), (0, 0.0, 2), (0, 90.0, 3), (1, -90.0, 0), (1, 0.0, 1), (1, 90.0, 2),
    ]


def test_bbox_reaches_the_scan(spark, tmp_path):
    frame(spark, RNG.normal(size=(9, 9)), fff=0).write.parquet(str(tmp_path / "cells"))
    out = grid_select.bbox_filter(spark.read.parquet(str(tmp_path / "cells")), (22.5, 23.5), (102.5, 103.0))
    assert out.count() == 15
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = out.select("value")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(lat,22.5)" in plan and "LessThanOrEqual(lon,103.0)" in plan


def test_sampling_keeps_row_major_steps(spark):
    out = grid_select.stride_sample(frame(spark, RNG.normal(size=(10, 10)), fff=0), ["fff"], 10)
    assert sorted((r["lat_idx"], r["lon_idx"]) for r in out.collect()) == [(y, 0) for y in range(10)]


def test_variable_choice_by_dataset_or_priority(spark):
    data = [(0, "tcc", 1.0), (1, "LCDC", 2.0)]
    cells = spark.createDataFrame(data, "dataset_idx int, variable string, value double").withColumn("fff", F.lit(0))
    pick = lambda **k: grid_select.pick_variable(cells, {"low": ["lcdc", "tcc"]}, ["fff"], **k).first()["value"]
    assert pick() == 1.0
    assert pick(order="priority") == 2.0


def test_density_and_crop(spark):
    data = [(0.0, 0.0)] * 5 + [(10.0, 10.0)] + [(5.0, 5.0)] * 2
    density = grid_stats.density_grid(spark.createDataFrame(data, "lat double, lon double"), (11, 11))
    got = {(r["iy"], r["ix"]): r["n"] for r in density.collect()}
    assert got == {(0, 0): 5, (9, 9): 1, (4, 4): 2}
    crop = grid_stats.dense_region_crop(density, (11, 11)).collect()
    assert [(r["iy"], r["y0"], r["y1"], round(r["scaled"], 6)) for r in crop] == [(0, 0, 1, 1.0)]


def test_grid_json_round_trip(spark, tmp_path):
    grid = np.round(RNG.normal(size=(5, 4)), 1)
    grid[1, 2] = np.nan
    path = str(tmp_path / "doc")
    sinks.write_json(sinks.grid_documents(frame(spark, grid, fff=0), ["fff"]).drop("fff"), path)
    np.testing.assert_array_equal(array(grids.read_grid_json(spark, path, one_per_line=True), (5, 4)), grid)


def test_ascending_latitudes_are_turned(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"lat": [8.0, 9.0],\n "lon": [102.0, 103.0],\n "data": [[1, 2], [3, 4]]}')
    got = array(grids.read_grid_json(spark, str(tmp_path / "g.json")), (2, 2))
    np.testing.assert_array_equal(got, [[3, 4], [1, 2]])


def test_bilinear_value(spark):
    y, x = np.mgrid[0:5, 0:5]
    grid = frame(spark, 2.0 * y + 3.0 * x, fff=0)
    points = spark.createDataFrame([(1, 0, 23.4, 102.6), (2, 0, 24.0, 102.0), (3, 0, 23.0, 103.0)], "point_id int, fff int, lat double, lon double")
    out = layers.at_track_points(points, grid, ["fff"], ["value"], 24.0, 102.0, 0.25, (5, 5))
    got = {r["point_id"]: round(r["value"], 9) for r in out.collect()}
    assert got == {1: 2 * 2.4 + 3 * 2.4, 2: 0.0, 3: 20.0}


@pytest.mark.parametrize("limit", ["50000", "0"])
def test_cells_are_not_shuffled_to_meet_a_small_side(spark, limit):
    """One row per frame is broadcast once it is counted; beyond the limit rows are the same."""
    cells = spark.range(6 * 20).selectExpr("CAST(id % 6 AS INT) AS fff", "CAST(id % 20 AS INT) AS lon_idx", "id * 1.5 AS value", "id % 3 AS level_idx")
    spark.conf.set("galeframe.broadcast.rows", limit)
    try:
        plans = [grid_select.first_slice(cells, ["fff"]), grid_select.frame_limit(cells, [], 3)]
        texts = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
        if limit != "0":
            assert all("BroadcastHashJoin" in t and "hashpartitioning" not in t for t in texts)
        assert plans[0].count() == cells.where("level_idx = fff % 3").count() and plans[1].count() == 60
    finally:
        spark.conf.unset("galeframe.broadcast.rows")
