"""Putting variables of one grid side by side, and what is computed across them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galeframe.functions import classify, field, units
from galeframe.operators.attach import attach, attach_counted
from galeframe.operators.grid_stats import value_range
from galeframe.operators.percentiles import percentiles
from galeframe.operators.stencil import TILE, Span, finite, gaussian_weights, smoothed, tiled


def layers_side_by_side(cells: DataFrame, cell: Sequence[str], names: dict[str, str]) -> DataFrame:
    """One row per cell with a column per layer; ``names`` maps variable to column.

    Conditional aggregation instead of self joins: one scan, one shuffle, and the
    partial aggregate already merges the variables that share an input partition.
    """
    wanted = cells.filter(F.col("variable").isin(list(names)))
    return wanted.groupBy(*cell).agg(
        *[F.max(F.when(F.col("variable") == v, F.col("value"))).alias(c) for v, c in names.items()],
        *[F.max(F.col("variable") == v).alias(f"has_{c}") for v, c in names.items()],
    )


def wind_uv(cells: DataFrame, cell: Sequence[str], u: str = "u", v: str = "v") -> DataFrame:
    """Wind speed where both components exist for the cell."""
    both = layers_side_by_side(cells, cell, {u: "u", v: "v"}).filter("has_u AND has_v")
    return both.select(*cell, "u", "v", units.wind_speed(F.col("u"), F.col("v")).alias("speed"))


def precip_layers(cells: DataFrame, frame: Sequence[str], cell: Sequence[str] = ("lat_idx", "lon_idx")) -> DataFrame:
    """Rate with rain and snow flags; a frame without a flag layer has 0 for it.

    A frame without rate is left out. Inside a frame that has the flag layer a
    missing flag stays missing.
    """
    frame, cell = list(frame), list(cell)
    names = {"prate": "prate", "crain": "crain", "csnow": "csnow"}
    wide = layers_side_by_side(cells, frame + cell, names)
    present = (
        cells.filter(F.col("variable").isin(list(names)))
        .groupBy(*frame)
        .agg(*[F.max(F.col("variable") == v).alias(f"in_{c}") for v, c in names.items()])
        .filter("in_prate")
    )
    flag = lambda c: F.when(F.col(f"in_{c}"), F.col(c)).otherwise(F.lit(0.0)).alias(c)
    return attach_counted(wide, present, frame).select(*frame, *cell, "prate", flag("crain"), flag("csnow"))


def precip_index(layers: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Add ``mm_h``, ``combined`` and ``effect``; the peak rate is that of the series."""
    rated = layers.withColumn("mm_h", units.rate_to_mm_h(F.col("prate")))
    top = rated.groupBy(*series).agg(F.max("mm_h").alias("_top"))
    safe = F.when((F.col("_top") > 0) & (F.col("_top") < float("inf")), F.col("_top")).otherwise(F.lit(1.0))
    return (
        attach_counted(rated, top, series)
        .withColumns(
            {
                "combined": field.combined_index(F.col("mm_h"), safe, F.col("crain"), F.col("csnow")),
                "effect": classify.precip_class(F.col("mm_h"), F.col("crain"), F.col("csnow")),
            }
        )
        .drop("_top")
    )


def scale_cloud(cells: DataFrame, field_keys: Sequence[str], value: str = "value") -> DataFrame:
    """Cloud cover of each field to [0, 1] by the field's own range (missing as 0)."""
    v = F.coalesce(F.col(value), F.lit(0.0))
    stats = cells.groupBy(*field_keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    return (
        attach_counted(cells, stats, field_keys)
        .withColumn(value, field.scaled_cloud(F.col(value), F.col("_lo"), F.col("_hi")))
        .select(*cells.columns)
    )


def cloud_layers(cells: DataFrame, cell: Sequence[str], names: dict[str, str]) -> DataFrame:
    """Cells for which all layers of ``names`` exist."""
    wide = layers_side_by_side(cells, cell, names)
    for c in names.values():
        wide = wide.filter(F.col(f"has_{c}"))
    return wide.select(*cell, *names.values())


def color_norm(cells: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Add ``norm``: position of the value in the field's colour range."""
    ranged = attach_counted(cells, value_range(cells, keys, value), keys)
    return ranged.select(
        *cells.columns,
        field.normalized(F.col(value), F.col("range_low"), F.col("range_high")).alias("norm"),
    )


def shown_rain(cells: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Add ``shown``: rain scaled by its 99th percentile with a gamma."""
    stats = percentiles(cells, keys, F.col(value), [0.99]).select(
        *keys, F.col("_q")[0].alias("_p99"), F.col("_hi").alias("_top")
    )
    return attach_counted(cells, stats, keys).select(
        *cells.columns,
        field.shown_rain(F.col(value), F.col("_p99"), F.col("_top")).alias("shown"),
    )


def rain_accumulate(
    cells: DataFrame,
    cell: Sequence[str],
    value: str = "value",
    reset: str = "ignore",
    include_first: bool = False,
) -> DataFrame:
    """Total of the increases from frame to frame; missing counts as 0.

    The first frame contributes nothing and a drop contributes nothing, unless
    ``include_first`` and ``reset="add"`` (the value after a drop is new rain).
    A cell's series has one row per forecast hour, so its window is small.
    """
    v = F.coalesce(F.col(value), F.lit(0.0))
    before = F.lag(v).over(Window.partitionBy(*cell).orderBy("fff"))
    first = v if include_first else F.lit(0.0)
    drop = v if reset == "add" else F.lit(0.0)
    gain = F.when(before.isNull(), first).when(v < before, drop).otherwise(v - before)
    return (
        cells.select(*cell, "fff", gain.alias("_gain"))
        .groupBy(*cell)
        .agg(F.sum("_gain").alias("total"), F.count(F.lit(1)).alias("frames"))
    )


def cloud_rain_proxy(
    cells: DataFrame, series: Sequence[str], shape: tuple[int, int], value: str = "value"
) -> DataFrame:
    """Pseudo rain from total cloud: time mean, smoothed, with convective cores."""
    series = list(series)
    frame = series + ["fff"]
    top = cells.groupBy(*frame).agg(F.max(value).alias("_top"))
    percent = F.when(F.col("_top") > 1.5, F.col(value) / 100).otherwise(F.col(value))
    cell = series + ["lat_idx", "lon_idx"]
    mean = (
        attach_counted(cells, top, frame)
        .groupBy(*cell)
        .agg(F.avg(F.when(F.col(value).isNotNull(), field.clip(percent, 0.0, 1.0))).alias("value"))
    )
    rain = lambda cloud, wide: np.clip(cloud * 0.55 + np.maximum(cloud - wide, 0.0) * 1.35, 0.0, 1.0) * 35.0
    return _twice_smoothed(mean, series, shape, (1.2, 3.2), rain).withColumnRenamed("value", "total")


def rain_source(frames: DataFrame, series: Sequence[str]) -> DataFrame:
    """Which rain estimate a series allows; ``frames`` has one row per field.

    Two precipitation fields are accumulated, else one cloud field gives the proxy,
    else the series is invalid.
    """
    counted = frames.groupBy(*series).agg(
        F.count_if(F.lower("variable").isin("tp", "apcp", "prate", "acpcp")).alias("n_precip"),
        F.count_if(F.lower("variable").isin("tcc", "tcdc")).alias("n_cloud"),
    )
    return counted.withColumn(
        "source",
        F.when(F.col("n_precip") >= 2, "APCP/tp").when(F.col("n_cloud") >= 1, "TCDC-proxy"),
    ).withColumn("valid", F.col("source").isNotNull())


def rain_total(
    precip: DataFrame, cloud: DataFrame, series: Sequence[str], shape: tuple[int, int]
) -> DataFrame:
    """Rain per cell by the source each series allows, with its label."""
    series = list(series)
    cell = series + ["lat_idx", "lon_idx"]
    fields = (
        precip.select(*series, "fff").distinct().withColumn("variable", F.lit("tp"))
        .unionByName(cloud.select(*series, "fff").distinct().withColumn("variable", F.lit("tcc")))
    )
    choice = rain_source(fields, series).select(*series, "source")

    def part(total: DataFrame, label: str) -> DataFrame:
        return attach(total.select(*cell, "total"), choice.filter(F.col("source") == label), series)

    return part(rain_accumulate(precip, cell), "APCP/tp").unionByName(
        part(cloud_rain_proxy(cloud, series, shape), "TCDC-proxy")
    )


def _twice_smoothed(
    cells: DataFrame,
    keys: list[str],
    shape: tuple[int, int],
    sigmas: tuple[float, float],
    combine: Callable[[np.ndarray, np.ndarray], np.ndarray],
    tile: int = TILE,
) -> DataFrame:
    """``combine`` of a smoothed field and of that smoothed once more; missing counts as 0.

    Both smoothings of a tile are made in one pass, so the halo is that of the two.
    """
    light, wide = map(gaussian_weights, sigmas)
    reach = len(wide) // 2

    def change(grid: np.ndarray, rows: Span, cols: Span) -> np.ndarray:
        middle = [s.widened(reach) for s in (rows, cols)]
        smooth = smoothed(np.nan_to_num(grid), light, *middle)
        base = smoothed(smooth, wide, *(s.within(m) for s, m in zip((rows, cols), middle)))
        own = tuple(slice(s.start - m.start, s.end - m.start) for s, m in zip((rows, cols), middle))
        return combine(smooth[own], base)

    base = cells.select(*keys, "lat_idx", "lon_idx", finite("value").alias("value"))
    return tiled(base, keys, shape, len(light) // 2 + reach, change, tile)


def unsharp(cells: DataFrame, keys: Sequence[str], shape: tuple[int, int], tile: int = TILE) -> DataFrame:
    """Light smoothing plus the positive part of what a wider smoothing removes."""
    sharp = lambda smooth, base: np.maximum(smooth + 0.45 * np.maximum(smooth - base, 0.0), 0.0)
    return _twice_smoothed(cells, list(keys), shape, (1.0, 2.6), sharp, tile)


def nearest_hour(points: DataFrame, hours: Column, run: Column, time: str = "advisory_time") -> DataFrame:
    """Add ``fff``: the forecast hour of a run nearest to a point's time.

    ``hours`` is the array of hours that the run has; of two equally near ones the
    earlier counts, and without any the hour is null.
    """
    lead = F.unix_micros(time) - F.unix_micros(run)
    gaps = F.transform(hours, lambda h: F.struct(F.abs(lead - h.cast("long") * 3_600_000_000).alias("gap"), h.alias("fff")))
    return points.withColumn("fff", F.array_min(gaps)["fff"])


def at_track_points(
    points: DataFrame,
    layers: DataFrame,
    frame: Sequence[str],
    values: Sequence[str],
    north: float,
    west: float,
    step: float,
    shape: tuple[int, int],
) -> DataFrame:
    """Bilinear grid values at points; points carry ``point_id`` and the frame key.

    Each point asks for its four corners; corners meet the grid in an equi join on
    frame and cell. A missing corner with a weight makes the value missing.
    """
    frame = list(frame)
    rows, cols = shape
    y = (F.lit(north) - F.col("lat")) / F.lit(step)
    x = (F.col("lon") - F.lit(west)) / F.lit(step)
    y0 = F.greatest(F.lit(0), F.least(F.lit(rows - 2), F.floor(y).cast("int")))
    x0 = F.greatest(F.lit(0), F.least(F.lit(cols - 2), F.floor(x).cast("int")))
    corner = lambda dy, dx: F.struct(
        (y0 + dy).alias("lat_idx"),
        (x0 + dx).alias("lon_idx"),
        (
            (y - y0 if dy else F.lit(1.0) - (y - y0)) * (x - x0 if dx else F.lit(1.0) - (x - x0))
        ).alias("weight"),
    )
    asked = points.select(
        "point_id", *frame,
        F.explode(F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1))).alias("c"),
    ).select("point_id", *frame, "c.*")
    met = asked.filter(F.col("weight") > 0).join(layers, frame + ["lat_idx", "lon_idx"], "left")
    return met.groupBy("point_id").agg(
        *[
            F.when(F.count(F.col(v)) == F.count(F.lit(1)), F.sum(F.col("weight") * F.col(v))).alias(v)
            for v in values
        ]
    )
