"""Field statistics, ranges, bounds, point densities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.functions.field import clip, is_close
from galeframe.operators.attach import attach
from galeframe.operators.percentiles import percentiles
from galeframe.session import checkpointed


def field_stats(cells: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    v = F.col(value)
    return cells.groupBy(*keys).agg(
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
        F.avg(v).alias("mean_value"),
        (F.avg(v.isNull().cast("double")) * 100).alias("missing_pct"),
        (F.avg(F.coalesce(v > 0, F.lit(False)).cast("double")) * 100).alias("nonzero_pct"),
    )


def value_range(
    cells: DataFrame,
    keys: Sequence[str],
    value: str = "value",
    low: float = 0.05,
    high: float = 0.95,
    approximate: bool = False,
) -> DataFrame:
    """Colour range of a field: two percentiles, or min and max if they coincide.

    Exact percentiles lie between neighbours and hold for keys of any size;
    ``approximate`` saves passes over large keys.
    """
    if approximate:
        q = cells.groupBy(*keys).agg(
            F.percentile_approx(value, [low, high]).alias("_q"),
            F.min(value).alias("_lo"),
            F.max(value).alias("_hi"),
        )
    else:
        q = percentiles(cells, keys, F.col(value), [low, high])
    flat = is_close(F.col("_q")[0], F.col("_q")[1])
    return q.select(
        *keys,
        F.when(flat, F.col("_lo")).otherwise(F.col("_q")[0]).alias("range_low"),
        F.when(flat, F.col("_hi")).otherwise(F.col("_q")[1]).alias("range_high"),
    )


# Quantiles of contour lines, and levels for a field without rain.
CONTOUR_QUANTILES = (0.60, 0.75, 0.88, 0.95)
DRY_LEVELS = (0.1, 0.2, 0.3, 0.5)


def contour_levels(cells: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Sorted distinct contour levels, one row each (``level_no`` from 1)."""
    wet = F.when(F.col(value) > 0, F.col(value))
    levels = percentiles(cells, keys, wet, CONTOUR_QUANTILES)
    rounded = F.array_sort(
        F.array_distinct(
            F.transform(
                F.coalesce("_q", F.lit(list(DRY_LEVELS))), lambda x: F.rint(x * 1000.0) / 1000.0
            )
        )
    )
    return levels.select(*keys, F.posexplode(rounded).alias("level_no", "level")).withColumn(
        "level_no", F.col("level_no") + 1
    )


def series_value_range(cells: DataFrame, series: Sequence[str], value: str = "value") -> DataFrame:
    return cells.groupBy(*series).agg(
        F.min(value).alias("min_value"), F.max(value).alias("max_value")
    )


def bounds_center(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """South, north, west, east and the middle of the box."""
    box = points.groupBy(*keys).agg(
        F.min("lat").alias("south"), F.max("lat").alias("north"),
        F.min("lon").alias("west"), F.max("lon").alias("east"),
    )
    return box.withColumns(
        {
            "center_lat": (F.col("south") + F.col("north")) / 2,
            "center_lon": (F.col("west") + F.col("east")) / 2,
        }
    )


def time_mean(cells: DataFrame, cell: Sequence[str], value: str = "value") -> DataFrame:
    """Mean over frames of each cell, missing values left out."""
    return cells.groupBy(*cell).agg(F.avg(value).alias(value))


def density_grid(points: DataFrame, shape: tuple[int, int], keys: Sequence[str] = ()) -> DataFrame:
    """Points counted into ``shape`` bins over their own extent, scaled to the maximum.

    Empty bins have no row. Counting combines map-side, so a crowded bin is cheap.
    """
    keys = list(keys)
    height, width = shape
    extent = points.groupBy(*keys).agg(
        F.min("lat").alias("_s"), F.max("lat").alias("_n"),
        F.min("lon").alias("_w"), F.max("lon").alias("_e"),
    )

    def bin_of(v: str, lo: str, hi: str, n: int) -> Column:
        at = ((F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo) + F.lit(1e-9)) * (n - 1)).cast("int")
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), at))

    # At most one row per bin, read twice below: kept instead of counting twice.
    bins = checkpointed(
        attach(points, extent, keys)
        .groupBy(
            *keys,
            bin_of("lat", "_s", "_n", height).alias("iy"),
            bin_of("lon", "_w", "_e", width).alias("ix"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    top = bins.groupBy(*keys).agg(F.max("n").alias("_top"))
    return attach(bins, top, keys).select(
        *keys, "iy", "ix", "n",
        clip(F.col("n") / (F.col("_top") + F.lit(1e-9)), 0.0, 1.0).alias("density"),
    )


def dense_region_crop(
    density: DataFrame,
    shape: tuple[int, int],
    keys: Sequence[str] = (),
    quantile: float = 0.92,
    half: tuple[int, int] = (120, 160),
) -> DataFrame:
    """The box around the densest bins (ends exclusive), rescaled by its maximum.

    Without a bin at the threshold the box is a window around the maximum; of equal
    maxima the first in row-major order counts.
    """
    keys = list(keys)
    d = F.col("density")
    # A density grid has a fixed number of bins; four passes follow.
    density = checkpointed(density)
    threshold = density.groupBy(*keys).agg(
        F.coalesce(F.percentile(F.when(d > 0, d), F.lit(quantile)), F.lit(0.0)).alias("_thr"),
        F.max_by(F.struct("iy", "ix"), F.struct(d, -F.col("iy"), -F.col("ix"))).alias("_peak"),
    )
    marked = attach(density, threshold, keys)
    dense = d >= F.col("_thr")
    edge = lambda agg, c: agg(F.when(dense, F.col(c)))
    box = marked.groupBy(*keys).agg(
        edge(F.min, "iy").alias("_y0"), (edge(F.max, "iy") + 1).alias("_y1"),
        edge(F.min, "ix").alias("_x0"), (edge(F.max, "ix") + 1).alias("_x1"),
        F.first("_peak").alias("_peak"),
    )
    py, px = F.col("_peak.iy"), F.col("_peak.ix")
    box = box.select(
        *keys,
        F.coalesce("_y0", F.greatest(F.lit(0), py - half[0])).alias("y0"),
        F.coalesce("_y1", F.least(F.lit(shape[0]), py + half[0])).alias("y1"),
        F.coalesce("_x0", F.greatest(F.lit(0), px - half[1])).alias("x0"),
        F.coalesce("_x1", F.least(F.lit(shape[1]), px + half[1])).alias("x1"),
    )
    inside = attach(density, box, keys).filter(
        (F.col("iy") >= F.col("y0")) & (F.col("iy") < F.col("y1"))
        & (F.col("ix") >= F.col("x0")) & (F.col("ix") < F.col("x1"))
    )
    top = inside.groupBy(*keys).agg(F.max("density").alias("_top"))
    return attach(inside, top, keys).select(
        *keys, "iy", "ix", "y0", "y1", "x0", "x1",
        F.when(F.col("_top") > 1e-8, clip(d / F.col("_top"), 0.0, 1.0)).otherwise(d).alias("scaled"),
    )


def distinct_variables(cells: DataFrame, pattern: str = "cc|cdc|cld") -> DataFrame:
    """Sorted variable names that contain one of the fragments."""
    return cells.select("variable").distinct().filter(F.col("variable").rlike(pattern)).orderBy("variable")
