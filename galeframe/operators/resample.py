"""Denser grids by bicubic interpolation of values."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.operators.stencil import TILE, Span, every_cell, finite, tiled


def cubic_weight(distance: Column) -> Column:
    """Cubic convolution kernel with a = -0.5, zero from distance 2 on."""
    d = F.abs(distance)
    near = (d * 1.5 - 2.5) * d * d + 1.0
    far = ((d * -0.5 + 2.5) * d - 4.0) * d + 2.0
    return F.when(d < 1, near).when(d < 2, far).otherwise(F.lit(0.0))


def _stretch(cells: DataFrame, keys: list[str], axis: str, other: str, size: int, factor: int, extra: DataFrame) -> DataFrame:
    """One axis made ``factor`` times denser; pixel centres are aligned.

    A source cell reaches the targets whose centre is less than two source cells
    away. Taps outside the grid do not exist, and the weights of the rest are
    normalised by their own sum.
    """
    centre = F.col(axis) + 0.5
    low = F.greatest(F.lit(0), (F.ceil((centre - 2.0) * factor - 0.5)).cast("int"))
    high = F.least(F.lit(size * factor - 1), (F.floor((centre + 2.0) * factor - 0.5)).cast("int"))
    sent = cells.select(*keys, other, axis, "value", F.explode(F.sequence(low, high)).alias("_t"))
    gap = (F.col("_t") + 0.5) / F.lit(float(factor)) - F.col(axis) - 0.5
    weighted = sent.select(
        *keys, other, F.col("_t").alias(axis), "value", cubic_weight(gap).alias("_w"), gap.alias("_gap")
    ).filter(F.abs(F.col("_gap")) < 2)
    # Sources less than two cells away that the axis has, whether or not the table does.
    middle = (F.col(axis) + 0.5) / F.lit(float(factor)) - 0.5
    first = F.greatest(F.lit(0.0), F.floor(middle - 2.0) + 1)
    last = F.least(F.lit(float(size - 1)), F.ceil(middle + 2.0) - 1)
    whole = F.col("_have") == last - first + 1
    none = F.lit(None).cast("double")
    return (
        weighted.select(*keys, other, axis, "value", "_w")
        .unionByName(extra.select(*keys, other, axis, none.alias("value"), none.alias("_w")))
        .groupBy(*keys, other, axis)
        .agg(
            F.sum(F.col("value") * F.col("_w")).alias("_sum"),
            F.sum("_w").alias("_norm"),
            F.count("value").alias("_have"),
        )
        .select(
            *keys, other, axis,
            F.when(whole, F.col("_sum") / F.col("_norm")).alias("value"),
        )
    )


# Source cells on either side that the targets of a tile reach.
REACH = 2


def _axis_weights(span: Span, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """Normalised weights of an axis, target by source, and which sources are in reach."""
    target, source = np.arange(span.start * factor, span.end * factor), np.arange(span.low, span.high)
    gap = (target[:, None] + 0.5) / factor - source[None, :] - 0.5
    d = np.abs(gap)
    near = (1.5 * d - 2.5) * d * d + 1.0
    far = ((-0.5 * d + 2.5) * d - 4.0) * d + 2.0
    weights = np.where(d < 1, near, np.where(d < 2, far, 0.0))
    return weights / weights.sum(axis=1, keepdims=True), (d < 2).astype(float)


def bicubic_upsample(
    cells: DataFrame,
    keys: Sequence[str],
    shape: tuple[int, int],
    factor: int,
    strategy: str = "tile",
    tile: int = TILE,
    default: float | None = None,
) -> DataFrame:
    """Dense frames of ``shape`` to frames ``factor`` times as tall and wide.

    ``strategy`` as for the stencils; ``tile`` is the size of a tile of the result.  A
    missing cell spreads, or counts as ``default`` where one is given.
    """
    keys = list(keys)
    base = cells.select(*keys, "lat_idx", "lon_idx", finite("value").alias("value"))

    def denser(grid: np.ndarray, rows: Span, cols: Span) -> np.ndarray:
        if default is not None:
            grid = np.where(np.isnan(grid), default, grid)
        (down, near_down), (across, near_across) = (_axis_weights(s, factor) for s in (rows, cols))
        missing = np.isnan(grid)
        dense = down @ np.where(missing, 0.0, grid) @ across.T
        dense[near_down @ missing @ near_across.T > 0] = np.nan
        return dense

    if strategy == "tile":
        return tiled(base, keys, shape, REACH, denser, max(1, tile // factor), factor)
    if default is not None:
        # max passes over nulls, so a cell that is there keeps its value.
        filled = base.unionByName(every_cell(base, keys, shape)).groupBy(*keys, "lat_idx", "lon_idx")
        base = filled.agg(F.coalesce(F.max("value"), F.lit(float(default))).alias("value"))
    extra = every_cell(base, keys, (shape[0] * factor, shape[1]))
    tall = _stretch(base, keys, "lat_idx", "lon_idx", shape[0], factor, extra)
    wide = _stretch(tall, keys, "lon_idx", "lat_idx", shape[1], factor, every_cell(base, keys, (shape[0] * factor, shape[1] * factor)).limit(0))
    return wide.select(*keys, "lat_idx", "lon_idx", "value")


def upsample_stats(original: DataFrame, denser: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Point counts before and after, points added and the density ratio."""
    keys = list(keys)
    count = lambda d, n: d.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    both = count(original, "original").join(count(denser, "denser"), keys)
    return both.withColumns(
        {
            "added": F.col("denser") - F.col("original"),
            "ratio": F.col("denser") / F.col("original"),
        }
    )
