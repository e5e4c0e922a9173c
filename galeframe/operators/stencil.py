"""Neighbourhood operators on grids.

Tiles: a frame is cut into square tiles, every cell goes to its own tile and to those
whose border of ``halo`` cells it lies in, and one numpy pass makes a tile.  That is one
shuffle, little more than a row per cell, and no task holds more than a tile, whatever
the size of the frame.

``strategy="scatter"`` is the form in built-in functions: each cell sends its weighted
value to the cells around it, with the border rule folded into the target index, and the
targets add up; the sums combine map-side.

Both forms mean the same: a frame that has any cell has a result for every cell of its
shape, and absent cells, nulls, NaN and infinities are all missing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

# Rows and columns of a tile: half a megabyte of values.
TILE = 256


def finite(value: Column | str) -> Column:
    """``value`` with NaN and infinities as null."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(F.abs(value) < float("inf"), value)


def every_cell(cells: DataFrame, keys: list[str], shape: tuple[int, int], spread: bool = True) -> DataFrame:
    """Every cell of every frame that has one, with a null value; one row per frame is
    all that is shuffled.

    Frames are few small rows, which adaptive execution would merge into one task that
    then makes (and sums) the cells of all; ``spread`` deals them over all tasks.
    """
    frames = cells.select(*keys).distinct() if keys else cells.limit(1).select()
    if keys and spread:
        frames = frames.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grid = frames.withColumn("lat_idx", axis(shape[0])).withColumn("lon_idx", axis(shape[1]))
    return grid.withColumn("value", F.lit(None).cast("double"))


def clamped(index: Column, size: int) -> Column:
    """Border rule: repeat the edge."""
    return F.greatest(F.lit(0), F.least(F.lit(size - 1), index))


def reflected(index: Column, size: int) -> Column:
    """Border rule: mirror at the outer edge of the border cell."""
    turn = F.pmod(index, F.lit(2 * size))
    return F.when(turn < size, turn).otherwise(F.lit(2 * size - 1) - turn)


def gaussian_weights(sigma: float) -> list[float]:
    """Normalised weights for offsets -r..r with r = int(4 sigma + 0.5)."""
    radius = int(4.0 * sigma + 0.5)
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def _pass(cells: DataFrame, keys: list[str], axis: str, other: str, size: int, weights: list[float], extra: DataFrame) -> DataFrame:
    radius = len(weights) // 2
    taps = F.lit([float(w) for w in weights])
    sent = cells.select(*keys, other, axis, "value", F.posexplode(taps).alias("_k", "_w"))
    return (
        sent.select(
            *keys,
            other,
            reflected(F.col(axis) + F.col("_k") - radius, size).cast("int").alias(axis),
            (F.col("value") * F.col("_w")).alias("value"),
        )
        .unionByName(extra)
        .groupBy(*keys, other, axis)
        .agg(F.sum("value").alias("value"))
    )


def gaussian(
    cells: DataFrame,
    keys: Sequence[str],
    sigma: float,
    shape: tuple[int, int],
    strategy: str = "tile",
    tile: int = TILE,
) -> DataFrame:
    """Gaussian smoothing of frames; missing counts as 0, borders reflect."""
    keys = list(keys)
    base = cells.select(*keys, "lat_idx", "lon_idx", F.coalesce(finite("value"), F.lit(0.0)).alias("value"))
    weights = gaussian_weights(sigma)
    if strategy == "tile":
        return tiled(base, keys, shape, len(weights) // 2, lambda grid, *spans: smoothed(np.nan_to_num(grid), weights, *spans), tile)
    extra = every_cell(base, keys, shape).withColumn("value", F.lit(0.0))
    rows = _pass(base, keys, "lat_idx", "lon_idx", shape[0], weights, extra)
    both = _pass(rows, keys, "lon_idx", "lat_idx", shape[1], weights, extra.limit(0))
    return both.select(*keys, "lat_idx", "lon_idx", "value")


def box_blur(
    cells: DataFrame,
    keys: Sequence[str],
    shape: tuple[int, int],
    passes: int = 1,
    strategy: str = "scatter",
    tile: int = TILE,
) -> DataFrame:
    """Mean of the 3x3 neighbourhood with repeated edges; a missing cell spreads."""
    keys = list(keys)
    out = cells.select(*keys, "lat_idx", "lon_idx", finite("value").alias("value"))
    if strategy == "tile":
        return tiled(out, keys, shape, passes, lambda grid, rows, cols: _blur(grid, rows, cols, passes), tile)
    extra = every_cell(out, keys, shape)
    for _ in range(passes):
        out = _blur_pass(out, keys, shape, extra)
        extra = extra.limit(0)
    return out


def _blur_pass(cells: DataFrame, keys: list[str], shape: tuple[int, int], extra: DataFrame) -> DataFrame:
    moves = F.array(
        *[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    )
    sent = cells.select(*keys, "lat_idx", "lon_idx", "value", F.explode(moves).alias("m"))
    return (
        sent.select(
            *keys,
            clamped(F.col("lat_idx") + F.col("m.dy"), shape[0]).alias("lat_idx"),
            clamped(F.col("lon_idx") + F.col("m.dx"), shape[1]).alias("lon_idx"),
            "value",
        )
        .unionByName(extra)
        .groupBy(*keys, "lat_idx", "lon_idx")
        .agg(F.sum("value").alias("_sum"), F.count("value").alias("_n"))
        .select(
            *keys, "lat_idx", "lon_idx",
            F.when(F.col("_n") == 9, F.col("_sum") / 9.0).alias("value"),
        )
    )


@dataclass(frozen=True)
class Span:
    """What a tile has of an axis of ``size`` cells: it makes ``start`` to ``end`` (half
    open) and sees ``low`` to ``high``."""

    start: int
    end: int
    low: int
    high: int
    size: int

    @classmethod
    def of(cls, number: int, tile: int, halo: int, size: int) -> Span:
        start, end = number * tile, min(size, (number + 1) * tile)
        return cls(start, end, max(0, start - halo), min(size, end + halo), size)

    def widened(self, by: int) -> Span:
        """The span that makes ``by`` cells more on either side, of what this one sees."""
        return Span(max(0, self.start - by), min(self.size, self.end + by), self.low, self.high, self.size)

    def within(self, wider: Span) -> Span:
        """This span where it sees no more than what ``wider`` makes."""
        return Span(self.start, self.end, wider.start, wider.end, self.size)


def smoothed(grid: np.ndarray, weights: list[float], rows: Span, cols: Span) -> np.ndarray:
    return _smooth(_smooth(grid, weights, 0, rows), weights, 1, cols)


def _smooth(grid: np.ndarray, weights: list[float], axis: int, span: Span) -> np.ndarray:
    radius = len(weights) // 2
    turn = np.arange(span.start - radius, span.end + radius) % (2 * span.size)
    source = np.where(turn < span.size, turn, 2 * span.size - 1 - turn) - span.low
    wide = np.take(grid, source, axis=axis)
    made = span.end - span.start
    return sum(w * np.take(wide, np.arange(k, k + made), axis=axis) for k, w in enumerate(weights))


def _blur(grid: np.ndarray, rows: Span, cols: Span, passes: int) -> np.ndarray:
    """Edges repeat at the border of the frame; at other borders of the tile every pass
    uses up a row or column of the halo."""
    ends = [(int(s.low == 0), int(s.high == s.size)) for s in (rows, cols)]
    for _ in range(passes):
        wide = np.pad(grid, ends, mode="edge")
        h, w = wide.shape[0] - 2, wide.shape[1] - 2
        grid = sum(wide[y : y + h, x : x + w] for y in range(3) for x in range(3)) / 9.0
    first = [s.start if s.low == 0 else 0 for s in (rows, cols)]
    return grid[first[0] : first[0] + rows.end - rows.start, first[1] : first[1] + cols.end - cols.start]


def tiled(
    cells: DataFrame,
    keys: list[str],
    shape: tuple[int, int],
    halo: int,
    change: Callable[[np.ndarray, Span, Span], np.ndarray],
    tile: int = TILE,
    factor: int = 1,
) -> DataFrame:
    """Every cell of ``change`` of each tile of each frame; missing cells are NaN in it.

    ``change`` gets what a tile sees of the frame and returns what the tile makes,
    ``factor`` times as tall and wide as the tile.  Tiles are no smaller than the halo.
    """
    tile = max(int(tile), halo, 1)
    number = [-(-n // tile) for n in shape]

    def one(key: tuple, table: pa.Table) -> pa.Table:
        rows, cols = (Span.of(key[len(keys) + k].as_py(), tile, halo, shape[k]) for k in (0, 1))
        grid = np.full((rows.high - rows.low, cols.high - cols.low), np.nan)
        y, x = (table.column(n).to_numpy() for n in ("lat_idx", "lon_idx"))
        value = table.column("value").to_numpy()  # nulls are NaN
        real = y >= 0
        grid[y[real] - rows.low, x[real] - cols.low] = value[real]
        made = change(grid, rows, cols)
        y, x = np.indices(made.shape)
        own = [pa.repeat(k, made.size) for k in key[: len(keys)]]
        own += [pa.array((a.ravel() + s.start * factor).astype(np.int32)) for a, s in ((y, rows), (x, cols))]
        return pa.Table.from_arrays([*own, pa.array(made.ravel(), from_pandas=True)], names=[*keys, "lat_idx", "lon_idx", "value"])

    def numbers(axis: str, k: int) -> Column:
        seen = [F.floor((F.col(axis) + d) / F.lit(tile)).cast("int") for d in (-halo, halo)]
        return F.explode(F.sequence(F.greatest(F.lit(0), seen[0]), F.least(F.lit(number[k] - 1), seen[1])))

    place = [F.col(c).cast("int").alias(c) for c in ("lat_idx", "lon_idx")]
    sent = cells.select(*keys, *place, F.col("value").cast("double").alias("value"))
    sent = sent.withColumn("_ty", numbers("lat_idx", 0)).withColumn("_tx", numbers("lon_idx", 1))
    # One row more for every tile of a frame, so that tiles without cells are made too.
    every = every_cell(cells, keys, (number[0], number[1]), spread=False).withColumnsRenamed({"lat_idx": "_ty", "lon_idx": "_tx"})
    every = every.withColumns({"lat_idx": F.lit(-1), "lon_idx": F.lit(-1)})
    own = [StructField(f.name, f.dataType) for f in cells.select(*keys).schema]
    cell = [StructField("lat_idx", IntegerType()), StructField("lon_idx", IntegerType()), StructField("value", DoubleType())]
    return sent.unionByName(every).groupBy(*keys, "_ty", "_tx").applyInArrow(one, StructType([*own, *cell]))
