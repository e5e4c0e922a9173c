"""Choosing cells: areas, strides, variables, slices, frames and axis positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeframe.functions.geo import wrap_longitude
from galeframe.operators.attach import attach, attach_counted

# The regional area of interest, both ends inclusive.
REGION = {"lat": (8.0, 24.0), "lon": (102.0, 110.0)}


def bbox_filter(cells: DataFrame, lat: tuple = REGION["lat"], lon: tuple = REGION["lon"]) -> DataFrame:
    """Cells inside the area. Plain range predicates, so they reach the scan."""
    return cells.filter(F.col("lat").between(*lat) & F.col("lon").between(*lon))


def index_crop(cells: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Half-open row and column ranges."""
    r, c = F.col("lat_idx"), F.col("lon_idx")
    return cells.filter(
        (r >= rows[0]) & (r < rows[1]) & (c >= cols[0]) & (c < cols[1])
    )


def stride_downsample(cells: DataFrame, step: int = 4) -> DataFrame:
    k = max(1, int(step))
    return cells.filter((F.col("lat_idx") % k == 0) & (F.col("lon_idx") % k == 0))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def finite_cells(cells: DataFrame, value: str = "value") -> DataFrame:
    return cells.filter(is_finite(F.col(value)))


def stride_sample(cells: DataFrame, keys: Sequence[str], target: int = 3000, value: str = "value") -> DataFrame:
    """Every max(1, n // target)-th finite cell of a field in row-major order.

    Positions come from the counts of whole grid rows, a table with one row per
    field and latitude, plus the position inside the grid row.
    """
    keys = list(keys)
    kept = finite_cells(cells, value)
    per_row = kept.groupBy(*keys, "lat_idx").agg(F.count(F.lit(1)).alias("_n"))
    field = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    starts = per_row.select(
        *keys,
        "lat_idx",
        F.coalesce(
            F.sum("_n").over(field.orderBy("lat_idx").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_start"),
        F.greatest(
            F.lit(1), F.floor(F.sum("_n").over(field) / F.lit(target))
        ).alias("_step"),
    )
    row = Window.partitionBy(*keys, "lat_idx").orderBy("lon_idx")
    return (
        attach_counted(kept, starts, keys + ["lat_idx"])
        .withColumn("_pos", F.col("_start") + F.row_number().over(row) - 1)
        .filter(F.col("_pos") % F.col("_step") == 0)
        .select(*cells.columns)
    )


def unify_coordinates(cells: DataFrame) -> DataFrame:
    """Accept ``latitude``/``longitude`` for ``lat``/``lon``; fail if neither is there."""
    for short, long in (("lat", "latitude"), ("lon", "longitude")):
        if short not in cells.columns:
            if long not in cells.columns:
                raise ValueError(f"no {long} column")
            cells = cells.withColumnRenamed(long, short)
    return cells


def index_axes(cells: DataFrame, grid: Sequence[str] = (), north_first: bool = True) -> DataFrame:
    """Add ``lat_idx``/``lon_idx``: dense positions, north (or south) and west first.

    Ranks are taken over the distinct coordinates of a grid, a few thousand rows,
    never over cells. ``grid`` names the columns that tell grids apart.
    """
    grid = list(grid)

    def axis(name: str, index: str, descending: bool) -> DataFrame:
        part = Window.partitionBy(*grid) if grid else Window.partitionBy(F.lit(0))
        by = F.col(name).desc() if descending else F.col(name).asc()
        ranks = cells.select(*grid, name).distinct()
        return ranks.withColumn(index, F.dense_rank().over(part.orderBy(by)) - 1)

    out = cells.drop("lat_idx", "lon_idx")
    out = attach_counted(out, axis("lat", "lat_idx", north_first), grid + ["lat"])
    return attach_counted(out, axis("lon", "lon_idx", False), grid + ["lon"])


def normalize_longitude(cells: DataFrame, grid: Sequence[str] = ()) -> DataFrame:
    """Longitudes to [-180, 180) where the grid runs past 180, then re-index."""
    top = cells.groupBy(*grid).agg(F.max("lon").alias("_top"))
    wrapped = attach_counted(cells, top, grid).withColumn(
        "lon",
        F.when(F.col("_top") > 180, wrap_longitude(F.col("lon"))).otherwise(F.col("lon")),
    )
    return index_axes(wrapped.select(*cells.columns), grid)


def pick_variable(
    cells: DataFrame,
    layers: dict[str, Sequence[str]],
    keys: Sequence[str],
    order: str = "dataset",
) -> DataFrame:
    """For each layer keep the cells of the first candidate variable present.

    ``cells`` carries ``dataset_idx`` and ``variable``. By default the earliest
    dataset wins and the candidate list only breaks ties inside it;
    ``order="priority"`` looks at the list first. Adds ``layer``.
    """
    keys = list(keys)
    wanted = F.array(
        *[
            F.struct(F.lit(layer).alias("layer"), F.lit(name.lower()).alias("name"), F.lit(i).alias("prio"))
            for layer, names in layers.items()
            for i, name in enumerate(names)
        ]
    )
    offered = (
        cells.select(*keys, "dataset_idx", "variable")
        .distinct()
        .select("*", F.explode(F.filter(wanted, lambda w: w["name"] == F.lower("variable"))).alias("w"))
    )
    rank = ("dataset_idx", "w.prio") if order == "dataset" else ("w.prio", "dataset_idx")
    chosen = offered.groupBy(*keys, F.col("w.layer").alias("layer")).agg(
        F.min_by(F.struct("dataset_idx", "variable"), F.struct(*rank)).alias("c")
    )
    chosen = chosen.select(*keys, "layer", "c.dataset_idx", "c.variable")
    return attach_counted(cells, chosen, keys + ["dataset_idx", "variable"])


def first_variable(cells: DataFrame, file_keys: Sequence[str]) -> DataFrame:
    """Only the first data variable of each file (lowest ``var_seq``)."""
    first = cells.groupBy(*file_keys).agg(F.min_by("variable", "var_seq").alias("variable"))
    return attach_counted(cells, first, list(file_keys) + ["variable"])


def first_slice(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First index of an extra dimension ``level_idx``; ``single`` tells if it had one."""
    keys = list(keys)
    lowest = cells.groupBy(*keys).agg(
        F.min("level_idx").alias("level_idx"),
        (F.min("level_idx") == F.max("level_idx")).alias("single"),
    )
    return attach_counted(cells, lowest, keys + ["level_idx"])


def frame_limit(cells: DataFrame, series: Sequence[str], max_frames: int = 80) -> DataFrame:
    """First ``max_frames`` forecast hours of each series.

    The hours are ranked in a table with one row per frame; cells are then cut by a
    semi join on the frame key, which also prunes partitions by hour.
    """
    series = list(series)
    hours = cells.select(*series, "fff").distinct()
    part = Window.partitionBy(*series) if series else Window.partitionBy(F.lit(0))
    kept = hours.withColumn("_r", F.row_number().over(part.orderBy("fff"))).filter(
        F.col("_r") <= max_frames
    )
    return attach_counted(cells, kept.select(*series, "fff"), series + ["fff"], "left_semi")


def label_points(
    cells: DataFrame, shape: tuple[int, int], size: tuple[int, int], value: str = "value"
) -> DataFrame:
    """Cells that carry a printed value, with pixel position and rounded text.

    ``shape`` is the grid's rows and columns, ``size`` the picture's height and width.
    """
    rows, cols = shape
    height, width = size
    step_r, step_c = max(1, rows // 10), max(1, cols // 8)
    extent = cells.agg(
        F.min("lat").alias("_s"), F.max("lat").alias("_n"),
        F.min("lon").alias("_w"), F.max("lon").alias("_e"),
    )
    picked = cells.filter(
        (F.col("lat_idx") % step_r == 0)
        & (F.col("lon_idx") % step_c == 0)
        & is_finite(F.col(value))
    )
    return attach(picked, extent, []).select(
        *cells.columns,
        ((F.col("lon") - F.col("_w")) / (F.col("_e") - F.col("_w")) * (width - 1)).cast("int").alias("x"),
        ((F.col("_n") - F.col("lat")) / (F.col("_n") - F.col("_s")) * (height - 1)).cast("int").alias("y"),
        F.rint(value).cast("int").cast("string").alias("label"),
    )
