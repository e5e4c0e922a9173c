"""Grid tables and grid documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.operators.grid_select import bbox_filter, stride_downsample
from galeframe.sources import rejects

GRID_JSON = "lat array<double>, lon array<double>, data array<array<double>>"


def read_series(
    spark: SparkSession,
    path: str,
    map_type: str | None = None,
    products: Sequence[str] | None = None,
    downsample: int = 4,
) -> DataFrame:
    """Frames of a map type from a cells table partitioned by map type and product.

    Partition filters prune folders before anything is read, and the 1000 m wind of the
    wind animation is left out.  Unreadable files are skipped and are the rejects of
    ``checked_series``; damage inside a file is an error.
    """
    return checked_series(spark, path, map_type, products, downsample).rows


def checked_series(
    spark: SparkSession,
    path: str,
    map_type: str | None = None,
    products: Sequence[str] | None = None,
    downsample: int = 4,
) -> rejects.Checked:
    """``read_series`` with the files it skips: (file, size, reason)."""
    found = rejects.read_parquet(spark, path)
    cells = found.rows
    if map_type is not None:
        cells = cells.filter(F.col("map_type") == map_type)
    if products is not None:
        cells = cells.filter(F.col("product").isin(list(products)))
    unused = (F.col("map_type") == "wind_animation") & (F.col("product") == "wind_1000m")
    return rejects.Checked(stride_downsample(cells.filter(~unused), downsample), found.rejects)


def write_cells(cells: DataFrame, path: str) -> None:
    """Cells table laid out for pruning: by map type and product, rows by position.

    Rows are spread by frame and latitude, so a large frame is not one task.
    """
    (
        cells.repartition("map_type", "product", "fff", "lat_idx")
        .sortWithinPartitions("map_type", "product", "fff", "lat_idx", "lon_idx")
        .write.mode("overwrite").partitionBy("map_type", "product").parquet(path)
    )


# Bits of a curve position for each of latitude and longitude (steps of 0.003 and 0.006 degrees).
CURVE_BITS = 16
# Cells of a file that is laid out by area.
FILE_CELLS = 1 << 20


def curve_position(lat: Column, lon: Column) -> Column:
    """Place of a point on a curve that keeps near points together: the bits of its
    latitude and longitude in turn.  Null where either is null; longitudes may be given
    as -180 to 180 or 0 to 360, which are the same places."""
    steps = 1 << CURVE_BITS
    north = F.floor((lat + 90.0) / 180.0 * steps)
    east = F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * steps)
    sides = [F.greatest(F.lit(0), F.least(F.lit(steps - 1), side)).cast("long") for side in (north, east)]
    place = F.when(lat.isNull() | lon.isNull(), None).otherwise(F.lit(0).cast("long"))
    for k in range(CURVE_BITS):
        for at, side in ((2 * k + 1, sides[0]), (2 * k, sides[1])):
            place = place.bitwiseOR(F.shiftleft(F.shiftright(side, k).bitwiseAND(F.lit(1).cast("long")), at))
    return place


def write_cells_by_area(cells: DataFrame, path: str, file_cells: int = FILE_CELLS, group_bytes: int = 4 << 20) -> None:
    """Cells table laid out so that a read of an area skips files and row groups.

    Within a map type and product, cells follow a curve over latitude and longitude, so
    each file and each row group covers a small rectangle, which its statistics show.
    Places with very many frames are cut by frame and cell.  The cells are counted while
    the table is written; equal cells and cells without a place are kept.  Of a table
    that is there already, the map types and products written are replaced.
    """
    files = max(1, -(-cells.count() // file_cells))
    keys = [F.col("map_type"), F.col("product"), curve_position(F.col("lat"), F.col("lon")), F.col("fff"), F.col("lat_idx"), F.col("lon_idx")]
    laid = cells.repartitionByRange(files, *keys).sortWithinPartitions(*keys)
    writer = laid.write.mode("overwrite").option("parquet.block.size", group_bytes).option("maxRecordsPerFile", file_cells)
    writer.partitionBy("map_type", "product").parquet(path)


def read_area(
    spark: SparkSession, path: str, lat: tuple[float, float], lon: tuple[float, float], map_type: str | None = None
) -> DataFrame:
    """Cells of an area, both ends included.  Both ranges and the map type reach the scan."""
    cells = spark.read.parquet(path)
    if map_type is not None:
        cells = cells.filter(F.col("map_type") == map_type)
    return bbox_filter(cells, lat, lon)


def read_grid_json(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """``{lat, lon, data}`` documents as cells."""
    reader = spark.read.schema(GRID_JSON).option("multiLine", not one_per_line)
    return grid_cells(reader.json(path))


def grid_cells(documents: DataFrame) -> DataFrame:
    """Rows with ``lat``, ``lon`` and ``data`` arrays to one row per cell, north first."""
    keys = [c for c in documents.columns if c not in ("lat", "lon", "data")]
    n_lat, n_lon = F.size("lat"), F.size("lon")
    rows = documents.select(*keys, "lat", "lon", F.posexplode("data").alias("_r", "_row"))
    cells = rows.select(*keys, "lat", "lon", "_r", F.posexplode("_row").alias("_c", "value"))
    northward = F.element_at("lat", 1) < F.element_at("lat", -1)
    westward = F.element_at("lon", 1) > F.element_at("lon", -1)
    return cells.select(
        *keys,
        F.when(northward, n_lat - 1 - F.col("_r")).otherwise(F.col("_r")).alias("lat_idx"),
        F.when(westward, n_lon - 1 - F.col("_c")).otherwise(F.col("_c")).alias("lon_idx"),
        F.get("lat", F.col("_r")).alias("lat"),
        F.get("lon", F.col("_c")).alias("lon"),
        "value",
    )
