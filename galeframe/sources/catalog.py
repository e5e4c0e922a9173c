"""The catalogue of map types, their products, query maps and forecast hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Map type -> (start, end, step) ranges of forecast hours.
SEGMENTS = {
    "temperature_feels_like": [(0, 120, 1), (123, 384, 3)],
    "rain_basic": [(0, 24, 3)],
    "rain_advanced": [(0, 24, 3)],
    "cloud_total": [(0, 0, 1)],
    "cloud_layered": [(0, 0, 1)],
    "snow_depth": [(0, 48, 3), (54, 54, 6), (66, 240, 12)],
    "wind_animation": [(0, 120, 1), (123, 384, 3)],
}

# Map type, product, level, variables.
PRODUCTS = (
    ("temperature_feels_like", "tmp_2m", "2_m_above_ground", ("TMP",)),
    ("rain_basic", "apcp_surface", "surface", ("APCP",)),
    ("rain_advanced", "rain_adv_surface", "surface", ("PRATE", "CRAIN", "CSNOW")),
    ("cloud_total", "tcdc_entire_atmosphere", "entire_atmosphere", ("TCDC",)),
    ("cloud_layered", "low_cloud", "low_cloud_layer", ("LCDC",)),
    ("cloud_layered", "mid_cloud", "middle_cloud_layer", ("MCDC",)),
    ("cloud_layered", "high_cloud", "high_cloud_layer", ("HCDC",)),
    ("snow_depth", "snod_surface", "surface", ("SNOD",)),
    ("wind_animation", "wind_30m", "30_m_above_ground", ("UGRD", "VGRD")),
    ("wind_animation", "wind_50m", "50_m_above_ground", ("UGRD", "VGRD")),
    ("wind_animation", "wind_100m", "100_m_above_ground", ("UGRD", "VGRD")),
    ("wind_animation", "wind_600mb_approx_4200m", "600_mb", ("UGRD", "VGRD")),
    ("wind_animation", "wind_300mb_approx_9200m", "300_mb", ("UGRD", "VGRD")),
    ("wind_animation", "wind_250mb_approx_10400m", "250_mb", ("UGRD", "VGRD")),
    ("wind_animation", "wind_200mb_approx_11800m", "200_mb", ("UGRD", "VGRD")),
)


def map_catalog(spark: SparkSession) -> DataFrame:
    """One row per product; 15 rows, so plans may broadcast it."""
    rows = []
    for map_type, product, level, variables in PRODUCTS:
        on = ", ".join(f"'{k}', 'on'" for k in (f"lev_{level}", *[f"var_{v}" for v in variables]))
        spans = ", ".join(
            f"named_struct('start', {a}, 'end', {b}, 'step', {c})" for a, b, c in SEGMENTS[map_type]
        )
        rows.append(f"('{map_type}', '{product}', map({on}), array({spans}))")
    return spark.sql(
        f"SELECT * FROM VALUES {', '.join(rows)} AS t(map_type, product, query, segments)"
    )
