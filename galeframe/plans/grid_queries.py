"""Queries over grid cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeframe import sinks
from galeframe.functions import classify, field, units
from galeframe.operators import grid_select as select
from galeframe.operators import grid_stats as stats
from galeframe.operators import layers, resample, stencil
from galeframe.operators.attach import attach
from galeframe.plans import sqlkit as q
from galeframe.plans.registry import query, r6, rounded
from galeframe.plans.views import (
    CELLS_SQL, COLS, ROWS, SHAPE, WIDE_SHAPE, WIDE_SQL, cells, long_cells, long_cells_sql, table, wide_cells,
)
from galeframe.session import scratch_dir
from galeframe.sources import grids

CELL = ["fff", "lat_idx", "lon_idx"]
ID = "fff, lat_idx, lon_idx"
W = f"WITH {CELLS_SQL}"


@query("kelvin_to_celsius", f"{W} SELECT {ID}, round_even((t2m-273.15e0)*10,0)/10 AS celsius FROM cells")
def _(spark, sf):
    return cells(spark, sf).select(*CELL, units.kelvin_to_celsius(F.col("t2m")).alias("celsius"))


@query("prate_to_mm_h", f"{W} SELECT {ID}, ROUND(prate*3600,6) AS mm_h FROM cells")
def _(spark, sf):
    return cells(spark, sf).select(*CELL, r6(units.rate_to_mm_h(F.col("prate"))).alias("mm_h"))


@query("wind_speed", f"{W} SELECT {ID}, ROUND(sqrt(u*u+v*v),6) AS speed FROM cells")
def _(spark, sf):
    return cells(spark, sf).select(*CELL, r6(units.wind_speed(F.col("u"), F.col("v"))).alias("speed"))


WRAPPED = (
    "w AS (SELECT fff, lat, CASE WHEN fff%2=1 THEN lon*3 ELSE lon END AS lon0, value FROM cells), "
    "m AS (SELECT *, max(lon0) OVER (PARTITION BY fff) AS top FROM w), "
    f"n AS (SELECT fff, lat, value, CASE WHEN top>180 THEN {q.mod360('lon0+180')}-180 ELSE lon0 END AS lon FROM m)"
)


@query(
    "normalize_longitude",
    f"{W}, {WRAPPED} SELECT fff, ROUND(lon,6) AS lon, ROUND(value,6) AS value, "
    "CAST(dense_rank() OVER (PARTITION BY fff ORDER BY lat DESC)-1 AS INT) AS lat_idx, "
    "CAST(dense_rank() OVER (PARTITION BY fff ORDER BY lon)-1 AS INT) AS lon_idx FROM n",
)
def _(spark, sf):
    wide = cells(spark, sf).select(
        "fff", "lat", F.when(F.col("fff") % 2 == 1, F.col("lon") * 3).otherwise(F.col("lon")).alias("lon"), "value"
    )
    out = select.normalize_longitude(wide, ["fff"])
    return rounded(out.select("fff", "lon", "value", "lat_idx", "lon_idx"), "lon", "value")


@query(
    "canonical_orientation",
    f"{W} SELECT fff, lat, lon, CAST({ROWS - 1}-lat_idx AS INT) AS lat_idx, lon_idx FROM cells",
)
def _(spark, sf):
    return select.index_axes(cells(spark, sf).select("fff", "lat", "lon"), north_first=False)


PEAK = "p AS (SELECT max(prate*3600) AS top FROM cells)"


@query(
    "precip_combined_index",
    f"{W}, {PEAK} SELECT {ID}, ROUND((prate*3600/CASE WHEN top>0 THEN top ELSE 1e0 END)*(1e0+0.8e0*crain+0.8e0*csnow),6) "
    "AS combined FROM cells, p",
)
def _(spark, sf):
    wide = cells(spark, sf).select(*CELL, "prate", "crain", "csnow")
    return rounded(layers.precip_index(wide).select(*CELL, "combined"), "combined")


EFFECT = (
    "CAST(CASE WHEN crain>0.1 AND csnow>0.1 THEN 5 WHEN crain>0.1 THEN CASE WHEN prate*3600<1.5 THEN 1 ELSE 2 END "
    "WHEN csnow>0.1 THEN CASE WHEN prate*3600<1.5 THEN 3 ELSE 4 END ELSE 0 END AS INT)"
)


def effect(spark, sf):
    wide = cells(spark, sf).select(*CELL, "prate", "crain", "csnow")
    return layers.precip_index(wide).select(*CELL, "effect")


@query("precip_effect_class", f"{W} SELECT {ID}, {EFFECT} AS effect FROM cells")
def _(spark, sf):
    return effect(spark, sf)


@query(
    "precip_effect_label",
    f"{W} SELECT {ID}, (['No precip','Light rain','Heavy rain','Light snow','Heavy snow','Mixed'])[{EFFECT}+1] AS label FROM cells",
)
def _(spark, sf):
    return effect(spark, sf).select(*CELL, classify.precip_label(F.col("effect")).alias("label"))


CLOUDS = ["low", "frac", "big"]
CLOUD_SQL = (
    "x AS (SELECT *, low/1e2 AS frac, high*3 AS big FROM cells), y AS ("
    + " UNION ALL ".join(f"SELECT fff, lat_idx, lon_idx, '{v}' AS variable, {v} AS value FROM x" for v in CLOUDS)
    + "), z AS (SELECT *, min(coalesce(value,0e0)) OVER (PARTITION BY fff, variable) AS lo, "
    "max(coalesce(value,0e0)) OVER (PARTITION BY fff, variable) AS hi FROM y)"
)


@query("cloud_normalize", f"{W}, {CLOUD_SQL} SELECT {ID}, variable, ROUND({q.cloud_norm('value', 'lo', 'hi')},6) AS cover FROM z")
def _(spark, sf):
    wide = cells(spark, sf).withColumns({"frac": F.col("low") / 1e2, "big": F.col("high") * 3})
    long = wide.unpivot(CELL, CLOUDS, "variable", "value")
    return layers.scale_cloud(long, ["fff", "variable"]).select(*CELL, "variable", r6("value").alias("cover"))


def scaled_layers(spark, sf):
    """Low, mid and high cloud cover in [0, 1], side by side."""
    names = ["low", "mid", "high"]
    long = cells(spark, sf).unpivot(CELL, names, "variable", "value")
    scaled = layers.scale_cloud(long, ["fff", "variable"])
    return layers.cloud_layers(scaled, CELL, {n: n for n in names})


def scaled_sql() -> str:
    ext = ", ".join(
        f"{a}(coalesce({v},0e0)) OVER (PARTITION BY fff) AS {v}_{n}"
        for v in ("low", "mid", "high")
        for a, n in (("min", "lo"), ("max", "hi"))
    )
    norm = ", ".join(f"{q.cloud_norm(v, f'{v}_lo', f'{v}_hi')} AS {v}" for v in ("low", "mid", "high"))
    return f"e AS (SELECT {ID}, low, mid, high, {ext} FROM cells), n AS (SELECT {ID}, {norm} FROM e)"


COVER = "greatest(0e0,least(1e0,0.5e0*low+0.32e0*mid+0.18e0*high))"
WAVE = "0.06e0*sin(lon_idx/5.5e0)+0.05e0*cos(lat_idx/4e0)+0.04e0*sin((lon_idx+lat_idx)/8.5e0)"


@query(
    "cloud_composite",
    f"{W}, {scaled_sql()} SELECT {ID}, ROUND(greatest(0e0,least(1e0,{COVER}+({WAVE})*{COVER})),6) AS cover FROM n",
)
def _(spark, sf):
    cover = field.composite_cloud(F.col("low"), F.col("mid"), F.col("high"), F.col("lat_idx"), F.col("lon_idx"))
    return scaled_layers(spark, sf).select(*CELL, r6(cover).alias("cover"))


@query(
    "overlay_alpha",
    f"{W}, {scaled_sql()} SELECT {ID}, "
    + ", ".join(
        f"CAST(trunc(greatest(0e0,least(255e0,pow({v},0.85e0)*255e0*{s}e0))) AS INT) AS {v}"
        for v, s in (("low", 0.55), ("mid", 0.7), ("high", 0.85))
    )
    + " FROM n",
)
def _(spark, sf):
    return scaled_layers(spark, sf).select(
        *CELL, *[field.opacity(F.col(v), field.LAYER_OPACITY[v]).alias(v) for v in ("low", "mid", "high")]
    )


@query(
    "cloud_layer_join",
    f"{W} SELECT {ID}, ROUND(low,6) AS low, ROUND(mid,6) AS mid, ROUND(high,6) AS high FROM cells WHERE lat_idx%5<>0",
)
def _(spark, sf):
    """Cells that have all three layers; the middle layer lacks every fifth row."""
    names = ["low", "mid", "high"]
    long = cells(spark, sf).unpivot(CELL, names, "variable", "value")
    part = long.filter("variable <> 'mid' OR lat_idx % 5 <> 0")
    return rounded(layers.cloud_layers(part, CELL, {n: n for n in names}), *names)


def range_sql(v: str) -> str:
    return (
        f"g AS (SELECT fff, quantile_cont({v},0.05) AS p5, quantile_cont({v},0.95) AS p95, min({v}) AS mn, max({v}) AS mx "
        "FROM cells GROUP BY fff), rg AS (SELECT fff, CASE WHEN abs(p5-p95)<=1e-8+1e-5*abs(p95) THEN mn ELSE p5 END AS lo, "
        "CASE WHEN abs(p5-p95)<=1e-8+1e-5*abs(p95) THEN mx ELSE p95 END AS hi FROM g)"
    )


@query("value_range_p5_p95", f"{W}, {range_sql('value')} SELECT fff, ROUND(lo,6) AS range_low, ROUND(hi,6) AS range_high FROM rg")
def _(spark, sf):
    return rounded(stats.value_range(cells(spark, sf), ["fff"]), "range_low", "range_high")


@query(
    "color_norm",
    f"{W}, {range_sql('value')} SELECT {ID}, ROUND(CASE WHEN hi=lo THEN CASE WHEN value IS NULL THEN NULL ELSE 0e0 END "
    "WHEN value IS NULL THEN NULL ELSE greatest(0e0,least(1e0,(value-lo)/(hi-lo))) END,6) AS norm FROM cells JOIN rg USING (fff)",
)
def _(spark, sf):
    short = cells(spark, sf).select(*CELL, "value")
    normed = layers.color_norm(short, ["fff"])
    return normed.select(*CELL, r6(F.when(F.col("value").isNotNull(), F.col("norm"))).alias("norm"))


@query(
    "rain_visual_scale",
    f"{W}, g AS (SELECT fff, quantile_cont(coalesce(value,0e0),0.99) AS p, max(coalesce(value,0e0)) AS mx FROM cells GROUP BY fff) "
    f"SELECT {ID}, ROUND(least(1e0,pow(greatest(0e0,least(1e0,coalesce(value,0e0)/CASE WHEN p>1e-6 THEN p ELSE mx+1e-6 END)),0.62e0)),6) "
    "AS shown FROM cells JOIN g USING (fff)",
)
def _(spark, sf):
    rain = cells(spark, sf).select(*CELL, F.coalesce("value", F.lit(0.0)).alias("value"))
    return rounded(layers.shown_rain(rain, ["fff"]).select(*CELL, "shown"), "shown")


# --- filters ------------------------------------------------------------------------


@query(
    "bbox_filter",
    f"{W} SELECT {ID}, lat, lon FROM cells WHERE lat BETWEEN 10 AND 20 AND lon BETWEEN 104 AND 108",
)
def _(spark, sf):
    return select.bbox_filter(cells(spark, sf), (10.0, 20.0), (104.0, 108.0)).select(*CELL, "lat", "lon")


@query(
    "finite_cells",
    f"{W} SELECT fff, count(*) AS n, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east FROM cells "
    "WHERE value IS NOT NULL AND lat_idx%9<>0 AND lon_idx%7<>0 GROUP BY fff",
)
def _(spark, sf):
    spoiled = cells(spark, sf).withColumn(
        "value",
        F.when(F.col("lat_idx") % 9 == 0, F.lit(float("nan")))
        .when(F.col("lon_idx") % 7 == 0, F.lit(float("inf")))
        .otherwise(F.col("value")),
    )
    kept = select.finite_cells(spoiled)
    count = kept.groupBy("fff").agg(F.count(F.lit(1)).alias("n"))
    box = stats.bounds_center(kept, ["fff"]).drop("center_lat", "center_lon")
    return count.join(box, "fff")


OFFERED = (("low", "LCC", 0), ("tcc", "tcc", 0), ("mid", "mcc", 1), ("high", "lcdc", 1))


@query(
    "pick_variable",
    f"{W} " + " UNION ALL ".join(
        f"SELECT {ID}, '{layer}' AS layer, '{name}' AS variable, ROUND({col},6) AS value FROM cells"
        for layer, name, col in (("low", "LCC", "low"), ("mid", "tcc", "tcc"), ("high", "tcc", "tcc"))
    ),
)
def _(spark, sf):
    """The first dataset offers ``LCC`` and ``tcc``, the second ``mcc`` and ``lcdc``."""
    long = long_cells(spark, sf, [c for c, _, _ in OFFERED])
    rename = F.create_map(*[F.lit(x) for c, n, _ in OFFERED for x in (c, n)])
    dataset = F.create_map(*[F.lit(x) for c, _, d in OFFERED for x in (c, d)])
    offered = long.select(
        *CELL, "value", rename[F.col("variable")].alias("variable"), dataset[F.col("variable")].alias("dataset_idx")
    )
    wanted = {"low": ["lcdc", "lcc", "tcc"], "mid": ["mcdc", "mcc", "tcc"], "high": ["hcdc", "hcc", "tcc"]}
    picked = select.pick_variable(offered, wanted, ["fff"])
    return rounded(picked.select(*CELL, "layer", "variable", "value"), "value")


@query("first_variable", f"{W} SELECT {ID}, 'u' AS variable, ROUND(u,6) AS value FROM cells")
def _(spark, sf):
    long = long_cells(spark, sf, ["v", "u"]).withColumn("var_seq", F.when(F.col("variable") == "u", 1).otherwise(2))
    return rounded(select.first_variable(long, ["fff"]).select(*CELL, "variable", "value"), "value")


@query("first_slice", f"{W} SELECT {ID}, ROUND(low,6) AS value, fff=0 AS single FROM cells")
def _(spark, sf):
    """Cloud layers as levels 0..2; the first hour has one level only."""
    level = F.create_map(F.lit("low"), F.lit(0), F.lit("mid"), F.lit(1), F.lit("high"), F.lit(2))
    long = long_cells(spark, sf, ["low", "mid", "high"]).withColumn("level_idx", level[F.col("variable")])
    kept = long.filter("fff > 0 OR level_idx = 0")
    return rounded(select.first_slice(kept, ["fff"]).select(*CELL, "value", "single"), "value")


@query("coord_rename", f"{W} SELECT {ID}, lat, lon FROM cells")
def _(spark, sf):
    long_names = cells(spark, sf).withColumnsRenamed({"lat": "latitude", "lon": "longitude"})
    return select.unify_coordinates(long_names).select(*CELL, "lat", "lon")


@query("stride_downsample", f"{W} SELECT {ID}, ROUND(value,6) AS value FROM cells WHERE lat_idx%4=0 AND lon_idx%4=0")
def _(spark, sf):
    return rounded(select.stride_downsample(cells(spark, sf), 4).select(*CELL, "value"), "value")


@query(
    "stride_sample_points",
    f"{W}, p AS (SELECT {ID}, row_number() OVER (PARTITION BY fff ORDER BY lat_idx, lon_idx)-1 AS i, "
    "count(*) OVER (PARTITION BY fff) AS n FROM cells WHERE value IS NOT NULL) "
    f"SELECT {ID} FROM p WHERE i % greatest(1, n//100)=0",
)
def _(spark, sf):
    return select.stride_sample(cells(spark, sf), ["fff"], 100).select(*CELL)


@query("index_crop", f"{W} SELECT {ID} FROM cells WHERE lat_idx BETWEEN 20 AND 25 AND lon_idx BETWEEN 10 AND 15")
def _(spark, sf):
    return select.index_crop(cells(spark, sf), (20, 26), (10, 16)).select(*CELL)


@query(
    "frame_limit",
    f"{W}, h AS (SELECT fff FROM (SELECT DISTINCT fff FROM cells) ORDER BY fff LIMIT 4) "
    f"SELECT {ID} FROM cells WHERE fff IN (SELECT fff FROM h)",
)
def _(spark, sf):
    return select.frame_limit(cells(spark, sf), [], 4).select(*CELL)


@query(
    "label_grid_points",
    f"{W}, e AS (SELECT min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM cells) SELECT {ID}, "
    "CAST(trunc((lon-w)/(e-w)*511) AS INT) AS x, CAST(trunc((n-lat)/(n-s)*649) AS INT) AS y, "
    "CAST(CAST(round_even(value,0) AS INT) AS VARCHAR) AS label FROM cells, e "
    f"WHERE lat_idx%{ROWS // 10}=0 AND lon_idx%{COLS // 8}=0 AND value IS NOT NULL",
)
def _(spark, sf):
    return select.label_points(cells(spark, sf), SHAPE, (650, 512)).select(*CELL, "x", "y", "label")


@query(
    "scan_grid_frames",
    f"{W} SELECT {ID}, CASE WHEN fff%2=0 THEN 'wind_30m' ELSE 'wind_50m' END AS product, ROUND(u,6) AS value "
    "FROM cells WHERE fff<>18 AND lat_idx%2=0 AND lon_idx%2=0",
)
def _(spark, sf):
    """Cells written as a partitioned table, then one map type read back."""
    product = F.when(F.col("fff") == 18, "wind_1000m").when(F.col("fff") % 2 == 0, "wind_30m").otherwise("wind_50m")
    out = cells(spark, sf).select(
        *CELL, "lat", "lon", F.col("u").alias("value"), F.lit("wind_animation").alias("map_type"), product.alias("product")
    )
    path = scratch_dir(spark, "cells")
    grids.write_cells(out, path)
    back = grids.read_series(spark, path, "wind_animation", downsample=2)
    return rounded(back.select(*CELL, "product", "value"), "value")


@query(
    "scan_area",
    f"WITH {WIDE_SQL}, placed AS (SELECT *, 24-lat_idx/8e0 AS lat, 102+lon_idx/8e0 AS lon FROM wide) "
    "SELECT run, fff, lat_idx, lon_idx, lat, lon, ROUND(value,6) AS value FROM placed "
    "WHERE value>0 AND lat BETWEEN 15 AND 17 AND lon BETWEEN 104 AND 105.5",
)
def _(spark, sf):
    """Cells written by area as two map types, then an area read back of both."""
    placed = wide_cells(spark, sf).where("value > 0").selectExpr("*", "24-lat_idx/8e0 AS lat", "102+lon_idx/8e0 AS lon")
    kind = F.when(F.col("fff") < 9, "rain_basic").otherwise("temperature_feels_like")
    path = scratch_dir(spark, "area")
    grids.write_cells_by_area(placed.withColumns({"map_type": kind, "product": F.lit("surface")}), path, file_cells=8192)
    back = grids.read_area(spark, path, (15.0, 17.0), (104.0, 105.5))
    return rounded(back.select("run", "fff", "lat_idx", "lon_idx", "lat", "lon", "value"), "value")


# --- aggregates ---------------------------------------------------------------------

STAT_VARS = ["value", "prate", "u"]


@query(
    "field_stats",
    f"{W}, {long_cells_sql(STAT_VARS)} SELECT variable, ROUND(min(value),6) AS min_value, ROUND(max(value),6) AS max_value, "
    "ROUND(avg(value),6) AS mean_value, ROUND(avg(CASE WHEN value IS NULL THEN 1e0 ELSE 0e0 END)*100,6) AS missing_pct, "
    "ROUND(avg(CASE WHEN value>0 THEN 1e0 ELSE 0e0 END)*100,6) AS nonzero_pct FROM long GROUP BY variable",
)
def _(spark, sf):
    out = stats.field_stats(long_cells(spark, sf, STAT_VARS), ["variable"])
    return rounded(out, "min_value", "max_value", "mean_value", "missing_pct", "nonzero_pct")


@query(
    "contour_levels",
    f"{W}, g AS (SELECT fff, quantile_cont(value,[0.6,0.75,0.88,0.95]) AS qs FROM cells WHERE value>0 AND fff<15 GROUP BY fff), "
    "a AS (SELECT DISTINCT c.fff, coalesce(g.qs,[0.1e0,0.2e0,0.3e0,0.5e0]) AS qs FROM cells c LEFT JOIN g USING (fff)), "
    "l AS (SELECT DISTINCT fff, round_even(unnest(qs)*1000,0)/1000 AS level FROM a) "
    "SELECT fff, CAST(row_number() OVER (PARTITION BY fff ORDER BY level) AS INT) AS level_no, level FROM l",
)
def _(spark, sf):
    """The last hours are made dry, so that they get the fixed levels."""
    rain = cells(spark, sf).withColumn("value", F.when(F.col("fff") < 15, F.col("value")).otherwise(F.lit(0.0)))
    return stats.contour_levels(rain, ["fff"])


@query(
    "series_value_range",
    f"{W}, {long_cells_sql(STAT_VARS)} SELECT variable, ROUND(min(value),6) AS min_value, ROUND(max(value),6) AS max_value "
    "FROM long WHERE fff<12 GROUP BY variable",
)
def _(spark, sf):
    long = select.frame_limit(long_cells(spark, sf, STAT_VARS), ["variable"], 4)
    return rounded(stats.series_value_range(long, ["variable"]), "min_value", "max_value")


@query(
    "field_bounds_center",
    f"{W} SELECT fff, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east, "
    "(min(lat)+max(lat))/2 AS center_lat, (min(lon)+max(lon))/2 AS center_lon FROM cells WHERE value>25 GROUP BY fff",
)
def _(spark, sf):
    return stats.bounds_center(cells(spark, sf).filter("value > 25"), ["fff"])


@query("field_time_mean", f"{W} SELECT lat_idx, lon_idx, ROUND(avg(value),6) AS value FROM cells GROUP BY 1, 2")
def _(spark, sf):
    return rounded(stats.time_mean(cells(spark, sf), ["lat_idx", "lon_idx"]), "value")


POINTS_SQL = "pts AS (SELECT ((event_id*37)%12000)/1e2-60 AS lat, ((event_id*91)%36000)/1e2-180 AS lon FROM events)"
BINS = (52, 92)
DENSITY_SQL = (
    f"{POINTS_SQL}, e AS (SELECT min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM pts), "
    f"b AS (SELECT CAST(trunc((lat-s)/(n-s+1e-9)*{BINS[0] - 1}) AS INT) AS iy, CAST(trunc((lon-w)/(e-w+1e-9)*{BINS[1] - 1}) AS INT) AS ix, "
    "count(*) AS n FROM pts, e GROUP BY 1, 2), "
    "dn AS (SELECT iy, ix, n, least(1e0,n/((SELECT max(n) FROM b)+1e-9)) AS density FROM b)"
)


def density(spark, sf):
    points = table(spark, sf, "events").selectExpr(
        "((event_id*37)%12000)/1e2-60 AS lat", "((event_id*91)%36000)/1e2-180 AS lon"
    )
    return stats.density_grid(points, BINS)


@query("density_grid", f"WITH {DENSITY_SQL} SELECT iy, ix, n, ROUND(density,6) AS density FROM dn")
def _(spark, sf):
    return rounded(density(spark, sf), "density")


@query(
    "dense_region_crop",
    f"WITH {DENSITY_SQL}, th AS (SELECT quantile_cont(density,0.92) AS t FROM dn WHERE density>0), "
    "bx AS (SELECT min(iy) AS y0, max(iy)+1 AS y1, min(ix) AS x0, max(ix)+1 AS x1 FROM dn, th WHERE density>=t), "
    "i AS (SELECT * FROM dn, bx WHERE iy>=y0 AND iy<y1 AND ix>=x0 AND ix<x1) "
    "SELECT iy, ix, y0, y1, x0, x1, ROUND(least(1e0,density/(SELECT max(density) FROM i)),6) AS scaled FROM i",
)
def _(spark, sf):
    return rounded(stats.dense_region_crop(density(spark, sf), BINS), "scaled")


@query(
    "distinct_variables",
    "SELECT DISTINCT concat(p_type, CASE WHEN p_size%3=0 THEN '_lcc' WHEN p_size%3=1 THEN '_hcdc' ELSE '_t2m' END) AS variable "
    "FROM part WHERE p_size%3<2",
)
def _(spark, sf):
    names = table(spark, sf, "part").selectExpr(
        "concat(p_type, CASE WHEN p_size%3=0 THEN '_lcc' WHEN p_size%3=1 THEN '_hcdc' ELSE '_t2m' END) AS variable"
    )
    return stats.distinct_variables(names)


# --- joins across layers --------------------------------------------------------------


@query(
    "wind_uv_join",
    f"{W} SELECT {ID}, ROUND(u,6) AS u, ROUND(v,6) AS v, ROUND(sqrt(u*u+v*v),6) AS speed FROM cells WHERE lon_idx%6<>0",
)
def _(spark, sf):
    long = long_cells(spark, sf, ["u", "v"]).filter("variable = 'u' OR lon_idx % 6 <> 0")
    return rounded(layers.wind_uv(long, CELL), "u", "v", "speed")


@query(
    "precip_layer_join",
    f"{W} SELECT {ID}, ROUND(prate,12) AS prate, CASE WHEN fff=6 THEN 0e0 ELSE crain END AS crain, "
    "CASE WHEN fff=9 THEN 0e0 ELSE csnow END AS csnow FROM cells WHERE fff<>3",
)
def _(spark, sf):
    """Hour 3 lacks the rate, hour 6 the rain flag, hour 9 the snow flag."""
    long = long_cells(spark, sf, ["prate", "crain", "csnow"]).filter(
        "NOT (fff = 3 AND variable = 'prate' OR fff = 6 AND variable = 'crain' OR fff = 9 AND variable = 'csnow')"
    )
    out = layers.precip_layers(long, ["fff"])
    return out.withColumn("prate", F.round("prate", 12))


@query(
    "scalar_broadcast",
    f"{W}, {PEAK} SELECT {ID}, ROUND(prate*3600/top,6) AS share FROM cells, p",
)
def _(spark, sf):
    rated = cells(spark, sf).select(*CELL, units.rate_to_mm_h(F.col("prate")).alias("mm_h"))
    peak = rated.agg(F.max("mm_h").alias("top"))
    return attach(rated, peak, []).select(*CELL, r6(F.col("mm_h") / F.col("top")).alias("share"))


AT = (
    "a AS (SELECT event_id AS point_id, CAST(least(6,greatest(0,ceil((epoch_us(CAST(ts AS TIMESTAMP))-epoch_us(date_trunc('day',CAST(ts AS TIMESTAMP))))/10800e6-0.5)))*3 AS INT) AS fff, 24-((event_id*37)%1600)/1e2 AS lat, "
    "102+((event_id*91)%800)/1e2 AS lon FROM events), "
    f"b AS (SELECT *, (24e0-lat)/0.25e0 AS y, (lon-102e0)/0.25e0 AS x FROM a), "
    f"d AS (SELECT *, CAST(greatest(0,least({ROWS - 2},floor(y))) AS INT) AS y0, "
    f"CAST(greatest(0,least({COLS - 2},floor(x))) AS INT) AS x0 FROM b), "
    "k(dy,dx) AS (VALUES (0,0),(0,1),(1,0),(1,1)), "
    "c AS (SELECT point_id, fff, y0+dy AS lat_idx, x0+dx AS lon_idx, (CASE WHEN dy=1 THEN y-y0 ELSE 1e0-(y-y0) END)"
    "*(CASE WHEN dx=1 THEN x-x0 ELSE 1e0-(x-x0) END) AS w FROM d, k)"
)


@query(
    "gfs_at_track_point",
    f"{W}, {AT} SELECT point_id, ROUND(CASE WHEN count(speed)=count(*) THEN sum(w*speed) END,6) AS speed, "
    "ROUND(CASE WHEN count(mslp)=count(*) THEN sum(w*mslp) END,6) AS mslp FROM c LEFT JOIN "
    "(SELECT fff, lat_idx, lon_idx, sqrt(u*u+v*v) AS speed, 1000+value/5 AS mslp FROM cells) USING (fff, lat_idx, lon_idx) "
    "WHERE w>0 GROUP BY point_id",
)
def _(spark, sf):
    """Wind and pressure at every point from the frame nearest to its time of day."""
    frames = cells(spark, sf)
    hours = frames.agg(F.array_sort(F.collect_set("fff"))).scalar()
    points = table(spark, sf, "events").selectExpr(
        "event_id AS point_id", "CAST(ts AS TIMESTAMP) AS advisory_time",
        "24-((event_id*37)%1600)/1e2 AS lat", "102+((event_id*91)%800)/1e2 AS lon",
    )
    points = points.withColumn("hours", hours)
    points = layers.nearest_hour(points, F.col("hours"), F.date_trunc("day", "advisory_time"))
    grid = frames.select(
        *CELL, units.wind_speed(F.col("u"), F.col("v")).alias("speed"), (F.col("value") / 5 + 1000).alias("mslp")
    )
    out = layers.at_track_points(points, grid, ["fff"], ["speed", "mslp"], 24.0, 102.0, 0.25, SHAPE)
    return rounded(out, "speed", "mslp")


@query(
    "rain_accumulate",
    f"{W}, l AS (SELECT *, coalesce(value,0e0)-lag(coalesce(value,0e0)) OVER (PARTITION BY lat_idx, lon_idx ORDER BY fff) AS g "
    "FROM cells) SELECT lat_idx, lon_idx, ROUND(sum(greatest(coalesce(g,0e0),0e0)),6) AS total, count(*) AS frames FROM l GROUP BY 1, 2",
)
def _(spark, sf):
    return rounded(layers.rain_accumulate(cells(spark, sf), ["lat_idx", "lon_idx"]), "total")


def proxy_sql(source: str, keys: str) -> str:
    """CTEs from ``source`` (tcc per frame and cell) to ``proxy`` (total)."""
    comma = f"{keys}, " if keys else ""
    using = f"{comma}lat_idx, lon_idx"
    return (
        f"pt AS (SELECT *, max(tcc) OVER (PARTITION BY {comma}fff) AS top FROM {source}), "
        f"pm AS (SELECT {comma}lat_idx, lon_idx, avg(CASE WHEN tcc IS NULL THEN NULL ELSE greatest(0e0,least(1e0,"
        "CASE WHEN top>1.5 THEN tcc/100 ELSE tcc END)) END) AS value FROM pt GROUP BY ALL), "
        + q.gauss("pm", "g1", q.gauss_weights(1.2), SHAPE, keys) + ", "
        + q.gauss("g1", "g2", q.gauss_weights(3.2), SHAPE, keys) + ", "
        + f"proxy AS (SELECT {comma}lat_idx, lon_idx, 35e0*greatest(0e0,least(1e0,0.55e0*g1.value+1.35e0*greatest(g1.value-g2.value,0e0))) "
        f"AS total FROM g1 JOIN g2 USING ({using}))"
    )


@query("cloud_rain_proxy", f"{W}, {proxy_sql('cells', '')} SELECT lat_idx, lon_idx, ROUND(total,6) AS total FROM proxy")
def _(spark, sf):
    cloud = cells(spark, sf).select(*CELL, F.col("tcc").alias("value"))
    return rounded(layers.cloud_rain_proxy(cloud, [], SHAPE), "total")


@query(
    "rain_source_choice",
    f"{W}, s AS (SELECT CAST(fff%2 AS INT) AS series, fff, lat_idx, lon_idx, high, tcc FROM cells), {proxy_sql('s', 'series')}, "
    "ac AS (SELECT *, coalesce(high,0e0)-lag(coalesce(high,0e0)) OVER (PARTITION BY series, lat_idx, lon_idx ORDER BY fff) AS g FROM s) "
    "SELECT series, lat_idx, lon_idx, ROUND(sum(greatest(coalesce(g,0e0),0e0)),6) AS total, 'APCP/tp' AS source FROM ac "
    "WHERE series=0 GROUP BY 1, 2, 3 UNION ALL SELECT series, lat_idx, lon_idx, ROUND(total,6), 'TCDC-proxy' FROM proxy WHERE series=1",
)
def _(spark, sf):
    """Even hours have precipitation, odd hours have cloud only."""
    both = cells(spark, sf).withColumn("series", (F.col("fff") % 2).cast("int"))
    precip = both.filter("series = 0").select("series", *CELL, F.col("high").alias("value"))
    cloud = both.select("series", *CELL, F.col("tcc").alias("value"))
    return rounded(layers.rain_total(precip, cloud, ["series"], SHAPE), "total")


# --- stencils ---------------------------------------------------------------------------


def clamp(x: str, n: int) -> str:
    return f"greatest(0,least({n - 1},{x}))"


@query(
    "box_blur_3x3",
    f"{W}, k(dy,dx) AS (SELECT a, b FROM range(-1,2) AS r(a), range(-1,2) AS c(b)) "
    "SELECT c.fff, c.lat_idx, c.lon_idx, ROUND(CASE WHEN count(s.q)=9 THEN sum(s.q)/9 END,6) AS value FROM cells c, k, "
    f"(SELECT {ID}, t2m AS q FROM cells) s WHERE s.fff=c.fff AND s.lat_idx={clamp('c.lat_idx+dy', ROWS)} "
    f"AND s.lon_idx={clamp('c.lon_idx+dx', COLS)} GROUP BY ALL",
)
def _(spark, sf):
    field_cells = cells(spark, sf).select(*CELL, F.col("t2m").alias("value"))
    return rounded(stencil.box_blur(field_cells, ["fff"], SHAPE), "value")


@query(
    "gaussian_stencil",
    f"{W}, {q.gauss('cells', 'g', q.gauss_weights(1.2), SHAPE, 'fff')} SELECT {ID}, ROUND(value,6) AS value FROM g",
)
def _(spark, sf):
    return rounded(stencil.gaussian(cells(spark, sf), ["fff"], 1.2, SHAPE), "value")


@query(
    "unsharp_enhance",
    f"{W}, {q.gauss('cells', 'a', q.gauss_weights(1.0), SHAPE, 'fff')}, "
    f"{q.gauss('a', 'b', q.gauss_weights(2.6), SHAPE, 'fff')} SELECT {ID}, "
    "ROUND(greatest(a.value+0.45e0*greatest(a.value-b.value,0e0),0e0),6) AS value FROM a JOIN b USING (fff, lat_idx, lon_idx)",
)
def _(spark, sf):
    return rounded(layers.unsharp(cells(spark, sf), ["fff"], SHAPE), "value")


FACTOR = 3


def stretch(source: str, out: str, axis: str, other: str, size: int, key: str = "fff") -> str:
    gap = f"((t.t+0.5e0)/{FACTOR}e0-s.{axis}-0.5e0)"
    return (
        f"{out}_t AS (SELECT CAST(i AS INT) AS t FROM range({size * FACTOR}) AS r(i)), "
        f"{out}_w AS (SELECT s.{key}, s.{other}, t.t AS {axis}, s.value, {q.cubic(gap)} AS w FROM {source} s, {out}_t t WHERE abs({gap})<2), "
        f"{out} AS (SELECT {key}, {other}, {axis}, CASE WHEN count(value)=count(*) THEN sum(value*w)/sum(w) END AS value FROM {out}_w GROUP BY ALL)"
    )


@query(
    "bicubic_upsample",
    f"{W}, src AS (SELECT {ID}, high AS value FROM cells), {stretch('src', 'tall', 'lat_idx', 'lon_idx', ROWS)}, "
    f"{stretch('tall', 'wide', 'lon_idx', 'lat_idx', COLS)} SELECT {ID}, ROUND(value,6) AS value FROM wide",
)
def _(spark, sf):
    source = cells(spark, sf).select(*CELL, F.col("high").alias("value"))
    return rounded(resample.bicubic_upsample(source, ["fff"], SHAPE, FACTOR), "value")


# Frames of several tiles, as many as the table has runs and hours.
WIDE_ID, WIDE_TILE = "run, fff, lat_idx, lon_idx", 32


@query(
    "gaussian_tiles",
    f"WITH {WIDE_SQL}, {q.gauss('wide', 'g', q.gauss_weights(1.2), WIDE_SHAPE, 'run,fff')} SELECT {WIDE_ID}, ROUND(value,6) AS value FROM g",
)
def _(spark, sf):
    return rounded(stencil.gaussian(wide_cells(spark, sf), ["run", "fff"], 1.2, WIDE_SHAPE, tile=WIDE_TILE), "value")


@query(
    "unsharp_tiles",
    f"WITH {WIDE_SQL}, {q.gauss('wide', 'a', q.gauss_weights(1.0), WIDE_SHAPE, 'run,fff')}, "
    f"{q.gauss('a', 'b', q.gauss_weights(2.6), WIDE_SHAPE, 'run,fff')} SELECT {WIDE_ID}, "
    "ROUND(greatest(a.value+0.45e0*greatest(a.value-b.value,0e0),0e0),6) AS value FROM a JOIN b USING (run, fff, lat_idx, lon_idx)",
)
def _(spark, sf):
    return rounded(layers.unsharp(wide_cells(spark, sf), ["run", "fff"], WIDE_SHAPE, WIDE_TILE), "value")


@query(
    "bicubic_tiles",
    f"WITH {WIDE_SQL}, g AS (SELECT concat(run, '/', fff) AS frame, lat_idx, lon_idx, value FROM wide), "
    f"{stretch('g', 'tall', 'lat_idx', 'lon_idx', WIDE_SHAPE[0], 'frame')}, "
    f"{stretch('tall', 'across', 'lon_idx', 'lat_idx', WIDE_SHAPE[1], 'frame')} SELECT frame, lat_idx, lon_idx, ROUND(value,6) AS value FROM across",
)
def _(spark, sf):
    """Cells without data count as 0 here; in the operator a missing cell spreads."""
    data = wide_cells(spark, sf).select(F.concat_ws("/", "run", "fff").alias("frame"), "lat_idx", "lon_idx", "value")
    dense = resample.bicubic_upsample(data, ["frame"], WIDE_SHAPE, FACTOR, tile=FACTOR * WIDE_TILE, default=0.0)
    return rounded(dense, "value")


@query(
    "upsample_stats",
    f"{W}, o AS (SELECT fff, count(*) AS original FROM cells WHERE lat_idx BETWEEN 20 AND 25 AND lon_idx BETWEEN 10 AND 15 GROUP BY 1) "
    "SELECT fff, original, original*100 AS denser, original*99 AS added, 100e0 AS ratio FROM o",
)
def _(spark, sf):
    """A 6 x 6 crop of every hour made ten times denser."""
    crop = select.index_crop(cells(spark, sf), (20, 26), (10, 16)).select(
        "fff", (F.col("lat_idx") - 20).alias("lat_idx"), (F.col("lon_idx") - 10).alias("lon_idx"), "value"
    )
    return resample.upsample_stats(crop, resample.bicubic_upsample(crop, ["fff"], (6, 6), 10), ["fff"])


# --- documents ----------------------------------------------------------------------------

JSON_SQL = f"{W} SELECT {ID}, ROUND(lat,2) AS lat, ROUND(lon,2) AS lon, round_even(value,1) AS value FROM cells"


def grid_documents(spark, sf):
    short = cells(spark, sf).select(*CELL, "lat", "lon", "value")
    return sinks.grid_documents(short, ["fff"])


@query("sink_grid_json", JSON_SQL)
def _(spark, sf):
    """Documents put in place of earlier ones of the same hours, then read again."""
    path = scratch_dir(spark, "grid-docs")
    sinks.replace_documents(grid_documents(spark, sf), path, ["fff"])
    back = sinks.read_documents(spark, path, f"fff int, {grids.GRID_JSON}")
    return grids.grid_cells(back).select(*CELL, "lat", "lon", "value")


@query("scan_grid_json", f"{W} SELECT {ID}, ROUND(lat,2) AS lat, ROUND(lon,2) AS lon, round_even(value,1) AS value FROM cells")
def _(spark, sf):
    """Documents written as JSON, one folder per hour, then read again."""
    path = scratch_dir(spark, "grid-json")
    sinks.write_json(grid_documents(spark, sf), path, ["fff"])
    schema = f"{grids.GRID_JSON}, fff int"
    return grids.grid_cells(spark.read.schema(schema).json(path)).select(*CELL, "lat", "lon", "value")
