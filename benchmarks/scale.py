"""Larger runs than the given tables allow: a hot storm and global grids.

    python benchmarks/scale.py [hot|grid]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import functions as F  # noqa: E402

from bench import session  # noqa: E402
from galeframe.operators import grid_stats, layers, ordered, resample, stencil, tracks  # noqa: E402
from galeframe.session import prepare, scratch_dir  # noqa: E402

SHAPE = (721, 1440)


def timed(label: str, make) -> None:
    start = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    print(f"{label}: {time.perf_counter() - start:.1f} s", flush=True)


def hot_storm(spark, rows: int) -> None:
    """A third of all points belong to one storm, the rest to many short ones."""
    i = F.col("id")
    points = spark.range(0, rows, 1, 16).select(
        F.when(i % 3 == 0, F.lit(0)).otherwise(1 + i % 400_000).cast("long").alias("storm_id"),
        i.alias("seq"),
        F.timestamp_seconds(i * 5).alias("advisory_time"),
        ((i * 37) % 12000 / 1e2 - 60).alias("lat"),
        ((i * 91) % 36000 / 1e2 - 180).alias("lon"),
        F.when(i % 50 == 0, "current").when(i % 2 == 0, "past").otherwise("forecast").alias("type"),
        ((i % 150) * 1.0).alias("wind_kts"),
        (F.lit(900.0) + i % 100).alias("pressure_hpa"),
    )
    path = scratch_dir(spark, "points")
    points.write.parquet(path)
    stored = spark.read.parquet(path)
    plain = ordered.HotKeys(None)

    def without_cut():
        prev = {"prev": tracks.PREV, "current_time": ordered.whole(F.min, tracks.current_time())}
        return tracks.describe(tracks.along(stored, prev, hot=plain))

    timed(f"enrich {rows} points, one window per storm", without_cut)
    timed(f"enrich {rows} points, hot storm cut", lambda: tracks.enrich_track(stored))


def global_grid(spark, hours: int) -> None:
    """0.25 degree global fields, one per hour."""
    cells = SHAPE[0] * SHAPE[1]
    i = F.col("id") % cells
    grid = spark.range(0, cells * hours, 1, 16).select(
        (F.floor(F.col("id") / cells) * 3).cast("int").alias("fff"),
        F.floor(i / SHAPE[1]).cast("int").alias("lat_idx"),
        (i % SHAPE[1]).cast("int").alias("lon_idx"),
        F.round(F.sin(i / 997.0) * 20 + F.cos(F.col("id") / 7.0) * 5 + 15, 3).alias("value"),
    )
    path = scratch_dir(spark, "global")
    grid.write.parquet(path)
    stored = spark.read.parquet(path)
    label = f"{hours} global fields"
    timed(f"{label}, percentiles", lambda: grid_stats.value_range(stored, ["fff"]))
    timed(f"{label}, accumulation", lambda: layers.rain_accumulate(stored, ["lat_idx", "lon_idx"]))
    timed(f"{label}, blur, scatter", lambda: stencil.box_blur(stored, ["fff"], SHAPE))
    timed(f"{label}, blur, per frame", lambda: stencil.box_blur(stored, ["fff"], SHAPE, strategy="frame"))
    timed(f"{label}, Gaussian 1.2, scatter", lambda: stencil.gaussian(stored, ["fff"], 1.2, SHAPE, "scatter"))
    timed(f"{label}, Gaussian 1.2, per frame", lambda: stencil.gaussian(stored, ["fff"], 1.2, SHAPE, "frame"))
    timed(f"{label}, bicubic x2, scatter", lambda: resample.bicubic_upsample(stored, ["fff"], SHAPE, 2, "scatter"))
    timed(f"{label}, bicubic x2, per frame", lambda: resample.bicubic_upsample(stored, ["fff"], SHAPE, 2))


if __name__ == "__main__":
    which = sys.argv[1] if len(sys.argv) > 1 else "hot"
    spark = prepare(session("8"))
    hot_storm(spark, 30_000_000) if which == "hot" else global_grid(spark, 4)
    spark.stop()
