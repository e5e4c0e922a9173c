"""Per-cell arithmetic of grid layers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Opacity scale of each cloud layer.
LAYER_OPACITY = {"low": 0.55, "mid": 0.70, "high": 0.85, "composite": 0.95}


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def scaled_cloud(value: Column, low: Column, high: Column) -> Column:
    """Cloud cover to [0, 1] given the field's minimum and maximum.

    A fraction stays, a percentage is divided by 100, anything else is stretched
    over its own range.  Missing cells count as 0.
    """
    v = F.coalesce(value, F.lit(0.0))
    return (
        F.when(high <= 1.05, clip(v, 0.0, 1.0))
        .when(high <= 100.5, clip(v / 100, 0.0, 1.0))
        .when(high - low < 1e-9, F.lit(0.0))
        .otherwise(clip((v - low) / F.nullif(high - low, F.lit(0.0)), 0.0, 1.0))
    )


def composite_cloud(low: Column, mid: Column, high: Column, row: Column, col: Column) -> Column:
    """Weighted layers with a light wave texture over row and column."""
    cover = clip(low * 0.50 + mid * 0.32 + high * 0.18, 0.0, 1.0)
    wave = (
        F.sin(col / 5.5) * 0.06
        + F.cos(row / 4.0) * 0.05
        + F.sin((col + row) / 8.5) * 0.04
    )
    return clip(cover + wave * cover, 0.0, 1.0)


def opacity(intensity: Column, scale: float) -> Column:
    """Alpha channel 0..255 of a layer, fraction dropped."""
    shown = F.pow(clip(intensity, 0.0, 1.0), F.lit(0.85)) * 255.0 * scale
    return clip(shown, 0.0, 255.0).cast("int")


def normalized(value: Column, low: Column, high: Column) -> Column:
    """Position of ``value`` in [low, high], clipped; 0 for an empty range."""
    return F.when(high == low, F.when(value.isNotNull(), F.lit(0.0))).otherwise(
        clip((value - low) / F.nullif(high - low, F.lit(0.0)), 0.0, 1.0)
    )


def is_close(a: Column, b: Column) -> Column:
    """Equal within 1e-5 relative and 1e-8 absolute tolerance."""
    return F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(b)


def combined_index(rate: Column, top: Column, crain: Column, csnow: Column) -> Column:
    return (rate / top) * (F.lit(1.0) + crain * 0.8 + csnow * 0.8)


def shown_rain(value: Column, p99: Column, top: Column) -> Column:
    scale = F.when(p99 > 1e-6, p99).otherwise(top + 1e-6)
    return clip(F.pow(clip(value / scale, 0.0, 1.0), F.lit(0.62)), 0.0, 1.0)
