"""Unit conversions. Inputs and results are double columns; null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kelvin_to_celsius(kelvin: Column) -> Column:
    """Celsius to one decimal, half to even."""
    return F.rint((kelvin - F.lit(273.15)) * F.lit(10.0)) / F.lit(10.0)


def rate_to_mm_h(rate: Column) -> Column:
    """kg m-2 s-1 to mm per hour."""
    return rate * F.lit(3600.0)


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def knots_to_kmh(knots: Column) -> Column:
    return F.bround(knots * F.lit(1.852), 1)


def hpa_to_mmhg(hpa: Column) -> Column:
    return F.bround(hpa * F.lit(0.75), 1)


def hpa_to_whole_mmhg(hpa: Column) -> Column:
    """Whole mmHg as exported documents show it (fraction dropped)."""
    return F.floor(hpa * F.lit(0.75)).cast("int")


def bytes_to_mb(size: Column) -> Column:
    return F.bround(size / F.lit(1048576.0), 3)


def missing_to_null(value: Column) -> Column:
    """NaN to null, so that comparisons and aggregates treat it as missing."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))
