"""Time differences and time text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hours_between(start: Column, end: Column) -> Column:
    """Hours from ``start`` to ``end`` as a double."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(3.6e9)


def iso_utc(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_local(instant: Column, zone: Column) -> Column:
    """Wall-clock time in ``zone`` followed by its offset, ``+hh:mm``."""
    local = F.from_utc_timestamp(instant, zone)
    minutes = F.floor((F.unix_micros(local) - F.unix_micros(instant)) / F.lit(60e6)).cast("int")
    return F.concat(
        F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(minutes < 0, "-").otherwise("+"),
        F.format_string("%02d:%02d", F.floor(F.abs(minutes) / 60).cast("int"), F.abs(minutes) % 60),
    )


def parse_iso(text: Column) -> Column:
    return F.try_to_timestamp(text)
