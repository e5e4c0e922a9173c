"""Great-circle geometry on a sphere, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0

# Compass names clockwise from north.
COMPASS_16 = (
    "N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE",
    "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW",
)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(chord), F.sqrt(1 - chord))


def whole_turn(angle: Column) -> Column:
    """Angle to [0, 360).  Both remainders are needed: one alone leaves 359.99999999999994
    where a course is north but for the last bit, and that is no other course than 0."""
    return (angle % F.lit(360.0) + F.lit(360.0)) % F.lit(360.0)


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial course from the first point to the second, 0 <= course < 360."""
    turn = F.radians(lon2 - lon1)
    east = F.sin(turn) * F.cos(F.radians(lat2))
    north = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(
        F.radians(lat1)
    ) * F.cos(F.radians(lat2)) * F.cos(turn)
    return whole_turn(F.degrees(F.atan2(east, north)) + 360)


def compass16(course: Column) -> Column:
    sector = F.pmod(F.floor((course + 11.25) / 22.5), F.lit(16)).cast("int")
    return F.element_at(F.array(*[F.lit(n) for n in COMPASS_16]), sector + 1)


def destination_lat(lat: Column, course: Column, km: Column) -> Column:
    arc = km / F.lit(EARTH_RADIUS_KM)
    sine = F.sin(F.radians(lat)) * F.cos(arc) + F.cos(F.radians(lat)) * F.sin(
        arc
    ) * F.cos(F.radians(course))
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sine))))


def destination_lon(lat: Column, lon: Column, course: Column, km: Column) -> Column:
    """Longitude in [-180, 180) after ``km`` along ``course``."""
    arc = km / F.lit(EARTH_RADIUS_KM)
    end_lat = F.radians(destination_lat(lat, course, km))
    east = F.sin(F.radians(course)) * F.sin(arc) * F.cos(F.radians(lat))
    north = F.cos(arc) - F.sin(F.radians(lat)) * F.sin(end_lat)
    turned = F.degrees(F.radians(lon) + F.atan2(east, north))
    return whole_turn(turned + 540) - 180


def wrap_longitude(lon: Column) -> Column:
    """Longitude to [-180, 180)."""
    return whole_turn(lon + 180) - 180
