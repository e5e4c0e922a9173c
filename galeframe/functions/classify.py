"""Status icons, storm types, precipitation classes and forecast-cone radii."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lead time in hours -> radius of the forecast cone in km.
CONE_KNOTS = {12: 45.0, 24: 80.0, 48: 150.0, 72: 225.0, 96: 325.0, 120: 450.0}

# Hour after the cutoff -> position error in km.
CONE_ERRORS = {0: 0.0, 12: 50.0, 24: 80.0, 36: 120.0, 48: 150.0, 72: 220.0, 96: 300.0, 120: 350.0}

# Labels of precipitation classes 0..5.
PRECIP_LABELS = (
    "No precip", "Light rain", "Heavy rain", "Light snow", "Heavy snow", "Mixed",
)

# Icon stem, label, active.
ICON_ROWS = (
    ("LOW", "Low", False),
    ("TD", "Tropical Depression", True),
    ("TS", "Tropical Storm", True),
    ("TY", "Hurricane/Typhoon", True),
    ("TSSH", "Tropical Storm (South Hemisphere)", True),
    ("TYSH", "Typhoon (South Hemisphere)", True),
    ("TDgray", "Post/Weak Depression", False),
    ("TSgray", "Post/Weak Storm", False),
    ("TYgray", "Post/Weak Hurricane", False),
    ("TSgraySH", "Post/Weak Storm (SH)", False),
    ("TYgraySH", "Post/Weak Typhoon (SH)", False),
)


def _strength(wind: Column) -> Column:
    """TD below 34 kt, TS below 64 kt, else TY; null wind gives null."""
    return F.when(wind < 34, "TD").when(wind < 64, "TS").when(wind >= 64, "TY")


def icon_by_wind(wind_kts: Column, point_type: Column) -> Column:
    gray = F.when(point_type == "past", "gray").otherwise("")
    return F.coalesce(
        F.concat(_strength(wind_kts), gray, F.lit(".png")), F.lit("LOW.png")
    )


def icon_by_warning(wind_kts: Column, gray: Column) -> Column:
    """Variant for warning bulletins: no wind is TD, zero or less is LOW."""
    stem = F.when(wind_kts <= 0, "LOW").otherwise(
        F.coalesce(_strength(wind_kts), F.lit("TD"))
    )
    return F.concat(
        stem, F.when(gray & (stem != "LOW"), "gray").otherwise(""), F.lit(".png")
    )


def type_by_wind(wind_kts: Column) -> Column:
    return F.when(wind_kts < 34, "TD").when(wind_kts < 64, "TS").when(
        wind_kts >= 64, "HU"
    ).otherwise("TD")


def icon_stem(storm_type: Column, lat: Column) -> tuple[Column, Column]:
    """The icon a type code asks for, and the one to use if that is not at hand."""
    code = F.upper(F.coalesce(storm_type, F.lit("")))
    south = F.coalesce(lat < 0, F.lit(False))
    weak = code.isin("EX", "DB", "WV", "SD", "ET")
    fallback = (
        F.when(code == "TD", "TD")
        .when(code.isin("TS", "SS"), "TS")
        .when(code.isin("HU", "TY", "ST"), "TY")
        .when(code == "LO", "LOW")
        .when(weak, "TDgray")
    )
    southern = (
        F.when(code.isin("TS", "SS"), "TSSH")
        .when(code.isin("HU", "TY", "ST"), "TYSH")
        .when(weak, "TSgraySH")
    )
    wanted = F.when(south & southern.isNotNull(), southern).otherwise(
        F.coalesce(fallback, F.lit("TDgray"))
    )
    return wanted, F.coalesce(fallback, F.lit("TD"))


def cone_radius(lead_hours: Column) -> Column:
    """Radius for a forecast point; linear between knots, one decimal."""
    knots = sorted(CONE_KNOTS.items())
    (first, first_km), (last, last_km) = knots[0], knots[-1]
    radius = F.when(lead_hours <= first, F.lit(first_km))
    radius = radius.when(lead_hours >= last, F.lit(last_km))
    for (h0, km0), (h1, km1) in zip(knots, knots[1:]):
        share = (lead_hours - float(h0)) / float(h1 - h0)
        radius = radius.when(
            lead_hours <= h1, F.bround(F.lit(km0) + share * F.lit(km1 - km0), 1)
        )
    return radius


def point_cone_radius(point_type: Column, lead_hours: Column, given: Column | None = None) -> Column:
    """0 for past and current points; a radius given by the source wins."""
    by_lead = F.coalesce(cone_radius(lead_hours), F.lit(min(CONE_KNOTS.values())))
    if given is not None:
        by_lead = F.coalesce(given, by_lead)
    return F.when(point_type.isin("past", "current"), F.lit(0.0)).otherwise(by_lead)


def cone_error(hour: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CONE_ERRORS.items() for x in kv])
    return F.try_element_at(table, hour.cast("int"))


def precip_class(rate_mm_h: Column, crain: Column, csnow: Column) -> Column:
    """0 none, 1/2 light/heavy rain, 3/4 light/heavy snow, 5 both.

    A missing rate counts as heavy, as it does not compare below the threshold.
    """
    rain = F.coalesce(crain > 0.1, F.lit(False))
    snow = F.coalesce(csnow > 0.1, F.lit(False))
    heavy = F.when(rate_mm_h < 1.5, 0).otherwise(1)
    return (
        F.when(rain & snow, F.lit(5))
        .when(rain, heavy + 1)
        .when(snow, heavy + 3)
        .otherwise(F.lit(0))
    )


def precip_label(klass: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in PRECIP_LABELS]), klass + 1)


def point_label(tau: Column) -> Column:
    return F.when(tau.isNull(), F.lit("Initial")).otherwise(
        F.concat(F.lit("+"), tau.cast("string"), F.lit("h"))
    )


def is_initial(hour: Column, style: Column) -> Column:
    return F.coalesce(hour == 0, F.lit(False)) | F.coalesce(
        style.endswith("initial_point"), F.lit(False)
    )


# Bulletin code -> weight in the feed score.
FEED_WEIGHTS = {"VPTW": 4, "VPWW54": 3, "VPWW53": 2}


def feed_score(entry_id: Column, link: Column) -> Column:
    text = F.concat_ws(" ", entry_id, link)
    score = F.when(F.lower(text).endswith(".xml"), 1).otherwise(0)
    for code, weight in FEED_WEIGHTS.items():
        score = score + F.when(text.contains(code), weight).otherwise(0)
    return score


def is_bulletin(entry_id: Column, link: Column) -> Column:
    text = F.concat_ws(" ", entry_id, link)
    hit = F.lit(False)
    for code in FEED_WEIGHTS:
        hit = hit | text.contains(code)
    return hit
