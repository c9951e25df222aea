"""Spherical geometry as column expressions (no UDF, so it stays inside generated code)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sojourn.constants import EARTH_RADIUS_M, PLAUSIBLE_MAX_KMH, TRANSIT_MAX_KMH, WALK_MAX_KMH


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def haversine_sql(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    """Great-circle metres between two points given in degrees, as SQL text over column names."""
    h = (f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
         f" * pow(sin(radians({lng2} - {lng1}) / 2), 2))")
    return f"({2 * EARTH_RADIUS_M}D * atan2(sqrt({h}), sqrt(1D - {h})))"


def haversine_m(lat1: str, lng1: str, lat2: str, lng2: str) -> Column:
    """Great-circle metres between two points given in degrees by column names."""
    return F.expr(haversine_sql(lat1, lng1, lat2, lng2))


def valid_coordinate(lat, lng) -> Column:
    """True when both numbers are finite and inside the globe's range."""
    lat, lng = _col(lat), _col(lng)
    inside = (F.abs(lat) <= 90) & (F.abs(lng) <= 180) & ~F.isnan(lat) & ~F.isnan(lng)
    return F.coalesce(inside, F.lit(False))


def speed_mode(kmh) -> Column:
    kmh = _col(kmh)
    return (F.when(kmh <= WALK_MAX_KMH, F.lit("walk"))
            .when(kmh <= TRANSIT_MAX_KMH, F.lit("transit"))
            .otherwise(F.lit("drive")))


def plausible(kmh) -> Column:
    return ~(_col(kmh) > PLAUSIBLE_MAX_KMH)


def cell(coordinate, size) -> Column:
    """Index of the square cell that holds a coordinate (``size`` in degrees, scalar or column)."""
    size = F.lit(size) if isinstance(size, (int, float)) else _col(size)
    return F.floor(_col(coordinate) / size).cast("bigint")


def scaled_key(coordinate, decimals: int = 4) -> Column:
    """A coordinate rounded to ``decimals`` places, as an integer so that equality is exact."""
    c = _col(coordinate)
    return (F.signum(c) * F.floor(F.abs(c) * F.lit(float(10 ** decimals)) + F.lit(0.5))).cast("bigint")


def box_diagonal_m(min_lat, max_lat, min_lng, max_lng) -> Column:
    """An upper bound for the distance between any two points of a small box."""
    min_lat, max_lat, min_lng, max_lng = map(_col, (min_lat, max_lat, min_lng, max_lng))
    nearest_equator = F.when((min_lat <= 0) & (max_lat >= 0), F.lit(0.0)).otherwise(
        F.least(F.abs(min_lat), F.abs(max_lat)))
    dy = F.radians(max_lat - min_lat)
    dx = F.radians(max_lng - min_lng) * F.cos(F.radians(nearest_equator))
    return F.lit(EARTH_RADIUS_M) * F.sqrt(dy * dy + dx * dx)


def box_extent_m(min_lat, max_lat, min_lng, max_lng) -> Column:
    """A lower bound for the distance between the two farthest points of a box's contents."""
    min_lat, max_lat, min_lng, max_lng = map(_col, (min_lat, max_lat, min_lng, max_lng))
    farthest = F.greatest(F.abs(min_lat), F.abs(max_lat))
    dy = F.radians(max_lat - min_lat)
    chord = F.cos(F.radians(farthest)) * F.sin(F.radians(max_lng - min_lng) / 2)
    return F.lit(EARTH_RADIUS_M) * F.greatest(dy, 2 * F.asin(F.least(F.greatest(chord, F.lit(0.0)), F.lit(1.0))))
