"""EPSG:4326 <-> EPSG:32198 (Quebec Lambert) as SQL expressions.

Ellipsoidal Lambert conformal conic with two standard parallels, after Snyder,
"Map Projections: A Working Manual" (1987), section 15, in built-in functions only.
The forward direction, which every asset goes through, stays inside whole-stage
code generation.

Like all of ``functions``, these take and return SQL text, to be used in
``selectExpr``/``F.expr`` and inside lambdas: a formula then costs one call to
Spark instead of one per operator.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

# GRS80 ellipsoid and the defining parameters of EPSG:32198.
SEMI_MAJOR_M = 6378137.0
INVERSE_FLATTENING = 298.257222101
STANDARD_PARALLELS = (60.0, 46.0)
ORIGIN_LAT = 44.0
ORIGIN_LON = -68.5

LATITUDE_STEPS = 5  # fixed-point steps of the inverse; error below 1e-13 degrees

_flattening = 1.0 / INVERSE_FLATTENING
ECCENTRICITY = math.sqrt(_flattening * (2.0 - _flattening))


def _m(lat_deg: float) -> float:
    phi = math.radians(lat_deg)
    return math.cos(phi) / math.sqrt(1.0 - (ECCENTRICITY * math.sin(phi)) ** 2)


def _t(lat_deg: float) -> float:
    phi = math.radians(lat_deg)
    return math.tan(math.pi / 4 - phi / 2) * math.exp(ECCENTRICITY * math.atanh(ECCENTRICITY * math.sin(phi)))


def _cone() -> tuple[float, float, float]:
    first, second = STANDARD_PARALLELS
    n = math.log(_m(first) / _m(second)) / math.log(_t(first) / _t(second))
    scale = SEMI_MAJOR_M * _m(first) / (n * _t(first) ** n)
    return n, scale, scale * _t(ORIGIN_LAT) ** n


CONE_N, CONE_SCALE, CONE_ORIGIN = _cone()


def number(value: float) -> str:
    """A DOUBLE literal."""
    return f"{float(value)!r}D"


_E, _N, _SCALE, _ORIGIN = (number(v) for v in (ECCENTRICITY, CONE_N, CONE_SCALE, CONE_ORIGIN))
_HALF_PI = number(math.pi / 2)


def _rho(lat: str) -> str:
    isometric = (f"tan({number(math.pi / 4)} - radians({lat}) / 2.0D) * "
                 f"exp({_E} * atanh({_E} * sin(radians({lat}))))")
    return f"{_SCALE} * pow({isometric}, {_N})"


def _theta(lon: str) -> str:
    return f"{_N} * radians(({lon}) - {number(ORIGIN_LON)})"


def x_metres(lon: str, lat: str) -> str:
    return f"({_rho(lat)} * sin({_theta(lon)}))"


def y_metres(lon: str, lat: str) -> str:
    return f"({_ORIGIN} - {_rho(lat)} * cos({_theta(lon)}))"


def lon_degrees(x: str, y: str) -> str:
    return f"(degrees(atan2({x}, {_ORIGIN} - ({y})) / {_N}) + {number(ORIGIN_LON)})"


def lat_degrees(x: str, y: str) -> str:
    """A fold keeps the text short: unrolled, every step would repeat the one before."""
    south = f"({_ORIGIN} - ({y}))"
    isometric = f"pow(sqrt(({x}) * ({x}) + {south} * {south}) / {_SCALE}, {number(1.0 / CONE_N)})"
    step = f"{_HALF_PI} - 2.0D * atan({isometric} * exp(-{_E} * atanh({_E} * sin(phi))))"
    return (f"degrees(aggregate(sequence(1, {LATITUDE_STEPS}), {_HALF_PI} - 2.0D * atan({isometric}), "
            f"(phi, step) -> {step}))")


def with_metres(df: DataFrame, lon: str = "lon", lat: str = "lat", x: str = "x", y: str = "y") -> DataFrame:
    """Add projected coordinates next to a lon/lat pair."""
    return df.selectExpr("*", f"{x_metres(lon, lat)} AS {x}", f"{y_metres(lon, lat)} AS {y}")


def ring_metres(ring: str) -> str:
    """array of struct(lon, lat) -> array of struct(x, y)."""
    return (f"transform({ring}, p -> named_struct('x', {x_metres('p.lon', 'p.lat')}, "
            f"'y', {y_metres('p.lon', 'p.lat')}))")


def ring_degrees(ring: str) -> str:
    """array of struct(x, y) -> array of struct(lon, lat)."""
    return (f"transform({ring}, p -> named_struct('lon', {lon_degrees('p.x', 'p.y')}, "
            f"'lat', {lat_degrees('p.x', 'p.y')}))")
