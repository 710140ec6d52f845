"""Geometry values as plain columns; every function takes and returns SQL text.

A point is a pair of DOUBLE columns or struct(lon, lat); a ring is
array<struct<lon,lat>>; a polygon is an array of rings (the first is the outer
one, further ones are holes, combined by the even-odd rule).
"""

from __future__ import annotations

import json

from feederlake.functions.projection import ring_metres

COORDINATE_DECIMALS = 7  # about one centimetre, the precision GeoJSON recommends


# ---------------------------------------------------------------- parsing

def rings_from_wkt(wkt: str) -> str:
    """POLYGON text -> rings. Text that is not a polygon gives NULL."""
    pattern = r"(?is)^\s*(?:SRID=\d+;)?\s*POLYGON\s*(?:ZM|Z|M)?\s*\(\s*\((.*)\)\s*\)\s*$"
    body = f"regexp_extract({wkt}, r'{pattern}', 1)"
    pair = r"split(trim(pair), r'\s+')"
    point = (f"named_struct('lon', CAST(element_at({pair}, 1) AS DOUBLE), "
             f"'lat', CAST(element_at({pair}, 2) AS DOUBLE))")
    return (rf"CASE WHEN {body} <> '' THEN transform(split({body}, r'\)\s*,\s*\('), "
            f"ring -> transform(split(ring, ','), pair -> {point})) END")


def rings_from_geojson(text: str) -> str:
    """GeoJSON Polygon text -> rings."""
    parsed = f"from_json({text}, 'type string, coordinates array<array<array<double>>>')"
    return (f"CASE WHEN {parsed}.type = 'Polygon' THEN transform({parsed}.coordinates, "
            f"ring -> transform(ring, p -> named_struct('lon', p[0], 'lat', p[1]))) END")


def rings_literal(geojson: str) -> list[list[tuple[float, float]]]:
    """A polygon handed in by a caller, as plain coordinates."""
    shape = json.loads(geojson)
    if shape.get("type") != "Polygon":
        raise ValueError("a selection must be a GeoJSON Polygon")
    return [[(float(p[0]), float(p[1])) for p in ring] for ring in shape["coordinates"]]


# ---------------------------------------------------------------- output

def _decimal(value: str) -> str:
    return f"CAST(round({value}, {COORDINATE_DECIMALS}) AS STRING)"


def _pair(lon: str, lat: str) -> str:
    return f"concat('[', {_decimal(lon)}, ',', {_decimal(lat)}, ']')"


def _list(items: str) -> str:
    return f"concat('[', array_join({items}, ','), ']')"


def _ring(points: str) -> str:
    return _list(f"transform({points}, p -> {_pair('p.lon', 'p.lat')})")


def _geojson(kind: str, coordinates: str) -> str:
    return f"""concat('{{"type":"{kind}","coordinates":', {coordinates}, '}}')"""


def point_geojson(lon: str = "lon", lat: str = "lat") -> str:
    return _geojson("Point", _pair(lon, lat))


def line_geojson(lon1: str = "lon1", lat1: str = "lat1", lon2: str = "lon2", lat2: str = "lat2") -> str:
    return _geojson("LineString", f"concat('[', {_pair(lon1, lat1)}, ',', {_pair(lon2, lat2)}, ']')")


def multiline_geojson(lines: str) -> str:
    """array of point arrays -> MultiLineString."""
    return _geojson("MultiLineString", _list(f"transform({lines}, path -> {_ring('path')})"))


def polygon_geojson(rings: str) -> str:
    return _geojson("Polygon", _list(f"transform({rings}, ring -> {_ring('ring')})"))


def multipolygon_geojson(rings: str) -> str:
    """array of rings, each one a polygon of its own -> MultiPolygon."""
    one = f"concat('[', {_ring('ring')}, ']')"
    return _geojson("MultiPolygon", _list(f"transform({rings}, ring -> {one})"))


def point_wkt(lon: str = "lon", lat: str = "lat") -> str:
    return f"concat('POINT (', {_decimal(lon)}, ' ', {_decimal(lat)}, ')')"


def line_wkt(lon1: str = "lon1", lat1: str = "lat1", lon2: str = "lon2", lat2: str = "lat2") -> str:
    return (f"concat('LINESTRING (', {_decimal(lon1)}, ' ', {_decimal(lat1)}, ', ', {_decimal(lon2)}, ' ', "
            f"{_decimal(lat2)}, ')')")


def polygon_wkt(rings: str) -> str:
    pair = f"concat({_decimal('p.lon')}, ' ', {_decimal('p.lat')})"
    ring = f"concat('(', array_join(transform(ring, p -> {pair}), ', '), ')')"
    return f"concat('POLYGON (', array_join(transform({rings}, ring -> {ring}), ', '), ')')"


# ---------------------------------------------------------------- measures

def leading(points: str) -> str:
    """All but the last element."""
    return f"slice({points}, 1, greatest(size({points}) - 1, 0))"


def following(points: str) -> str:
    """All but the first element."""
    return f"slice({points}, 2, greatest(size({points}) - 1, 0))"


def _sum_edges(points: str, term: str) -> str:
    """Sum of a term in a and b over every edge a -> b."""
    return (f"aggregate(zip_with({leading(points)}, {following(points)}, (a, b) -> {term}), 0.0D, "
            f"(total, v) -> total + v)")


_CROSS = "(a.x * b.y - b.x * a.y)"


def planar_ring_area(points: str) -> str:
    """Unsigned shoelace area of a closed ring of struct(x, y)."""
    return f"(abs({_sum_edges(points, _CROSS)}) / 2.0D)"


def polygon_area_m2(rings: str) -> str:
    """Projected area: outer ring minus holes."""
    areas = f"transform({rings}, ring -> {planar_ring_area(ring_metres('ring'))})"
    return f"(2.0D * element_at({areas}, 1) - aggregate({areas}, 0.0D, (total, v) -> total + v))"


def ring_centroid(ring: str) -> str:
    """Area-weighted centroid of a closed ring as struct(lon, lat), in the ring's own lon/lat plane.

    Coordinates are taken relative to the first vertex: a zone is tiny against
    its longitude, and the raw cross products would cancel.
    """
    lon0, lat0 = f"{ring}[0].lon", f"{ring}[0].lat"
    local = f"transform({ring}, p -> named_struct('x', p.lon - {lon0}, 'y', p.lat - {lat0}))"
    edges = f"zip_with({leading(local)}, {following(local)}, (a, b) -> named_struct('a', a, 'b', b, 'w', {_CROSS}))"
    add = ("named_struct('w', s.w + e.w, 'x', s.x + (e.a.x + e.b.x) * e.w, 'y', s.y + (e.a.y + e.b.y) * e.w)")
    return (f"aggregate({edges}, named_struct('w', 0.0D, 'x', 0.0D, 'y', 0.0D), (s, e) -> {add}, "
            f"s -> named_struct('lon', {lon0} + s.x / (3.0D * s.w), 'lat', {lat0} + s.y / (3.0D * s.w)))")


def bounds(rings: str) -> dict[str, str]:
    """Bounding box of a polygon's outer ring."""
    return {"xmin": f"array_min({rings}[0].lon)", "ymin": f"array_min({rings}[0].lat)",
            "xmax": f"array_max({rings}[0].lon)", "ymax": f"array_max({rings}[0].lat)"}


def distance(x1: str, y1: str, x2: str, y2: str) -> str:
    """Planar distance between projected points."""
    return f"sqrt(({x2} - {x1}) * ({x2} - {x1}) + ({y2} - {y1}) * ({y2} - {y1}))"


# ---------------------------------------------------------------- validity

def rings_well_formed(rings: str) -> str:
    """Every ring closed, at least four points, non-zero area.

    Crossing edges need an edge comparison; see operators.spatial.edges_apart.
    """
    closed = ("element_at(ring, 1).lon = element_at(ring, -1).lon AND "
              "element_at(ring, 1).lat = element_at(ring, -1).lat")
    flat = "transform(ring, p -> named_struct('x', p.lon, 'y', p.lat))"
    sound = f"CASE WHEN size(ring) < 4 THEN false ELSE {closed} AND {planar_ring_area(flat)} > 0 END"
    return f"coalesce({rings} IS NOT NULL AND size({rings}) > 0 AND forall({rings}, ring -> {sound}), false)"
