"""Result tables to map features: one GeoJSON Feature per row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which column names hold a geometry or a coordinate.
GEOMETRY_NAME = re.compile(r"^(geojson|geom|geometry|.*_geom|wkt)$", re.IGNORECASE)
LON_NAME = re.compile(r"^(lon|longitude|x)$", re.IGNORECASE)
LAT_NAME = re.compile(r"^(lat|latitude|y)$", re.IGNORECASE)

_NUMBER = r"[-+0-9.eE]+"


def wkt_to_geojson(wkt: Column) -> Column:
    """WKT of the six simple types -> GeoJSON text; anything else gives NULL.

    An SRID prefix, and Z or M values, are dropped.
    """
    text = F.regexp_replace(F.trim(wkt), r"(?i)^SRID=\d+;", "")
    head = r"(?is)^(\w+?)\s*(?:ZM|Z|M)?\s*\((.*)\)\s*$"
    kind = F.upper(F.regexp_extract(text, head, 1))
    body = F.regexp_extract(text, head, 2)
    # JSON numbers have no plus sign, and digits on both sides of a point
    for found, written in ((r"(^|[\s,(])\+", "$1"), (r"(^|[\s,(]-?)\.(\d)", "$10.$2"), (r"(\d)\.(?=[\s,)eE]|$)", "$1"),
                           (r"(^|[\s,(]-?)0+(\d)", "$1$2")):
        body = F.regexp_replace(body, found, written)
    pairs = F.regexp_replace(body, rf"({_NUMBER})\s+({_NUMBER})(?:\s+{_NUMBER})*", "[$1,$2]")
    pairs = F.regexp_replace(pairs, r"\s+", "")
    nested = F.translate(pairs, "()", "[]")
    flat = F.translate(pairs, "()", "")

    def shape(name: str, coordinates: Column) -> Column:
        return F.concat(F.lit(f'{{"type":"{name}","coordinates":'), coordinates, F.lit("}"))

    def wrapped(inner: Column) -> Column:
        return F.concat(F.lit("["), inner, F.lit("]"))

    return (F.when(kind == "POINT", shape("Point", flat))
            .when(kind == "LINESTRING", shape("LineString", wrapped(flat)))
            .when(kind == "POLYGON", shape("Polygon", wrapped(nested)))
            .when(kind == "MULTIPOINT", shape("MultiPoint", wrapped(flat)))
            .when(kind == "MULTILINESTRING", shape("MultiLineString", wrapped(nested)))
            .when(kind == "MULTIPOLYGON", shape("MultiPolygon", wrapped(nested))))


def _first(names: list[str], pattern: re.Pattern) -> str | None:
    return next((n for n in names if pattern.match(n)), None)


def to_features(df: DataFrame) -> DataFrame:
    """One ``feature`` text per row that has a location; other rows are left out.

    A geometry column (GeoJSON or WKT text) wins; without a value there, a lon/lat
    pair gives a point. The remaining columns become the properties.
    """
    shape = _first(df.columns, GEOMETRY_NAME)
    lon, lat = _first(df.columns, LON_NAME), _first(df.columns, LAT_NAME)
    options = []
    if shape:
        text = F.trim(F.col(shape).cast("string"))
        options.append(F.when(text.startswith("{"), text).otherwise(wkt_to_geojson(text)))
    if lon and lat:
        point = F.concat(F.lit('{"type":"Point","coordinates":['), F.col(lon).cast("string"), F.lit(","),
                         F.col(lat).cast("string"), F.lit("]}"))
        has_point = F.col(lon).isNotNull() & F.col(lat).isNotNull()
        if shape:
            has_point = has_point & (F.col(shape).isNull() | (F.col(shape).cast("string") == ""))
        options.append(F.when(has_point, point))
    if not options:
        return df.sparkSession.createDataFrame([], "feature string")
    kept = [c for c in df.columns if c != shape]
    properties = F.to_json(F.struct(*[_plain(df, c) for c in kept]), {"ignoreNullFields": "false"})
    geometry = F.coalesce(*options)
    geometry = F.when(F.try_parse_json(geometry).isNotNull(), geometry)  # broken text has no place on a map
    feature = F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), properties,
                       F.lit("}"))
    return df.select(feature.alias("feature")).filter(F.col("feature").isNotNull())


def _plain(df: DataFrame, name: str) -> Column:
    """JSON has text, numbers and truth values; everything else is written as text."""
    kind = df.schema[name].dataType.typeName()
    simple = kind in ("string", "integer", "long", "short", "byte", "double", "float", "boolean")
    return F.col(name) if simple else F.col(name).cast("string").alias(name)


def write_feature_lines(df: DataFrame, path: str) -> None:
    """Newline-delimited features, written by the executors."""
    to_features(df).write.mode("overwrite").text(path)
