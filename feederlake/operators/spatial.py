"""Containment, intersection, clipping and distance, and the joins built on them.

Predicates are SQL text over an array of edges. Joins go through grids: every
point has one cell in each, every shape lists the cells of one of them, and the
exact test runs on equal cells. That is an equi-join, so Spark broadcasts a small
side after checking its size and shuffles by cell otherwise; each pair meets in
exactly one cell. A polygon's inner cells answer without a test, and those on its
outline carry only the edges that a ray to the right can meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feederlake.functions.projection import number, x_metres, y_metres
from feederlake.functions.shapes import bounds, distance, following, leading

#: Cell sizes in degrees, powers of two, so that cell borders are exact numbers.
CELLS_DEG = (2.0 ** -2, 2.0 ** -4, 2.0 ** -6, 2.0 ** -8)
#: Bounds of the cells along the longer side of a polygon's box; between them, the square root of its edges.
CELLS_ALONG, CELLS_ALONG_MAX = 16, 64

Rings = list[list[tuple[float, float]]]


def polygon_literal(rings: Rings) -> str:
    """A caller's polygon as a constant array of rings."""
    def ring(points):
        return "array(" + ", ".join(
            f"named_struct('lon', {number(lon)}, 'lat', {number(lat)})" for lon, lat in points) + ")"

    return "array(" + ", ".join(ring(r) for r in rings) + ")"


def edges_literal(rings: Rings) -> str:
    """The edges of a caller's polygon."""
    edges = [(a, b) for ring in rings for a, b in zip(ring, ring[1:])]
    return "array(" + ", ".join(
        f"named_struct('ax', {number(a[0])}, 'ay', {number(a[1])}, 'bx', {number(b[0])}, 'by', {number(b[1])})"
        for a, b in edges) + ")"


_EDGE = "named_struct('ax', a.lon, 'ay', a.lat, 'bx', b.lon, 'by', b.lat)"


def ring_edges(rings: str) -> str:
    """All edges of all rings: array of struct(ax, ay, bx, by)."""
    return (f"flatten(transform({rings}, ring -> zip_with({leading('ring')}, {following('ring')}, "
            f"(a, b) -> {_EDGE})))")


def _side(e: str, px: str, py: str) -> str:
    """Sign tells on which side of the directed edge a point lies."""
    return f"(({e}.bx - {e}.ax) * ({py} - {e}.ay) - ({e}.by - {e}.ay) * ({px} - {e}.ax))"


def _on_edge(e: str, px: str, py: str) -> str:
    return (f"({_side(e, px, py)} = 0 AND {px} BETWEEN least({e}.ax, {e}.bx) AND greatest({e}.ax, {e}.bx) "
            f"AND {py} BETWEEN least({e}.ay, {e}.by) AND greatest({e}.ay, {e}.by))")


def _odd_crossings(edges: str, px: str, py: str) -> str:
    passes = (f"CASE WHEN (e.ay > {py}) <> (e.by > {py}) "
              f"THEN {px} < e.ax + ({py} - e.ay) / (e.by - e.ay) * (e.bx - e.ax) ELSE false END")
    return f"size(filter({edges}, e -> {passes})) % 2 = 1"


def contains_point(edges: str, px: str, py: str) -> str:
    """Strictly inside: a point on the outline is not contained."""
    return f"({_odd_crossings(edges, px, py)} AND NOT exists({edges}, e -> {_on_edge('e', px, py)}))"


def touches_point(edges: str, px: str, py: str) -> str:
    """Inside or on the outline."""
    return f"({_odd_crossings(edges, px, py)} OR exists({edges}, e -> {_on_edge('e', px, py)}))"


def _meets(e: str, f: str) -> str:
    """Whether two edges have a point in common."""
    s1, s2 = _side(e, f"{f}.ax", f"{f}.ay"), _side(e, f"{f}.bx", f"{f}.by")
    s3, s4 = _side(f, f"{e}.ax", f"{e}.ay"), _side(f, f"{e}.bx", f"{e}.by")
    ends = " OR ".join([_on_edge(e, f"{f}.ax", f"{f}.ay"), _on_edge(e, f"{f}.bx", f"{f}.by"),
                        _on_edge(f, f"{e}.ax", f"{e}.ay"), _on_edge(f, f"{e}.bx", f"{e}.by")])
    return f"(({s1} * {s2} < 0 AND {s3} * {s4} < 0) OR {ends})"


def touches_segment(edges: str, ax: str, ay: str, bx: str, by: str) -> str:
    """An end inside, or any outline edge met."""
    segment = f"named_struct('ax', {ax}, 'ay', {ay}, 'bx', {bx}, 'by', {by})"
    met = f"exists(transform({edges}, e -> named_struct('e', e, 's', {segment})), m -> {_meets('m.e', 'm.s')})"
    return f"({touches_point(edges, ax, ay)} OR {met})"


def with_cuts(segments: DataFrame, ax: str, ay: str, bx: str, by: str, edges: str = "_edges") -> DataFrame:
    """Add ``_cuts``: the shares of the way along each segment where it meets the outline, with 0 and 1."""
    turn = f"(({bx} - {ax}) * (e.by - e.ay) - ({by} - {ay}) * (e.bx - e.ax))"
    t = f"try_divide((e.ax - {ax}) * (e.by - e.ay) - (e.ay - {ay}) * (e.bx - e.ax), {turn})"
    u = f"try_divide((e.ax - {ax}) * ({by} - {ay}) - (e.ay - {ay}) * ({bx} - {ax}), {turn})"
    crossing = f"CASE WHEN {t} BETWEEN 0 AND 1 AND {u} BETWEEN 0 AND 1 THEN {t} END"
    return segments.selectExpr("*", (
        f"array_sort(array_distinct(concat(array(0.0D, 1.0D), "
        f"filter(transform({edges}, e -> {crossing}), t -> t IS NOT NULL)))) AS _cuts"))


def clipped_length_m(edges: str, cuts: str, ax: str, ay: str, bx: str, by: str) -> str:
    """Projected length of the part of segment a-b inside the polygon.

    Of the pieces between two cuts, those count whose middle is inside; a segment
    that stays outside adds nothing.
    """
    def at(share: str) -> tuple[str, str]:
        return f"({ax} + {share} * ({bx} - {ax}))", f"({ay} + {share} * ({by} - {ay}))"

    start, end, middle = at("c.s"), at("c.t"), at("((c.s + c.t) / 2.0D)")
    placed = f"transform({leading(cuts)}, (s, i) -> named_struct('s', s, 't', {cuts}[i + 1]))"
    metres = distance(x_metres(*start), y_metres(*start), x_metres(*end), y_metres(*end))
    halved = f"transform({placed}, c -> named_struct('s', c.s, 't', c.t, 'mx', {middle[0]}, 'my', {middle[1]}))"
    kept = f"filter({halved}, c -> {touches_point(edges, 'c.mx', 'c.my')})"
    return f"aggregate(transform({kept}, c -> {metres}), 0.0D, (total, v) -> total + v)"


def box_test(rings: Rings, lon: str = "lon", lat: str = "lat") -> str:
    """Bounding box of a constant polygon: two ranges the scan can use."""
    lons, lats = [p[0] for p in rings[0]], [p[1] for p in rings[0]]
    return (f"{lon} BETWEEN {number(min(lons))} AND {number(max(lons))} AND "
            f"{lat} BETWEEN {number(min(lats))} AND {number(max(lats))}")


def edges_apart(rings: str) -> str:
    """No two edges of the polygon cross, and edges of a ring meet only at joints."""
    numbered = (f"zip_with({leading('ring')}, transform({following('ring')}, (b, i) -> named_struct('b', b, 'i', i)), "
                "(a, n) -> named_struct('ax', a.lon, 'ay', a.lat, 'bx', n.b.lon, 'by', n.b.lat, 'i', n.i, "
                "'ring', ring_no, 'n', size(ring) - 1))")
    edges = f"flatten(transform({rings}, (ring, ring_no) -> {numbered}))"
    neighbours = "(f.i = e.i + 1 OR (e.i = 0 AND f.i = e.n - 1))"
    later = f"(f.ring > e.ring OR (f.ring = e.ring AND f.i > e.i AND NOT {neighbours}))"
    return f"NOT exists({edges}, e -> exists({edges}, f -> {later} AND {_meets('e', 'f')}))"


def polygon_cells(polygons: DataFrame, rings: str, cells_deg: tuple[float, ...] = CELLS_DEG) -> DataFrame:
    """The polygons, one row for each cell that may hold points of it: ``_deg``, ``_cx``, ``_cy`` and ``_edges``.

    The grid of a polygon is the finest in which its box is few cells long, more of them the more edges it has. Its
    edges are dealt to rows of cells first. A cell that no edge's box touches is inside or outside as a whole: ``_edges``
    is NULL there, or the cell is left out. Any other one carries the edges of its row that do not end to its left, which
    decide about all its points just as the whole outline does.
    """
    along = f"least({CELLS_ALONG_MAX}, greatest({CELLS_ALONG}, sqrt(size(_all))))"
    longer = "greatest(_xmax - _xmin, _ymax - _ymin)"
    sizes = sorted(cells_deg)
    fits = " ".join(f"WHEN {longer} <= {number(d)} * {along} THEN {number(d)}" for d in sizes[:-1])
    deg = f"CASE {fits} ELSE {number(sizes[-1])} END" if fits else number(sizes[-1])
    across = "least(e.ay, e.by) <= (_cy + 1) * _deg AND greatest(e.ay, e.by) >= _cy * _deg"
    beside = "least(e.ax, e.bx) <= (_cx + 1) * _deg AND greatest(e.ax, e.bx) >= _cx * _deg"
    centre = "(_cx + 0.5D) * _deg", "(_cy + 0.5D) * _deg"
    return (
        polygons.filter(f"size({rings}) > 0").selectExpr("*", f"{ring_edges(rings)} AS _all", *[f"{v} AS _{k}" for k, v in bounds(rings).items()])
        .withColumn("_deg", F.expr(deg))
        .withColumn("_cy", F.expr("explode(sequence(floor(_ymin / _deg), floor(_ymax / _deg)))"))
        .withColumn("_all", F.expr(f"filter(_all, e -> {across})"))
        .withColumn("_cx", F.expr("explode(sequence(floor(_xmin / _deg), floor(_xmax / _deg)))"))
        .withColumn("_edges", F.expr(
            f"CASE WHEN exists(_all, e -> {beside}) THEN filter(_all, e -> greatest(e.ax, e.bx) >= _cx * _deg) END"))
        .filter(f"_edges IS NOT NULL OR {_odd_crossings('_all', *centre)}")
        .drop("_all", "_xmin", "_xmax", "_ymin", "_ymax"))


def join_containing(points: DataFrame, polygons: DataFrame, rings: str, cells_deg: tuple[float, ...] = CELLS_DEG) -> DataFrame:
    """Inner join of points (lon, lat) with the polygons that contain them; a point on the outline is not contained.

    Points of any number meet polygons of any number of edges by equal cells. Neither side is collected, and no row of
    the join holds a whole outline of many edges.
    """
    shapes = polygon_cells(polygons, rings, cells_deg)
    grids = ", ".join(number(d) for d in cells_deg)
    placed = points.selectExpr("*", f"explode(array({grids})) AS _deg").selectExpr(
        "*", "floor(lon / _deg) AS _cx", "floor(lat / _deg) AS _cy")
    return (placed.join(shapes, ["_deg", "_cx", "_cy"])
            .filter(f"_edges IS NULL OR {contains_point('_edges', 'lon', 'lat')}")
            .drop("_deg", "_cx", "_cy", "_edges"))


def join_within(points: DataFrame, centres: DataFrame, metres: float) -> DataFrame:
    """Inner join of points (x, y) with the centres (cx, cy) at most so far away."""
    d = number(metres)
    wide = (
        centres.withColumn("_ox", F.expr("explode(sequence(-1, 1))"))
        .withColumn("_oy", F.expr("explode(sequence(-1, 1))"))
        .selectExpr("* EXCEPT (_ox, _oy)", f"floor(cx / {d}) + _ox AS _gx", f"floor(cy / {d}) + _oy AS _gy"))
    placed = points.selectExpr("*", f"floor(x / {d}) AS _gx", f"floor(y / {d}) AS _gy")
    return (placed.join(wide, ["_gx", "_gy"])
            .filter(f"(x - cx) * (x - cx) + (y - cy) * (y - cy) <= {d} * {d}")
            .drop("_gx", "_gy"))
