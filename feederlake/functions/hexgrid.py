"""Hexagonal cells on the projected plane (pointy-top axial grid), as SQL text.

The cell edge is the published mean H3 edge length of the resolution, so cells
have about H3's size; the ids are this grid's own, written ``res:q:r``.
"""

from __future__ import annotations

import math

from feederlake.functions.projection import lat_degrees, lon_degrees, number, ring_degrees

# Mean hexagon edge in metres per resolution.
EDGE_M = {8: 531.414010, 9: 200.786148}

_SQRT3 = math.sqrt(3.0)


def cell_id(x: str, y: str, resolution: int) -> str:
    """Cell of a projected point: axial coordinates, then cube rounding."""
    edge = number(EDGE_M[resolution])
    q = f"(({number(_SQRT3 / 3.0)} * {x} - {y} / 3.0D) / {edge})"
    r = f"(({number(2.0 / 3.0)} * {y}) / {edge})"
    s = f"(-{q} - {r})"
    rq, rr, rs = (f"floor({v} + 0.5D)" for v in (q, r, s))
    dq, dr, ds = f"abs({rq} - {q})", f"abs({rr} - {r})", f"abs({rs} - {s})"
    far_q = f"({dq} > {dr} AND {dq} > {ds})"
    col = f"CASE WHEN {far_q} THEN -{rr} - {rs} ELSE {rq} END"
    row = f"CASE WHEN NOT {far_q} AND {dr} > {ds} THEN -{rq} - {rs} ELSE {rr} END"
    return f"concat('{resolution}:', CAST({col} AS STRING), ':', CAST({row} AS STRING))"


def _edge(cell: str) -> str:
    cases = " ".join(f"WHEN '{res}' THEN {number(edge)}" for res, edge in EDGE_M.items())
    return f"(CASE split({cell}, ':')[0] {cases} END)"


def centre_x(cell: str) -> str:
    q, r = (f"CAST(split({cell}, ':')[{i}] AS DOUBLE)" for i in (1, 2))
    return f"({_edge(cell)} * {number(_SQRT3)} * ({q} + {r} / 2.0D))"


def centre_y(cell: str) -> str:
    return f"({_edge(cell)} * 1.5D * CAST(split({cell}, ':')[2] AS DOUBLE))"


def centre_lon(cell: str) -> str:
    return lon_degrees(centre_x(cell), centre_y(cell))


def centre_lat(cell: str) -> str:
    return lat_degrees(centre_x(cell), centre_y(cell))


def cell_ring(cell: str) -> str:
    """Closed boundary ring of a cell as lon/lat points."""
    angles = [math.pi / 6 + k * math.pi / 3 for k in (0, 1, 2, 3, 4, 5, 0)]
    corners = ", ".join(f"named_struct('dx', {number(math.cos(a))}, 'dy', {number(math.sin(a))})" for a in angles)
    placed = (f"transform(array({corners}), c -> named_struct('x', {centre_x(cell)} + {_edge(cell)} * c.dx, "
              f"'y', {centre_y(cell)} + {_edge(cell)} * c.dy))")
    return ring_degrees(placed)
