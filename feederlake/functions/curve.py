"""A space-filling curve as SQL text: places near each other have numbers near each other."""

from __future__ import annotations

#: Halvings of the globe along each axis; cells of the last one are some two metres wide.
BITS = 24


def hilbert(x: str, y: str, bits: int = BITS) -> str:
    """Number of an integer cell (0 to 2^bits - 1 along both axes) on Hilbert's curve.

    From the coarsest bit to the finest: the quadrant gives two bits of the number, and what is left of the cell is
    turned as the curve turns in that quadrant.
    """
    last = (1 << bits) - 1
    right, upper = "(shiftright(a.x, level) & 1L)", "(shiftright(a.y, level) & 1L)"
    step = (f"named_struct('x', CASE WHEN {upper} = 1 THEN a.x WHEN {right} = 1 THEN {last}L - a.y ELSE a.y END, "
            f"'y', CASE WHEN {upper} = 1 THEN a.y WHEN {right} = 1 THEN {last}L - a.x ELSE a.x END, "
            f"'d', shiftleft(a.d, 2) | ((3L * {right}) ^ {upper}))")
    start = f"named_struct('x', CAST({x} AS BIGINT), 'y', CAST({y} AS BIGINT), 'd', 0L)"
    return f"aggregate(sequence({bits - 1}, 0), {start}, (a, level) -> {step}, a -> a.d)"


def place_number(lon: str, lat: str) -> str:
    """The number of a place in degrees; NULL without one. Places off the globe count to its edge."""
    def cell(value: str, span: float) -> str:
        share = f"({value} + {span / 2}D) / {span}D"
        return f"CAST(least(greatest(floor({share} * {1 << BITS}D), 0), {(1 << BITS) - 1}) AS BIGINT)"

    # floor of a NaN has no cell; such a place is put with those that have none
    known = f"{lon} BETWEEN -1e9D AND 1e9D AND {lat} BETWEEN -1e9D AND 1e9D"
    return f"CASE WHEN {known} THEN {hilbert(cell(lon, 360.0), cell(lat, 360.0))} END"
