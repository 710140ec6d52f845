"""Right of way: the area and outline of everything within r metres of a line.

The area is that of the union of the span corridors (overlaps count once). The
plane is cut into thin horizontal bands; a corridor is convex, so a band's middle
line meets it in one interval, and the union of intervals is a running maximum.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feederlake.functions.projection import number
from feederlake.functions.shapes import distance

BAND_M = 0.5
TILE_M = 512.0
#: Crossings of spans and bands that a block of a tile may hold before it is halved, and how often it is halved across.
BLOCK_CROSSINGS, HALVED_ACROSS = 1 << 17, 6
QUARTER_STEPS = 8


def _crossing(sign: str, x_side: str, low: str, high: str) -> str:
    """Where the horizontal line at yb meets one flank of the corridor.

    Below the flank that is the circle around the lower end, above it the circle
    around the upper end.
    """
    def circle(end: str) -> str:
        return f"x{end} {sign} sqrt(greatest(0.0D, r2 - (yb - y{end}) * (yb - y{end})))"

    return (f"CASE WHEN yb < {low} THEN {circle('1')} WHEN yb > {high} THEN {circle('2')} "
            f"ELSE {x_side} + (yb - {low}) * slope END")


def corridor_blocks(spans: DataFrame, key: str, radius: float, band: float = BAND_M, tile: float = TILE_M,
                    crossings: int = BLOCK_CROSSINGS) -> DataFrame:
    """The different spans, once for every block that their corridor may meet, dealt by (key, tx, ty, bx, by).

    A tile is one block unless the spans of its key cross its bands too often. Then it is halved in height until few
    crossings are left or a block is one band, and after that in width. The crossings are counted beforehand, combined
    before they are shuffled. So a dense tile spreads over many tasks. Copies of a span count once.
    """
    partitions = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_tile = int(round(tile / band))
    r, h, t = number(radius), number(band), number(tile)

    def explode(first: str, last: str):
        return F.expr(f"explode(sequence({first}, {last}))")

    upward = (spans
              .selectExpr(key, "y1 > y2 AS turned", "x1", "y1", "x2", "y2")
              .selectExpr(key, "if(turned, x2, x1) AS x1", "if(turned, y2, y1) AS y1",
                          "if(turned, x1, x2) AS x2", "if(turned, y1, y2) AS y2")
              .distinct())
    tiled = (upward
             # the bands whose middle line meets the corridor
             .selectExpr("*", f"ceil((y1 - {r}) / {h} - 0.5D) AS first_band", f"floor((y2 + {r}) / {h} - 0.5D) AS last_band",
                         f"least(x1, x2) - {r} AS west", f"greatest(x1, x2) + {r} AS east")
             .withColumn("tx", explode(f"floor(west / {t})", f"floor(east / {t})"))
             .withColumn("ty", explode(f"floor(first_band / {per_tile})", f"floor(last_band / {per_tile})"))
             .withColumns({"low": F.expr(f"greatest(first_band - ty * {per_tile}, 0)"),
                           "high": F.expr(f"least(last_band - ty * {per_tile}, {per_tile - 1})")}))
    deepest = (per_tile - 1).bit_length()
    dense = (tiled.groupBy(key, "tx", "ty").agg(F.sum(F.expr("high - low + 1")).alias("n")).filter(f"n > {crossings}")
             .selectExpr(key, "tx", "ty", f"CAST(ceil(log2(n / {crossings})) AS INT) AS halvings"))
    down, across = f"least(coalesce(halvings, 0), {deepest})", f"least(greatest(coalesce(halvings, 0) - {deepest}, 0), {HALVED_ACROSS})"
    sized = (tiled.join(dense, [key, "tx", "ty"], "left")
             .selectExpr("* EXCEPT (halvings)", f"CAST(ceil({per_tile}.0D / shiftleft(1, {down})) AS BIGINT) AS tall", f"shiftleft(1, {across}) AS columns")
             .selectExpr("*", f"{t} / columns AS wide"))
    return (
        sized
        .withColumn("bx", explode(f"floor(greatest(west - tx * {t}, 0.0D) / wide)",
                                  f"least(floor((east - tx * {t}) / wide), columns - 1)"))
        .withColumn("by", explode("low div tall", "high div tall"))
        .selectExpr(key, "tx", "ty", "bx", "by", "x1", "y1", "x2", "y2", "wide", f"tx * {t} + bx * wide AS west",
                    f"ty * {per_tile} + by * tall AS bottom", f"ty * {per_tile} + greatest(low, by * tall) AS first_band",
                    f"ty * {per_tile} + least(high, (by + 1) * tall - 1) AS last_band")
        .repartition(partitions, key, "tx", "ty", "bx", "by"))


def corridor_area(spans: DataFrame, key: str, radius: float, band: float = BAND_M, tile: float = TILE_M,
                  crossings: int = BLOCK_CROSSINGS) -> DataFrame:
    """(key, x1, y1, x2, y2) spans -> (key, area_m2).

    Only spans travel: they are shuffled by block, and cut into bands afterwards in place; the sums of the blocks are
    combined before the last, small shuffle. What depends on the span alone is worked out once, so that the per-band
    code stays small enough for the JVM to compile. A span without length is a disc; one with a NULL coordinate has no
    area, and a key with no other spans no row.
    """
    r, h = number(radius), number(band)
    flanks = (
        corridor_blocks(spans, key, radius, band, tile, crossings)
        .selectExpr("*", f"coalesce(try_divide({r}, {distance('x1', 'y1', 'x2', 'y2')}), 0.0D) AS k")
        .selectExpr(
            key, "tx", "ty", "bx", "by", "wide", "west", "bottom", "first_band", "last_band",
            "x1", "y1", "x2", "y2", f"{r} * {r} AS r2", "coalesce(try_divide(x2 - x1, y2 - y1), 0.0D) AS slope",
            "x1 - k * (y2 - y1) AS left_x", "y1 + k * (x2 - x1) AS left_low", "y2 + k * (x2 - x1) AS left_high",
            "x1 + k * (y2 - y1) AS right_x", "y1 - k * (x2 - x1) AS right_low", "y2 - k * (x2 - x1) AS right_high"))
    cut = (flanks.withColumn("b", F.expr("explode(sequence(first_band, last_band))"))
           .selectExpr("*", f"(b + 0.5D) * {h} AS yb")
           .selectExpr(key, "tx", "ty", "bx", "by", "wide", "west", "(b - bottom) * wide AS start",
                       f"{_crossing('-', 'left_x', 'left_low', 'left_high')} AS lo",
                       f"{_crossing('+', 'right_x', 'right_low', 'right_high')} AS hi"))
    # clamped to the block, and the block's bands laid end to end: one running maximum
    # serves them all, for where a band begins everything before it is left behind
    block = [key, "tx", "ty", "bx", "by"]
    row = cut.selectExpr(*block, *[f"start + least(greatest({c} - west, 0.0D), wide) AS {c}" for c in ("lo", "hi")])
    before = Window.partitionBy(*block).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    return (row.withColumn("done", F.max("hi").over(before))
            .withColumn("fresh", F.expr("greatest(0.0D, hi - greatest(lo, coalesce(done, lo)))"))
            .groupBy(key).agg(F.expr(f"sum(fresh) * {h}").alias("area_m2")))


def corridor_ring(radius: float) -> str:
    """Closed outline of one span's corridor as struct(x, y) points.

    Half a circle around each end, in eight steps per quarter.
    """
    length = distance("x1", "y1", "x2", "y2")
    ux, uy = f"((x2 - x1) / {length})", f"((y2 - y1) / {length})"
    turns = [math.pi / 2 * (k / QUARTER_STEPS - 1) for k in range(2 * QUARTER_STEPS + 1)]
    stops = [(1.0, math.cos(t), math.sin(t)) for t in turns]
    stops += [(0.0, -math.cos(t), -math.sin(t)) for t in turns]
    stops.append(stops[0])
    offsets = ", ".join(f"named_struct('e', {number(e)}, 'c', {number(c)}, 's', {number(v)})" for e, c, v in stops)
    r = number(radius)
    return (f"transform(array({offsets}), o -> named_struct("
            f"'x', x1 + o.e * (x2 - x1) + {r} * ({ux} * o.c - {uy} * o.s), "
            f"'y', y1 + o.e * (y2 - y1) + {r} * ({ux} * o.s + {uy} * o.c)))")
