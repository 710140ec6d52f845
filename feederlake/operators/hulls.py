"""Convex hull per group, widened by a margin, over groups of any size.

Points are thinned to partial hulls inside every input partition before they are
shuffled; the group is then finished as a sorted stream that keeps only the
current hull in memory. A hull of hulls is the hull of all points, so nothing is
lost on the way.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Executors need not have this package installed: its helpers travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CIRCLE_POINTS = 32
#: Directions in which the extreme points of a group are looked up before its hull is walked.
DIRECTIONS = 16
HELD_ROWS = 200_000


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull vertices of an (n, 2) array, without collinear ones."""
    listed = sorted(set(map(tuple, points.tolist())))
    if len(listed) < 3:
        return np.array(listed)

    def half(ordered) -> list:
        chain: list = []
        for px, py in ordered:
            while len(chain) > 1:
                (ax, ay), (bx, by) = chain[-2], chain[-1]
                if (bx - ax) * (py - ay) - (by - ay) * (px - ax) > 0:
                    break
                chain.pop()
            chain.append((px, py))
        return chain

    return np.array(half(listed)[:-1] + half(reversed(listed))[:-1])


def widen(hull: np.ndarray, margin: float) -> np.ndarray:
    """Closed ring around a hull at the given margin.

    Both outlines are convex, so their sum is found by laying all edges end to end
    in order of direction. The margin circle is a regular polygon.
    """
    angles = 2 * np.pi * np.arange(CIRCLE_POINTS) / CIRCLE_POINTS
    circle = margin * np.column_stack([np.cos(angles), np.sin(angles)])
    edges = np.roll(circle, -1, axis=0) - circle
    if len(hull) > 1:
        edges = np.vstack([np.roll(hull, -1, axis=0) - hull, edges])
    direction = np.mod(np.arctan2(edges[:, 1], edges[:, 0]), 2 * np.pi)
    lowest = hull[np.lexsort((hull[:, 0], hull[:, 1]))[0]] + circle[CIRCLE_POINTS * 3 // 4]
    ring = lowest + np.vstack([[0.0, 0.0], np.cumsum(edges[np.argsort(direction, kind="stable")], axis=0)])
    ring[-1] = ring[0]
    return ring


def outer_points(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which points may be on the hull of their group; groups lie one after another from `starts` on.

    Those clearly inside the polygon of a group's extreme points in DIRECTIONS directions are not. It is found for all
    groups at once; points within rounding of an edge stay.
    """
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(points))))
    corners = []
    for angle in 2 * np.pi * np.arange(DIRECTIONS) / DIRECTIONS:
        reach = points @ np.array([np.cos(angle), np.sin(angle)])
        hits = np.flatnonzero(reach == np.maximum.reduceat(reach, starts)[group])
        corners.append(points[hits[np.searchsorted(group[hits], np.arange(len(starts)))]])
    ring = np.array(corners)
    edges = np.roll(ring, -1, axis=0) - ring
    turned = (edges != 0).any(axis=2)
    slack = 1e-9 * (np.abs(edges).max(axis=(0, 2)) + 1e-9 * np.abs(ring).max(axis=(0, 2))) ** 2
    inside = turned.any(axis=0)[group]
    for corner, edge, real in zip(ring, edges, turned, strict=True):
        at = points - corner[group]
        side = edge[group, 0] * at[:, 1] - edge[group, 1] * at[:, 0]
        inside &= ~real[group] | (side > slack[group])
    return ~inside


def _thin(frame: pd.DataFrame, key: str) -> pd.DataFrame:
    """Replace every group in the frame by its hull vertices."""
    codes, names = pd.factorize(frame[key])
    order = np.argsort(codes, kind="stable")
    codes, points = codes[order], frame[["x", "y"]].to_numpy(float)[order]
    outer = outer_points(points, np.r_[0, np.flatnonzero(np.diff(codes)) + 1])
    codes, points = codes[outer], points[outer]
    cuts = np.flatnonzero(np.diff(codes)) + 1
    kept = [convex_hull(group) for group in np.split(points, cuts)]
    merged = np.vstack(kept)
    labels = np.repeat(names[codes[np.r_[0, cuts]]], [len(k) for k in kept])
    return pd.DataFrame({key: labels, "x": merged[:, 0], "y": merged[:, 1]})


def _partial(key: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for frame in frames:
            if not len(frame):
                continue
            held.append(frame)
            rows += len(frame)
            if rows > HELD_ROWS:
                thinned = _thin(pd.concat(held), key)
                if len(thinned) > HELD_ROWS // 2:
                    yield thinned
                    held, rows = [], 0
                else:
                    held, rows = [thinned], len(thinned)
        if held:
            yield _thin(pd.concat(held), key)

    return run


def _finish(key: str, margin: float):
    def rings(frame: pd.DataFrame) -> pd.DataFrame:
        # thinned groups: each already lists its hull, in order
        names, points = frame[key].to_numpy(), frame[["x", "y"]].to_numpy(float)
        starts = np.r_[0, np.flatnonzero(names[1:] != names[:-1]) + 1]
        closed = [widen(hull, margin) for hull in np.split(points, starts[1:])]
        return pd.DataFrame({key: names[starts], "xs": [r[:, 0] for r in closed], "ys": [r[:, 1] for r in closed]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry: pd.DataFrame | None = None
        for frame in frames:
            if not len(frame):
                continue
            open_key = frame[key].iloc[-1]
            if carry is not None:
                frame = pd.concat([carry, frame])
            thinned = _thin(frame, key)
            is_open = thinned[key] == open_key
            carry = thinned[is_open]
            if not is_open.all():
                yield rings(thinned[~is_open])
        if carry is not None:
            yield rings(carry)

    return run


def hull_rings(points: DataFrame, key: str, margin_m: float) -> DataFrame:
    """(key, x, y) points -> (key, ring) with ring an array of struct(x, y).

    Points without two finite coordinates do not count; a key with no others has no row.
    """
    placed = "abs(x) < double('Infinity') AND abs(y) < double('Infinity')"  # NaN is beyond infinity
    slim = points.filter(placed).select(F.col(key).cast("string").alias(key), "x", "y")
    thinned = slim.mapInPandas(_partial(key), f"{key} string, x double, y double")
    # a given number of partitions: the rows are few, but each group is work for Python
    partitions = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = thinned.repartition(partitions, key).sortWithinPartitions(key)
    rings = ordered.mapInPandas(_finish(key, margin_m), f"{key} string, xs array<double>, ys array<double>")
    return rings.select(
        key,
        F.zip_with("xs", "ys", lambda x, y: F.struct(x.alias("x"), y.alias("y"))).alias("ring"))
