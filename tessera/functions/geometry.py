"""Quads of four points (struct x, y, from 0 to 1) and plane transforms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

QUAD = "array<struct<x:double,y:double>>"


def shoelace(quad: Column) -> Column:
    """Twice the signed area."""
    return sum(quad[i]["x"] * quad[(i + 1) % 4]["y"] - quad[(i + 1) % 4]["x"] * quad[i]["y"] for i in range(4))


def quad_area(quad: Column) -> Column:
    return F.abs(shoelace(quad)) * 0.5


def usable_quad(quad: Column) -> Column:
    """Four separate corners around a convex area of 0.01 or more."""
    area = quad_area(quad)
    near = F.lit(False)
    for i in range(4):
        for j in range(i + 1, 4):
            near = near | (F.pow(quad[i]["x"] - quad[j]["x"], 2) + F.pow(quad[i]["y"] - quad[j]["y"], 2) < 0.0004)

    def cross(i: int) -> Column:
        p, c, n = quad[(i + 3) % 4], quad[i], quad[(i + 1) % 4]
        return (c["x"] - p["x"]) * (n["y"] - c["y"]) - (c["y"] - p["y"]) * (n["x"] - c["x"])

    turns = [cross(i) for i in range(4)]
    left, right = F.lit(False), F.lit(False)
    for t in turns:
        left, right = left | (t > 0), right | (t < 0)
    fine = ~F.isnan(area) & (area >= 0.01) & (area < F.lit(float("inf"))) & ~near & ~(left & right)
    return F.coalesce((F.size(quad) == 4) & fine, F.lit(False))


def shortest_edge_top(quad: Column, width: Column, height: Column) -> Column:
    """The corners turned so that the first shortest edge comes first."""
    edges = F.array(*[F.hypot((quad[i]["x"] - quad[(i + 1) % 4]["x"]) * width, (quad[i]["y"] - quad[(i + 1) % 4]["y"]) * height) for i in range(4)])
    first = F.array_position(edges, F.array_min(edges)).cast("int")
    return F.concat(F.slice(quad, first, F.lit(4)), F.slice(quad, F.lit(1), first - 1))


def ordered_corners(quad: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """Clockwise (y pointing down) from the corner with the least x + y; with a frame's width and height, from the
    first shortest edge in pixels instead, as a card's top edge is."""
    cx, cy = (sum(quad[i][c] for i in range(4)) / 4 for c in "xy")
    keyed = F.transform(quad, lambda p, i: F.struct(F.atan2(p["y"] - cy, p["x"] - cx).alias("a"), i.alias("i"), p.alias("p")))
    by_angle = F.transform(F.array_sort(keyed), lambda k: k["p"])

    def from_least(q: Column) -> Column:
        sums = F.transform(q, lambda p: p["x"] + p["y"])
        first = F.array_position(sums, F.array_min(sums)).cast("int")
        return F.concat(F.slice(q, first, F.lit(4)), F.slice(q, F.lit(1), first - 1))

    steps = [from_least, lambda q: F.when(shoelace(q) < 0, F.array(*[q[i] for i in (0, 3, 2, 1)])).otherwise(q)]
    if width is not None and height is not None:
        steps.append(lambda q: shortest_edge_top(q, width, height))
    out = F.array(by_angle)  # of one quad: a lambda binds what several uses of an expression would compute again
    for step in steps:
        out = F.transform(out, step)
    return out[0]


def homographies(source: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of targets (n x 4 x 2) the nine numbers that map the four source points to it, the last of them 1, and which
    of them hold: those of degenerate points are zeros."""
    (x, y), (u, v) = np.asarray(source, dtype=np.float64).T, np.moveaxis(np.asarray(targets, dtype=np.float64), 2, 0)
    no, one = np.zeros_like(u), np.ones_like(u)
    x, y = x * one, y * one
    a = np.stack([np.stack([x, y, one, no, no, no, -u * x, -u * y], axis=2), np.stack([no, no, no, x, y, one, -v * x, -v * y], axis=2)], axis=2)
    a, b = a.reshape(-1, 8, 8), np.stack([u, v], axis=2).reshape(-1, 8)
    fine = np.isfinite(a).all(axis=(1, 2)) & np.isfinite(b).all(axis=1)
    fine[fine] = np.linalg.matrix_rank(a[fine]) == 8
    out = np.zeros((len(a), 9))
    out[fine, :8], out[fine, 8] = np.linalg.solve(a[fine], b[fine][..., None])[..., 0], 1.0
    return out, fine


def solve_homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The nine numbers that map four source points to four target points; the last is 1. Raises for degenerate points."""
    maps, fine = homographies(source, np.asarray(target, dtype=np.float64)[None])
    if not fine[0]:
        raise ValueError("degenerate points")
    return maps[0]


@F.pandas_udf(ArrayType(DoubleType()))
def homography(source: pd.Series, target: pd.Series) -> pd.Series:
    """Nine numbers for two columns of quads; null for degenerate ones."""

    def one(a, b):
        try:
            return solve_homography([(p["x"], p["y"]) for p in a], [(p["x"], p["y"]) for p in b])
        except (ValueError, TypeError, np.linalg.LinAlgError):
            return None

    return pd.Series([one(a, b) for a, b in zip(source, target, strict=True)], dtype=object)


def apply_homography(h: Column, x: Column, y: Column) -> Column:
    w = h[6] * x + h[7] * y + h[8]
    return F.struct(((h[0] * x + h[1] * y + h[2]) / w).alias("x"), ((h[3] * x + h[4] * y + h[5]) / w).alias("y"))


def frame_rejection(present: Column, quad: Column, min_area: float = 0.1) -> Column:
    """Why a frame is not worth reading, the first reason that holds; null if it is."""
    return F.when(~present, "no-card").when(~usable_quad(quad), "bad-quad").when(quad_area(quad) < min_area, "too-small")


def detection(corners: Column, presence: Column, sharpness: Column, width: Column, height: Column, min_card: float = 0.03, min_presence: float = 0.35) -> Column:
    """struct(corners, confidence, card_present) of a detector's outputs: eight corner numbers and two heads.

    Corners begin with the shortest edge in a frame of that width and height.
    """
    from .vector import clamp01, sigmoid

    points = F.array(*[F.struct(clamp01(corners[2 * i]).alias("x"), clamp01(corners[2 * i + 1]).alias("y")) for i in range(4)])
    confidence = F.coalesce(sharpness, sigmoid(presence))
    floor = F.when(sharpness.isNotNull(), min_card).otherwise(min_presence)
    return F.struct(ordered_corners(points, width, height).alias("corners"), confidence.alias("confidence"), (confidence >= floor).alias("card_present"))
