"""Column functions of lattices: rectangular and hexagonal bins, tiles, bilinear and linear interpolation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect_bin(x: Column, width: float) -> Column:
    """Index of the bin of a rectangular lattice whose edges are multiples of the width."""
    return F.floor(x / F.lit(float(width))).cast("long")


def _hex_steps(a: float, b: float) -> tuple[float, float]:
    return a / 2.0, 2.0 * b / math.sqrt(3.0) / 2.0


def to_hex(x: Column, y: Column, a: float, b: float | None = None) -> tuple[Column, Column]:
    """Integer coordinates of the hexagon (width a, and b across for stretched ones) that holds a point."""
    r, s = _hex_steps(a, a if b is None else b)
    s = 2 * s
    half, across = x / F.lit(2 * r), y / F.lit(s)
    hx = F.floor((F.floor(half - across) + F.floor(x / F.lit(r)) + 2) / F.lit(3.0))
    hy = F.floor((F.floor(half + across) + F.floor(across - half) + 2) / F.lit(3.0))
    return hx.cast("long"), hy.cast("long")


def from_hex(hx: Column, hy: Column, a: float, b: float | None = None) -> tuple[Column, Column]:
    """Centre of a hexagon."""
    r, s = _hex_steps(a, a if b is None else b)
    return hx * F.lit(2 * r) + hy * F.lit(r), hy * F.lit(1.5 * 2 * s)


def hex_corners(x: Column, y: Column, a: float, scale: Column | None = None) -> Column:
    """The six corners of a hexagon around a centre, as an array of (k, x, y); scale shrinks it."""
    radius = F.lit(a / math.sqrt(3.0)) * (scale if scale is not None else F.lit(1.0))

    def corner(k: Column) -> Column:
        angle = F.radians(k * F.lit(60.0) + F.lit(30.0))
        return F.struct(k.alias("k"), (x + radius * F.cos(angle)).alias("x"), (y + radius * F.sin(angle)).alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(5)), corner)


def tile_range(low: Column, extent: Column, tile: int) -> tuple[Column, Column]:
    """First and last tile (from 0) that a span of pixels (from 1) touches: ceil(low / tile) - 1 and ceil((low + extent) / tile) - 1."""
    return (F.ceil(low / F.lit(float(tile))) - 1).cast("long"), (F.ceil((low + extent) / F.lit(float(tile))) - 1).cast("long")


def position(x: Column, first: float, step: float) -> Column:
    """Fractional place of x among nodes first, first + step, ..."""
    return (x - F.lit(float(first))) / F.lit(float(step))


def clamped_cell(at: Column, nodes: int) -> tuple[Column, Column]:
    """Lower node and weight of the upper one; outside the nodes the nearest node has all the weight."""
    inside = F.least(F.greatest(at, F.lit(0.0)), F.lit(float(nodes - 1)))
    low = F.least(F.floor(inside), F.lit(max(0, nodes - 2))).cast("int")
    return low, inside - low


def blend(nw: Column, ne: Column, sw: Column, se: Column, fx: Column, fy: Column) -> Column:
    """Bilinear blend of four corners."""
    top = nw + fx * (ne - nw)
    return top + fy * (sw + fx * (se - sw) - top)


def linear(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Line through two points at x, also beyond them; the first value where both coincide."""
    return F.when(x1 == x0, y0).otherwise(y0 + (x - x0) * (y1 - y0) / F.nullif(x1 - x0, F.lit(0.0)))


def in_polygon(x: Column, y: Column, vertices: list[tuple[float, float]]) -> Column:
    """Even-odd test: an odd number of edges crosses the ray to the right of the point."""
    crossings = F.lit(0)
    for (x0, y0), (x1, y1) in zip(vertices, vertices[1:] + vertices[:1]):
        if y0 != y1:
            straddles = (F.lit(float(y0)) > y) != (F.lit(float(y1)) > y)
            meets = x < F.lit(float(x1 - x0)) * (y - F.lit(float(y0))) / F.lit(float(y1 - y0)) + F.lit(float(x0))
            crossings = crossings + (straddles & meets).cast("int")
    return crossings % 2 == 1
