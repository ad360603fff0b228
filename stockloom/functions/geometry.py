"""Scalar geometry on boxes, quads and transforms; expressions only, so that they stay inside code generation; areas of polygons are in ``polygons``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockloom.functions.polygons import shared_area

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


def centre(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a: Box, b: Box) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; the union is at least 1e-9."""
    both = intersection(a, b)
    return both / F.greatest(area(a) + area(b) - both, F.lit(1e-9))


def coverage(inner: Box, outer: Box) -> Column:
    """Share of ``inner`` that ``outer`` covers."""
    return intersection(inner, outer) / F.greatest(area(inner), F.lit(1e-9))


def touches_border(b: Box, width: Column, height: Column, margin: Column) -> Column:
    return (b[0] <= margin) | (b[1] <= margin) | (b[2] >= width - margin) | (b[3] >= height - margin)


def view_status(b: Box, width: Column, height: Column, margin: Column, band: Column) -> Column:
    """``cut`` at the image border, ``inner`` with its centre inside the band (inclusive), else ``band``."""
    cx, cy = centre(b)
    inside = cx.between(band, width - band) & cy.between(band, height - band)
    return F.when(touches_border(b, width, height, margin), "cut").when(inside, "inner").otherwise("band")


def clip(b: Box, width: Column, height: Column) -> Box:
    zero = F.lit(0.0)
    return F.greatest(b[0], zero), F.greatest(b[1], zero), F.least(b[2], width), F.least(b[3], height)


def visible(b: Box, width: Column, height: Column, least: float = 2.0) -> Column:
    """Wider and taller than ``least`` after clipping."""
    c = clip(b, width, height)
    return (c[2] - c[0] > least) & (c[3] - c[1] > least)


def warp_point(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point under a 3 x 3 transform in row order."""
    w = h[6] * x + h[7] * y + h[8]
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def warp_box(h: Column, b: Box) -> Box:
    """The axis-aligned hull of the four warped corners."""
    xs, ys = zip(*(warp_point(h, x, y) for x, y in ((b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3]))), strict=True)
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def affine_box(m: Column, b: Box) -> Box:
    """As ``warp_box`` for the six numbers of an affine transform."""
    xs, ys = zip(*((m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]) for x, y in ((b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3]))), strict=True)
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def in_rect(x: Column, y: Column, r: Box) -> Column:
    return x.between(r[0], r[2]) & y.between(r[1], r[3])


def in_convex(x: Column, y: Column, quad: list[tuple[Column, Column]]) -> Column:
    """Inside a convex polygon or on its border, whatever its direction."""
    signs = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for (ax, ay), (bx, by) in zip(quad, quad[1:] + quad[:1], strict=True)]
    ge, le = signs[0] >= 0, signs[0] <= 0
    for s in signs[1:]:
        ge, le = ge & (s >= 0), le & (s <= 0)
    return ge | le


def view_advance(dx: Column, dy: Column, width: Column, height: Column) -> Column:
    """The share of the view that a shift has replaced: one less the overlap."""
    one, zero = F.lit(1.0), F.lit(0.0)
    return one - F.greatest(zero, one - F.abs(dx) / width) * F.greatest(zero, one - F.abs(dy) / height)


def angular_speed(px: Column, focal: Column, dt: Column, frame_time: Column) -> Column:
    """Degrees a second of a displacement; lost tracking (null or NaN) is infinitely fast; ``dt <= 0`` counts as one frame."""
    step = F.when(dt > 0, dt).otherwise(frame_time)
    return F.when(px.isNull() | F.isnan(px), F.lit(float("inf"))).otherwise(F.degrees(F.atan(px / focal)) / step)


def plausible_registration(inliers: Column, good: Column, convex: Column, area_ratio: Column, overlap: Column, cover: Column) -> Column:
    return (inliers >= 40) & (inliers >= 0.25 * good) & convex & (area_ratio > 0.2) & (area_ratio < 5) & (overlap >= 0.03) & (cover >= 0.08)


def plausible_fit(a: Column, b: Column) -> Column:
    """Scale within (2/3, 1.5) and rotation under 0.26 rad of a similarity with first column (a, b)."""
    scale = F.hypot(a, b)
    return (scale > 2 / 3) & (scale < 1.5) & (F.abs(F.atan2(b, a)) < 0.26)


def convex_overlap(a: list[tuple[Column, Column]], b: list[tuple[Column, Column]]) -> Column:
    """The area that two convex quads share."""
    return shared_area(a, b)
