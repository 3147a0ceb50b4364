"""Geometric measures of boxes, as column expressions. y grows downwards, depth grows away from the camera."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-9


def num(x: float) -> Column:
    """A double: bare decimals in SQL would be decimals."""
    return F.lit(float(x))


@dataclass(frozen=True)
class Box:
    """The four sides of a box, as columns."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")))

    @property
    def area(self) -> Column:
        return (self.x2 - self.x1) * (self.y2 - self.y1)


def box_from_1024(xc: Column, yc: Column, w: Column, h: Column, width: Column, height: Column) -> Box:
    """Sides, as shares of the image, of a centre-form box of an image resized to 1024 on its longer side."""
    scale = num(1024) / F.greatest(width, height)

    def unit(v: Column, size: Column) -> Column:
        return F.least(num(1), F.greatest(num(0), v / (size * scale)))

    return Box(unit(xc - w / 2, width), unit(yc - h / 2, height), unit(xc + w / 2, width), unit(yc + h / 2, height))


def center_form(b: Box, width: Column, height: Column, longest: int) -> tuple[Column, ...]:
    """Centre, width and height in pixels of an image resized to `longest`, rounded half to even."""
    scale = num(longest) / F.greatest(width, height)
    return tuple(F.bround(v, 0).cast("int") for v in ((b.x1 + b.x2) / 2 * width * scale, (b.y1 + b.y2) / 2 * height * scale, (b.x2 - b.x1) * width * scale, (b.y2 - b.y1) * height * scale))


def shared_width(a: Box, b: Box) -> Column:
    return F.greatest(num(0), F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1))


def x_extent_overlap(a: Box, b: Box) -> Column:
    """Shared horizontal extent over that of the narrower box."""
    return shared_width(a, b) / F.greatest(num(TINY), F.least(a.x2 - a.x1, b.x2 - b.x1))


def vertical_gap(top: Box, bottom: Box) -> Column:
    return bottom.y1 - top.y2


def _apart(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    return F.greatest(num(0), F.greatest(lo_a, lo_b) - F.least(hi_a, hi_b))


def box_gap_rel(a: Box, b: Box) -> Column:
    """Euclidean gap between boxes over the mean of the square roots of their areas."""
    gx, gy = _apart(a.x1, a.x2, b.x1, b.x2), _apart(a.y1, a.y2, b.y1, b.y2)
    return F.sqrt(gx * gx + gy * gy) / ((F.sqrt(F.greatest(num(TINY), a.area)) + F.sqrt(F.greatest(num(TINY), b.area))) / 2)


def distance_3d(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column, z_scale: float = 1.0) -> Column:
    dx, dy, dz = ax - bx, ay - by, (az - bz) * num(z_scale)
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def intersection(a: Box, b: Box) -> Column:
    return shared_width(a, b) * F.greatest(num(0), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, 0 for an empty union."""
    both = intersection(a, b)
    union = a.area + b.area - both
    return F.when(union <= 0, num(0)).otherwise(both / union)


def overlap_frac(a: Box, b: Box) -> Column:
    """Share of a that b covers."""
    return F.when(a.area <= 0, num(0)).otherwise(intersection(a, b) / a.area)


def drop_fraction(a: Box, b: Box) -> Column:
    """How deep a's bottom lies in b's height; null for a flat b."""
    return F.when(b.y2 - b.y1 > 0, (a.y2 - b.y1) / (b.y2 - b.y1))


def clipped(b: Box, width: Column, height: Column) -> Box:
    inside = lambda v, most: F.least(most, F.greatest(num(0), v))
    return Box(inside(b.x1, width), inside(b.y1, height), inside(b.x2, width), inside(b.y2, height))


def pixels(b: Box, width: Column, height: Column) -> Box:
    return Box(b.x1 * width, b.y1 * height, b.x2 * width, b.y2 * height)


def rect_contact(a: Box, b: Box, band: float = 0.01) -> Column:
    """Contact of filled boxes in closed form: the share of a's bottom edge that has b below it within the band."""
    below = (b.y1 <= a.y2 + num(band)) & (a.y2 < b.y2)
    return F.when(below, shared_width(a, b) / (a.x2 - a.x1)).otherwise(num(0))


def face_region(b: Box, width: Column, height: Column, pad_x: int = 5, pad_y: int = 8) -> Box:
    """The top 30 % of a person's box in pixels, padded and clipped."""
    p = pixels(b, width, height)
    return clipped(Box(p.x1 - pad_x, p.y1 - pad_y, p.x2 + pad_x, p.y1 + num(0.3) * (p.y2 - p.y1) + pad_y), width, height)


def pair_features(p: str = "a_", q: str = "b_", contact_ab: str = "c_ab", contact_ba: str = "c_ba") -> list[Column]:
    """The 17 numbers by which a classifier sees an ordered pair."""
    a, b = Box.of(p), Box.of(q)
    dx, dy, dz = (F.col(q + c) - F.col(p + c) for c in ("cx", "cy", "depth"))
    named = {
        "dx": dx, "dy": dy, "dz": dz, "abs_dz": F.abs(dz),
        "w_a": a.x2 - a.x1, "h_a": a.y2 - a.y1, "w_b": b.x2 - b.x1, "h_b": b.y2 - b.y1,
        "area_a": a.area, "area_b": b.area,
        "x_overlap": x_extent_overlap(a, b), "gap_ab": vertical_gap(a, b), "gap_ba": vertical_gap(b, a), "gap_rel": box_gap_rel(a, b),
        "contact_ab": F.col(contact_ab), "contact_ba": F.col(contact_ba),
        "dist": distance_3d(*(F.col(p + c) for c in ("cx", "cy", "depth")), *(F.col(q + c) for c in ("cx", "cy", "depth"))),
    }
    return [v.alias(k) for k, v in named.items()]
