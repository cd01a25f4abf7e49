"""Vector, box, triangle and colour expressions over Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def sub(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Vec) -> Vec:
    """Unit vector; the zero vector stays zero."""
    n = length(a)
    return tuple(F.when(n > 0, c / n).otherwise(F.lit(0.0)) for c in a)


def box_union(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    """Boxes are (x0, y0, x1, y1)."""
    return F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])


def box_intersection(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    return F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])


def box_empty(a: tuple[Column, ...]) -> Column:
    return (a[0] > a[2]) | (a[1] > a[3])


def boxes_overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Overlap with an area: boxes that only touch don't count."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def segment_hits_box(ax: Column, ay: Column, bx: Column, by: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Slab test of a closed segment against a closed box: the parameter ranges of both slabs meet within [0, 1]."""

    def slab(a: Column, b: Column, low: Column, high: Column) -> tuple[Column, Column, Column]:
        d = b - a
        flat = d == 0
        u, v = (low - a) / F.nullif(d, F.lit(0.0)), (high - a) / F.nullif(d, F.lit(0.0))
        return F.when(flat, F.lit(0.0)).otherwise(F.least(u, v)), F.when(flat, F.lit(1.0)).otherwise(F.greatest(u, v)), ~flat | ((a >= low) & (a <= high))

    ux, vx, okx = slab(ax, bx, x0, x1)
    uy, vy, oky = slab(ay, by, y0, y1)
    return okx & oky & (F.greatest(ux, uy, F.lit(0.0)) <= F.least(vx, vy, F.lit(1.0)))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def smoothstep(low: float, high: float, v: Column) -> Column:
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - low) / (high - low)))
    return t * t * (3 - 2 * t)


def sun_direction(altitude: Column, azimuth: Column) -> Vec:
    """Unit vector to the sun from altitude and azimuth in degrees; x east, y north, z up."""
    h, a = F.radians(altitude), F.radians(azimuth)
    return F.cos(h) * F.sin(a), F.cos(h) * F.cos(a), F.sin(h)


def representative_angle(low: Column, high: Column) -> Column:
    """Half-way in a narrow range; else 0 if the range less 5 degrees at each end holds it, or the end nearer to 0."""
    a, b = low + 5, high - 5
    half = F.call_function("div", low + high, F.lit(2))
    return F.when(high - low <= 10, half).when((a <= 0) & (b >= 0), F.lit(0).cast("long")).when(a >= 0, a.cast("long")).otherwise(b.cast("long"))


def heightfield_normal(west: Column, east: Column, south: Column, north: Column, step: float) -> Vec:
    """Normal of a regular grid from the four neighbours' heights; null if any is missing."""
    return normalize(((west - east) / (2 * step), (south - north) / (2 * step), F.lit(1.0) + 0 * (west + east + south + north)))
