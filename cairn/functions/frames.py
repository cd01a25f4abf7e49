"""Coordinate frames as Column expressions: geodetic, spherical Mercator, work frame, Lambert-93."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The frames' constants.
MERC_RADIUS = 6378137.0
WMQ_EXTENT = 20037508.342789244
LAT_REF = 45.5
GRS80_A = 6378137.0
GRS80_INV_F = 298.257222101
L93_LAT0, L93_LON0, L93_LAT1, L93_LAT2 = 46.5, 3.0, 49.0, 44.0
L93_X0, L93_Y0 = 700000.0, 6600000.0
CELL_LEVEL, LOD_LEVEL0, COARSE_BASE_DEPTH = 11, 15, 6

WORK_SCALE = 1 / math.cos(math.radians(LAT_REF))
WORK_EXTENT = WMQ_EXTENT / WORK_SCALE


def check_levels(cell_level: int = CELL_LEVEL, lod_level0: int = LOD_LEVEL0) -> None:
    if not cell_level < lod_level0:
        raise ValueError("cell_level must be coarser than lod_level0")


check_levels()


def _lcc() -> tuple[float, float, float, float]:
    """Eccentricity, cone constant, scale and polar radius of the Lambert conformal cone with two parallels."""
    f = 1 / GRS80_INV_F
    e = math.sqrt(2 * f - f * f)
    m = lambda lat: math.cos(lat) / math.sqrt(1 - (e * math.sin(lat)) ** 2)
    t = lambda lat: math.tan(math.pi / 4 - lat / 2) / ((1 - e * math.sin(lat)) / (1 + e * math.sin(lat))) ** (e / 2)
    p1, p2, p0 = (math.radians(v) for v in (L93_LAT1, L93_LAT2, L93_LAT0))
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    scale = GRS80_A * m(p1) / (n * t(p1) ** n)
    return e, n, scale, scale * t(p0) ** n


LCC_E, LCC_N, LCC_C, LCC_RHO0 = _lcc()


def geodetic_to_work(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.lit(MERC_RADIUS) * F.radians(lon) / WORK_SCALE, F.lit(MERC_RADIUS) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) / WORK_SCALE


def work_to_geodetic(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x * WORK_SCALE / MERC_RADIUS), F.degrees(2 * F.atan(F.exp(y * WORK_SCALE / MERC_RADIUS)) - math.pi / 2)


def geodetic_to_l93(lon: Column, lat: Column) -> tuple[Column, Column]:
    phi = F.radians(lat)
    s = LCC_E * F.sin(phi)
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(LCC_E / 2))
    rho, theta = LCC_C * F.pow(t, F.lit(LCC_N)), LCC_N * F.radians(lon - L93_LON0)
    return L93_X0 + rho * F.sin(theta), L93_Y0 + LCC_RHO0 - rho * F.cos(theta)


def l93_to_geodetic(x: Column, y: Column, rounds: int = 8) -> tuple[Column, Column]:
    """The latitude's fixed point is reached in ``rounds`` steps, folded over a sequence so that the plan stays small."""
    dx, dy = x - L93_X0, L93_RHO(y)
    rho = F.sqrt(dx * dx + dy * dy)
    t = F.pow(rho / LCC_C, F.lit(1 / LCC_N))
    step = lambda phi, _: F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - LCC_E * F.sin(phi)) / (1 + LCC_E * F.sin(phi)), F.lit(LCC_E / 2)))
    phi = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.lit(math.pi / 2) - 2 * F.atan(t), step)
    return L93_LON0 + F.degrees(F.atan2(dx, dy) / LCC_N), F.degrees(phi)


def L93_RHO(y: Column) -> Column:  # noqa: N802
    return L93_Y0 + LCC_RHO0 - y


_TO_GEODETIC = {"geodetic": lambda x, y: (x, y), "work": work_to_geodetic, "l93": l93_to_geodetic}
_FROM_GEODETIC = {"geodetic": lambda x, y: (x, y), "work": geodetic_to_work, "l93": geodetic_to_l93}


def convert(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    """Any frame to any other through geodetic; heights never change."""
    if source == target:
        return x, y
    return _FROM_GEODETIC[target](*_TO_GEODETIC[source](x, y))


def work_tile_size(level: int) -> float:
    return 2 * WORK_EXTENT / 2**level


def work_tile_of(x: Column, y: Column, level: int) -> tuple[Column, Column]:
    size = work_tile_size(level)
    return F.floor((x + WORK_EXTENT) / size).cast("long"), F.floor((WORK_EXTENT - y) / size).cast("long")


def work_tile_bounds(tx: Column, ty: Column, level: int) -> tuple[Column, Column, Column, Column]:
    """x0, y0, x1, y1 of a tile; rows grow southward."""
    size = work_tile_size(level)
    x0, y1 = tx * size - WORK_EXTENT, WORK_EXTENT - ty * size
    return x0, y1 - size, x0 + size, y1


def mercator_bounds(z: Column, x: Column, y: Column) -> tuple[Column, Column, Column]:
    """Lower-left corner and side of a tile in plain spherical Mercator metres."""
    s = F.lit(2 * WMQ_EXTENT) / F.pow(F.lit(2.0), z)
    return x * s - WMQ_EXTENT, WMQ_EXTENT - (y + 1) * s, s


def local_from_work(x: Column, y: Column, origin: tuple[float, float]) -> tuple[Column, Column]:
    return x - origin[0], y - origin[1]
