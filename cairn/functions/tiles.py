"""Quadtree tile maths as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.frames import CELL_LEVEL


def tile_xy(lon: Column, lat: Column, level: int) -> tuple[Column, Column]:
    """Fractional tile coordinates of a geodetic point."""
    n = float(1 << level)
    s = F.sin(F.radians(lat))
    return (lon + 180.0) / 360.0 * n, (F.lit(0.5) - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * n


def tile_lonlat(x: Column, y: Column, level: int) -> tuple[Column, Column]:
    """North-west corner of a tile."""
    n = float(1 << level)
    return x / n * 360.0 - 180.0, F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / n))))


def tile_bounds(x: Column, y: Column, level: int) -> Column:
    west, north = tile_lonlat(x, y, level)
    east, south = tile_lonlat(x + 1, y + 1, level)
    return F.struct(west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north"))


def clamp(v: Column, n: int) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(F.lit(n - 1).cast("long"), v.cast("long")))


def tile_range(lon0: Column, lat0: Column, lon1: Column, lat1: Column, level: int, upper: str = "ceil") -> tuple[Column, Column, Column, Column]:
    """First and last tile column and row of a rectangle, clamped to the level; the upper edge is ``ceil - 1``, or the
    tile that holds it with upper="floor"."""
    n = 1 << level
    x0, y0 = tile_xy(F.least(lon0, lon1), F.greatest(lat0, lat1), level)
    x1, y1 = tile_xy(F.greatest(lon0, lon1), F.least(lat0, lat1), level)
    last = (lambda v: F.ceil(v) - 1) if upper == "ceil" else F.floor
    return clamp(F.floor(x0), n), clamp(last(x1), n), clamp(F.floor(y0), n), clamp(last(y1), n)


def explode_tiles(df: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column, x: str = "x", y: str = "y") -> DataFrame:
    """One row for each tile of each row's range; a range that is empty gives none."""
    steps = lambda a, b: F.when(b >= a, F.sequence(a, b))
    return df.withColumn(x, F.explode(steps(x0, x1))).withColumn(y, F.explode(steps(y0, y1)))


def tiles_in_rect(df: DataFrame, lon0: Column, lat0: Column, lon1: Column, lat1: Column, level: int) -> DataFrame:
    return explode_tiles(df, *tile_range(lon0, lat0, lon1, lat1, level))


def tiles_in_rect_aligned(df: DataFrame, lon0: Column, lat0: Column, lon1: Column, lat1: Column, level: int, align_level: int) -> DataFrame:
    """All tiles at ``level`` under every tile at the coarser ``align_level`` that the rectangle touches."""
    n = 1 << (level - align_level)
    coarse = explode_tiles(df, *tile_range(lon0, lat0, lon1, lat1, align_level), "_cx", "_cy")
    span = F.sequence(F.lit(0), F.lit(n - 1))
    inner = coarse.withColumn("_dx", F.explode(span)).withColumn("_dy", F.explode(span))
    return inner.withColumn("x", F.col("_cx") * n + F.col("_dx")).withColumn("y", F.col("_cy") * n + F.col("_dy")).drop("_cx", "_cy", "_dx", "_dy")


def cell_of(x: Column, y: Column, level: Column | int) -> tuple[Column, Column]:
    shift = F.lit(level - CELL_LEVEL) if isinstance(level, int) else (level - CELL_LEVEL).cast("int")
    return F.call_function("shiftright", x, shift), F.call_function("shiftright", y, shift)


def tile_path(x: Column, y: Column, level: Column) -> Column:
    """``cx.cy/shift/lx.ly.glb``: tiles lie under their cell, by level and place within it."""
    shift = level - CELL_LEVEL
    n = F.pow(F.lit(2), shift).cast("long")
    cx, cy = cell_of(x, y, level)
    text = lambda c: c.cast("string")
    return F.concat(text(cx), F.lit("."), text(cy), F.lit("/"), text(shift), F.lit("/"), text(F.pmod(x, n)), F.lit("."), text(F.pmod(y, n)), F.lit(".glb"))


TILE_PATH = r"^([0-9]+)\.([0-9]+)/([0-9]+)/([0-9]+)\.([0-9]+)\.glb$"


def parse_tile_path(path: Column) -> tuple[Column, Column, Column]:
    """level, x, y of a stored tile; nulls where the path has another form."""
    part = lambda k: F.nullif(F.regexp_extract(path, TILE_PATH, k), F.lit("")).cast("long")
    shift = part(3)
    n = F.pow(F.lit(2), shift).cast("long")
    return shift + CELL_LEVEL, part(1) * n + part(4), part(2) * n + part(5)


def imagery_tile(source: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """The imagery tile for a terrain tile: one level up, at most 18 for ortho and 17 for others."""
    level = F.least(z - 1, F.when(source == "ortho", 18).otherwise(17))
    d = F.pow(F.lit(2), z - level).cast("long")
    return level, F.floor(x / d).cast("long"), F.floor(y / d).cast("long")


def demorton(code: Column, bits: int = 16) -> tuple[Column, Column]:
    """x from the even bits of ``code``, y from the odd ones."""
    places = F.sequence(F.lit(0), F.lit(bits - 1))
    bit = lambda k, odd: F.call_function("shiftleft", F.call_function("shiftright", code, (2 * k + odd).cast("int")).bitwiseAND(F.lit(1)).cast("long"), k.cast("int"))
    take = lambda odd: F.aggregate(places, F.lit(0).cast("long"), lambda a, k: a + bit(k, odd))
    return take(0), take(1)


def morton(x: Column, y: Column, bits: int = 16) -> Column:
    places = F.sequence(F.lit(0), F.lit(bits - 1))
    bit = lambda v, k, odd: F.call_function("shiftleft", F.call_function("shiftright", v.cast("long"), k.cast("int")).bitwiseAND(F.lit(1)).cast("long"), (2 * k + odd).cast("int"))
    return F.aggregate(places, F.lit(0).cast("long"), lambda a, k: a + bit(x, k, 0) + bit(y, k, 1))


def world_pixel(lon: Column, lat: Column, zoom: int, side: int = 256) -> tuple[Column, Column]:
    x, y = tile_xy(lon, lat, zoom)
    return x * side, y * side


def best_fit_zoom(lon0: Column, lat0: Column, lon1: Column, lat1: Column, width: int, height: int, lowest: int = 3, highest: int = 18) -> Column:
    """The highest zoom at which the box fits the viewport, or the lowest."""
    best = F.lit(lowest)
    for z in range(lowest, highest + 1):
        x0, y0 = world_pixel(lon0, lat1, z)
        x1, y1 = world_pixel(lon1, lat0, z)
        best = F.when((x1 - x0 <= width) & (y1 - y0 <= height), F.lit(z)).otherwise(best)
    return best


def km_cell_of_stem(stem: Column) -> tuple[Column, Column]:
    """A file's ``x_y`` names its north-west corner in km; the cell's own row is one further south."""
    parts = F.split(F.regexp_extract(stem, r"([0-9]{4}_[0-9]{4})", 1), "_")
    return parts[0].cast("long"), parts[1].cast("long") - 1


def stem_of_km_cell(x_km: Column, y_km: Column) -> Column:
    return F.concat(F.lpad(x_km.cast("string"), 4, "0"), F.lit("_"), F.lpad((y_km + 1).cast("string"), 4, "0"))


def pad_to_aspect(x0: Column, y0: Column, x1: Column, y1: Column, aspect: float) -> tuple[Column, Column, Column, Column]:
    """The box grown about its middle, in one direction, to width / height = ``aspect``."""
    w, h = x1 - x0, y1 - y0
    dx = F.when(w < h * aspect, (h * aspect - w) / 2).otherwise(0.0)
    dy = F.when(w > h * aspect, (w / aspect - h) / 2).otherwise(0.0)
    return x0 - dx, y0 - dy, x1 + dx, y1 + dy
