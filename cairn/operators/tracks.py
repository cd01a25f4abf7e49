"""Tracks of points: distances, interpolation, smoothing, decluttering."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from cairn.operators.ordered import scan_in_order


def cumulative_distance(points: DataFrame, key: str, order: list[str], x: str, y: str) -> DataFrame:
    """``dist``: plan distance along each track up to each point."""
    w = Window.partitionBy(key).orderBy(*order)
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    step = F.coalesce(F.sqrt((dx * dx + dy * dy).cast("double")), F.lit(0.0))
    return points.withColumn("_step", step).withColumn("dist", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def point_at(measured: DataFrame, asked: DataFrame, key: str, coordinates: list[str]) -> DataFrame:
    """Positions at distances ``d``: asked (key, d) to key, d and interpolated coordinates, clamped to the track's ends.

    Segments are half-open ranges of distance, so a distance is in one; joined by track.
    """
    w = Window.partitionBy(key).orderBy("dist")
    ahead = {f"_{c}": F.lead(c).over(w) for c in [*coordinates, "dist"]}
    bounds = measured.groupBy(key).agg(F.min("dist").alias("_low"), F.max("dist").alias("_high"))
    q = asked.join(bounds, key).withColumn("_at", F.least(F.greatest(F.col("d"), F.col("_low")), F.col("_high")))
    segments = measured.withColumns(ahead)
    inside = (F.col("_at") >= F.col("dist")) & (F.col("_dist").isNull() | (F.col("_at") < F.col("_dist")))
    found = q.join(segments, key).where(inside & ((F.col("_dist").isNull() & (F.col("_at") == F.col("dist"))) | (F.col("_dist") > F.col("dist"))))
    t = F.coalesce((F.col("_at") - F.col("dist")) / (F.col("_dist") - F.col("dist")), F.lit(0.0))
    return found.select(key, "d", *[(F.col(c) + (F.coalesce(F.col(f"_{c}"), F.col(c)) - F.col(c)) * t).alias(c) for c in coordinates]).dropDuplicates([key, "d"])


def exponential_smooth(points: DataFrame, key: str, order: list[str], value: str, seconds: Column, tau: float) -> DataFrame:
    """``smooth``: s += (v - s) * (1 - exp(-dt / tau)) along each track, from its first value; a null value or time keeps s."""

    def start():
        s = t = None

        def step(v, now):
            nonlocal s, t
            if v is not None and now is not None:
                s = v if s is None else s + (v - s) * (1 - math.exp(-(now - t) / tau))
                t = now
            return s

        return step

    rows = points.select(key, *order, F.col(value).cast("double").alias("_v"), seconds.cast("double").alias("_t"))
    return scan_in_order(rows, key, order, ["_v", "_t"], "smooth", DoubleType(), start).drop("_v", "_t")


def declutter(labels: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The labels (boxes x0, y0, x1, y1) of each ``key`` that stay when, in order, each that overlaps a kept one goes.

    Kept boxes stand in a grid as wide as the widest box and as high as the highest, so a label is compared with those
    of nine cells. A label that lacks a coordinate overlaps nothing and stays.
    """
    most = labels.agg(F.max(F.col("x1") - F.col("x0")).alias("w"), F.max(F.col("y1") - F.col("y0")).alias("h")).first()
    w, h = max(float(most["w"] or 0), 1e-9), max(float(most["h"] or 0), 1e-9)

    def start():
        kept: dict[tuple[int, int], list[tuple]] = {}

        def stays(x0, y0, x1, y1) -> bool:
            if None in (x0, y0, x1, y1):
                return True
            i, j = math.floor(x0 / w), math.floor(y0 / h)
            for a in (i - 1, i, i + 1):
                for b in (j - 1, j, j + 1):
                    if any(x0 < k[2] and x1 > k[0] and y0 < k[3] and y1 > k[1] for k in kept.get((a, b), ())):
                        return False
            kept.setdefault((i, j), []).append((x0, y0, x1, y1))
            return True

        return stays

    return scan_in_order(labels, key, order, ["x0", "y0", "x1", "y1"], "_stays", BooleanType(), start).where("_stays").drop("_stays")


def paint(points: DataFrame, key: str, order: list[str], box: tuple[float, float, float], side: int = 256) -> DataFrame:
    """Pixels (px, py, from the upper left) of the track's points on a tile with lower left (x0, y0) and side s."""
    x0, y0, s = box
    px = F.floor((F.col("x") - x0) / s * side).cast("long")
    py = F.floor((y0 + s - F.col("y")) / s * side).cast("long")
    return points.select(key, *order, px.alias("px"), py.alias("py")).where(F.col("px").between(0, side - 1) & F.col("py").between(0, side - 1))


def solar_altitude(hour: Column, day: Column, latitude: float) -> Column:
    """Altitude of the sun in degrees from the solar hour and the day of the year."""
    tilt = F.radians(F.lit(-23.44)) * F.cos(2 * math.pi * (day + 10) / 365.0)
    angle, lat = F.radians((hour - 12) * 15.0), math.radians(latitude)
    return F.degrees(F.asin(math.sin(lat) * F.sin(tilt) + math.cos(lat) * F.cos(tilt) * F.cos(angle)))
