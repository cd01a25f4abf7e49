"""Elevation rasters in long form: (row, col, z), null where there is no data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_DATA = -1000.0


def no_data_to_null(z: Column, limit: float = NO_DATA) -> Column:
    return F.when(z >= limit, z)


def patch(raster: DataFrame, fallback: DataFrame) -> DataFrame:
    """No-data cells filled from the fallback where it has data."""
    other = fallback.select("row", "col", F.col("z").alias("_z"))
    return raster.join(other, ["row", "col"], "left").select("row", "col", F.coalesce("z", "_z").alias("z"))


def gradient(raster: DataFrame, step: float) -> DataFrame:
    """dz/dcol and dz/drow: central differences, one-sided at edges and next to no data; null at a lone cell.

    Neighbours are found by windows along rows and columns, each of which is bounded by the raster's side.
    """
    across, down = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")

    def slope(w, place):
        near = lambda f, k: F.when(f(place).over(w) == F.col(place) + k, f("z").over(w))
        low, high = near(F.lag, -1), near(F.lead, 1)
        return F.coalesce((high - low) / (2 * step), (high - F.col("z")) / step, (F.col("z") - low) / step)

    return raster.select("row", "col", "z", slope(across, "col").alias("dx"), slope(down, "row").alias("dy"))


def bilinear(samples: DataFrame, raster: DataFrame, fallback: bool = False) -> DataFrame:
    """Samples (id, u, v in pixel units, centres at half) with their height: null if any corner is missing, or, with
    ``fallback``, the first corner there is."""
    x, y = F.col("u") - 0.5, F.col("v") - 0.5
    c0, r0 = F.floor(x).cast("long"), F.floor(y).cast("long")
    spread = samples.select("id", (x - F.floor(x)).alias("fx"), (y - F.floor(y)).alias("fy"), c0.alias("c0"), r0.alias("r0"))
    corner = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in (0, 1) for dc in (0, 1)]))
    asked = spread.withColumn("k", corner).select("id", "fx", "fy", "k", (F.col("r0") + F.col("k.dr")).alias("row"), (F.col("c0") + F.col("k.dc")).alias("col"))
    found = asked.join(raster, ["row", "col"], "left")
    at = lambda dr, dc: F.max(F.when((F.col("k.dr") == dr) & (F.col("k.dc") == dc), F.col("z")))
    g = found.groupBy("id").agg(F.first("fx").alias("fx"), F.first("fy").alias("fy"), at(0, 0).alias("h00"), at(0, 1).alias("h10"), at(1, 0).alias("h01"), at(1, 1).alias("h11"))
    fx, fy = F.col("fx"), F.col("fy")
    h = (F.col("h00") * (1 - fx) + F.col("h10") * fx) * (1 - fy) + (F.col("h01") * (1 - fx) + F.col("h11") * fx) * fy
    return g.select("id", (F.coalesce(h, "h00", "h10", "h01", "h11") if fallback else h).alias("z"))


def resample(raster: DataFrame, width: int, height: int, columns: int, rows: int) -> DataFrame:
    """The raster sampled on a regular grid of ``columns`` by ``rows`` points: id = row * columns + column."""
    spark = raster.sparkSession
    grid = spark.range(columns * rows).select("id", ((F.col("id") % columns + 0.5) * width / columns).alias("u"), ((F.floor(F.col("id") / columns) + 0.5) * height / rows).alias("v"))
    return bilinear(grid, raster)


def roll_up(raster: DataFrame) -> DataFrame:
    """The next coarser level: means of 2 x 2 cells that have data."""
    half = lambda c: F.floor(F.col(c) / 2).cast("long").alias(c)
    return raster.where("z IS NOT NULL").groupBy(half("row"), half("col")).agg((F.sum("z") / F.count("z")).alias("z"))
