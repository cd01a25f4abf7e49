"""ESRI ASCII grids and 32-bit BIL rasters in long form (path, row, col, z); row 0 is north."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.binary import decode_files, read_files

ASC_HEADER = ("ncols", "nrows", "xllcorner", "yllcorner", "cellsize", "nodata_value")


def read_asc(spark: SparkSession, path: str) -> DataFrame:
    """path, row, col, x, y, z: cell centres half a cell from the corner, no data dropped; parsed by Spark expressions."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split(F.trim("value"), r"\r?\n").alias("lines"))
    head = {k: F.element_at(F.split(F.trim(F.get("lines", F.lit(i))), r"\s+"), 2).cast("double").alias(k) for i, k in enumerate(ASC_HEADER)}
    rows = lines.select("path", *head.values(), F.posexplode(F.slice("lines", 7, F.size("lines") - 6)).alias("row", "line"))
    cells = rows.select("path", *ASC_HEADER, "row", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "v"))
    x = F.col("xllcorner") + (F.col("col") + 0.5) * F.col("cellsize")
    y = F.col("yllcorner") + (F.col("nrows") - F.col("row") - 0.5) * F.col("cellsize")
    return cells.select("path", "row", "col", x.alias("x"), y.alias("y"), F.nullif(F.col("v").cast("double"), F.col("nodata_value")).alias("z")).where("z IS NOT NULL")


def asc_index(spark: SparkSession, path: str) -> DataFrame:
    """path, west, south, side of each grid, from its header."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", r"\r?\n", 7).alias("lines"))
    v = lambda i: F.element_at(F.split(F.trim(F.get("lines", F.lit(i))), r"\s+"), 2).cast("double")
    return lines.select("path", v(2).alias("west"), v(3).alias("south"), (v(0) * v(4)).alias("side"))


def encode_asc(raster: DataFrame, ncols: int, nrows: int, west: float, south: float, cell: float, nodata: float = -9999.0) -> DataFrame:
    """name, content of a raster (raster_id, row, col, z) as one ASCII grid per raster_id."""
    line = raster.groupBy("raster_id", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", F.coalesce(F.col("z").cast("double"), F.lit(nodata)).alias("z")))), lambda c: c["z"].cast("string")), " ").alias("line"))
    head = "\n".join(f"{k} {v}" for k, v in zip(ASC_HEADER, (ncols, nrows, west, south, cell, nodata), strict=True))
    body = line.groupBy("raster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda r: r["line"]), "\n").alias("body"))
    return body.select(F.concat(F.col("raster_id").cast("string"), F.lit(".asc")).alias("name"), F.concat(F.lit(head + "\n"), F.col("body")).cast("binary").alias("content"))


def read_bil(spark: SparkSession, path: str, width: int, height: int, no_data: float = -1000.0) -> DataFrame:
    """path, row, col, z of 32-bit little-endian rasters; files of another size are passed over, no data is null."""

    def decode(name, content):
        if len(content) == 4 * width * height:
            z = np.frombuffer(content, "<f4").astype(float)
            rows, cols = np.divmod(np.arange(width * height), width)
            yield pd.DataFrame({"path": name, "row": rows, "col": cols, "z": pd.array(np.where(z < no_data, np.nan, z))})

    return decode_files(read_files(spark, path), decode, "path string, row long, col long, z double").withColumn("z", F.when(~F.isnan("z"), F.col("z")))
