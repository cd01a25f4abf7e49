"""Joins by place: bins turn range conditions into equi-joins with a residual test."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import materialize


def _bins(low: Column, high: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long")))


def bin_overlap_join(left: DataFrame, right: DataFrame, left_box: tuple[str, ...], right_box: tuple[str, ...], size: float, touching: bool = False) -> DataFrame:
    """Pairs of rows whose boxes (x0, y0, x1, y1 columns) overlap, once each.

    Each box goes to the bins of ``size`` that it touches; a pair is kept only in the bin of its intersection's lower
    left corner, so no distinct is needed. Choose ``size`` near the larger boxes' side.
    """
    binned = lambda df, b, p: df.withColumn(f"_{p}x", _bins(F.col(b[0]), F.col(b[2]), size)).withColumn(f"_{p}y", _bins(F.col(b[1]), F.col(b[3]), size))
    a, b = binned(left, left_box, "l"), binned(right, right_box, "r")
    joined = a.join(b, (F.col("_lx") == F.col("_rx")) & (F.col("_ly") == F.col("_ry")))
    first = (F.floor(F.greatest(F.col(left_box[0]), F.col(right_box[0])) / size) == F.col("_lx")) & (F.floor(F.greatest(F.col(left_box[1]), F.col(right_box[1])) / size) == F.col("_ly"))
    less = (lambda x, y: x <= y) if touching else (lambda x, y: x < y)
    meets = less(F.col(left_box[0]), F.col(right_box[2])) & less(F.col(right_box[0]), F.col(left_box[2])) & less(F.col(left_box[1]), F.col(right_box[3])) & less(F.col(right_box[1]), F.col(left_box[3]))
    return joined.where(first & meets).drop("_lx", "_ly", "_rx", "_ry")


def point_in_box_join(points: DataFrame, boxes: DataFrame, x: str, y: str, box: tuple[str, ...], size: float) -> DataFrame:
    """Points with each box that holds them, edges included; a point is in one bin, so pairs come once."""
    p = points.withColumn("_px", F.floor(F.col(x) / size).cast("long")).withColumn("_py", F.floor(F.col(y) / size).cast("long"))
    b = boxes.withColumn("_bx", _bins(F.col(box[0]), F.col(box[2]), size)).withColumn("_by", _bins(F.col(box[1]), F.col(box[3]), size))
    joined = p.join(b, (F.col("_px") == F.col("_bx")) & (F.col("_py") == F.col("_by")))
    return joined.where(F.col(x).between(F.col(box[0]), F.col(box[2])) & F.col(y).between(F.col(box[1]), F.col(box[3]))).drop("_px", "_py", "_bx", "_by")


def neighbours(cells: DataFrame, radius: int, i: str = "i", j: str = "j") -> DataFrame:
    """Each cell repeated under each cell key within ``radius``: columns ci, cj name the centre, di, dj the offset from it."""
    span = F.sequence(F.lit(-radius), F.lit(radius))
    spread = cells.withColumn("di", F.explode(span)).withColumn("dj", F.explode(span))
    return spread.withColumn("ci", F.col(i) - F.col("di")).withColumn("cj", F.col(j) - F.col("dj"))


def nearest_join(queries: DataFrame, points: DataFrame, query_id: str, point_id: str, k: int, size: float, qx: str = "x", qy: str = "y", px: str = "px", py: str = "py") -> DataFrame:
    """The ``k`` nearest points of each query: query_id, point_id, d2 (squared distance), rn; ties by point_id.

    Of points at the same place the ``k`` least take part, and queries at the same place are one, whose result all get.
    Rings of bins around a place are searched, the first of ``size`` or, where that puts over 4 ``k`` points in a bin, of
    less; after each round places with ``k`` points within the searched distance are done, the rest go on with four times
    the reach, until the reach spans all points. Each round is a table in the shared folder. Points and queries
    without a place are in no pair.
    """
    spark = queries.sparkSession
    there = Window.partitionBy(px, py).orderBy(point_id)
    points = points.select(point_id, px, py).where(F.col(px).isNotNull() & F.col(py).isNotNull()).withColumn("_r", F.row_number().over(there)).where(F.col("_r") <= k).drop("_r")
    points = materialize(points, "nearest-points")
    extent = points.agg(F.min(px), F.max(px), F.min(py), F.max(py)).first()
    ask = queries.agg(F.min(qx), F.max(qx), F.min(qy), F.max(qy)).first()
    if None in (extent[0], ask[0], ask[2]):
        schema = queries.select(query_id).schema.fields + points.select(point_id).schema.fields
        return spark.createDataFrame([], f"`{query_id}` {schema[0].dataType.simpleString()}, `{point_id}` {schema[1].dataType.simpleString()}, d2 double, rn int")
    reach_all = max(extent[1], ask[1]) - min(extent[0], ask[0]) + max(extent[3], ask[3]) - min(extent[2], ask[2]) + size
    everyone, query, reach = queries.select(query_id, qx, qy), query_id, size
    held = lambda: points.groupBy(*(F.floor(F.col(c) / reach).cast("long").alias(c) for c in (px, py))).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    while reach > reach_all * 1e-9 and held() > 4 * k:
        reach /= 2
    places = everyone.where(F.col(qx).isNotNull() & F.col(qy).isNotNull()).select(qx, qy).distinct().withColumn("_place", F.monotonically_increasing_id())
    places = materialize(places, "nearest-places")
    query_id = "_place"
    left, done = places, []
    while True:
        last = reach >= reach_all
        bins = lambda v: F.floor(v / reach).cast("long")  # noqa: E731, B023
        span = F.array(F.lit(-1), F.lit(0), F.lit(1))
        asked = left.withColumn("_dx", F.explode(span)).withColumn("_dy", F.explode(span)).withColumn("_bx", bins(F.col(qx)) + F.col("_dx")).withColumn("_by", bins(F.col(qy)) + F.col("_dy"))
        held = points.select(point_id, px, py, bins(F.col(px)).alias("_bx"), bins(F.col(py)).alias("_by"))
        d2 = (F.col(qx) - F.col(px)) * (F.col(qx) - F.col(px)) + (F.col(qy) - F.col(py)) * (F.col(qy) - F.col(py))
        found = asked.join(held, ["_bx", "_by"]).select(query_id, point_id, d2.cast("double").alias("d2"))
        ranked = found.withColumn("rn", F.row_number().over(Window.partitionBy(query_id).orderBy("d2", point_id))).where(F.col("rn") <= k)
        if last:
            done.append(ranked.join(left.select(query_id), query_id, "left_semi"))
            break
        ranked = materialize(ranked, "nearest")
        sure = ranked.groupBy(query_id).agg(F.count("*").alias("n"), F.max("d2").alias("far")).where((F.col("n") == k) & (F.col("far") <= reach * reach)).select(query_id)
        done.append(ranked.join(sure, query_id, "left_semi"))
        left = materialize(left.join(sure, query_id, "left_anti"), "nearest-left")
        if left.isEmpty():
            break
        reach *= 4
    near = reduce(DataFrame.unionByName, done).join(places.withColumnsRenamed({qx: "_qx", qy: "_qy"}), query_id)
    return everyone.join(near, (F.col(qx) == F.col("_qx")) & (F.col(qy) == F.col("_qy"))).select(query, point_id, "d2", "rn")


def nearest_ancestor(tiles: DataFrame, cached: DataFrame, depth: int = 6) -> DataFrame:
    """Each tile (z, x, y) with its nearest cached ancestor-or-self at most ``depth`` levels up: dz, null if none."""
    ups = tiles.withColumn("dz", F.explode(F.sequence(F.lit(0), F.lit(depth)))).where(F.col("z") >= F.col("dz"))
    up = lambda c: F.call_function("shiftright", F.col(c), F.col("dz"))
    keyed = ups.select("z", "x", "y", "dz", (F.col("z") - F.col("dz")).alias("az"), up("x").alias("ax"), up("y").alias("ay"))
    held = cached.select(F.col("z").alias("az"), F.col("x").alias("ax"), F.col("y").alias("ay")).distinct()
    best = keyed.join(held, ["az", "ax", "ay"]).groupBy("z", "x", "y").agg(F.min("dz").alias("dz"))
    return tiles.join(best, ["z", "x", "y"], "left")
