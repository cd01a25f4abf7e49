"""Point-cloud analytics: flight lines, grids, thinning, normals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.geometry import representative_angle
from cairn.operators.ordered import numbered
from cairn.operators.spatial_join import nearest_join, neighbours


def dense_ids(points: DataFrame, key: str, seq: list[str]) -> DataFrame:
    """Distinct keys numbered from 0 in the order of their first row."""
    first = points.groupBy(key).agg(F.min(F.struct(*seq)).alias("_first"))
    return numbered(first, [], ["_first"], "_place").select(key, (F.col("_place") - 1).alias("dense_id"))


def source_stats(points: DataFrame) -> DataFrame:
    stats = points.groupBy("source_id").agg(
        F.count("*").alias("n"), F.min("scan_angle").cast("long").alias("min_angle"), F.max("scan_angle").cast("long").alias("max_angle"), F.min("gps_time").alias("min_gps"), F.max("gps_time").alias("max_gps")
    )
    return stats.withColumn("repr_angle", representative_angle(F.col("min_angle"), F.col("max_angle")))


def flight_lines(points: DataFrame, order: list[str], angle_tolerance: int = 2) -> DataFrame:
    """For each source the points of extreme time near its representative angle, and of extreme angle near its middle time.

    Statistics come from one partial aggregation and go back by a join on the few sources, so the points aren't shuffled
    by source. Ties take the first row in ``order``. Columns: along_min, along_max, across_min, across_max as structs of
    x_cm, y_cm; valid if all exist, the two lines aren't single points and |sin| of their angle is 0.5 at least.
    """
    stats = source_stats(points)
    p = points.join(stats.select("source_id", "repr_angle", "min_gps", "max_gps"), "source_id")
    near_angle = F.abs(F.col("scan_angle") - F.col("repr_angle")) <= angle_tolerance
    middle, span = (F.col("min_gps") + F.col("max_gps")) / 2, F.col("max_gps") - F.col("min_gps")
    near_time = F.abs(F.col("gps_time") - middle) <= span / 100
    place = F.struct("x_cm", "y_cm")
    pick = lambda key, sign, cond: F.min_by(F.when(cond, place), F.when(cond, F.struct((sign * F.col(key)).alias("k"), *order)))
    lines = p.groupBy("source_id").agg(
        pick("gps_time", 1, near_angle).alias("along_min"), pick("gps_time", -1, near_angle).alias("along_max"), pick("scan_angle", 1, near_time).alias("across_min"), pick("scan_angle", -1, near_time).alias("across_max")
    )
    d = lambda a, b, k: F.col(f"{b}.{k}") - F.col(f"{a}.{k}")
    along, across = F.atan2(d("along_min", "along_max", "y_cm"), d("along_min", "along_max", "x_cm")), F.atan2(d("across_min", "across_max", "y_cm"), d("across_min", "across_max", "x_cm"))
    apart = lambda a, b: (d(a, b, "x_cm") != 0) | (d(a, b, "y_cm") != 0)
    lines = lines.withColumn("azimuth_along", along).withColumn("azimuth_across", across)
    valid = apart("along_min", "along_max") & apart("across_min", "across_max") & (F.abs(F.sin(along - across)) >= 0.5)
    return lines.withColumn("valid", F.coalesce(valid, F.lit(False)))


def grid_key(points: DataFrame, size: float, x: str = "x_cm", y: str = "y_cm") -> DataFrame:
    return points.withColumn("i", F.floor(F.col(x) / size).cast("long")).withColumn("j", F.floor(F.col(y) / size).cast("long"))


def grid(points: DataFrame, size: float) -> DataFrame:
    """Sums per cell: count, positions, and normals where they aren't zero."""
    some = (F.col("nx") != 0) | (F.col("ny") != 0) | (F.col("nz") != 0) if "nx" in points.columns else None
    sums = [F.count("*").alias("n"), F.sum("x_cm").alias("sx"), F.sum("y_cm").alias("sy"), F.sum("z_cm").alias("sz")]
    if some is not None:
        sums += [F.count_if(some).alias("normals")] + [F.sum(F.when(some, F.col(k)).otherwise(0)).alias("s" + k) for k in ("nx", "ny", "nz")]
    return grid_key(points, size).groupBy("i", "j").agg(*sums)


def flat_cells(cells: DataFrame, size: float, radius: int, slope_degrees: float) -> DataFrame:
    """Each cell with flat: the slope between the neighbours of highest and lowest mean height is under the limit.

    Among equals the centre wins, then the least (dj, di).
    """
    near = neighbours(cells.select("i", "j", (F.col("sz") / F.col("n")).alias("z")), radius)
    centre = (F.col("di") != 0) | (F.col("dj") != 0)
    key = lambda sign: F.struct((sign * F.col("z")).alias("z"), centre.alias("c"), "dj", "di")
    place = F.struct("di", "dj", "z")
    best = near.groupBy("ci", "cj").agg(F.min_by(place, key(-1)).alias("top"), F.min_by(place, key(1)).alias("low"))
    dx, dy = (F.col("top.di") - F.col("low.di")) * float(size), (F.col("top.dj") - F.col("low.dj")) * float(size)
    run = F.sqrt(dx * dx + dy * dy)
    slope = F.when(run > 0, F.degrees(F.atan2(F.abs(F.col("top.z") - F.col("low.z")), run))).otherwise(0.0)
    return cells.join(best.select(F.col("ci").alias("i"), F.col("cj").alias("j"), slope.alias("slope")), ["i", "j"]).withColumn("flat", F.col("slope") < slope_degrees)


def flat_area_thin(points: DataFrame, size: float, radius: int = 5, slope_degrees: float = 45.0) -> DataFrame:
    """x_cm, y_cm, z_cm, thinned: points of steep cells as they are, one centroid for each flat cell."""
    cells = flat_cells(grid(points, size), size, radius, slope_degrees)
    kept = grid_key(points, size).join(cells.where("NOT flat").select("i", "j"), ["i", "j"], "left_semi")
    one = cells.where("flat").select(*[(F.col("s" + k) / F.col("n")).alias(k + "_cm") for k in "xyz"], F.lit(True).alias("thinned"))
    return kept.select(*[F.col(k + "_cm").cast("double").alias(k + "_cm") for k in "xyz"], F.lit(False).alias("thinned")).unionByName(one)


def repair_zero_normals(points: DataFrame, size: float) -> DataFrame:
    """Zero normals replaced by the mean of the 3 x 3 cells around, turned upward; ``fixed`` tells which."""
    cells = grid(points, size).where("normals > 0").select("i", "j", "normals", "snx", "sny", "snz")
    around = neighbours(cells, 1).groupBy(F.col("ci").alias("i"), F.col("cj").alias("j")).agg(F.sum("normals").alias("m"), *[F.sum("s" + k).alias("m" + k) for k in ("nx", "ny", "nz")])
    zero = (F.col("nx") == 0) & (F.col("ny") == 0) & (F.col("nz") == 0)
    joined = grid_key(points, size).join(around, ["i", "j"], "left")
    mean = [F.col("m" + k) / F.col("m") for k in ("nx", "ny", "nz")]
    size_ = F.sqrt(sum((c * c for c in mean[1:]), mean[0] * mean[0]))
    sign = F.when(mean[2] < 0, -1).otherwise(1)
    can = zero & (F.col("m") > 0) & (size_ > 0)
    return joined.select(*[c for c in points.columns if c not in ("nx", "ny", "nz")], *[F.when(can, sign * c / size_).otherwise(F.col(k).cast("double")).alias(k) for k, c in zip(("nx", "ny", "nz"), mean)], F.coalesce(can, F.lit(False)).alias("fixed"))


def height_above_ground(points: DataFrame, ground: DataFrame, point_id: str, size: float) -> DataFrame:
    """Each point's height over its nearest ground point in plan: point_id, ground_id, height."""
    best = nearest_join(points.select(point_id, "x", "y"), ground.select("ground_id", "px", "py"), point_id, "ground_id", 1, size)
    return best.join(points.select(point_id, "z"), point_id).join(ground.select("ground_id", F.col("pz")), "ground_id").select(point_id, "ground_id", (F.col("z") - F.col("pz")).alias("height"))


def pca_normals(neighbourhoods: DataFrame, key: str) -> DataFrame:
    """Normal and quality (1 - smallest / largest eigenvalue) of each neighbourhood of points (key, x, y, z).

    Covariances are summed by Spark; only the 3 x 3 eigenproblems run in numpy, in batches.
    """
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    sums = neighbourhoods.groupBy(key).agg(F.count("*").alias("n"), *[F.sum(c).alias("s" + c) for c in "xyz"], *[F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in pairs])
    cov = [(F.col(a + b) / F.col("n") - F.col("s" + a) * F.col("s" + b) / F.col("n") / F.col("n")).alias(a + b) for a, b in pairs]
    kind = dict(neighbourhoods.dtypes)[key]

    def solve(frames):
        for f in frames:
            m = f[[a + b for a, b in pairs]].to_numpy()
            values, vectors = np.linalg.eigh(m[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)) if len(m) else (np.zeros((0, 3)), np.zeros((0, 3, 3)))
            normal = vectors[:, :, 0] * np.where(vectors[:, 2:3, 0] < 0, -1, 1)
            yield pd.DataFrame({key: f[key], "nx": normal[:, 0], "ny": normal[:, 1], "nz": normal[:, 2], "quality": 1 - values[:, 0] / np.maximum(values[:, 2], 1e-12)})

    return sums.where("n >= 3").select(key, *cov).mapInPandas(solve, f"`{key}` {kind}, nx double, ny double, nz double, quality double")


def orient(nz: Column, beam_dot: Column, quality: Column) -> Column:
    """How a normal is oriented: by the beam if sure enough, else upward if steep enough, else given up."""
    return F.when(F.abs(beam_dot) > 0.25 + 2 * (1 - quality), "beam").when(F.abs(nz) > 0.55 + 2 * (1 - quality), "up").otherwise("zero")


def local_maxima(cells: DataFrame, radius: int, height: str = "h") -> DataFrame:
    """Cells (i, j, height) that no cell within ``radius`` exceeds."""
    top = neighbours(cells, radius).groupBy(F.col("ci").alias("i"), F.col("cj").alias("j")).agg(F.max(height).alias("_top"))
    return cells.join(top, ["i", "j"]).where(F.col(height) >= F.col("_top")).drop("_top")


def gaussian(cells: DataFrame, sigma: float = 1.0, radius: int = 3, height: str = "h") -> DataFrame:
    """Heights smoothed by a normalised Gaussian over the cells that exist."""
    near = neighbours(cells, radius)
    w = F.exp(-(F.col("di") * F.col("di") + F.col("dj") * F.col("dj")) / (2 * sigma * sigma))
    smooth = near.groupBy(F.col("ci").alias("i"), F.col("cj").alias("j")).agg((F.sum(F.col(height) * w) / F.sum(w)).alias(height))
    return cells.drop(height).join(smooth, ["i", "j"])


def watershed(cells: DataFrame, height: str = "h", rounds: int = 20) -> DataFrame:
    """Each cell's crown: follow the steepest ascent to its summit, by pointer jumping. An approximation of a flood."""
    key = F.struct(F.col(height).alias("h"), F.col("i").alias("i"), F.col("j").alias("j"))
    up = neighbours(cells, 1).groupBy("ci", "cj").agg(F.max(key).alias("to"))
    held = cells.select(F.col("i").alias("ci"), F.col("j").alias("cj"))
    step = up.join(held, ["ci", "cj"], "left_semi").select(F.col("ci").alias("i"), F.col("cj").alias("j"), F.col("to.i").alias("ti"), F.col("to.j").alias("tj"))
    from cairn.session import materialize

    for _ in range(rounds):
        ahead = step.select(F.col("i").alias("ti"), F.col("j").alias("tj"), F.col("ti").alias("ui"), F.col("tj").alias("uj"))
        jumped = materialize(step.join(ahead, ["ti", "tj"]).select("i", "j", F.col("ui").alias("ti"), F.col("uj").alias("tj"), ((F.col("ui") != F.col("ti")) | (F.col("uj") != F.col("tj"))).alias("moved")), "watershed")
        step = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            break
    return step
