"""Queries on rasters."""

from pyspark.sql import functions as F

from cairn.functions.geometry import heightfield_normal
from cairn.operators import raster as ra
from cairn.plans.registry import query

C = F.col


@query("SELECT a.row, a.col, coalesce(a.z, CASE WHEN (a.row + a.col) % 3 = 0 THEN NULL ELSE a.row + a.col END) AS z FROM v_raster a")
def src18_patch_no_data(t):
    fallback = t.v_raster.select("row", "col", F.when((C("row") + C("col")) % 3 != 0, C("row") + C("col")).alias("z"))
    return ra.patch(t.v_raster, fallback)


@query("SELECT count(*) AS n, count(*) FILTER (WHERE z IS NULL) AS missing, min(z) AS low, max(z) AS high FROM v_raster")
def agg23_altitude_span(t):
    return t.v_raster.agg(F.count("*").alias("n"), F.count_if(C("z").isNull()).alias("missing"), F.min("z").alias("low"), F.max("z").alias("high"))


@query("""SELECT row, col, coalesce((e - w) / 2.0, (e - z) / 1.0, (z - w) / 1.0)::DOUBLE AS dx, coalesce((s - n) / 2.0, (s - z) / 1.0, (z - n) / 1.0)::DOUBLE AS dy FROM
 (SELECT *, lag(z) OVER r AS w, lead(z) OVER r AS e, lag(z) OVER c AS n, lead(z) OVER c AS s FROM v_raster WINDOW r AS (PARTITION BY row ORDER BY col), c AS (PARTITION BY col ORDER BY row))""")
def win04_gradient(t):
    return ra.gradient(t.v_raster, 1.0).select("row", "col", C("dx").cast("double").alias("dx"), C("dy").cast("double").alias("dy"))


@query("""SELECT row, col, round((w - e) / 2.0 / sqrt(power((w - e) / 2.0, 2) + power((s - n) / 2.0, 2) + 1), 9) AS nx FROM
 (SELECT row, col, lag(z) OVER r AS w, lead(z) OVER r AS e, lag(z) OVER c AS n, lead(z) OVER c AS s FROM v_raster WINDOW r AS (PARTITION BY row ORDER BY col), c AS (PARTITION BY col ORDER BY row)) WHERE w IS NOT NULL AND e IS NOT NULL AND n IS NOT NULL AND s IS NOT NULL""")
def scl34_heightfield_normal(t):
    from pyspark.sql import Window

    r, c = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    p = t.v_raster.select("row", "col", F.lag("z").over(r).alias("w"), F.lead("z").over(r).alias("e"), F.lag("z").over(c).alias("n"), F.lead("z").over(c).alias("s"))
    n = heightfield_normal(C("w"), C("e"), C("s"), C("n"), 1.0)
    return p.where("w IS NOT NULL AND e IS NOT NULL AND n IS NOT NULL AND s IS NOT NULL").select("row", "col", F.round(n[0], 9).alias("nx"))


_BIL = """s AS (SELECT document_id AS id, (x_m % 6000) / 100.0::DOUBLE AS u, (y_m % 6000) / 100.0::DOUBLE AS v FROM v_poi), q AS (SELECT id, u - 0.5 AS x, v - 0.5 AS y FROM s),
 k AS (SELECT id, x - floor(x) AS fx, y - floor(y) AS fy, a.z AS h00, b.z AS h10, c.z AS h01, d.z AS h11 FROM q LEFT JOIN v_raster a ON a.row = floor(y) AND a.col = floor(x) LEFT JOIN v_raster b ON b.row = floor(y) AND b.col = floor(x) + 1
 LEFT JOIN v_raster c ON c.row = floor(y) + 1 AND c.col = floor(x) LEFT JOIN v_raster d ON d.row = floor(y) + 1 AND d.col = floor(x) + 1), h AS (SELECT *, (h00 * (1 - fx) + h10 * fx) * (1 - fy) + (h01 * (1 - fx) + h11 * fx) * fy AS z FROM k)"""


def _samples(t):
    return t.v_poi.select(C("document_id").alias("id"), ((C("x_m") % 6000) / 100.0).alias("u"), ((C("y_m") % 6000) / 100.0).alias("v"))


@query(f"WITH {_BIL} SELECT id, round(z, 6) AS z FROM h")
def ana05_jon25_bilinear(t):
    return ra.bilinear(_samples(t), t.v_raster).select("id", F.round("z", 6).alias("z"))


@query(f"WITH {_BIL} SELECT id, round(coalesce(z, h00, h10, h01, h11)::DOUBLE, 6) AS z FROM h")
def ana06_height_with_fallback(t):
    return ra.bilinear(_samples(t), t.v_raster, fallback=True).select("id", F.round(C("z").cast("double"), 6).alias("z"))


@query("""WITH s AS (SELECT i AS id, (i % 16 + 0.5::DOUBLE) * 64 / 16 - 0.5 AS x, (i // 16 + 0.5::DOUBLE) * 64 / 16 - 0.5 AS y FROM range(256) r(i))
 SELECT id, round((a.z + b.z + c.z + d.z) / 4.0, 6)::DOUBLE AS z FROM s LEFT JOIN v_raster a ON a.row = floor(y) AND a.col = floor(x) LEFT JOIN v_raster b ON b.row = floor(y) AND b.col = floor(x) + 1 LEFT JOIN v_raster c ON c.row = floor(y) + 1 AND c.col = floor(x) LEFT JOIN v_raster d ON d.row = floor(y) + 1 AND d.col = floor(x) + 1""")
def ana07_resample(t):
    return ra.resample(t.v_raster, 64, 64, 16, 16).select("id", F.round("z", 6).alias("z"))


@query("SELECT row // 4 AS row, col // 4 AS col, round(avg(z), 6) AS z FROM (SELECT row // 2 * 2 AS row, col // 2 * 2 AS col, avg(z) AS z FROM v_raster WHERE z IS NOT NULL GROUP BY ALL) GROUP BY 1, 2")
def ana13_roll_up(t):
    return ra.roll_up(ra.roll_up(t.v_raster)).select("row", "col", F.round("z", 6).alias("z"))
