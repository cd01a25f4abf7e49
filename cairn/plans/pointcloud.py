"""Queries on point clouds."""

from pyspark.sql import functions as F

from cairn.operators import pointcloud as pc
from cairn.operators.ordered import numbered
from cairn.operators.spatial_join import neighbours
from cairn.plans.registry import query

C = F.col
SEQ = ["l_orderkey", "l_linenumber", "x_cm", "y_cm", "z_cm", "l_partkey"]


@query("SELECT source_id, row_number() OVER (ORDER BY k) - 1 AS dense_id FROM (SELECT source_id, min((l_orderkey, l_linenumber, x_cm, y_cm, z_cm, l_partkey)) AS k FROM v_point GROUP BY source_id)")
def agg01_dense_ids(t):
    return pc.dense_ids(t.v_point, "source_id", SEQ).withColumn("dense_id", C("dense_id").cast("long"))


@query("SELECT source_id, count(*) AS n, CAST(min(scan_angle) AS BIGINT) AS min_angle, CAST(max(scan_angle) AS BIGINT) AS max_angle, min(gps_time) AS min_gps, max(gps_time) AS max_gps FROM v_point GROUP BY source_id")
def agg02_source_stats(t):
    return pc.source_stats(t.v_point).drop("repr_angle")


_LINES = """s AS (SELECT source_id, min(scan_angle) AS lo, max(scan_angle) AS hi, min(gps_time) AS g0, max(gps_time) AS g1 FROM v_point GROUP BY source_id),
 r AS (SELECT source_id, g0, g1, CASE WHEN hi - lo <= 10 THEN trunc((hi + lo) / 2.0) WHEN lo + 5 <= 0 AND hi - 5 >= 0 THEN 0 WHEN lo + 5 >= 0 THEN lo + 5 ELSE hi - 5 END AS repr FROM s),
 p AS (SELECT v.*, abs(scan_angle - repr) <= 2 AS na, abs(gps_time - (g0 + g1) / 2) <= (g1 - g0) / 100 AS nt FROM v_point v JOIN r USING (source_id)),
 l AS (SELECT source_id, arg_min((x_cm, y_cm), (gps_time, l_orderkey, l_linenumber, x_cm, y_cm, z_cm, l_partkey)) FILTER (WHERE na) AS a0, arg_min((x_cm, y_cm), (-gps_time, l_orderkey, l_linenumber, x_cm, y_cm, z_cm, l_partkey)) FILTER (WHERE na) AS a1,
  arg_min((x_cm, y_cm), (scan_angle, l_orderkey, l_linenumber, x_cm, y_cm, z_cm, l_partkey)) FILTER (WHERE nt) AS c0, arg_min((x_cm, y_cm), (-scan_angle, l_orderkey, l_linenumber, x_cm, y_cm, z_cm, l_partkey)) FILTER (WHERE nt) AS c1 FROM p GROUP BY source_id)"""


@query(f"WITH {_LINES} SELECT source_id, a0[1] AS ax0, a0[2] AS ay0, a1[1] AS ax1, a1[2] AS ay1, c0[1] AS cx0, c1[2] AS cy1 FROM l")
def agg03_flight_line_extremes(t):
    f = pc.flight_lines(t.v_point, SEQ)
    return f.select("source_id", C("along_min.x_cm").alias("ax0"), C("along_min.y_cm").alias("ay0"), C("along_max.x_cm").alias("ax1"), C("along_max.y_cm").alias("ay1"), C("across_min.x_cm").alias("cx0"), C("across_max.y_cm").alias("cy1"))


@query(f"WITH {_LINES} SELECT source_id, round(atan2(a1[2] - a0[2], a1[1] - a0[1]), 6) AS along, round(atan2(c1[2] - c0[2], c1[1] - c0[1]), 6) AS across, coalesce(abs(sin(atan2(a1[2] - a0[2], a1[1] - a0[1]) - atan2(c1[2] - c0[2], c1[1] - c0[1]))) >= 0.5 AND (a0[1] <> a1[1] OR a0[2] <> a1[2]) AND (c0[1] <> c1[1] OR c0[2] <> c1[2]), false) AS valid FROM l")
def agg04_flt18_azimuths(t):
    return pc.flight_lines(t.v_point, SEQ).select("source_id", F.round("azimuth_along", 6).alias("along"), F.round("azimuth_across", 6).alias("across"), "valid")


@query("SELECT x_cm // 50000 AS i, y_cm // 50000 AS j, count(*) AS n, CAST(sum(x_cm) AS BIGINT) AS sx, CAST(sum(y_cm) AS BIGINT) AS sy, CAST(sum(z_cm) AS BIGINT) AS sz FROM v_point GROUP BY ALL")
def agg05_grid(t):
    return pc.grid(t.v_point, 50000)


_FLAT = """c AS (SELECT x_cm // 20000 AS i, y_cm // 20000 AS j, count(*) AS n, sum(x_cm) AS sx, sum(y_cm) AS sy, sum(z_cm) AS sz FROM v_point GROUP BY ALL), m AS (SELECT i, j, sz::DOUBLE / n AS z FROM c),
 nb AS (SELECT a.i, a.j, b.i - a.i AS di, b.j - a.j AS dj, b.z FROM m a JOIN m b ON b.i BETWEEN a.i - 2 AND a.i + 2 AND b.j BETWEEN a.j - 2 AND a.j + 2),
 e AS (SELECT i, j, arg_min((di, dj, z), (-z, di <> 0 OR dj <> 0, dj, di)) AS hi, arg_min((di, dj, z), (z, di <> 0 OR dj <> 0, dj, di)) AS lo FROM nb GROUP BY i, j),
 s AS (SELECT i, j, sqrt(power((hi[1] - lo[1]) * 20000, 2) + power((hi[2] - lo[2]) * 20000, 2)) AS run, abs(hi[3] - lo[3]) AS rise FROM e),
 f AS (SELECT i, j, CASE WHEN run > 0 THEN degrees(atan2(rise, run)) ELSE 0.0 END AS slope FROM s)"""


@query(f"WITH {_FLAT} SELECT i, j, round(slope, 5) AS slope, slope < 45.0 AS flat FROM f")
def agg06_flat_cells(t):
    return pc.flat_cells(pc.grid(t.v_point, 20000), 20000, 2, 45.0).select("i", "j", F.round("slope", 5).alias("slope"), "flat")


@query(f"""WITH {_FLAT} SELECT count(*) AS n, round(sum(z) / 1000, 2) AS z, thinned FROM (SELECT z_cm::DOUBLE AS z, false AS thinned FROM v_point v JOIN f ON v.x_cm // 20000 = f.i AND v.y_cm // 20000 = f.j WHERE slope >= 45.0
 UNION ALL SELECT sz::DOUBLE / n, true FROM c JOIN f USING (i, j) WHERE slope < 45.0) GROUP BY thinned""")
def agg06_flat_area_thin(t):
    thin = pc.flat_area_thin(t.v_point, 20000, 2, 45.0)
    return thin.groupBy("thinned").agg(F.count("*").alias("n"), F.round(F.sum("z_cm") / 1000, 2).alias("z"))


@query("SELECT x_cm // 5000 AS i, y_cm // 5000 AS j, max(z_cm) AS h FROM v_point WHERE classification = 5 GROUP BY ALL")
def agg07_canopy_height(t):
    return pc.grid_key(t.v_point.where("classification = 5"), 5000).groupBy("i", "j").agg(F.max("z_cm").alias("h"))


@query("SELECT source_id, classification, count(*) AS n FROM v_point GROUP BY ALL")
def agg08_group_indexes(t):
    return t.v_point.groupBy("source_id", "classification").agg(F.count("*").alias("n"))


@query("SELECT source_id, count(*) AS n, max(z_cm) AS top, min(x_cm) AS x0, max(x_cm) AS x1, CAST(floor(sum(x_cm) / count(*)) AS BIGINT) AS mx FROM v_point WHERE classification = 5 GROUP BY source_id HAVING count(*) >= 20")
def agg09_crown_stats(t):
    s = t.v_point.where("classification = 5").groupBy("source_id").agg(F.count("*").alias("n"), F.max("z_cm").alias("top"), F.min("x_cm").alias("x0"), F.max("x_cm").alias("x1"), F.floor(F.sum("x_cm") / F.count("*")).cast("long").alias("mx"))
    return s.where("n >= 20")


@query("SELECT min(x_cm) AS x0, max(x_cm) AS x1, min(y_cm) AS y0, max(y_cm) AS y1, min(z_cm) AS z0, max(z_cm) AS z1 FROM v_point")
def agg10_bbox(t):
    return t.v_point.agg(*[f(c + "_cm").alias(c + k) for c in "xyz" for f, k in ((F.min, "0"), (F.max, "1"))])


@query("SELECT CAST(floor(quantile_cont(x_cm, 0.5) / 1000) * 1000 AS BIGINT) AS ox, CAST(floor(quantile_cont(y_cm, 0.5) / 1000) * 1000 AS BIGINT) AS oy FROM v_point")
def agg30_median_origin(t):
    at = lambda c: (F.floor(F.percentile(c, 0.5) / 1000) * 1000).cast("long")
    return t.v_point.agg(at("x_cm").alias("ox"), at("y_cm").alias("oy"))


@query("SELECT 1.0::DOUBLE * count(*) FILTER (WHERE scan_angle > 0) / count(*) AS right_share, count(*) FILTER (WHERE scan_angle = 0) AS nadir, classification FROM v_point GROUP BY classification")
def agg28_orientation_counters(t):
    return t.v_point.groupBy("classification").agg((F.count_if(C("scan_angle") > 0) / F.count("*")).alias("right_share"), F.count_if(C("scan_angle") == 0).alias("nadir"))


@query("""WITH b AS (SELECT min(x_cm) AS x0, greatest(max(x_cm) - min(x_cm), 1) AS w, min(y_cm) AS y0, greatest(max(y_cm) - min(y_cm), 1) AS h FROM v_point)
 SELECT CAST(least(15, floor((x_cm - x0) / (w / 16.0))) AS BIGINT) AS i, CAST(least(15, floor((y_cm - y0) / (h / 16.0))) AS BIGINT) AS j, max(z_cm) AS z FROM v_point, b GROUP BY ALL""")
def agg26_height_grid(t):
    b = t.v_point.agg(F.min("x_cm").alias("x0"), F.max("x_cm").alias("x1"), F.min("y_cm").alias("y0"), F.max("y_cm").alias("y1")).first()
    w, h = max(b["x1"] - b["x0"], 1) / 16.0, max(b["y1"] - b["y0"], 1) / 16.0
    cell = lambda c, low, s: F.least(F.lit(15).cast("long"), F.floor((C(c) - low) / s).cast("long"))
    return t.v_point.groupBy(cell("x_cm", b["x0"], w).alias("i"), cell("y_cm", b["y0"], h).alias("j")).agg(F.max("z_cm").alias("z"))


@query("SELECT source_id, gps_time, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY source_id ORDER BY gps_time, l_orderkey, l_linenumber, x_cm, y_cm, z_cm, l_partkey) AS pos FROM v_point")
def win07_scanline_order(t):
    order = ["gps_time", *SEQ]
    p = t.v_point.select(*dict.fromkeys(["source_id", "gps_time", "l_orderkey", "l_linenumber", *order]))
    return numbered(p, ["source_id"], order, "pos").select("source_id", "gps_time", "l_orderkey", "l_linenumber", "pos")


@query("""WITH c AS (SELECT x_cm // 20000 AS i, y_cm // 20000 AS j, sum(z_cm) AS z, count(*) AS n FROM v_point GROUP BY ALL)
 SELECT a.i, a.j, count(*) AS cells, CAST(sum(b.z) AS BIGINT) AS z, CAST(sum(b.n) AS BIGINT) AS n FROM c a JOIN c b ON b.i BETWEEN a.i - 1 AND a.i + 1 AND b.j BETWEEN a.j - 1 AND a.j + 1 GROUP BY a.i, a.j""")
def jon11_grid_neighbours(t):
    cells = pc.grid(t.v_point, 20000).select("i", "j", "sz", "n")
    around = neighbours(cells, 1).groupBy(C("ci").alias("i"), C("cj").alias("j")).agg(F.count("*").alias("cells"), F.sum("sz").alias("z"), F.sum("n").alias("n"))
    return around.join(cells.select("i", "j"), ["i", "j"], "left_semi")


_NORMAL = "CASE WHEN l_linenumber = 3 THEN 0 ELSE l_suppkey % 5 - 2 END AS nx, CASE WHEN l_linenumber = 3 THEN 0 ELSE l_partkey % 5 - 2 END AS ny, CASE WHEN l_linenumber = 3 THEN 0 ELSE 1 - 2 * (l_orderkey % 2) END AS nz"


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, x_cm, x_cm // 40000 AS i, y_cm // 40000 AS j, {_NORMAL} FROM v_point), c AS (SELECT i, j, count(*) AS n, sum(nx) AS sx, sum(ny) AS sy, sum(nz) AS sz FROM p WHERE nx <> 0 OR ny <> 0 OR nz <> 0 GROUP BY i, j),
 a AS (SELECT k.i, k.j, sum(c.n) AS n, sum(c.sx)::DOUBLE AS sx, sum(c.sy)::DOUBLE AS sy, sum(c.sz)::DOUBLE AS sz FROM (SELECT DISTINCT i, j FROM p) k JOIN c ON c.i BETWEEN k.i - 1 AND k.i + 1 AND c.j BETWEEN k.j - 1 AND k.j + 1 GROUP BY k.i, k.j)
 SELECT l_orderkey, l_linenumber, x_cm, round(CASE WHEN nx = 0 AND ny = 0 AND nz = 0 AND sx * sx + sy * sy + sz * sz > 0 THEN abs(sz / n) / sqrt(power(sx / n, 2) + power(sy / n, 2) + power(sz / n, 2)) ELSE nz END, 6) AS nz FROM p LEFT JOIN a USING (i, j)""")
def ana10_repair_zero_normals(t):
    zero = lambda v: F.when(C("l_linenumber") == 3, 0).otherwise(v)
    p = t.v_point.withColumn("nx", zero(C("l_suppkey") % 5 - 2)).withColumn("ny", zero(C("l_partkey") % 5 - 2)).withColumn("nz", zero(1 - 2 * (C("l_orderkey") % 2)))
    return pc.repair_zero_normals(p, 40000).select("l_orderkey", "l_linenumber", "x_cm", F.round("nz", 6).alias("nz"))


@query("SELECT l_orderkey, l_linenumber, x_cm, CASE WHEN abs(b) > 0.25 + 2 * (1 - q) THEN 'beam' WHEN abs(nz) > 0.55 + 2 * (1 - q) THEN 'up' ELSE 'zero' END AS how FROM (SELECT *, (l_partkey % 41 - 20) / 20.0::DOUBLE AS b, (l_suppkey % 21 - 10) / 10.0::DOUBLE AS nz, 0.6 + (l_orderkey % 40) / 100.0::DOUBLE AS q FROM v_point)")
def ana09_orientation_cascade(t):
    return t.v_point.select("l_orderkey", "l_linenumber", "x_cm", pc.orient((C("l_suppkey") % 21 - 10) / 10.0, (C("l_partkey") % 41 - 20) / 20.0, 0.6 + (C("l_orderkey") % 40) / 100.0).alias("how"))


@query()
def ana08_pca_normals(t):
    key = F.concat_ws(".", F.floor(C("x_cm") / 50000), F.floor(C("y_cm") / 50000))
    return pc.pca_normals(t.v_point.select(key.alias("cell"), *[(C(k + "_cm") / 100.0).alias(k) for k in "xyz"]), "cell")


_CHM = "c AS (SELECT x_cm // 20000 AS i, y_cm // 20000 AS j, max(z_cm) AS h FROM v_point GROUP BY ALL)"


@query(f"WITH {_CHM} SELECT i, j, h FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.i BETWEEN a.i - 3 AND a.i + 3 AND b.j BETWEEN a.j - 3 AND a.j + 3 AND b.h > a.h)")
def ana17_local_maxima(t):
    return pc.local_maxima(pc.grid_key(t.v_point, 20000).groupBy("i", "j").agg(F.max("z_cm").alias("h")), 3)


@query(f"WITH {_CHM} SELECT a.i, a.j, round(sum(b.h * exp(-((b.i - a.i) * (b.i - a.i) + (b.j - a.j) * (b.j - a.j)) / 2.0)) / sum(exp(-((b.i - a.i) * (b.i - a.i) + (b.j - a.j) * (b.j - a.j)) / 2.0)), 3) AS h FROM c a JOIN c b ON b.i BETWEEN a.i - 3 AND a.i + 3 AND b.j BETWEEN a.j - 3 AND a.j + 3 GROUP BY a.i, a.j")
def ana17_gaussian(t):
    return pc.gaussian(pc.grid_key(t.v_point, 20000).groupBy("i", "j").agg(F.max("z_cm").alias("h"))).select("i", "j", F.round("h", 3).alias("h"))


@query(f"""WITH RECURSIVE {_CHM}, up AS (SELECT a.i, a.j, arg_max((b.i, b.j), (b.h, b.i, b.j)) AS u FROM c a JOIN c b ON b.i BETWEEN a.i - 1 AND a.i + 1 AND b.j BETWEEN a.j - 1 AND a.j + 1 GROUP BY a.i, a.j),
 w AS (SELECT i, j, u[1] AS ti, u[2] AS tj FROM up UNION SELECT w.i, w.j, up.u[1], up.u[2] FROM w JOIN up ON up.i = w.ti AND up.j = w.tj)
 SELECT w.i, w.j, ti, tj FROM w JOIN up ON up.i = ti AND up.j = tj AND up.u[1] = ti AND up.u[2] = tj""")
def ana17_watershed(t):
    return pc.watershed(pc.grid_key(t.v_point, 20000).groupBy("i", "j").agg(F.max("z_cm").alias("h")))


@query("SELECT DISTINCT x_cm // 100000 AS ci, y_cm // 100000 AS cj, count(*) FILTER (WHERE classification = 2) OVER (PARTITION BY x_cm // 100000, y_cm // 100000) AS ground, count(*) OVER (PARTITION BY x_cm // 100000, y_cm // 100000) AS n FROM v_point")
def src05_class_only_scan(t):
    return pc.grid_key(t.v_point.select("x_cm", "y_cm", "classification"), 100000).groupBy(C("i").alias("ci"), C("j").alias("cj")).agg(F.count_if(C("classification") == 2).alias("ground"), F.count("*").alias("n"))
