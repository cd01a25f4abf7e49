"""Queries on frames and tiles."""

from pyspark.sql import functions as F

from cairn.functions import frames, geometry, tiles
from cairn.plans.registry import query



def lonlat():
    return F.col("lon_u") / 1e6, F.col("lat_u") / 1e6


_TX11 = "CAST(floor((lon_u / 1e6 + 180.0) / 360.0 * 2048.0) AS BIGINT)"
_TY11 = "CAST(floor((0.5 - ln((1 + sin(radians(lat_u / 1e6))) / (1 - sin(radians(lat_u / 1e6)))) / (4 * pi())) * 2048.0) AS BIGINT)"
K = "(1 / cos(radians(45.5)))"


def points_with_tile(t, level):
    x, y = tiles.tile_xy(*lonlat(), level)
    return t.v_point.withColumn("tx", F.floor(x).cast("long")).withColumn("ty", F.floor(y).cast("long"))


@query(f"SELECT {_TX11} AS tx, {_TY11} AS ty, count(*) AS n, min(z_cm) AS z_min, max(z_cm) AS z_max FROM v_point WHERE classification IN (2, 9) GROUP BY ALL")
def flagship_ground_by_cell(t):
    ground = points_with_tile(t, 11).where(F.col("classification").isin(2, 9))
    return ground.groupBy("tx", "ty").agg(F.count("*").alias("n"), F.min("z_cm").alias("z_min"), F.max("z_cm").alias("z_max"))


@query(f"SELECT l_orderkey, l_linenumber, {_TX11} AS tx, {_TY11} AS ty FROM v_point")
def scl01_lonlat_to_tile(t):
    return points_with_tile(t, 11).select("l_orderkey", "l_linenumber", "tx", "ty")


@query("SELECT DISTINCT x, y, level, round(x / power(2, level) * 360.0 - 180.0, 6) AS lon, round(degrees(atan(sinh(pi() * (1 - 2 * y / power(2, level))))), 6) AS lat FROM v_tile WHERE level = 15")
def scl02_tile_to_lonlat(t):
    lon, lat = tiles.tile_lonlat(F.col("x"), F.col("y"), 15)
    return t.v_tile.where("level = 15").select("x", "y", "level", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat")).distinct()


@query("""SELECT DISTINCT x, y, round(x / 32768.0 * 360 - 180, 6) AS west, round((x + 1) / 32768.0 * 360 - 180, 6) AS east,
 round(degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 32768.0)))), 6) AS south, round(degrees(atan(sinh(pi() * (1 - 2 * y / 32768.0)))), 6) AS north FROM v_hd""")
def scl03_tile_bounds(t):
    b = t.v_hd.select("x", "y", tiles.tile_bounds(F.col("x"), F.col("y"), 15).alias("b"))
    return b.select("x", "y", *[F.round(f"b.{k}", 6).alias(k) for k in ("west", "east", "south", "north")]).distinct()


@query("""SELECT l_orderkey, l_linenumber, round((lon_u / 1e6 + 180.0) / 360.0 * 1024 * 256, 4) AS px,
 round((0.5 - ln((1 + sin(radians(lat_u / 1e6))) / (1 - sin(radians(lat_u / 1e6)))) / (4 * pi())) * 1024 * 256, 4) AS py FROM v_point""")
def scl04_world_pixel(t):
    px, py = tiles.world_pixel(*lonlat(), 10)
    return t.v_point.select("l_orderkey", "l_linenumber", F.round(px, 4).alias("px"), F.round(py, 4).alias("py"))


@query(f"SELECT l_orderkey, l_linenumber, round(6378137.0 * radians(lon_u / 1e6) / {K}, 3) AS wx, round(6378137.0 * ln(tan(pi() / 4 + radians(lat_u / 1e6) / 2)) / {K}, 3) AS wy FROM v_point")
def scl05_geodetic_to_work(t):
    x, y = frames.geodetic_to_work(*lonlat())
    return t.v_point.select("l_orderkey", "l_linenumber", F.round(x, 3).alias("wx"), F.round(y, 3).alias("wy"))


@query("SELECT l_orderkey, l_linenumber, round(lon_u / 1e6, 6) AS lon, round(lat_u / 1e6, 6) AS lat FROM v_point")
def scl05_work_round_trip(t):
    lon, lat = frames.convert(*frames.convert(*lonlat(), "geodetic", "work"), "work", "geodetic")
    return t.v_point.select("l_orderkey", "l_linenumber", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


_L93 = f"""SELECT l_orderkey, l_linenumber, round({frames.L93_X0} + rho * sin(th), 2) AS x, round({frames.L93_Y0} + {frames.LCC_RHO0!r} - rho * cos(th), 2) AS y FROM (
 SELECT *, {frames.LCC_C!r} * power(tan(pi() / 4 - phi / 2) / power((1 - e * sin(phi)) / (1 + e * sin(phi)), e / 2), {frames.LCC_N!r}) AS rho, {frames.LCC_N!r} * radians(lon_u / 1e6 - 3.0) AS th
 FROM (SELECT *, radians(lat_u / 1e6) AS phi, {frames.LCC_E!r} AS e FROM v_point))"""


@query(_L93)
def scl06_geodetic_to_l93(t):
    x, y = frames.geodetic_to_l93(*lonlat())
    return t.v_point.select("l_orderkey", "l_linenumber", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


@query("SELECT l_orderkey, l_linenumber, round(lon_u / 1e6, 6) AS lon, round(lat_u / 1e6, 6) AS lat FROM v_point")
def scl06_l93_round_trip(t):
    lon, lat = frames.l93_to_geodetic(*frames.geodetic_to_l93(*lonlat()))
    return t.v_point.select("l_orderkey", "l_linenumber", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query(f"SELECT l_orderkey, l_linenumber, round(6378137.0 * radians(lon_u / 1e6) / {K}, 2) AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(lat_u / 1e6) / 2)) / {K}, 2) AS y, z_cm FROM v_point")
def scl07_convert_l93_to_work(t):
    x, y = frames.convert(*frames.geodetic_to_l93(*lonlat()), "l93", "work")
    return t.v_point.select("l_orderkey", "l_linenumber", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"), "z_cm")


@query("SELECT document_id, (x_m - 50000.0)::DOUBLE AS lx, (y_m - 40000.0)::DOUBLE AS ly FROM v_poi")
def scl08_merc_to_local(t):
    x, y = frames.local_from_work(F.col("x_m"), F.col("y_m"), (50000.0, 40000.0))
    return t.v_poi.select("document_id", x.alias("lx"), y.alias("ly"))


@query(f"""SELECT l_orderkey, l_linenumber, CAST(floor((wx + ext) / (2 * ext / 2048)) AS BIGINT) AS tx, CAST(floor((ext - wy) / (2 * ext / 2048)) AS BIGINT) AS ty FROM (
 SELECT *, 6378137.0 * radians(lon_u / 1e6) / {K} AS wx, 6378137.0 * ln(tan(pi() / 4 + radians(lat_u / 1e6) / 2)) / {K} AS wy, 20037508.342789244 / {K} AS ext FROM v_point)""")
def scl09_work_tile_of(t):
    tx, ty = frames.work_tile_of(*frames.geodetic_to_work(*lonlat()), 11)
    return t.v_point.select("l_orderkey", "l_linenumber", tx.alias("tx"), ty.alias("ty"))


@query(f"""SELECT DISTINCT x, y, round(x * s - ext, 2) AS x0, round(ext - y * s - s, 2) AS y0, round(x * s - ext + s, 2) AS x1, round(ext - y * s, 2) AS y1
 FROM (SELECT x, y, 20037508.342789244 / {K} AS ext, 2 * 20037508.342789244 / {K} / 32768 AS s FROM v_hd)""")
def scl09_work_tile_bounds(t):
    b = frames.work_tile_bounds(F.col("x"), F.col("y"), 15)
    return t.v_hd.select("x", "y", *[F.round(c, 2).alias(k) for k, c in zip(("x0", "y0", "x1", "y1"), b)]).distinct()


@query("SELECT DISTINCT level, x, y, round(x * s - 20037508.342789244, 3) AS x0, round(20037508.342789244 - (y + 1) * s, 3) AS y0, round(s, 3) AS side FROM (SELECT *, 40075016.685578488 / power(2, level) AS s FROM v_tile)")
def scl10_mercator_bounds(t):
    x0, y0, s = frames.mercator_bounds(F.col("level"), F.col("x"), F.col("y"))
    return t.v_tile.select("level", "x", "y", F.round(x0, 3).alias("x0"), F.round(y0, 3).alias("y0"), F.round(s, 3).alias("side")).distinct()


@query("SELECT o_orderkey, x >> CAST(level - 11 AS INT) AS cell_x, y >> CAST(level - 11 AS INT) AS cell_y FROM v_tile")
def scl11_cell_of(t):
    cx, cy = tiles.cell_of(F.col("x"), F.col("y"), F.col("level"))
    return t.v_tile.select("o_orderkey", cx.alias("cell_x"), cy.alias("cell_y"))


_PATH = "concat(cx, '.', cy, '/', level - 11, '/', x % CAST(power(2, level - 11) AS BIGINT), '.', y % CAST(power(2, level - 11) AS BIGINT), '.glb')"


@query(f"SELECT o_orderkey, {_PATH} AS path FROM v_tile")
def scl12_tile_path(t):
    return t.v_tile.select("o_orderkey", tiles.tile_path(F.col("x"), F.col("y"), F.col("level")).alias("path"))


@query("SELECT o_orderkey, CAST(level AS BIGINT) AS level, x, y FROM v_tile")
def scl13_parse_tile_path(t):
    path = t.v_tile.select("o_orderkey", tiles.tile_path(F.col("x"), F.col("y"), F.col("level")).alias("path"))
    level, x, y = tiles.parse_tile_path(F.col("path"))
    return path.select("o_orderkey", level.alias("level"), x.alias("x"), y.alias("y"))


@query("""SELECT o_orderkey, iz, CAST(floor(x / power(2, level - iz)) AS BIGINT) AS ix, CAST(floor(y / power(2, level - iz)) AS BIGINT) AS iy
 FROM (SELECT *, least(level - 1, CASE WHEN o_orderkey % 2 = 0 THEN 18 ELSE 17 END) AS iz FROM v_tile)""")
def scl14_imagery_tile(t):
    z, x, y = tiles.imagery_tile(F.when(F.col("o_orderkey") % 2 == 0, "ortho").otherwise("plan"), F.col("x"), F.col("y"), F.col("level"))
    return t.v_tile.select("o_orderkey", z.alias("iz"), x.alias("ix"), y.alias("iy"))


@query("SELECT p_partkey, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM v_hd")
def scl15_demorton(t):
    coded = t.v_hd.select("p_partkey", tiles.morton(F.col("x"), F.col("y")).alias("code"))
    x, y = tiles.demorton(F.col("code"))
    return coded.select("p_partkey", x.alias("x"), y.alias("y"))


@query("SELECT document_id, CAST(900 + document_id % 90 AS BIGINT) AS x_km, CAST(6400 + document_id % 50 AS BIGINT) AS y_km FROM v_poi")
def scl16_stem_to_cell(t):
    named = t.v_poi.select("document_id", F.concat(F.lit("LHD_FXX_"), tiles.stem_of_km_cell(900 + F.col("document_id") % 90, 6400 + F.col("document_id") % 50), F.lit("_PTS.laz")).alias("stem"))
    x, y = tiles.km_cell_of_stem(F.col("stem"))
    return named.select("document_id", x.alias("x_km"), y.alias("y_km"))


@query("SELECT cleabs, least(x0, x1) - 50 AS bx0, least(y0, y1) - 50 AS by0, greatest(x0, x1) + 50 AS bx1, greatest(y0, y1) + 50 AS by1 FROM v_footprint")
def scl19_padded_bbox(t):
    c = F.col
    return t.v_footprint.select("cleabs", (F.least("x0", "x1") - 50).alias("bx0"), (F.least("y0", "y1") - 50).alias("by0"), (F.greatest("x0", "x1") + 50).alias("bx1"), (F.greatest(c("y0"), c("y1")) + 50).alias("by1"))


_PX = "(({0} + 180.0) / 360.0 * power(2, z) * 256)"
_PY = "((0.5 - ln((1 + sin(radians({0}))) / (1 - sin(radians({0})))) / (4 * pi())) * power(2, z) * 256)"


@query(f"""WITH b AS (SELECT document_id, 5.0 + document_id % 100 / 100.0 AS lon0, 45.0 AS lat0, 5.0 + document_id % 100 / 100.0 + (1 + document_id % 37) / 50.0 AS lon1, 45.0 + (1 + document_id % 29) / 60.0 AS lat1 FROM v_poi)
 SELECT document_id, CAST(coalesce(max(z) FILTER (WHERE {_PX.format('lon1')} - {_PX.format('lon0')} <= 800 AND {_PY.format('lat0')} - {_PY.format('lat1')} <= 600), 3) AS INT) AS zoom FROM b, range(3, 19) AS r(z) GROUP BY document_id""")
def scl20_best_fit_zoom(t):
    d = F.col("document_id")
    lon0, lat0 = 5.0 + d % 100 / 100.0, F.lit(45.0)
    return t.v_poi.select("document_id", tiles.best_fit_zoom(lon0, lat0, lon0 + (1 + d % 37) / 50.0, lat0 + (1 + d % 29) / 60.0, 800, 600).alias("zoom"))


@query("""SELECT cleabs, round(x0 - dx, 6) AS ax0, round(y0 - dy, 6) AS ay0, round(x1 + dx, 6) AS ax1, round(y1 + dy, 6) AS ay1 FROM (SELECT *,
 CASE WHEN (x1 - x0) < (y1 - y0) * 1.5 THEN ((y1 - y0) * 1.5 - (x1 - x0)) / 2 ELSE 0.0 END::DOUBLE AS dx, CASE WHEN (x1 - x0) > (y1 - y0) * 1.5 THEN ((x1 - x0) / 1.5 - (y1 - y0)) / 2 ELSE 0.0 END::DOUBLE AS dy FROM v_footprint)""")
def scl21_pad_to_aspect(t):
    out = tiles.pad_to_aspect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), 1.5)
    return t.v_footprint.select("cleabs", *[F.round(c.cast("double"), 6).alias(k) for k, c in zip(("ax0", "ay0", "ax1", "ay1"), out)])


@query("SELECT o_orderkey, CASE WHEN bytes < 2000 THEN least(10, CAST(floor(log2(1 / (0.75 * s))) AS BIGINT)) ELSE least(11, CAST(floor(log2(1 / (0.75 * s))) AS BIGINT)) END AS depth FROM (SELECT *, (1 + o_orderkey % 97) / 100000.0::DOUBLE AS s FROM v_tile)")
def scl23_guess_depth(t):
    depth = F.floor(F.log2(1 / (0.75 * ((1 + F.col("o_orderkey") % 97) / 100000.0)))).cast("long")
    return t.v_tile.select("o_orderkey", F.least(F.when(F.col("bytes") < 2000, 10).otherwise(11).cast("long"), depth).alias("depth"))


@query("""WITH g AS (SELECT source_id, min(x_cm) AS x0, max(x_cm) AS x1, min(y_cm) AS y0, max(y_cm) AS y1, min(z_cm) AS z0, max(z_cm) AS z1 FROM v_point GROUP BY source_id)
 SELECT source_id, round(0.75 / greatest(x1 - x0, y1 - y0), 12) AS scale, round(0.5 - 0.75 * (x0 + x1) / 2.0 / greatest(x1 - x0, y1 - y0), 9) AS shift_x,
 round((0.5 - 0.75 * (z0 + z1) / 2.0 / greatest(x1 - x0, y1 - y0)) * 16) / 16 AS shift_z FROM g""")
def scl24_unit_cube(t):
    g = t.v_point.groupBy("source_id").agg(*[f(c).alias(c[0] + k) for c in ("x_cm", "y_cm", "z_cm") for f, k in ((F.min, "0"), (F.max, "1"))])
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    middle = lambda a: 0.5 - 0.75 * (F.col(a + "0") + F.col(a + "1")) / 2.0 / side
    return g.select("source_id", F.round(0.75 / side, 12).alias("scale"), F.round(middle("x"), 9).alias("shift_x"), (F.round(middle("z") * 16) / 16).alias("shift_z"))


@query("""WITH s AS (SELECT source_id, CAST(min(scan_angle) AS BIGINT) AS lo, CAST(max(scan_angle) AS BIGINT) AS hi FROM v_point WHERE scan_angle % 4 = source_id % 4 GROUP BY source_id)
 SELECT source_id, lo, hi, CAST(CASE WHEN hi - lo <= 10 THEN trunc((hi + lo) / 2.0) WHEN lo + 5 <= 0 AND hi - 5 >= 0 THEN 0 WHEN lo + 5 >= 0 THEN lo + 5 ELSE hi - 5 END AS BIGINT) AS repr FROM s""")
def scl26_representative_angle(t):
    s = t.v_point.where("scan_angle % 4 = source_id % 4").groupBy("source_id").agg(F.min("scan_angle").cast("long").alias("lo"), F.max("scan_angle").cast("long").alias("hi"))
    return s.select("source_id", "lo", "hi", geometry.representative_angle(F.col("lo"), F.col("hi")).alias("repr"))


_RECT = "SELECT document_id, 5.5 + document_id % 100 / 100.0 AS lon0, 44.5 AS lat0, 5.5 + document_id % 100 / 100.0 + (document_id % 7) / 10.0 AS lon1, 44.5 + (document_id % 5) / 10.0 AS lat1 FROM v_poi"
_T = lambda v, n: f"(({v} + 180.0) / 360.0 * {n})"
_U = lambda v, n: f"((0.5 - ln((1 + sin(radians({v}))) / (1 - sin(radians({v})))) / (4 * pi())) * {n})"
_COVER = f"""b AS ({_RECT}), r AS (SELECT document_id, CAST(floor({_T('lon0', '{n}')}) AS BIGINT) AS x0, CAST(ceil({_T('lon1', '{n}')}) - 1 AS BIGINT) AS x1, CAST(floor({_U('lat1', '{n}')}) AS BIGINT) AS y0, CAST(ceil({_U('lat0', '{n}')}) - 1 AS BIGINT) AS y1 FROM b),
 c AS (SELECT document_id, x, unnest(range(y0, y1 + 1)) AS y FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM r))"""


def _rects(t):
    d = F.col("document_id")
    return t.v_poi.select("document_id", (5.5 + d % 100 / 100.0).alias("lon0"), F.lit(44.5).alias("lat0"), (5.5 + d % 100 / 100.0 + (d % 7) / 10.0).alias("lon1"), (44.5 + (d % 5) / 10.0).alias("lat1"))


@query("WITH " + _COVER.replace("{n}", "2048.0") + " SELECT document_id, x, y FROM c")
def jon01_tiles_in_rect(t):
    return tiles.tiles_in_rect(_rects(t), *map(F.col, ("lon0", "lat0", "lon1", "lat1")), 11).select("document_id", "x", "y")


@query("WITH " + _COVER.replace("{n}", "2048.0") + " SELECT document_id, c.x * 4 + i.i AS x, c.y * 4 + j.i AS y FROM c, range(4) i(i), range(4) j(i)")
def jon02_tiles_in_rect_aligned(t):
    return tiles.tiles_in_rect_aligned(_rects(t), *map(F.col, ("lon0", "lat0", "lon1", "lat1")), 13, 11).select("document_id", "x", "y")


@query(f"""WITH b AS ({_RECT}) SELECT document_id, CAST(floor({_T('lon0', '1024.0')}) AS BIGINT) AS x0, CAST(floor({_T('lon1', '1024.0')}) AS BIGINT) AS x1, CAST(floor({_U('lat1', '1024.0')}) AS BIGINT) AS y0, CAST(floor({_U('lat0', '1024.0')}) AS BIGINT) AS y1 FROM b""")
def msc15_inclusive_tile_range(t):
    r = tiles.tile_range(*map(F.col, ("lon0", "lat0", "lon1", "lat1")), 10, upper="floor")
    return _rects(t).select("document_id", *[c.alias(k) for k, c in zip(("x0", "x1", "y0", "y1"), r)])


def required_km_cells(jobs, level, steps=4, margin=50.0):
    """km cells, named by their north-west corner, that a tile's outline needs in Lambert-93.

    The tile is grown by ``margin`` in the work frame; each edge is sampled at ``steps`` + 1 places.
    """
    x0, y0, x1, y1 = frames.work_tile_bounds(F.col("x"), F.col("y"), level)
    x0, y0, x1, y1 = x0 - margin, y0 - margin, x1 + margin, y1 + margin
    at = F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k")
    s = F.col("k") / steps
    edge = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    outline = jobs.select("x", "y", at).withColumn("p", F.explode(F.array(edge(x0 + (x1 - x0) * s, y0), edge(x0 + (x1 - x0) * s, y1), edge(x0, y0 + (y1 - y0) * s), edge(x1, y0 + (y1 - y0) * s))))
    lx, ly = frames.convert(F.col("p.x"), F.col("p.y"), "work", "l93")
    box = outline.select("x", "y", lx.alias("lx"), ly.alias("ly")).groupBy("x", "y").agg(F.min("lx").alias("a"), F.max("lx").alias("b"), F.min("ly").alias("c"), F.max("ly").alias("d"))
    west, north = (lambda v: F.floor(F.col(v) / 1000).cast("long")), (lambda v: F.ceil(F.col(v) / 1000).cast("long"))
    return tiles.explode_tiles(box, west("a"), west("b"), north("c"), north("d"), "x_km", "y_km").select("x", "y", "x_km", "y_km")


@query(f"""WITH j AS (SELECT DISTINCT x, y FROM v_hd), k AS (SELECT x, y, 20037508.342789244 / {K} AS ext, 2 * 20037508.342789244 / {K} / 32768 AS s FROM j),
 e AS (SELECT x, y, x * s - ext - 50 AS x0, ext - y * s - s - 50 AS y0, s + 100 AS s, i / 4.0::DOUBLE AS f FROM k, range(5) r(i)),
 p AS (SELECT x, y, x0 + s * f AS px, y0 AS py FROM e UNION ALL SELECT x, y, x0 + s * f, y0 + s FROM e UNION ALL SELECT x, y, x0, y0 + s * f FROM e UNION ALL SELECT x, y, x0 + s, y0 + s * f FROM e),
 g AS (SELECT x, y, radians(degrees(px * {K} / 6378137.0) - 3.0) AS lam, 2 * atan(exp(py * {K} / 6378137.0)) - pi() / 2 AS phi, {frames.LCC_E!r} AS e FROM p),
 q AS (SELECT x, y, {frames.LCC_C!r} * power(tan(pi() / 4 - phi / 2) / power((1 - e * sin(phi)) / (1 + e * sin(phi)), e / 2), {frames.LCC_N!r}) AS rho, {frames.LCC_N!r} * lam AS th FROM g),
 b AS (SELECT x, y, min({frames.L93_X0} + rho * sin(th)) AS a, max({frames.L93_X0} + rho * sin(th)) AS b, min({frames.L93_Y0} + {frames.LCC_RHO0!r} - rho * cos(th)) AS c, max({frames.L93_Y0} + {frames.LCC_RHO0!r} - rho * cos(th)) AS d FROM q GROUP BY x, y)
 SELECT x, y, x_km, unnest(range(CAST(ceil(c / 1000) AS BIGINT), CAST(ceil(d / 1000) AS BIGINT) + 1)) AS y_km FROM (SELECT *, unnest(range(CAST(floor(a / 1000) AS BIGINT), CAST(floor(b / 1000) AS BIGINT) + 1)) AS x_km FROM b)""")
def jon03_required_km_cells(t):
    return required_km_cells(t.v_hd.select("x", "y").distinct(), 15)
