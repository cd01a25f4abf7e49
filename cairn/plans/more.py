"""Queries on the smaller helpers: keys, paths, boxes, documents, composed pipelines."""

from pyspark.sql import functions as F

from cairn.functions import frames, geometry, tiles
from cairn.operators import pointcloud as pc
from cairn.operators.ordered import numbered
from cairn.plans.registry import query
from cairn.plans.tiling import K, lonlat

C = F.col
_SHIFT = "CAST(level - 11 AS INT)"


@query(f"SELECT o_orderkey, concat('https://tiles.example/', cx, '.', cy, '/', level - 11, '/', x % (1 << {_SHIFT}), '.', y % (1 << {_SHIFT}), '.glb') AS url, level, x, y FROM v_tile")
def scl13_key_from_url(t):
    url = F.concat(F.lit("https://tiles.example/"), tiles.tile_path(C("x"), C("y"), C("level")))
    p = t.v_tile.select("o_orderkey", url.alias("url"))
    level, x, y = tiles.parse_tile_path(F.regexp_extract("url", r"([0-9]+\.[0-9]+/[0-9]+/[0-9]+\.[0-9]+\.glb)$", 1))
    return p.select("o_orderkey", "url", level.alias("level"), x.alias("x"), y.alias("y"))


@query("SELECT o_orderkey, CAST(cx AS BIGINT) AS cx, CAST(cy AS BIGINT) AS cy, CAST(level - 11 AS BIGINT) AS depth FROM v_tile")
def scl17_subtree_path(t):
    path = F.concat(F.lit("subtrees/"), F.concat_ws(".", "cx", "cy"), F.lit("/"), C("level") - 11, F.lit(".0.0.subtree"))
    part = lambda k: F.regexp_extract("p", r"^subtrees/([0-9]+)\.([0-9]+)/([0-9]+)\.([0-9]+)\.([0-9]+)\.subtree$", k).cast("long")
    return t.v_tile.select("o_orderkey", path.alias("p")).select("o_orderkey", part(1).alias("cx"), part(2).alias("cy"), part(3).alias("depth"))


@query("SELECT document_id, round((x_m * 1.4267 - 2000) / 50000, 9)::DOUBLE AS u, round((y_m * 1.4267 - 3000) / 50000, 9)::DOUBLE AS v FROM v_poi")
def scl18_texture_coordinates(t):
    uv = lambda c, low: F.round(((C(c) * 1.4267 - low) / 50000).cast("double"), 9)
    return t.v_poi.select("document_id", uv("x_m", 2000).alias("u"), uv("y_m", 3000).alias("v"))


@query("SELECT p_partkey, (coalesce(zt, z_hi) / 2.0)::DOUBLE AS middle, (coalesce(zt, z_hi) / 2.0)::DOUBLE AS half FROM v_hd LEFT JOIN (SELECT x, y, max(bytes) % 4000 AS zt FROM v_tile WHERE level = 15 GROUP BY ALL) k USING (x, y)")
def scl22_z_box(t):
    k = t.v_tile.where("level = 15").groupBy("x", "y").agg((F.max("bytes") % 4000).alias("zt"))
    half = (F.coalesce("zt", "z_hi") / 2.0).cast("double")
    return t.v_hd.join(k, ["x", "y"], "left").select("p_partkey", half.alias("middle"), half.alias("half"))


@query("SELECT p_partkey, concat_ws(',', 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, x, y, z_hi, 1) AS matrix FROM v_hd")
def scl25_translation_matrix(t):
    cells = F.array(*[F.lit(v) for v in (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0)], C("x"), C("y"), C("z_hi"), F.lit(1))
    return t.v_hd.select("p_partkey", F.array_join(cells, ",").alias("matrix"))


@query("SELECT cleabs, (x1 - x0) * (y1 - y0) AS crossed, round(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)), 9) AS diagonal FROM v_footprint")
def scl31_plane_vectors(t):
    dx, dy = C("x1") - C("x0"), C("y1") - C("y0")
    return t.v_footprint.select("cleabs", (dx * dy).alias("crossed"), F.round(F.sqrt((dx * dx + dy * dy).cast("double")), 9).alias("diagonal"))


@query("SELECT cleabs, (2 * (x1 - x0) * (y1 - y0))::DOUBLE AS nz, 'z' AS axis FROM v_footprint")
def scl35_newell_normal(t):
    p = lambda x, y: F.struct(C(x).alias("x"), C(y).alias("y"), F.lit(5).cast("long").alias("z"))
    ring = F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"))
    turned = F.concat(F.slice("ring", 2, 3), F.slice("ring", 1, 1))
    part = lambda a, b: F.aggregate(F.zip_with("ring", turned, lambda u, v: (u[a] - v[a]) * (u[b] + v[b])), F.lit(0).cast("long"), lambda s, v: s + v).cast("double")
    n = t.v_footprint.select("cleabs", ring.alias("ring")).select("cleabs", part("y", "z").alias("nx"), part("z", "x").alias("ny"), part("x", "y").alias("nz"))
    axis = F.when((F.abs("nz") >= F.abs("nx")) & (F.abs("nz") >= F.abs("ny")), "z").when(F.abs("ny") >= F.abs("nx"), "y").otherwise("x")
    return n.select("cleabs", "nz", axis.alias("axis"))


@query("SELECT document_id, x_m BETWEEN 2000 AND 98000 AND y_m BETWEEN 2000 AND 98000 AND coalesce(elevation, 0) < 5000 AS allowed FROM v_poi")
def scl46_target_allowed(t):
    inside = C("x_m").between(2000, 98000) & C("y_m").between(2000, 98000)
    return t.v_poi.select("document_id", (inside & (F.coalesce(C("elevation"), F.lit(0)) < 5000)).alias("allowed"))


#: Texts as base64, with and without padding, and one that isn't base64.
_ENCODED = "'QWxwcw=='", "'TW9udCBCbGFuYw=='", "'Q29sIGR1IFRvdXI='", "'w4ljcmlucw=='", "''", "'not base64!'"


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Alps' WHEN 1 THEN 'Mont Blanc' WHEN 2 THEN 'Col du Tour' WHEN 3 THEN 'Écrins' WHEN 4 THEN '' END AS decoded FROM documents")
def scl57_base64_decode(t):
    """Known texts decoded; what isn't base64 gives null."""
    coded = F.element_at(F.expr(f"array({', '.join(_ENCODED)})"), (C("doc_id") % 6 + 1).cast("int"))
    return t.documents.select("doc_id", coded.alias("coded")).select("doc_id", F.try_to_binary("coded", F.lit("base64")).cast("string").alias("decoded"))


@query("SELECT cx, cy, count(*) FILTER (WHERE bytes > 0) AS n FROM v_tile GROUP BY ALL")
def src24_cell_documents(t):
    import uuid

    from cairn.session import shared_dir

    root = f"{shared_dir(t.spark)}/cells-{uuid.uuid4().hex}"
    cells = t.v_tile.groupBy("cx", "cy").agg(F.collect_list(F.when(C("bytes") > 0, C("x"))).alias("hdX"))
    cells.write.json(root)
    back = t.spark.read.schema("cx bigint, cy bigint, hdX array<bigint>, hdZHi array<bigint>").option("mode", "PERMISSIVE").json(root)
    return back.select("cx", "cy", F.size(F.coalesce("hdX", F.array())).cast("long").alias("n"))


@query("SELECT r_name AS area, count(*) AS corners, round(sum(x) / 1000.0, 3)::DOUBLE AS x FROM (SELECT r_name, unnest(range(4)) * 10 + r_regionkey AS x FROM region WHERE r_name LIKE '%A%') GROUP BY r_name")
def src37_area_polygon(t):
    ring = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array((i * 10 + C("r_regionkey")).cast("double"), i.cast("double")))
    doc = t.region.where(C("r_name").contains("A")).select("r_name", F.to_json(F.struct(F.to_json(F.struct(ring.alias("coordinates"))).alias("geom_detail"))).alias("doc"))
    pts = F.from_json(F.get_json_object("doc", "$.geom_detail"), "coordinates array<array<double>>")["coordinates"]
    return doc.select(C("r_name").alias("area"), F.explode(pts).alias("p")).groupBy("area").agg(F.count("*").alias("corners"), F.round(F.sum(C("p")[0]) / 1000.0, 3).alias("x"))


@query("SELECT level, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM v_tile WHERE level - 11 <= 3 GROUP BY level")
def src06_levels_up_to_resolution(t):
    deepest = F.floor(F.log2(F.lit(8.0) / F.lit(1.0))).cast("int")
    return t.v_tile.where(C("level") - 11 <= deepest).groupBy("level").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query("SELECT concat(cx, '.', cy) AS stem FROM (SELECT DISTINCT cx, cy FROM v_tile WHERE cx % 2 = 0)")
def msc12_list_stems(t):
    names = t.v_tile.select(F.concat(F.concat_ws(".", "cx", "cy"), F.when(C("cx") % 2 == 0, ".city.jsonl").otherwise(".txt")).alias("name")).distinct()
    return names.where(C("name").endswith(".city.jsonl")).select(F.regexp_replace("name", r"\.city\.jsonl$", "").alias("stem"))


@query("SELECT level, count(*) AS files FROM v_tile WHERE bytes > 0 AND level >= 13 GROUP BY level")
def snk11_sync_filter(t):
    listing = t.v_tile.where("bytes > 0").select(tiles.tile_path(C("x"), C("y"), C("level")).alias("path"))
    level, _, _ = tiles.parse_tile_path(C("path"))
    return listing.where(C("path").endswith(".glb")).select(level.alias("level")).where("level >= 13").groupBy("level").agg(F.count("*").alias("files"))


@query("SELECT o_orderkey, round(1.0 / (1 + o_orderkey % 7), 12)::DOUBLE AS scale, o_orderkey % 13 AS shift FROM v_tile")
def snk13_transform_side_file(t):
    """Side files of one line a tile, written by level and read back."""
    from cairn.plans.files import _folder

    line = F.concat_ws(" ", "o_orderkey", F.round(1.0 / (1 + C("o_orderkey") % 7), 12), C("o_orderkey") % 13)
    root = _folder(t, "transforms")
    t.v_tile.select("level", line.alias("value")).write.partitionBy("level").text(root)
    w = t.spark.read.text(root).select(F.split("value", " ").alias("w"))
    return w.select(C("w")[0].cast("long").alias("o_orderkey"), C("w")[1].cast("double").alias("scale"), C("w")[2].cast("long").alias("shift"))


@query("SELECT level, cx, cy, count(DISTINCT (x, y)) AS tiles FROM v_tile WHERE bytes > 0 GROUP BY ALL")
def snk05_msc10_level_counts(t):
    return t.v_tile.where("bytes > 0").select("level", "cx", "cy", "x", "y").distinct().groupBy("level", "cx", "cy").agg(F.count("*").alias("tiles"))


_HIT = "SELECT document_id, x_m // 1000 AS kx, y_m // 1000 - 1 AS ky FROM v_poi"


@query(f"SELECT document_id, kx, ky, cleabs FROM ({_HIT}) LEFT JOIN (SELECT x0 // 50 AS fx, y0 // 50 AS fy, min(cleabs) AS cleabs FROM v_footprint GROUP BY ALL) f ON kx = fx AND ky = fy")
def msc01_cell_to_file(t):
    k = lambda c, n: F.floor(C(c) / n).cast("long")
    f = t.v_footprint.groupBy(k("x0", 50).alias("kx"), k("y0", 50).alias("ky")).agg(F.min("cleabs").alias("cleabs"))
    return t.v_poi.select("document_id", k("x_m", 1000).alias("kx"), (k("y_m", 1000) - 1).alias("ky")).join(f, ["kx", "ky"], "left").select("document_id", "kx", "ky", "cleabs")


@query(f"SELECT l_orderkey, l_linenumber, round(6378137.0 * radians(lon_u / 1e6) / {K} - 400000, 2) AS lx, round(6378137.0 * ln(tan(pi() / 4 + radians(lat_u / 1e6) / 2)) / {K} - 4000000, 2) AS ly, z_cm - 50000 AS lz FROM v_point")
def msc04_msc05_scene_frame(t):
    x, y = frames.local_from_work(*frames.geodetic_to_work(*lonlat()), (400000, 4000000))
    return t.v_point.select("l_orderkey", "l_linenumber", F.round(x, 2).alias("lx"), F.round(y, 2).alias("ly"), (C("z_cm") - 50000).alias("lz"))


@query("SELECT DISTINCT level, x, y, round(x * s - 20037508.342789244, 3) AS x0, round(20037508.342789244 - y * s, 3) AS y1 FROM (SELECT *, 40075016.685578488 / power(2, level) AS s FROM v_tile)")
def msc07_tile_mercator_box(t):
    x0, y0, s = frames.mercator_bounds(C("level"), C("x"), C("y"))
    return t.v_tile.select("level", "x", "y", F.round(x0, 3).alias("x0"), F.round(y0 + s, 3).alias("y1")).distinct()


@query("SELECT DISTINCT x >> 4 AS cx, y >> 4 AS cy, round((x >> 4) / 2048.0 * 360 - 180, 6)::DOUBLE AS west, round(((x >> 4) + 1) / 2048.0 * 360 - 180, 6)::DOUBLE AS east FROM v_hd")
def msc16_built_boxes(t):
    cx, cy = tiles.cell_of(C("x"), C("y"), 15)
    b = t.v_hd.select(cx.alias("cx"), cy.alias("cy")).distinct().select("cx", "cy", tiles.tile_bounds(C("cx"), C("cy"), 11).alias("b"))
    return b.select("cx", "cy", F.round("b.west", 6).alias("west"), F.round("b.east", 6).alias("east"))


@query("SELECT cleabs FROM v_footprint WHERE cleabs NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 = 0)")
def msc18_skip_existing(t):
    return t.v_footprint.select("cleabs").join(t.supplier.where("s_suppkey % 4 = 0").select(C("s_suppkey").alias("cleabs")), "cleabs", "left_anti")


@query("SELECT l_orderkey, l_linenumber, round(x_cm / 100.0 * 0.5 - 1200, 3)::DOUBLE AS x, round(y_cm / 100.0 * 0.5 - 900, 3)::DOUBLE AS y FROM v_point WHERE classification = 2")
def msc23_reframed_ground(t):
    frame = lambda c, shift: F.round((C(c) / 100.0 * 0.5 - shift).cast("double"), 3)
    return t.v_point.where("classification = 2").select("l_orderkey", "l_linenumber", frame("x_cm", 1200).alias("x"), frame("y_cm", 900).alias("y"))


@query("SELECT document_id, arg_min(cleabs, ((x1 - x0) * (y1 - y0), cleabs)) AS owner, count(*) AS candidates FROM (SELECT document_id, x_m % 5000 AS x, y_m % 5000 AS y FROM v_poi) p JOIN v_footprint ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY document_id")
def msc24_tile_under_crosshair(t):
    from cairn.operators.spatial_join import point_in_box_join

    p = t.v_poi.select("document_id", (C("x_m") % 5000).alias("x"), (C("y_m") % 5000).alias("y"))
    hit = point_in_box_join(p, t.v_footprint, "x", "y", ("x0", "y0", "x1", "y1"), 64)
    area = (C("x1") - C("x0")) * (C("y1") - C("y0"))
    return hit.groupBy("document_id").agg(F.min_by("cleabs", F.struct(area.alias("a"), "cleabs")).alias("owner"), F.count("*").alias("candidates"))


@query("SELECT document_id, row_number() OVER (PARTITION BY waypoint_type ORDER BY sqrt(x_m * x_m + y_m * y_m), document_id) AS pos FROM v_poi")
def ord06_depth_sort(t):
    depth = F.sqrt((C("x_m") * C("x_m") + C("y_m") * C("y_m")).cast("double"))
    return numbered(t.v_poi.select("document_id", "waypoint_type", depth.alias("depth")), ["waypoint_type"], ["depth", "document_id"], "pos").select("document_id", "pos")


@query("WITH p AS (SELECT document_id AS id, x_m % 5000 AS x, y_m % 5000 AS y FROM v_poi), d AS (SELECT id, sqrt(((p.x - x0) * (p.x - x0) + (p.y - y0) * (p.y - y0))::DOUBLE) AS d FROM p, v_footprint QUALIFY row_number() OVER (PARTITION BY id ORDER BY (p.x - x0) * (p.x - x0) + (p.y - y0) * (p.y - y0), cleabs) = 6) SELECT round(quantile_cont(d, 0.5), 6) AS scale FROM d")
def agg27_range_scale(t):
    from cairn.operators.spatial_join import nearest_join

    p = t.v_poi.select(C("document_id").alias("id"), (C("x_m") % 5000).alias("x"), (C("y_m") % 5000).alias("y"))
    q = t.v_footprint.select(C("cleabs").alias("gid"), C("x0").alias("px"), C("y0").alias("py"))
    sixth = nearest_join(p, q, "id", "gid", 6, 800.0).where("rn = 6").groupBy("d2").agg(F.count("*").alias("n"))
    return sixth.agg(F.round(F.percentile(F.sqrt("d2"), 0.5, C("n")), 6).alias("scale"))


@query()
def ana14_lod_chain(t):
    """Largest component, welded, simplified, clipped to a tile and rescaled."""
    from cairn.operators import mesh
    from cairn.operators.kernels import simplify_tiles

    v, f = mesh.weld(t.v_mesh_vertex, mesh.largest_component(t.v_mesh_face))
    tri = simplify_tiles(mesh.corners(v, f).withColumn("tile", F.lit(0)), "tile", 200)
    return tri.select("fid", *[(C(k + d) * 0.5).alias(k + d) for k in "abc" for d in "xyz"])


@query("""WITH c AS (SELECT x_cm // 20000 AS i, y_cm // 20000 AS j, max(z_cm) AS h FROM v_point WHERE classification IN (5, 3) GROUP BY ALL),
 m AS (SELECT i, j, h FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.i BETWEEN a.i - 2 AND a.i + 2 AND b.j BETWEEN a.j - 2 AND a.j + 2 AND b.h > a.h)) SELECT i, j, h FROM m WHERE h >= 200""")
def ana19_vegetation(t):
    """Crown tops: canopy heights of the vegetation classes, local maxima, tall ones only."""
    canopy = pc.grid_key(t.v_point.where(C("classification").isin(3, 5)), 20000).groupBy("i", "j").agg(F.max("z_cm").alias("h"))
    return pc.local_maxima(canopy, 2).where("h >= 200")


@query("SELECT cleabs, count(document_id) AS pois, coalesce(max(elevation), 0)::DOUBLE AS top FROM v_footprint LEFT JOIN (SELECT document_id, elevation, x_m % 5000 AS x, y_m % 5000 AS y FROM v_poi) p ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY cleabs")
def ana21_buildings(t):
    """Footprints with what stands on them."""
    from cairn.operators.spatial_join import point_in_box_join

    p = t.v_poi.select("document_id", C("elevation").cast("double").alias("elevation"), (C("x_m") % 5000).alias("x"), (C("y_m") % 5000).alias("y"))
    on = point_in_box_join(p, t.v_footprint, "x", "y", ("x0", "y0", "x1", "y1"), 64).groupBy("cleabs").agg(F.count("document_id").alias("pois"), F.max("elevation").alias("top"))
    return t.v_footprint.select("cleabs").join(on, "cleabs", "left").select("cleabs", F.coalesce("pois", F.lit(0)).alias("pois"), F.coalesce("top", F.lit(0.0)).alias("top"))


@query("SELECT 6378137.0::DOUBLE AS merc_radius, 11 AS cell_level, 15 AS lod_level0")
def src35_constants(t):
    from cairn.sources.documents import constants

    c = constants('{"_note": "x", "merc_radius": {"value": 6378137.0, "unit": "metres"}, "cell_level": {"value": 11}, "lod_level0": 15}')
    return t.spark.range(1).select(F.lit(c["merc_radius"]).alias("merc_radius"), F.lit(c["cell_level"]).alias("cell_level"), F.lit(c["lod_level0"]).alias("lod_level0"))


@query("SELECT level, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS files FROM v_tile WHERE bytes > 300000 GROUP BY level")
def src12_heavy_files(t):
    return t.v_tile.where("bytes > 300000").groupBy("level").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("files"))


@query("SELECT document_id, least(1 + document_id % 5, 3) AS attempt, document_id % 5 < 3 AS ok FROM v_poi WHERE elevation IS NULL")
def str09_retry_failed(t):
    """Documents without an elevation are asked for again, three times at most; some answer at the first time, some never."""
    from cairn.operators.events import retry

    asked = retry(t.v_poi.where("elevation IS NULL").select("document_id"), lambda jobs: jobs.withColumn("ok", C("document_id") % 5 < C("attempt")), 3)
    return asked.select("document_id", C("attempt").cast("long").alias("attempt"), "ok")


@query("SELECT z, x, y, CASE WHEN EXISTS (SELECT 1 FROM v_tile c WHERE c.bytes > 0 AND c.level = q.z AND c.x = q.x AND c.y = q.y) THEN 'own' ELSE 'placeholder' END AS shown FROM (SELECT DISTINCT level AS z, x, y FROM v_tile) q")
def str10_placeholder(t):
    q = t.v_tile.select(C("level").alias("z"), "x", "y").distinct()
    own = t.v_tile.where("bytes > 0").select(C("level").alias("z"), "x", "y").distinct().withColumn("own", F.lit(True))
    return q.join(own, ["z", "x", "y"], "left").select("z", "x", "y", F.when(C("own"), "own").otherwise("placeholder").alias("shown"))


@query("SELECT l_orderkey, l_linenumber, x_cm, l_suppkey & 15 AS returns, l_suppkey >> 2 AS high FROM v_point")
def src04_bit_fields(t):
    return t.v_point.select("l_orderkey", "l_linenumber", "x_cm", C("l_suppkey").bitwiseAND(15).alias("returns"), F.shiftright("l_suppkey", 2).alias("high"))


@query("SELECT cleabs, greatest(ax, x0) < least(ax + 900, x1) AND greatest(ay, y0) < least(ay + 700, y1) AS hit FROM (SELECT *, cleabs * 31 % 4000 AS ax, cleabs * 17 % 4000 AS ay FROM v_footprint)")
def flt07_pairwise_overlap(t):
    ax, ay = C("cleabs") * 31 % 4000, C("cleabs") * 17 % 4000
    return t.v_footprint.select("cleabs", geometry.boxes_overlap((ax, ay, ax + 900, ay + 700), tuple(map(C, ("x0", "y0", "x1", "y1")))).alias("hit"))


@query("SELECT p_partkey FROM v_hd WHERE 10 * (p_partkey % 251) >= 11 * (p_partkey % 191) AND 10 * (p_partkey % 251) >= 11 * (p_partkey % 83)")
def scl44_green_dominance(t):
    r, g, b = C("p_partkey") % 191, C("p_partkey") % 251, C("p_partkey") % 83
    return t.v_hd.where((10 * g >= 11 * r) & (10 * g >= 11 * b)).select("p_partkey")


@query("SELECT l_orderkey, l_linenumber, x_cm, CASE WHEN m > 255 THEN c // 256 ELSE c END AS colour, x_cm - (SELECT min(x_cm) FROM v_point) AS dx FROM (SELECT *, l_partkey * 97 % 65536 AS c, max(l_partkey * 97 % 65536) OVER () AS m FROM v_point)")
def src30_colour_depth(t):
    """Colours of 16 bits brought to 8 where any exceeds 255; places relative to the cloud's corner."""
    c = C("l_partkey") * 97 % 65536
    b = t.v_point.agg(F.max(c).alias("top"), F.min("x_cm").alias("low")).first()
    colour = F.floor(c / 256).cast("long") if b["top"] > 255 else c
    return t.v_point.select("l_orderkey", "l_linenumber", "x_cm", colour.alias("colour"), (C("x_cm") - b["low"]).alias("dx"))


@query("SELECT row, col, coalesce(z * 3 % 256, 0) AS r, coalesce(z * 5 % 256, 0) AS g, coalesce(z * 7 % 256, 0) AS b FROM v_raster")
def src34_image_long_form(t):
    band = lambda k: F.coalesce(C("z") * k % 256, F.lit(0)).cast("long")
    return t.v_raster.select("row", "col", band(3).alias("r"), band(5).alias("g"), band(7).alias("b"))


_CODE = " + ".join(f"((x // 10 >> {k}) & 1) * {4**k} + ((y // 10 >> {k}) & 1) * {2 * 4**k}" for k in range(5))


@query(f"SELECT vid, row_number() OVER (ORDER BY {_CODE}, vid) - 1 AS pos FROM v_mesh_vertex")
def ana15_vertex_order(t):
    """Vertices along a Morton curve, the relational counterpart of a cache-friendly order."""
    code = tiles.morton(F.floor(C("x") / 10), F.floor(C("y") / 10), 8)
    return numbered(t.v_mesh_vertex.select("vid", code.alias("code")), [], ["code", "vid"], "place").select("vid", (C("place") - 1).alias("pos"))


@query("SELECT min(z)::DOUBLE AS low, max(z)::DOUBLE AS high FROM (SELECT unnest([a, b, c]) AS vid FROM v_mesh_face) JOIN v_mesh_vertex USING (vid)")
def msc14_bounds_of_tile(t):
    from cairn.operators.mesh import corners
    from cairn.plans.files import _folder
    from cairn.sources import binary, meshes

    root = _folder(t, "glb")
    binary.write_files(meshes.encode_meshes(corners(t.v_mesh_vertex, t.v_mesh_face).withColumn("k", F.lit(1)), "k", "glb"), root)
    return meshes.read_glb_heights(t.spark, root).select("low", "high")


@query("SELECT vid + 1 AS v, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM v_mesh_vertex")
def msc20_obj_vertices(t):
    """Vertices and faces written as OBJ lines and read back."""
    import uuid

    from cairn.session import shared_dir
    from cairn.sources.meshes import read_obj, write_obj

    root = f"{shared_dir(t.spark)}/obj-{uuid.uuid4().hex}"
    write_obj(t.v_mesh_vertex.withColumn("vid", C("vid") + 1), t.v_mesh_face, root)
    return read_obj(t.spark, root)[0]


@query("SELECT vid, CAST(round(x / 1000.0 * 16383 / 0.23) AS BIGINT) AS qx, CAST(round(y / 1000.0 * 16383 / 0.23) AS BIGINT) AS qy FROM v_mesh_vertex")
def snk12_quantised_km(t):
    q = lambda c: F.round(C(c) / 1000.0 * 16383 / 0.23).cast("long")
    return t.v_mesh_vertex.select("vid", q("x").alias("qx"), q("y").alias("qy"))


@query("SELECT cx, cy, count(*) AS n FROM v_tile WHERE bytes > 0 GROUP BY ALL")
def str07_periodic_sync(t):
    """A stream of new tiles appended to a partitioned target, here until all that is there is done."""
    import uuid

    from cairn.session import shared_dir
    from cairn.streaming.events import sync

    root = f"{shared_dir(t.spark)}/sync-{uuid.uuid4().hex}"
    new = t.v_tile.where("bytes > 0").select(F.concat(F.lit("c"), F.concat_ws("_", "cx", "cy")).alias("cell"), "level", "x", "y")
    new.write.parquet(f"{root}/in")
    stream = t.spark.readStream.schema(new.schema).parquet(f"{root}/in")
    sync(stream, f"{root}/out", f"{root}/state", once=True).awaitTermination()
    part = lambda k: F.regexp_extract("cell", r"^c([0-9]+)_([0-9]+)$", k).cast("long")
    return t.spark.read.parquet(f"{root}/out").groupBy(part(1).alias("cx"), part(2).alias("cy")).agg(F.count("*").alias("n"))
