"""Queries on filters, scalar geometry, strings, ordering and sets."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.functions import geometry as g
from cairn.functions import text
from cairn.operators.ordered import numbered
from cairn.plans.registry import query

C = F.col


@query("SELECT l_orderkey, l_linenumber, x_cm, y_cm, z_cm, classification FROM v_point WHERE x_cm BETWEEN 200000 AND 700000 AND y_cm BETWEEN 100000 AND 800000 AND classification IN (2, 5, 9, 10, 11)")
def flt01_point_filter(t):
    p = t.v_point.where(C("x_cm").between(200000, 700000) & C("y_cm").between(100000, 800000) & C("classification").isin(2, 5, 9, 10, 11))
    return p.select("l_orderkey", "l_linenumber", "x_cm", "y_cm", "z_cm", "classification")


@query("SELECT source_id, count(*) AS kept FROM v_point WHERE x_cm BETWEEN 200000 AND 700000 AND classification IN (2, 9) GROUP BY source_id")
def flt02_append_survivors(t):
    return t.v_point.where(C("x_cm").between(200000, 700000) & C("classification").isin(2, 9)).groupBy("source_id").agg(F.count("*").alias("kept"))


@query("SELECT classification, count(*) AS n FROM v_point WHERE classification IN (3, 5) GROUP BY ALL")
def flt03_class_mask(t):
    return t.v_point.where(C("classification").isin(3, 5)).groupBy("classification").agg(F.count("*").alias("n"))


@query("SELECT row, col, z FROM v_raster WHERE z IS NOT NULL AND z <> 0")
def flt05_nodata_drop(t):
    return t.v_raster.withColumn("z", F.nullif("z", F.lit(0))).where("z IS NOT NULL")


@query("SELECT document_id FROM v_poi WHERE x_m BETWEEN 20000 - 50 AND 30000 + 50 AND y_m BETWEEN 10000 - 50 AND 90000 + 50")
def flt06_margin_crop(t):
    return t.v_poi.where(C("x_m").between(19950, 30050) & C("y_m").between(9950, 90050)).select("document_id")


@query("SELECT cleabs FROM v_footprint WHERE x0 < 3000 AND 1000 < x1 AND y0 < 4000 AND 500 < y1")
def flt07_overlap_pruning(t):
    box = tuple(map(C, ("x0", "y0", "x1", "y1")))
    return t.v_footprint.where(g.boxes_overlap(box, tuple(map(F.lit, (1000, 500, 3000, 4000))))).select("cleabs")


@query("SELECT x, y FROM v_hd ANTI JOIN (SELECT DISTINCT x AS tx, y AS ty FROM v_tile WHERE level = 15 AND bytes > 0) ON x = tx AND y = ty")
def flt08_not_yet_built(t):
    built = t.v_tile.where("level = 15 AND bytes > 0").select("x", "y").distinct()
    return t.v_hd.select("x", "y").join(built, ["x", "y"], "left_anti")


@query("SELECT source_id, count(*) AS n, max(z_cm) AS top FROM v_point WHERE classification = 5 GROUP BY source_id HAVING count(*) >= 20 AND max(z_cm) >= 200 AND greatest(max(x_cm) - min(x_cm), max(y_cm) - min(y_cm)) > 1000")
def flt09_crown_filter(t):
    s = t.v_point.where("classification = 5").groupBy("source_id").agg(F.count("*").alias("n"), F.max("z_cm").alias("top"), F.greatest(F.max("x_cm") - F.min("x_cm"), F.max("y_cm") - F.min("y_cm")).alias("w"))
    return s.where("n >= 20 AND top >= 200 AND w > 1000").select("source_id", "n", "top")


@query("""WITH b AS (SELECT min(x_cm) AS x0, max(x_cm) AS x1, min(y_cm) AS y0, max(y_cm) AS y1, count(*) AS n FROM v_point),
 w AS (SELECT (x0 + x1) / 2.0 AS mx, (y0 + y1) / 2.0 AS my, (x1 - x0) / 2.0 * sqrt(least(1.0, 4000.0 / n)) AS hx, (y1 - y0) / 2.0 * sqrt(least(1.0, 4000.0 / n)) AS hy FROM b)
 SELECT count(*) AS n, CAST(sum(z_cm) AS BIGINT) AS z FROM v_point, w WHERE abs(x_cm - mx) <= hx AND abs(y_cm - my) <= hy""")
def flt10_centre_window_sample(t):
    b = t.v_point.agg(F.min("x_cm").alias("x0"), F.max("x_cm").alias("x1"), F.min("y_cm").alias("y0"), F.max("y_cm").alias("y1"), F.count("*").alias("n")).first()
    share = min(1.0, 4000.0 / b["n"]) ** 0.5
    inside = (F.abs(C("x_cm") - (b["x0"] + b["x1"]) / 2.0) <= (b["x1"] - b["x0"]) / 2.0 * share) & (F.abs(C("y_cm") - (b["y0"] + b["y1"]) / 2.0) <= (b["y1"] - b["y0"]) / 2.0 * share)
    return t.v_point.where(inside).agg(F.count("*").alias("n"), F.sum("z_cm").alias("z"))


@query("SELECT document_id FROM v_poi WHERE x_m * 20 BETWEEN 50000 AND 1250000 AND 6000000 + y_m * 15 BETWEEN 6000000 AND 7200000")
def flt11_domain_guard(t):
    return t.v_poi.where((C("x_m") * 20).between(50_000, 1_250_000) & (6_000_000 + C("y_m") * 15).between(6_000_000, 7_200_000)).select("document_id")


@query("SELECT document_id FROM v_poi WHERE abs(x_m / 50000.0 - 1) <= 1 AND abs(y_m / 50000.0 - 1) <= 1 AND sqrt((x_m - 50000) * (x_m - 50000) + (y_m - 50000) * (y_m - 50000)) <= 30000")
def flt13_on_screen(t):
    dx, dy = C("x_m") - 50000, C("y_m") - 50000
    return t.v_poi.where((F.abs(C("x_m") / 50000.0 - 1) <= 1) & (F.abs(C("y_m") / 50000.0 - 1) <= 1) & (F.sqrt(dx * dx + dy * dy) <= 30000)).select("document_id")


@query("SELECT document_id, title, waypoint_type FROM v_poi WHERE waypoint_type IN ('hut', 'access', 'pass', 'summit') AND title IS NOT NULL AND title <> ''")
def flt17_search_filter(t):
    return t.v_poi.where(C("waypoint_type").isin("hut", "access", "pass", "summit") & (F.coalesce("title", F.lit("")) != "")).select("document_id", "title", "waypoint_type")


@query("SELECT cleabs, count(*) FILTER (WHERE max_level > 19) AS too_fine, max(max_level) AS level FROM v_hd JOIN v_footprint ON p_partkey % 10 = cleabs % 10 GROUP BY cleabs")
def flt19_level_sanity(t):
    checked = t.v_hd.withColumn("max_level", F.when(F.assert_true(C("max_level") <= 19).isNull(), C("max_level")))
    per = checked.groupBy((C("p_partkey") % 10).alias("k")).agg(F.count_if(C("max_level") > 19).alias("too_fine"), F.max("max_level").alias("level"))
    return t.v_footprint.withColumn("k", C("cleabs") % 10).join(per, "k").select("cleabs", "too_fine", "level")


_V = "(x_cm / 1000.0)::DOUBLE AS ax, (y_cm / 1000.0)::DOUBLE AS ay, (z_cm / 1000.0)::DOUBLE AS az, l_partkey::DOUBLE AS bx, l_suppkey::DOUBLE AS b2, l_linenumber::DOUBLE AS bz"


def _vectors(t):
    return (C("x_cm") / 1000.0, C("y_cm") / 1000.0, C("z_cm") / 1000.0), tuple(C(c).cast("double") for c in ("l_partkey", "l_suppkey", "l_linenumber"))


@query(f"SELECT l_orderkey, l_linenumber, round(ax * bx + ay * b2 + az * bz, 3) AS d, round(ay * bz - az * b2, 3) AS cx, round(az * bx - ax * bz, 3) AS cy, round(ax * b2 - ay * bx, 3) AS cz, round(bx / sqrt(bx * bx + b2 * b2 + bz * bz), 9) AS ux FROM (SELECT l_orderkey, l_linenumber, {_V} FROM v_point)")
def scl30_vector_algebra(t):
    a, b = _vectors(t)
    c = g.cross(a, b)
    return t.v_point.select("l_orderkey", "l_linenumber", F.round(g.dot(a, b), 3).alias("d"), *[F.round(v, 3).alias(k) for k, v in zip(("cx", "cy", "cz"), c)], F.round(g.normalize(b)[0], 9).alias("ux"))


@query("SELECT a.cleabs AS a, b.cleabs AS b, least(a.x0, b.x0) AS ux0, greatest(a.y1, b.y1) AS uy1, greatest(a.x0, b.x0) AS ix0, greatest(a.x0, b.x0) > least(a.x1, b.x1) OR greatest(a.y0, b.y0) > least(a.y1, b.y1) AS apart FROM v_footprint a JOIN v_footprint b ON b.cleabs = a.cleabs + 1")
def scl32_aabb(t):
    a = t.v_footprint.select("cleabs", *[C(k).alias("a" + k) for k in ("x0", "y0", "x1", "y1")])
    b = t.v_footprint.select(C("cleabs").alias("b"), *[C(k).alias("b" + k) for k in ("x0", "y0", "x1", "y1")])
    box = lambda p: tuple(C(p + k) for k in ("x0", "y0", "x1", "y1"))
    u, i = g.box_union(box("a"), box("b")), g.box_intersection(box("a"), box("b"))
    return a.join(b, C("b") == C("cleabs") + 1).select(C("cleabs").alias("a"), "b", u[0].alias("ux0"), u[3].alias("uy1"), i[0].alias("ix0"), g.box_empty(i).alias("apart"))


@query("SELECT l_orderkey, l_linenumber, round(x_cm + (y_cm - x_cm) * ((500000.0 - x_cm) / (y_cm - x_cm)), 4) AS cut FROM v_point WHERE (x_cm < 500000) <> (y_cm < 500000)")
def scl33_plane_cut(t):
    p = t.v_point.where((C("x_cm") < 500000) != (C("y_cm") < 500000))
    return p.select("l_orderkey", "l_linenumber", F.round(g.lerp(C("x_cm"), C("y_cm"), (500000.0 - C("x_cm")) / (C("y_cm") - C("x_cm"))), 4).alias("cut"))


@query("SELECT document_id, CASE WHEN h < -0.1 THEN 10 WHEN h < 0.2 THEN CAST(round(10 + (200 - 10) * (h + 0.1) / 0.3) AS INT) ELSE 200 END AS red FROM (SELECT document_id, sin(radians(document_id % 90 - 20)) AS h FROM v_poi)")
def scl37_sky_colour(t):
    h = F.sin(F.radians(C("document_id") % 90 - 20))
    return t.v_poi.select("document_id", F.when(h < -0.1, 10).when(h < 0.2, F.round(g.lerp(F.lit(10), F.lit(200), (h + 0.1) / 0.3)).cast("int")).otherwise(200).alias("red"))


@query("SELECT p_partkey, concat('hsl(210, 60%, ', 70 - (max_level - 15) * 10, '%)') AS shade FROM v_hd")
def scl38_level_shade(t):
    return t.v_hd.select("p_partkey", F.concat(F.lit("hsl(210, 60%, "), (70 - (C("max_level") - 15) * 10).cast("string"), F.lit("%)")).alias("shade"))


@query("SELECT document_id, round(cos(h) * sin(a), 9) AS x, round(cos(h) * cos(a), 9) AS y, round(sin(h), 9) AS z FROM (SELECT document_id, radians(document_id % 180 - 90) AS h, radians(document_id % 360) AS a FROM v_poi)")
def scl39_sun_direction(t):
    v = g.sun_direction(C("document_id") % 180 - 90, C("document_id") % 360)
    return t.v_poi.select("document_id", *[F.round(c, 9).alias(k) for k, c in zip("xyz", v)])


@query("SELECT document_id, round(k * k * (3 - 2 * k), 9) AS light FROM (SELECT document_id, least(1.0, greatest(0.0, (document_id % 50 / 50.0 - 0.2) / (0.7 - 0.2)))::DOUBLE AS k FROM v_poi)")
def scl40_lighting(t):
    return t.v_poi.select("document_id", F.round(g.smoothstep(0.2, 0.7, C("document_id") % 50 / 50.0), 9).alias("light"))


@query("SELECT document_id, CASE WHEN degrees(acos(document_id % 100 / 100.0)) < 55 THEN 'snow' ELSE 'rock' END AS surface FROM v_poi")
def scl41_slope_class(t):
    return t.v_poi.select("document_id", F.when(F.degrees(F.acos(C("document_id") % 100 / 100.0)) < 55, "snow").otherwise("rock").alias("surface"))


@query("SELECT document_id, round(least(1.0, greatest(0.25, document_id % 40 / 40.0)) * 0.8 + 0.2 * (document_id % 7) / 7.0, 9) AS lit FROM v_poi")
def scl42_shadow_lift(t):
    d = C("document_id")
    return t.v_poi.select("document_id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.25), d % 40 / 40.0)) * 0.8 + 0.2 * (d % 7) / 7.0, 9).alias("lit"))


@query("SELECT p_partkey, least(255, (p_partkey % 256) * 12 // 10) AS r FROM v_hd WHERE 10 * (p_partkey % 251) >= 11 * (p_partkey % 191) AND 10 * (p_partkey % 251) >= 11 * (p_partkey % 83)")
def scl43_crown_colour(t):
    k = C("p_partkey")
    green = (10 * (k % 251) >= 11 * (k % 191)) & (10 * (k % 251) >= 11 * (k % 83))
    return t.v_hd.where(green).select("p_partkey", F.least(F.lit(255).cast("long"), F.floor((k % 256) * 12 / 10).cast("long")).alias("r"))


@query("SELECT source_id, CASE WHEN avg(z_cm) > avg(z_cm - l_partkey * 100) THEN round(avg(z_cm - l_partkey * 100), 4) END AS ground, round(avg(z_cm), 4) AS top FROM v_point WHERE classification = 5 GROUP BY source_id")
def scl45_trunk(t):
    a = t.v_point.where("classification = 5").groupBy("source_id").agg((F.sum(C("z_cm") - C("l_partkey") * 100) / F.count("*")).alias("g"), (F.sum("z_cm") / F.count("*")).alias("top"))
    return a.select("source_id", F.when(C("top") > C("g"), F.round("g", 4)).alias("ground"), F.round("top", 4).alias("top"))


@query("SELECT c_custkey, concat('pic', c_custkey, 'SM.jpg') AS url FROM customer")
def scl50_image_url(t):
    return t.customer.select("c_custkey", text.image_url(F.concat(F.lit("pic"), C("c_custkey").cast("string"), F.lit(".jpg")), "SM").alias("url"))


@query(r"""SELECT doc_id, CAST(len(ids) AS INT) AS n, list_sort(ids)::VARCHAR AS ids, caption FROM (SELECT doc_id, list_distinct(regexp_extract_all(raw, '\[img=(\d+)([^\]]*)\](.*?)\[/img\]', 1)) AS ids, regexp_replace(raw, '\[img=\d+[^\]]*\]\s*(.*?)\s*\[/img\]', '\1', 'g') AS caption FROM v_doc)""")
def scl51_image_tags(t):
    ids = F.array_sort(text.image_ids(C("raw")))
    return t.v_doc.select("doc_id", F.size(ids).alias("n"), F.concat(F.lit("["), F.array_join(ids, ", "), F.lit("]")).alias("ids"), text.drop_image_tags(C("raw")).alias("caption"))


@query("SELECT document_id, concat_ws(' · ', upper(waypoint_type), CASE WHEN elevation IS NOT NULL THEN concat(CAST(floor(elevation) AS BIGINT), ' m') END) AS label FROM v_poi")
def scl52_label(t):
    return t.v_poi.select("document_id", text.label([F.upper("waypoint_type"), F.concat(F.floor("elevation").cast("string"), F.lit(" m"))], " · ").alias("label"))


@query("SELECT o_orderkey, concat(lpad(CAST((o_orderkey % 1440) // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0')) AS clock FROM orders")
def scl53_minutes_to_clock(t):
    return t.orders.select("o_orderkey", text.clock(C("o_orderkey") % 1440).alias("clock"))


@query("SELECT c_custkey, printf('%.4f', c_acctbal::DOUBLE) AS s FROM customer")
def scl54_number_format(t):
    return t.customer.select("c_custkey", F.format_string("%.4f", C("c_acctbal").cast("double")).alias("s"))


@query("""SELECT y, upper(string_agg(lpad(to_hex(b), 2, '0'), '' ORDER BY k)) AS bits FROM (SELECT y, k, CAST(sum(bit) AS BIGINT) AS b FROM (
 SELECT g.y, (g.x - 16912) // 8 AS k, CASE WHEN h.x IS NOT NULL THEN 1 << ((g.x - 16912) % 8)::INT ELSE 0 END AS bit
 FROM (SELECT DISTINCT y, 16912 + i AS x FROM v_hd, range(96) r(i)) g LEFT JOIN (SELECT DISTINCT x, y FROM v_hd WHERE max_level > 16) h USING (x, y)) GROUP BY y, k) GROUP BY y""")
def scl55_pack_bits(t):
    held = t.v_hd.groupBy("y").agg(F.collect_set(F.when(C("max_level") > 16, (C("x") - 16912).cast("int"))).alias("xs"))
    flags = F.transform(F.sequence(F.lit(0), F.lit(95)), lambda i: F.array_contains("xs", i))
    return held.select("y", text.pack_bits(flags).alias("bits"))


@query("SELECT y, to_base64(unhex(string_agg(concat(lpad(to_hex(x % 256), 2, '0'), lpad(to_hex(x // 256), 2, '0')), '' ORDER BY x))) AS packed FROM v_hd GROUP BY y")
def scl56_pack_u16(t):
    return t.v_hd.groupBy("y").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("y", text.pack_u16(C("xs")).alias("packed"))


@query("SELECT y, CAST(x AS INT) AS x, CAST(row_number() OVER (PARTITION BY y ORDER BY x) - 1 AS INT) AS pos FROM v_hd")
def src38_unpack_u16(t):
    packed = t.v_hd.groupBy("y").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("y", text.pack_u16(C("xs")).alias("p"))
    return packed.select("y", F.posexplode(text.unpack_u16(C("p"))).alias("pos", "x"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def scl58_null_safe_cast(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("SELECT c_custkey, c_name AS name FROM customer")
def scl59_strip_suffix(t):
    return t.customer.select("c_custkey", text.strip_suffix(F.concat("c_name", F.lit(".copc.laz")), ".copc.laz").alias("name"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS n_lines FROM documents")
def scl60_lines_of(t):
    kind = F.when(C("doc_id") % 2 == 0, "MultiLineString").otherwise("LineString")
    line = F.array(C("doc_id"), C("doc_id") + 1)
    return t.documents.select("doc_id", F.size(text.lines_of(kind, line, F.array(line, line))).alias("n_lines"))


@query("SELECT doc_id, CAST(3 AS INT) AS surfaces, doc_id * 3 + 3 AS total FROM documents")
def scl61_flatten_surfaces(t):
    d = C("doc_id")
    flat = F.flatten(F.array(F.array(d, d + 1), F.array(d + 2)))
    return t.documents.select("doc_id", F.size(flat).alias("surfaces"), F.aggregate(flat, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT o_orderkey, concat_ws(' ', 'build', CAST(x AS VARCHAR), CAST(y AS VARCHAR), CASE WHEN bytes = 0 THEN '--force' END) AS command FROM v_tile")
def scl63_command_line(t):
    return t.v_tile.select("o_orderkey", F.concat_ws(" ", F.lit("build"), C("x").cast("string"), C("y").cast("string"), F.when(C("bytes") == 0, "--force")).alias("command"))


@query("SELECT row_number() OVER (ORDER BY source_id, gps_time, l_orderkey, l_linenumber, z_cm, x_cm, y_cm) AS rn, source_id, gps_time FROM v_point QUALIFY rn <= 100")
def ord01_two_key_sort(t):
    w = t.v_point.orderBy("source_id", "gps_time", "l_orderkey", "l_linenumber", "z_cm", "x_cm", "y_cm").limit(100).select("source_id", "gps_time", "l_orderkey", "l_linenumber", "z_cm", "x_cm", "y_cm")
    return w.select(F.row_number().over(Window.orderBy("source_id", "gps_time", "l_orderkey", "l_linenumber", "z_cm", "x_cm", "y_cm")).cast("long").alias("rn"), "source_id", "gps_time")


@query("SELECT DISTINCT source_id, dense_rank() OVER (ORDER BY source_id) AS pos FROM v_point")
def ord02_sorted_names(t):
    return t.v_point.select("source_id").distinct().select("source_id", F.row_number().over(Window.orderBy("source_id")).cast("long").alias("pos"))


@query("SELECT document_id, title FROM v_poi WHERE title LIKE '%7%' ORDER BY title, document_id LIMIT 5")
def ord03_search_limit(t):
    return t.v_poi.where(C("title").contains("7")).orderBy("title", "document_id").limit(5).select("document_id", "title")


@query("SELECT document_id, waypoint_type, row_number() OVER (PARTITION BY waypoint_type ORDER BY document_id) AS seq FROM v_poi")
def ord04_stable_group_sort(t):
    return numbered(t.v_poi.select("document_id", "waypoint_type"), ["waypoint_type"], ["document_id"], "seq")


@query("SELECT waypoint_type, min(document_id) AS first_id FROM v_poi GROUP BY ALL")
def ord05_first_row(t):
    return t.v_poi.groupBy("waypoint_type").agg(F.min("document_id").alias("first_id"))


@query("SELECT waypoint_type, arg_min(document_id, (x_m * y_m, document_id)) AS smallest FROM v_poi GROUP BY ALL")
def ord07_smallest_area(t):
    return t.v_poi.groupBy("waypoint_type").agg(F.min_by("document_id", F.struct(C("x_m") * C("y_m"), "document_id")).alias("smallest"))


@query("SELECT x, y, min(seq) AS seq FROM (SELECT x, y, p_partkey AS seq FROM v_hd UNION ALL SELECT x, y, o_orderkey + 1000000 FROM v_tile WHERE level = 15) GROUP BY ALL")
def set01_ordered_distinct_union(t):
    both = t.v_hd.select("x", "y", C("p_partkey").alias("seq")).unionByName(t.v_tile.where("level = 15").select("x", "y", (C("o_orderkey") + 1000000).alias("seq")))
    return both.groupBy("x", "y").agg(F.min("seq").alias("seq"))


@query("SELECT x, y FROM v_hd EXCEPT SELECT x, y FROM v_tile WHERE level = 15")
def set02_difference(t):
    return t.v_hd.select("x", "y").subtract(t.v_tile.where("level = 15").select("x", "y"))


@query("SELECT count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM (SELECT z_cm AS v FROM v_point UNION ALL SELECT z_hi FROM v_hd)")
def set03_concat(t):
    return t.v_point.select(C("z_cm").alias("v")).unionByName(t.v_hd.select(C("z_hi").alias("v"))).agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("SELECT DISTINCT cx, cy FROM v_tile")
def set04_distinct_cells(t):
    return t.v_tile.select("cx", "cy").distinct()


@query("""WITH w AS (SELECT DISTINCT x, y FROM v_hd WHERE p_partkey % 2 = 0), c AS (SELECT DISTINCT x, y FROM v_hd WHERE p_partkey % 3 = 0)
 SELECT coalesce(w.x, c.x) AS x, coalesce(w.y, c.y) AS y, CASE WHEN c.x IS NULL THEN 'load' ELSE 'unload' END AS act FROM w FULL JOIN c ON w.x = c.x AND w.y = c.y WHERE w.x IS NULL OR c.x IS NULL""")
def set05_load_and_unload(t):
    wanted = t.v_hd.where("p_partkey % 2 = 0").select("x", "y").distinct().withColumn("w", F.lit(1))
    held = t.v_hd.where("p_partkey % 3 = 0").select("x", "y").distinct().withColumn("c", F.lit(1))
    return wanted.join(held, ["x", "y"], "full").where("w IS NULL OR c IS NULL").select("x", "y", F.when(C("c").isNull(), "load").otherwise("unload").alias("act"))


@query("""WITH b AS (SELECT DISTINCT x_m // 8000 AS bx, y_m // 8000 AS b2 FROM v_poi) SELECT bx, b2 AS \"by\",
 CASE WHEN greatest(0, bx * 8000 - 51400, 50000 - 1400 - (bx + 1) * 8000) = 0 AND greatest(0, b2 * 8000 - 51400, 48600 - (b2 + 1) * 8000) = 0 THEN 'load' WHEN sqrt(power(greatest(0, bx * 8000 - 50000, 50000 - (bx + 1) * 8000), 2) + power(greatest(0, b2 * 8000 - 50000, 50000 - (b2 + 1) * 8000), 2)) > 1500 THEN 'drop' ELSE 'keep' END AS act FROM b""")
def set06_block_rings(t):
    b = t.v_poi.select(F.floor(C("x_m") / 8000).cast("long").alias("bx"), F.floor(C("y_m") / 8000).cast("long").alias("by")).distinct()
    gap = lambda c, r: F.greatest(F.lit(0).cast("long"), C(c) * 8000 - 50000 - r, 50000 - r - (C(c) + 1) * 8000)
    far = F.sqrt(gap("bx", 0) * gap("bx", 0) + gap("by", 0) * gap("by", 0)) > 1500
    return b.select("bx", "by", F.when((gap("bx", 1400) == 0) & (gap("by", 1400) == 0), "load").when(far, "drop").otherwise("keep").alias("act"))


@query("SELECT x, y, CAST(max_level AS BIGINT) AS max_level, z_hi FROM v_hd UNION ALL SELECT DISTINCT x, y, 15, 0 FROM v_tile t WHERE level = 15 AND NOT EXISTS (SELECT 1 FROM v_hd h WHERE h.x = t.x AND h.y = t.y)")
def set07_append_missing(t):
    missing = t.v_tile.where("level = 15").select("x", "y").distinct().join(t.v_hd.select("x", "y"), ["x", "y"], "left_anti")
    filled = missing.select("x", "y", F.lit(15).cast("long").alias("max_level"), F.lit(0).cast("long").alias("z_hi"))
    return t.v_hd.select("x", "y", C("max_level").cast("long").alias("max_level"), "z_hi").unionByName(filled)
