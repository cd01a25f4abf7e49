"""Queries on joins."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.functions import geometry as g
from cairn.operators import spatial_join as sj
from cairn.plans.registry import query

C = F.col


@query("SELECT h.p_partkey, count(t.o_orderkey) AS n, coalesce(max(t.bytes), 0) AS bytes FROM v_hd h LEFT JOIN v_tile t ON t.level = 15 AND t.x = h.x AND t.y = h.y GROUP BY h.p_partkey")
def jon04_jobs_and_files(t):
    files = t.v_tile.where("level = 15").groupBy("x", "y").agg(F.count("*").alias("n"), F.max("bytes").alias("bytes"))
    return t.v_hd.join(files, ["x", "y"], "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


@query("SELECT a.cleabs AS a, b.cleabs AS b FROM v_footprint a JOIN v_footprint b ON a.cleabs < b.cleabs AND a.x0 < b.x1 + 400 AND b.x0 < a.x1 + 400 AND a.y0 < b.y1 + 400 AND b.y0 < a.y1 + 400")
def jon05_box_overlap(t):
    named = lambda p, k: t.v_footprint.select(C("cleabs").alias(k), *[(C(c) + (400 if c[1] == "1" else 0)).alias(p + c) for c in ("x0", "y0", "x1", "y1")])
    box = lambda p: tuple(p + c for c in ("x0", "y0", "x1", "y1"))
    return sj.bin_overlap_join(named("l", "a"), named("r", "b"), box("l"), box("r"), 512).where("a < b").select("a", "b")


_PT = "p AS (SELECT document_id AS id, x_m % 5000 AS x, y_m % 5000 AS y, y_m % 997 AS z FROM v_poi), q AS (SELECT cleabs AS gid, x0 AS px, y0 AS py, (x0 + y0) % 311 AS pz FROM v_footprint)"


def _near(t):
    p = t.v_poi.select(C("document_id").alias("id"), (C("x_m") % 5000).alias("x"), (C("y_m") % 5000).alias("y"), (C("y_m") % 997).alias("z"))
    q = t.v_footprint.select(C("cleabs").alias("gid"), C("x0").alias("px"), C("y0").alias("py"), ((C("x0") + C("y0")) % 311).alias("pz"))
    return p, q


_D2 = "((p.x - px) * (p.x - px) + (p.y - py) * (p.y - py))::DOUBLE"


@query(f"WITH {_PT} SELECT id, gid, z - pz AS height FROM p JOIN q ON true QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_D2}, gid) = 1")
def jon08_flt04_nearest_ground(t):
    from cairn.operators.pointcloud import height_above_ground

    p, q = _near(t)
    h = height_above_ground(p, q.withColumnRenamed("gid", "ground_id"), "id", 200.0)
    return h.select("id", C("ground_id").alias("gid"), "height")


@query(f"WITH {_PT}, r AS (SELECT id, gid, {_D2} AS d2, row_number() OVER (PARTITION BY id ORDER BY {_D2}, gid) AS rn FROM p JOIN q ON true) SELECT id, gid, d2, rn FROM r WHERE rn <= 15 AND (rn <= 12 OR d2 <= 1000000)")
def jon09_k_nearest(t):
    p, q = _near(t)
    n = sj.nearest_join(p, q, "id", "gid", 15, 500.0)
    return n.where("rn <= 12 OR d2 <= 1000000").select("id", "gid", "d2", C("rn").cast("long").alias("rn"))


@query(f"WITH {_PT} SELECT id, gid FROM p JOIN q ON gid % 3 = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_D2}, gid) = 1")
def jon10_nearest_green_pixel(t):
    p, q = _near(t)
    return sj.nearest_join(p, q.where("gid % 3 = 0"), "id", "gid", 1, 400.0).select("id", "gid")


@query("SELECT a.vec_id AS a, b.vec_id AS b, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rn FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id QUALIFY rn <= 3")
def jon09_embedding_neighbours(t):
    from cairn.operators.vectors import nearest_vectors

    return nearest_vectors(t.embeddings, t.embeddings, 3)


@query("SELECT cleabs, x >> 0 AS tx, y AS ty FROM (SELECT cleabs, unnest(range(x0 // 100, x1 // 100 + 1)) AS x, y0, y1 FROM v_footprint), (SELECT unnest(range(0, 60)) AS y) WHERE y BETWEEN y0 // 100 AND y1 // 100")
def jon12_boxes_on_tiles(t):
    from cairn.functions.tiles import explode_tiles

    k = lambda c: F.floor(C(c) / 100).cast("long")
    cover = explode_tiles(t.v_footprint.select("cleabs", "x0", "x1", "y0", "y1"), k("x0"), k("x1"), k("y0"), k("y1"), "tx", "ty")
    return cover.select("cleabs", "tx", "ty")


@query("SELECT document_id FROM v_poi WHERE (x_m // 5000, y_m // 5000) IN (SELECT (x0 // 250, y0 // 250) FROM v_footprint)")
def jon13_manifest_semi(t):
    k = lambda c, n: F.floor(C(c) / n).cast("long")
    manifest = t.v_footprint.select(k("x0", 250).alias("i"), k("y0", 250).alias("j")).distinct()
    return t.v_poi.withColumn("i", k("x_m", 5000)).withColumn("j", k("y_m", 5000)).join(manifest, ["i", "j"], "left_semi").select("document_id")


@query("SELECT z, x, y, min(u) AS dz FROM (SELECT DISTINCT level AS z, x, y FROM v_tile WHERE bytes > 0) q, range(7) r(u) JOIN (SELECT DISTINCT level, x AS ax, y AS ay FROM v_tile WHERE bytes = 0) c ON c.level = z - u AND c.ax = x >> u::INT AND c.ay = y >> u::INT GROUP BY ALL")
def jon15_nearest_ancestor(t):
    asked = t.v_tile.where("bytes > 0").select(C("level").alias("z"), "x", "y").distinct()
    cached = t.v_tile.where("bytes = 0").select(C("level").alias("z"), "x", "y").distinct()
    return sj.nearest_ancestor(asked, cached, 6).where("dz IS NOT NULL").select("z", "x", "y", C("dz").cast("long").alias("dz"))


@query("SELECT document_id, arg_min(cleabs, ((x1 - x0) * (y1 - y0), cleabs)) AS cleabs FROM (SELECT document_id, x_m % 5000 AS x, y_m % 5000 AS y FROM v_poi) p JOIN v_footprint ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY document_id")
def jon16_smallest_containing(t):
    p = t.v_poi.select("document_id", (C("x_m") % 5000).alias("x"), (C("y_m") % 5000).alias("y"))
    hit = sj.point_in_box_join(p, t.v_footprint, "x", "y", ("x0", "y0", "x1", "y1"), 64)
    return hit.groupBy("document_id").agg(F.min_by("cleabs", F.struct((C("x1") - C("x0")) * (C("y1") - C("y0")), "cleabs")).alias("cleabs"))


@query("SELECT a.cleabs AS a, b.cleabs AS b FROM v_footprint a JOIN v_footprint b ON a.cleabs <> b.cleabs AND a.x0 - 201 <= b.x1 AND b.x0 <= a.x1 + 201 AND a.y0 - 201 <= b.y1 AND b.y0 <= a.y1 + 201 AND (b.x1 - b.x0) * (b.y1 - b.y0) * 2 <= 3 * (a.x1 - a.x0) * (a.y1 - a.y0)")
def jon17_adjacent_boxes(t):
    named = lambda p, k, grow: t.v_footprint.select(C("cleabs").alias(k), ((C("x1") - C("x0")) * (C("y1") - C("y0"))).alias(p + "area"), *[(C(c) + (grow if c[1] == "1" else -grow)).alias(p + c) for c in ("x0", "y0", "x1", "y1")])
    box = lambda p: tuple(p + c for c in ("x0", "y0", "x1", "y1"))
    near = sj.bin_overlap_join(named("l", "a", 201), named("r", "b", 0), box("l"), box("r"), 256, touching=True)
    return near.where("a <> b AND rarea * 2 <= 3 * larea").select("a", "b")


@query("SELECT document_id, doc, coalesce(length(text), 0) AS n FROM (SELECT document_id, unnest([document_id % 500, (document_id * 7) % 3000]) AS doc FROM v_poi) LEFT JOIN documents ON doc_id = doc")
def jon20_poi_documents(t):
    d = C("document_id")
    asked = t.v_poi.select("document_id", F.explode(F.array(d % 500, (d * 7) % 3000)).alias("doc"))
    return asked.join(t.documents.select(C("doc_id").alias("doc"), F.length("text").alias("n")), "doc", "left").select("document_id", "doc", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(r"SELECT doc_id, id, vec_id IS NOT NULL AS found FROM (SELECT doc_id, CAST(unnest(list_distinct(regexp_extract_all(raw, '\[img=(\d+)([^\]]*)\](.*?)\[/img\]', 1))) AS BIGINT) AS id FROM v_doc) LEFT JOIN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0) ON vec_id = id")
def jon21_image_documents(t):
    from cairn.functions.text import image_ids

    ids = t.v_doc.select("doc_id", F.explode(F.transform(image_ids(C("raw")), lambda i: i.cast("long"))).alias("id"))
    return ids.join(t.embeddings.where("vec_id % 2 = 0").select(C("vec_id").alias("id"), F.lit(True).alias("f")), "id", "left").select("doc_id", "id", F.coalesce("f", F.lit(False)).alias("found"))


@query("SELECT n_nationkey, n_name, r_name AS range_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%'")
def jon22_enclosing_area(t):
    areas = t.region.groupBy("r_regionkey").agg(F.collect_list(F.struct(F.lit("range").alias("type"), C("r_name").alias("name"))).alias("areas"))
    j = t.nation.join(areas, C("n_regionkey") == C("r_regionkey"))
    return j.select("n_nationkey", "n_name", F.get(F.filter("areas", lambda a: a["type"] == "range"), F.lit(0))["name"].alias("range_name")).where(C("range_name").startswith("A"))


@query("""WITH n AS (SELECT DISTINCT level - 11 AS d, x, y FROM v_tile WHERE bytes > 0), q AS (SELECT DISTINCT x, y FROM v_tile WHERE level = 18),
 g AS (SELECT q.x, q.y, d, n.x IS NOT NULL AS here FROM q CROSS JOIN range(8) r(d) LEFT JOIN n USING (d) WHERE n.x IS NULL OR (n.x = q.x >> (7 - d)::INT AND n.y = q.y >> (7 - d)::INT)),
 f AS (SELECT q.x, q.y, r.d, EXISTS (SELECT 1 FROM n WHERE n.d = r.d AND n.x = q.x >> (7 - r.d)::INT AND n.y = q.y >> (7 - r.d)::INT) AS here FROM q CROSS JOIN range(8) r(d))
 SELECT x, y, CAST(coalesce(min(d) FILTER (WHERE NOT here), 8) - 1 AS BIGINT) AS depth FROM f GROUP BY x, y""")
def jon23_octree_descent(t):
    nodes = t.v_tile.where("bytes > 0").select((C("level") - 11).alias("d"), C("x").alias("ax"), C("y").alias("ay")).distinct().withColumn("here", F.lit(True))
    q = t.v_tile.where("level = 18").select("x", "y").distinct().withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    up = lambda c: F.call_function("shiftright", C(c), (7 - C("d")).cast("int"))
    walk = q.withColumn("ax", up("x")).withColumn("ay", up("y")).join(nodes, ["d", "ax", "ay"], "left")
    return walk.groupBy("x", "y").agg((F.coalesce(F.min(F.when(C("here").isNull(), C("d"))), F.lit(8)) - 1).cast("long").alias("depth"))


@query("SELECT document_id, min(cleabs) AS block FROM (SELECT document_id, x_m % 5000 AS x, y_m % 5000 AS y FROM v_poi) p JOIN v_footprint ON x BETWEEN x0 - 25 AND x1 + 25 AND y BETWEEN y0 - 25 AND y1 + 25 GROUP BY document_id")
def msc03_survey_block(t):
    p = t.v_poi.select("document_id", (C("x_m") % 5000).alias("x"), (C("y_m") % 5000).alias("y"))
    b = t.v_footprint.select("cleabs", (C("x0") - 25).alias("bx0"), (C("y0") - 25).alias("by0"), (C("x1") + 25).alias("bx1"), (C("y1") + 25).alias("by1"))
    return sj.point_in_box_join(p, b, "x", "y", ("bx0", "by0", "bx1", "by1"), 128).groupBy("document_id").agg(F.min("cleabs").alias("block"))


_SEG = "s AS (SELECT track_id, seq, lag(x_cm) OVER w AS ax, lag(y_cm) OVER w AS ay, x_cm AS bx, y_cm AS b2 FROM v_track WINDOW w AS (PARTITION BY track_id ORDER BY ts, seq))"


@query(f"""WITH {_SEG}, u AS (SELECT *, CASE WHEN bx = ax THEN 0 ELSE least((2000.0 - ax) / (bx - ax), (6000.0 - ax) / (bx - ax)) END AS u0, CASE WHEN bx = ax THEN 1 ELSE greatest((2000.0 - ax) / (bx - ax), (6000.0 - ax) / (bx - ax)) END AS u1,
 CASE WHEN b2 = ay THEN 0 ELSE least((3000.0 - ay) / (b2 - ay), (3500.0 - ay) / (b2 - ay)) END AS v0, CASE WHEN b2 = ay THEN 1 ELSE greatest((3000.0 - ay) / (b2 - ay), (3500.0 - ay) / (b2 - ay)) END AS v1 FROM s WHERE ax IS NOT NULL)
 SELECT track_id, count(*) AS n FROM u WHERE (bx <> ax OR ax BETWEEN 2000 AND 6000) AND (b2 <> ay OR ay BETWEEN 3000 AND 3500) AND greatest(u0, v0, 0) <= least(u1, v1, 1) GROUP BY track_id""")
def flt12_traces_in_box(t):
    w = Window.partitionBy("track_id").orderBy("ts", "seq")
    s = t.v_track.select("track_id", F.lag("x_cm").over(w).cast("double").alias("ax"), F.lag("y_cm").over(w).cast("double").alias("ay"), C("x_cm").cast("double").alias("bx"), C("y_cm").cast("double").alias("by")).where("ax IS NOT NULL")
    hit = g.segment_hits_box(C("ax"), C("ay"), C("bx"), C("by"), *map(F.lit, (2000.0, 3000.0, 6000.0, 3500.0)))
    return s.where(hit).groupBy("track_id").agg(F.count("*").alias("n"))


@query("SELECT document_id FROM v_poi p WHERE EXISTS (SELECT 1 FROM v_footprint f WHERE p.x_m % 5000 > f.x0 AND p.x_m % 5000 < f.x1 AND p.y_m % 5000 > f.y0 AND p.y_m % 5000 < f.y1)")
def flt14_occluded(t):
    p = t.v_poi.select("document_id", (C("x_m") % 5000).alias("x"), (C("y_m") % 5000).alias("y"))
    hit = sj.point_in_box_join(p, t.v_footprint, "x", "y", ("x0", "y0", "x1", "y1"), 64)
    return hit.where("x > x0 AND x < x1 AND y > y0 AND y < y1").select("document_id").distinct()
