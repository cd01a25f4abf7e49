"""Queries on meshes."""

from pyspark.sql import functions as F

from cairn.operators import mesh
from cairn.plans.registry import query

C = F.col
_E = "e AS (SELECT fid, least(u, v) AS lo, greatest(u, v) AS hi, u, v FROM (SELECT fid, a AS u, b AS v FROM v_mesh_face UNION ALL SELECT fid, b, c FROM v_mesh_face UNION ALL SELECT fid, c, a FROM v_mesh_face))"


def _welded(t):
    """The vertices with every tenth row's repeated under a new id, and faces that use the repeats."""
    again = t.v_mesh_vertex.where("vid % 10 = 0").select((C("vid") + 1000).alias("vid"), "x", "y", "z")
    f = t.v_mesh_face.withColumn("a", F.when((C("a") % 10 == 0) & (C("fid") % 2 == 0), C("a") + 1000).otherwise(C("a")))
    return t.v_mesh_vertex.unionByName(again), f


@query("SELECT fid, a, b, c FROM v_mesh_face")
def ana02_weld_faces(t):
    return mesh.weld(*_welded(t))[1]


@query("SELECT DISTINCT vid, x, y, z FROM v_mesh_vertex JOIN (SELECT a AS vid FROM v_mesh_face UNION SELECT b FROM v_mesh_face UNION SELECT c FROM v_mesh_face) USING (vid)")
def ana02_flt15_weld_vertices(t):
    return mesh.weld(*_welded(t))[0]


@query(f"WITH {_E} SELECT any_value(u) AS u, any_value(v) AS v FROM e GROUP BY lo, hi HAVING count(*) = 1")
def agg14_boundary_edges(t):
    return mesh.boundary_edges(t.v_mesh_face)


@query(f"WITH {_E} SELECT a.fid AS fid, b.fid AS other FROM e a JOIN e b ON a.lo = b.lo AND a.hi = b.hi AND a.fid < b.fid")
def jon18_edge_neighbours(t):
    e = mesh.half_edges(t.v_mesh_face)
    o = e.select("lo", "hi", C("fid").alias("other"))
    return e.join(o, ["lo", "hi"]).where("fid < other").select("fid", "other")


_CC = f"WITH RECURSIVE {_E}, p AS (SELECT DISTINCT a.fid AS f, b.fid AS g FROM e a JOIN e b ON a.lo = b.lo AND a.hi = b.hi), w AS (SELECT fid, fid AS o FROM v_mesh_face UNION SELECT w.fid, p.g FROM w JOIN p ON p.f = w.o), l AS (SELECT fid, min(o) AS label FROM w GROUP BY fid)"


@query(f"{_CC} SELECT fid, label FROM l")
def ana01_components(t):
    return mesh.components(t.v_mesh_face)


@query(f"{_CC} SELECT f.fid, a, b, c FROM v_mesh_face f JOIN l USING (fid) WHERE label = (SELECT label FROM l GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)")
def ana01_largest_component(t):
    return mesh.largest_component(t.v_mesh_face).select("fid", "a", "b", "c")


_CORNER = """k AS (SELECT f.*, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS b2, q.z AS bz, r.x AS cx, r.y AS cy, r.z AS cz FROM v_mesh_face f JOIN v_mesh_vertex p ON p.vid = a JOIN v_mesh_vertex q ON q.vid = b JOIN v_mesh_vertex r ON r.vid = c),
 n AS (SELECT *, (b2 - ay) * (cz - az) - (bz - az) * (cy - ay) AS fx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS fy, (bx - ax) * (cy - ay) - (b2 - ay) * (cx - ax) AS fz FROM k)"""


@query(f"WITH {_CORNER} SELECT fid, fx, fy, fz FROM n")
def jon19_face_normals(t):
    return mesh.corners(t.v_mesh_vertex, t.v_mesh_face).select("fid", "fx", "fy", "fz")


_VN = "s AS (SELECT vid, sum(fx)::DOUBLE AS x, sum(fy)::DOUBLE AS y, sum(fz)::DOUBLE AS z FROM (SELECT a AS vid, fx, fy, fz FROM n UNION ALL SELECT b, fx, fy, fz FROM n UNION ALL SELECT c, fx, fy, fz FROM n) GROUP BY vid), m AS (SELECT vid, x / sqrt(x * x + y * y + z * z) AS nx, y / sqrt(x * x + y * y + z * z) AS ny, z / sqrt(x * x + y * y + z * z) AS nz FROM s)"


@query(f"WITH {_CORNER}, {_VN} SELECT vid, round(nx, 8) AS nx, round(ny, 8) AS ny, round(nz, 8) AS nz FROM m")
def agg11_vertex_normals(t):
    return mesh.vertex_normals(t.v_mesh_vertex, t.v_mesh_face).select("vid", *[F.round(k, 8).alias(k) for k in ("nx", "ny", "nz")])


def _angle(p, q, r):
    y = lambda k: "b2" if k == "b" else k + "y"
    d = lambda k: f"({k}x - {p}x)::DOUBLE, ({y(k)} - {y(p)})::DOUBLE, ({k}z - {p}z)::DOUBLE"
    return f"acos(greatest(-1.0, least(1.0, list_cosine_similarity([{d(q)}], [{d(r)}]))))"


@query(f"""WITH {_CORNER}, u AS (SELECT *, sqrt(fx * fx + fy * fy + fz * fz) AS ar FROM n), g AS (SELECT a AS vid, fx, fy, fz, {_angle('a', 'b', 'c')} / ar AS w FROM u UNION ALL SELECT b, fx, fy, fz, {_angle('b', 'c', 'a')} / ar FROM u UNION ALL SELECT c, fx, fy, fz, {_angle('c', 'a', 'b')} / ar FROM u),
 s AS (SELECT vid, sum(fx * w) AS x, sum(fy * w) AS y, sum(fz * w) AS z FROM g GROUP BY vid) SELECT vid, round(x / sqrt(x * x + y * y + z * z), 6) AS nx, round(z / sqrt(x * x + y * y + z * z), 6) AS nz FROM s""")
def agg12_angle_weighted_normals(t):
    return mesh.vertex_normals(t.v_mesh_vertex, t.v_mesh_face, "angle").select("vid", F.round("nx", 6).alias("nx"), F.round("nz", 6).alias("nz"))


_SM = lambda src, out: f"""{out}n AS (SELECT vid, avg(nx) AS ax, avg(ny) AS ay, avg(nz) AS az FROM (SELECT l.vid, nx, ny, nz FROM l JOIN {src} s ON s.vid = l.o) GROUP BY vid), {out}h AS (SELECT s.vid, 0.5 * nx + 0.5 * ax AS x, 0.5 * ny + 0.5 * ay AS y, 0.5 * nz + 0.5 * az AS z FROM {src} s JOIN {out}n USING (vid)),
 {out} AS (SELECT vid, x / sqrt(x * x + y * y + z * z) AS nx, y / sqrt(x * x + y * y + z * z) AS ny, z / sqrt(x * x + y * y + z * z) AS nz FROM {out}h)"""  # noqa: E731


@query(f"WITH {_CORNER}, {_VN}, l AS (SELECT unnest([a, a, b, b, c, c]) AS vid, unnest([b, c, a, c, a, b]) AS o FROM v_mesh_face), {_SM('m', 's1')}, {_SM('s1', 's2')} SELECT vid, round(nx, 7) AS nx, round(ny, 7) AS ny, round(nz, 7) AS nz FROM s2")
def agg13_smooth_normals(t):
    n = mesh.smooth_normals(mesh.vertex_normals(t.v_mesh_vertex, t.v_mesh_face), t.v_mesh_face)
    return n.select("vid", *[F.round(k, 7).alias(k) for k in ("nx", "ny", "nz")])


@query("SELECT fid, a, b, c FROM v_mesh_face")
def flt16_clean(t):
    extra = t.v_mesh_face.where("fid % 7 = 0").select((C("fid") + 5000).alias("fid"), C("b").alias("a"), C("c").alias("b"), C("a").alias("c"))
    flat = t.v_mesh_face.where("fid % 11 = 0").select((C("fid") + 9000).alias("fid"), "a", C("a").alias("b"), "c")
    return mesh.clean(t.v_mesh_face.unionByName(extra).unionByName(flat))


@query(f"WITH {_CORNER} SELECT count(*) AS faces, round(sum(abs((bx - ax) * (cy - ay) - (b2 - ay) * (cx - ax))) / 2.0 * 1, 4)::DOUBLE AS area FROM n WHERE greatest(ax, bx, cx) <= 110")
def ana03_clip_whole(t):
    parts = mesh.clip(t.v_mesh_vertex, t.v_mesh_face, "x", 110)
    area = F.abs((C("qx") - C("px")) * (C("ry") - C("py")) - (C("qy") - C("py")) * (C("rx") - C("px")))
    return parts.agg(F.count("*").alias("faces"), F.round(F.sum(area) / 2.0, 4).alias("area"))


@query(f"""WITH {_CORNER}, f AS (SELECT fid, least(ax, bx, cx) AS x0, greatest(ax, bx, cx) AS x1, (ax <= 115)::INT + (bx <= 115)::INT + (cx <= 115)::INT AS k, abs((bx - ax) * (cy - ay) - (b2 - ay) * (cx - ax)) / 2.0 AS s FROM n)
 SELECT CAST(sum(k) FILTER (WHERE k < 3) + count(*) FILTER (WHERE k = 3) AS BIGINT) AS parts, round(sum(CASE k WHEN 3 THEN s WHEN 2 THEN s * 0.75 WHEN 1 THEN s * 0.25 ELSE 0 END), 4)::DOUBLE AS area FROM f""")
def ana03_clip_across(t):
    parts = mesh.clip(t.v_mesh_vertex, t.v_mesh_face, "x", 115)
    area = F.abs((C("qx") - C("px")) * (C("ry") - C("py")) - (C("qy") - C("py")) * (C("rx") - C("px")))
    return parts.agg(F.count("*").alias("parts"), F.round(F.sum(area) / 2.0, 4).alias("area"))


@query("SELECT vid, x * 0.5 + 3::DOUBLE AS x, y * 0.5 - 2::DOUBLE AS y, z::DOUBLE AS z FROM v_mesh_vertex")
def ana04_rescale(t):
    return t.v_mesh_vertex.select("vid", (C("x") * 0.5 + 3).cast("double").alias("x"), (C("y") * 0.5 - 2).cast("double").alias("y"), C("z").cast("double").alias("z"))


@query(f"WITH {_E}, o AS (SELECT any_value(u) AS u, any_value(v) AS v FROM e GROUP BY lo, hi HAVING count(*) = 1), q AS (SELECT u AS vid FROM o UNION SELECT v FROM o) SELECT 'vertex' AS kind, count(*) AS n, CAST(sum(z - 100) AS BIGINT) AS s FROM v_mesh_vertex JOIN q USING (vid) UNION ALL SELECT 'face', 2 * count(*), CAST(sum(2 * u + 2 * v + (576 + u) + (576 + u) + (576 + v) - u) AS BIGINT) FROM o")
def ana16_skirt(t):
    v, f = mesh.skirt(t.v_mesh_face, t.v_mesh_vertex, 100.0)
    a = v.agg(F.lit("vertex").alias("kind"), F.count("*").alias("n"), F.sum("z").cast("long").alias("s"))
    return a.unionByName(f.agg(F.lit("face").alias("kind"), F.count("*").alias("n"), F.sum(C("a") + C("b") + C("c")).cast("long").alias("s")))


@query("SELECT vid, (x * x + 2.0 * x * y + 2 * y * y + 3 * z * z + 2 * z + 1)::DOUBLE AS e FROM v_mesh_vertex")
def scl36_quadric_error(t):
    q = F.array(*[F.lit(float(v)) for v in (1, 1, 0, 0, 2, 0, 0, 3, 1, 1)])
    return t.v_mesh_vertex.select("vid", mesh.quadric_error(q, C("x"), C("y"), C("z")).cast("double").alias("e"))


@query()
def ana18_convex_hull(t):
    return mesh.hulls(t.v_point.select("source_id", C("x_cm").alias("x"), C("y_cm").alias("y")), "source_id")


@query()
def ana11_simplify(t):
    from cairn.operators.kernels import simplify_tiles

    return simplify_tiles(mesh.corners(t.v_mesh_vertex, t.v_mesh_face).withColumn("tile", C("fid") % 2), "tile", 150).select("tile", "fid", "ax", "ay", "az")


@query("SELECT count(*) * 2 AS n, round(sum(a.z + b.z + c.z + b.z + d.z + c.z) / 1.0, 3)::DOUBLE AS z FROM v_raster a JOIN v_raster b ON b.row = a.row + 1 AND b.col = a.col JOIN v_raster c ON c.row = a.row AND c.col = a.col + 1 JOIN v_raster d ON d.row = a.row + 1 AND d.col = a.col + 1 WHERE a.z IS NOT NULL AND b.z IS NOT NULL AND c.z IS NOT NULL AND d.z IS NOT NULL")
def ana12_heightfield_mesh(t):
    from cairn.operators.kernels import heightfield

    m = heightfield(t.v_raster.where("z IS NOT NULL"), 5.0, "row", "col")
    return m.agg(F.count("*").alias("n"), F.round(F.sum(C("az") + C("bz") + C("cz")), 3).alias("z"))


@query("SELECT cleabs, 2 AS triangles, ((x1 - x0) * (y1 - y0))::DOUBLE AS area FROM v_footprint")
def ana20_triangulate(t):
    import numpy as np
    import pandas as pd

    from cairn.operators.kernels import triangulate_surface

    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                ring = np.array([(r.x0, r.y0, 5), (r.x1, r.y0, 5), (r.x1, r.y1, 5), (r.x0, r.y1, 5)], float)
                tri = triangulate_surface(ring)
                out.append((r.cleabs, len(tri), sum(abs(np.cross(ring[b] - ring[a], ring[c] - ring[a])[2]) / 2 for a, b, c in tri)))
            yield pd.DataFrame(out, columns=["cleabs", "triangles", "area"])

    return t.v_footprint.select("cleabs", "x0", "y0", "x1", "y1").mapInPandas(run, "cleabs long, triangles int, area double")
