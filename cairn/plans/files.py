"""Queries that write a format and read it back."""

import uuid

from pyspark.sql import functions as F

from cairn.plans.registry import query
from cairn.session import shared_dir
from cairn.sources import binary, documents, las, meshes, rasters

C = F.col


def _folder(t, name):
    path = shared_dir(t.spark)
    if "://" not in path:  # a path without a scheme is one of the cluster's own file system
        store = t.spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        path = store.rstrip("/") + path if not store.startswith("file:") else "file://" + path
    return f"{path}/{name}-{uuid.uuid4().hex}"


def _las_folder(t, point_format):
    p = t.v_point.withColumn("cell", F.concat_ws("_", F.floor(C("x_cm") / 250000), F.floor(C("y_cm") / 250000)))
    p = p.select("cell", "x_cm", "y_cm", "z_cm", (C("l_partkey") % 65536).cast("int").alias("intensity"), F.lit(1).alias("return_number"), F.lit(2).alias("number_of_returns"), C("classification").cast("int").alias("classification"), "scan_angle", C("source_id").cast("int").alias("source_id"), "gps_time")
    root = _folder(t, "las")
    binary.write_files(las.encode_groups(p, "cell", point_format), root)
    return root


@query("SELECT concat(x_cm // 250000, '_', y_cm // 250000) AS cell, count(*) AS point_num, 1 AS point_format, false AS compressed, min(x_cm) / 100.0::DOUBLE AS x_low, max(z_cm) / 100.0::DOUBLE AS z_high FROM v_point GROUP BY 1")
def src01_las_headers(t):
    h = las.read_headers(t.spark, _las_folder(t, 1))
    return h.select(F.regexp_extract("path", r"([0-9]+_[0-9]+)\.las$", 1).alias("cell"), "point_num", "point_format", "compressed", C("low")[0].alias("x_low"), C("high")[2].alias("z_high"))


_POINTS = "SELECT x_cm, y_cm, z_cm, CAST(l_partkey % 65536 AS INT) AS intensity, 1 AS return_number, 2 AS number_of_returns, classification, scan_angle, CAST(source_id AS INT) AS source_id, gps_time FROM v_point"


@query(_POINTS)
def src02_src04_las_points(t):
    return las.read_points(t.spark, _las_folder(t, 1)).drop("path", "seq")


@query(_POINTS)
def src04_las_points_format_6(t):
    return las.read_points(t.spark, _las_folder(t, 6)).drop("path", "seq")


@query("SELECT CAST(row AS INT) AS row, CAST(col AS INT) AS col, (col + 0.5) * 5 + 1000::DOUBLE AS x, (64 - row - 0.5) * 5 + 2000::DOUBLE AS y, z::DOUBLE AS z FROM v_raster WHERE z IS NOT NULL")
def src19_asc_grid(t):
    root = _folder(t, "asc")
    binary.write_files(rasters.encode_asc(t.v_raster.withColumn("raster_id", F.lit(1)), 64, 64, 1000.0, 2000.0, 5.0), root)
    return rasters.read_asc(t.spark, root).drop("path")


@query("SELECT 1000.0::DOUBLE AS west, 2000.0::DOUBLE AS south, 320.0::DOUBLE AS side")
def src20_asc_index(t):
    root = _folder(t, "asc")
    binary.write_files(rasters.encode_asc(t.v_raster.withColumn("raster_id", F.lit(1)), 64, 64, 1000.0, 2000.0, 5.0), root)
    return rasters.asc_index(t.spark, root).select("west", "south", "side")


@query("SELECT row, col, z::DOUBLE AS z FROM v_raster")
def src17_bil_raster(t):
    body = t.v_raster.agg(F.array_sort(F.collect_list(F.struct("row", "col", F.coalesce(C("z").cast("double"), F.lit(-9999.0)).alias("z")))).alias("a"))

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for a in b.column("a").to_pylist():
                yield pa.RecordBatch.from_pydict({"name": ["1.bil"], "content": [np.array([c["z"] for c in a], "<f4").tobytes()]})

    root = _folder(t, "bil")
    binary.write_files(body.mapInArrow(pack, "name string, content binary"), root)
    return rasters.read_bil(t.spark, root, 64, 64).drop("path")


def _triangles(t):
    from cairn.operators.mesh import corners

    return corners(t.v_mesh_vertex, t.v_mesh_face).withColumn("k", C("fid") % 3)


@query("SELECT fid % 3 AS k, count(*) AS faces FROM v_mesh_face GROUP BY 1")
def src27_snk01_ply(t):
    root = _folder(t, "ply")
    binary.write_files(meshes.encode_meshes(_triangles(t), "k", "ply"), root)
    _, faces = meshes.read_ply(t.spark, root)
    return faces.groupBy(F.regexp_extract("path", r"([0-9]+)\.ply$", 1).cast("long").alias("k")).agg(F.count("*").alias("faces"))


@query("SELECT fid % 3 AS k, min(z)::DOUBLE AS low, max(z)::DOUBLE AS high FROM (SELECT fid, unnest([a, b, c]) AS vid FROM v_mesh_face) JOIN v_mesh_vertex USING (vid) GROUP BY 1")
def src26_snk02_glb(t):
    root = _folder(t, "glb")
    binary.write_files(meshes.encode_meshes(_triangles(t), "k", "glb"), root)
    return meshes.read_glb_heights(t.spark, root).select(F.regexp_extract("path", r"([0-9]+)\.glb$", 1).cast("long").alias("k"), "low", "high")


@query("SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY seq) - 1 AS INT) AS seq, x_cm / 1000.0::DOUBLE AS lon, y_cm / 1000.0::DOUBLE AS lat, CASE WHEN seq % 2 = 0 THEN 5.0 ELSE 0.0 END::DOUBLE AS ele FROM v_track WHERE track_id IN (SELECT track_id FROM v_track GROUP BY 1 HAVING count(*) > 1)")
def src28_gpx(t):
    point = F.concat(F.lit('<trkpt lat="'), (C("y_cm") / 1000.0).cast("string"), F.lit('" lon="'), (C("x_cm") / 1000.0).cast("string"), F.when(C("seq") % 2 == 0, '"><ele>5.0</ele></trkpt>').otherwise('"/>'))
    text = t.v_track.groupBy("track_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", point.alias("p")))), lambda r: r["p"]), "").alias("p"))
    gpx = text.select("track_id", F.concat(F.lit("<gpx><trk><trkseg>"), C("p"), F.lit("</trkseg></trk></gpx>")).alias("g"))
    return gpx.select("track_id", F.explode(documents.parse_gpx(C("g"))).alias("s")).select("track_id", F.posexplode("s").alias("seq", "p")).select("track_id", "seq", "p.lon", "p.lat", "p.ele")


@query("SELECT concat('b', cleabs) AS id, CASE WHEN cleabs % 2 = 0 THEN '2.2' ELSE '1.2' END AS lod, x0 * 0.5 + 10::DOUBLE AS x, y1 * 0.5 + 20::DOUBLE AS y FROM v_footprint WHERE cleabs % 3 <> 0")
def src29_scl27_city_sequence(t):
    obj = F.concat(F.lit('{"type":"CityJSONFeature","id":"b'), C("cleabs"), F.lit('","CityObjects":{"b'), C("cleabs"), F.lit('":{"type":"Building","geometry":[{"lod":"'), F.when(C("cleabs") % 3 == 0, "0").otherwise("1.2"), F.lit('","type":"Solid"}'), F.when(C("cleabs") % 2 == 0, F.when(C("cleabs") % 3 != 0, ',{"lod":"2.2","type":"Solid"}').otherwise("")).otherwise(""), F.lit(']}},"vertices":[['), F.concat_ws(",", "x0", "y1", F.lit("0")), F.lit("]]}"))
    lines = t.v_footprint.select(F.lit("f").alias("path"), obj.alias("value"))
    head = t.spark.createDataFrame([("f", '{"type":"CityJSON","transform":{"scale":[0.5,0.5,1.0],"translate":[10.0,20.0,0.0]}}'), ("f", "not json")], "path string, value string")
    out = documents.read_city_sequence(lines.unionByName(head))
    return out.select("id", "lod", C("vertices")[0][0].alias("x"), C("vertices")[0][1].alias("y"))


@query("SELECT CAST(level - 11 AS INT) AS d, CAST(x AS INT) AS x, CAST(y AS INT) AS y, 0 AS z, max(bytes) AS n FROM v_tile WHERE level < 14 GROUP BY ALL")
def src31_octree_hierarchy(t):
    best = t.v_tile.where("level < 14").groupBy("level", "x", "y").agg(F.max("bytes").alias("n"))
    key = F.concat_ws("-", C("level") - 11, "x", "y", F.lit(0))
    docs = best.groupBy((C("x") % 8).alias("g")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(key.alias("k"), "n")))).alias("doc"))
    return documents.hierarchy(docs)


@query("SELECT concat('c', cx, '.', cy) AS cell, level, count(*) AS n FROM v_tile WHERE bytes > 0 GROUP BY ALL")
def snk04_partitioned_tiles(t):
    root = _folder(t, "tiles")
    t.v_tile.where("bytes > 0").withColumn("cell", F.concat(F.lit("c"), F.concat_ws(".", "cx", "cy"))).select("cell", "level", "x", "y", "bytes").write.partitionBy("cell", "level").parquet(root)
    back = t.spark.read.option("basePath", root).parquet(root)
    return back.groupBy(C("cell").cast("string").alias("cell"), C("level").cast("long").alias("level")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT cx, cy, count(*) OVER (PARTITION BY cx, cy) AS n FROM v_tile")
def snk15_append_log(t):
    root = _folder(t, "log")
    for part in (0, 1):
        t.v_tile.where(C("o_orderkey") % 2 == part).select("cx", "cy", "level").write.mode("append").json(root)
    return t.spark.read.schema("cx long, cy long, level long").json(root).groupBy("cx", "cy").agg(F.count("*").alias("n"))


@query("SELECT vid, CAST(round((z - (SELECT min(z) FROM v_mesh_vertex)) / (SELECT (max(z) - min(z))::DOUBLE FROM v_mesh_vertex) * 16383) AS BIGINT) AS q FROM v_mesh_vertex")
def snk03_quantise(t):
    b = t.v_mesh_vertex.agg(F.min("z").alias("low"), F.max("z").alias("high"))
    return t.v_mesh_vertex.join(F.broadcast(b)).select("vid", F.round((C("z") - C("low")) / (C("high") - C("low")) * 16383).cast("long").alias("q"))
