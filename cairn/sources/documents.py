"""GPX tracks, CityJSON sequences, octree hierarchies and constants as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_POINT = r'<(?:trkpt|rtept)\b[^>]*?(?:/>|>[\s\S]*?</(?:trkpt|rtept)>)'


def parse_gpx(text: Column) -> Column:
    """Segments of a GPX text as arrays of (lon, lat, ele): track segments, else routes, else the whole document.

    Points without finite coordinates go, a missing elevation is 0, segments of fewer than two points go.
    """
    segments = F.regexp_extract_all(text, F.lit(r"<trkseg\b[\s\S]*?</trkseg>"), F.lit(0))
    routes = F.regexp_extract_all(text, F.lit(r"<rte\b[\s\S]*?</rte>"), F.lit(0))
    parts = F.when(F.size(segments) > 0, segments).when(F.size(routes) > 0, routes).otherwise(F.array(text))
    number = lambda s, pattern: F.nullif(F.regexp_extract(s, pattern, 1), F.lit("")).try_cast("double")
    point = lambda p: F.struct(number(p, r'lon="([^"]*)"').alias("lon"), number(p, r'lat="([^"]*)"').alias("lat"), F.coalesce(number(p, r"<ele>\s*([^<\s]*)\s*</ele>"), F.lit(0.0)).alias("ele"))
    points = lambda s: F.filter(F.transform(F.regexp_extract_all(s, F.lit(_POINT), F.lit(0)), point), lambda p: p["lon"].isNotNull() & p["lat"].isNotNull() & ~F.isnan(p["lon"]) & ~F.isnan(p["lat"]))
    return F.filter(F.transform(parts, points), lambda s: F.size(s) > 1)


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """path, segment, seq, lon, lat, ele."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(parse_gpx(F.col("value"))).alias("segment", "points"))
    return texts.select("path", "segment", F.posexplode("points").alias("seq", "p")).select("path", "segment", "seq", "p.*")


CITY_HEADER = "transform struct<scale: array<double>, translate: array<double>>"
CITY_FEATURE = "type string, id string, vertices array<array<bigint>>, CityObjects map<string, struct<type: string, geometry: array<struct<lod: string, type: string>>>>"


def read_city_sequence(lines: DataFrame) -> DataFrame:
    """From (path, value), one row a line, to one row per city object: path, id, lod, vertices in metres.

    The line with a transform is the file's header; lines that aren't features are passed over. Of a building's
    geometries LOD 2.2 is taken, else 1.2.
    """
    header = lines.select("path", F.from_json("value", CITY_HEADER)["transform"].alias("t")).where("t IS NOT NULL").groupBy("path").agg(F.first("t").alias("t"))
    f = lines.select("path", F.from_json("value", CITY_FEATURE).alias("f")).where("f.type = 'CityJSONFeature' AND f.CityObjects IS NOT NULL")
    each = f.join(header, "path").select("path", "t", "f.vertices", F.explode("f.CityObjects").alias("id", "o"))
    pick = lambda lod: F.get(F.filter("o.geometry", lambda g: g["lod"] == lod), F.lit(0))
    metres = F.transform("vertices", lambda v: F.transform(v, lambda c, i: c * F.get(F.col("t.scale"), i) + F.get(F.col("t.translate"), i)))
    return each.select("path", "id", F.coalesce(pick("2.2"), pick("1.2"))["lod"].alias("lod"), metres.alias("vertices")).where("lod IS NOT NULL")


def hierarchy(documents: DataFrame) -> DataFrame:
    """From (doc), a JSON map of ``d-x-y-z`` keys to counts, to d, x, y, z, n; -1 means the node is in another chunk."""
    e = documents.select(F.explode(F.from_json("doc", "map<string, bigint>")).alias("key", "n"))
    part = lambda i: F.get(F.split("key", "-"), F.lit(i)).cast("int")
    return e.select(part(0).alias("d"), part(1).alias("x"), part(2).alias("y"), part(3).alias("z"), "n")


def constants(document: str) -> dict:
    """Values of a constants document; keys that begin with an underscore are notes."""
    import json

    return {k: v["value"] if isinstance(v, dict) and "value" in v else v for k, v in json.loads(document).items() if not k.startswith("_")}
