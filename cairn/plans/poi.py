"""Queries on points of interest and tracks."""

from pyspark.sql import functions as F

from cairn.operators import tracks
from cairn.plans.registry import query

C = F.col


@query("SELECT document_id, title, waypoint_type FROM v_poi WHERE x_m BETWEEN 10000 AND 60000 AND y_m BETWEEN 20000 AND 90000 AND waypoint_type <> 'other' AND title <> ''")
def src14_poi_scan(t):
    p = t.v_poi.where(C("x_m").between(10000, 60000) & C("y_m").between(20000, 90000))
    return p.where((C("waypoint_type") != "other") & (C("title") != "")).select("document_id", "title", "waypoint_type")


@query("SELECT document_id, title FROM (SELECT * FROM v_poi WHERE contains(lower(title), '00') ORDER BY title, document_id LIMIT 25) WHERE waypoint_type IN ('hut', 'pass') ORDER BY title, document_id LIMIT 5")
def src15_text_search(t):
    first = t.v_poi.where(F.lower("title").contains("00")).orderBy("title", "document_id").limit(25)
    return first.where(C("waypoint_type").isin("hut", "pass")).orderBy("title", "document_id").limit(5).select("document_id", "title")


@query("SELECT document_id, title, elevation::DOUBLE AS elevation FROM v_poi WHERE document_id = 77")
def src16_document_by_id(t):
    return t.v_poi.where("document_id = 77").select("document_id", "title", C("elevation").cast("double").alias("elevation"))


@query("SELECT document_id, x_m // 1000 AS kx, y_m // 1000 AS ky FROM v_poi WHERE x_m // 1000 = 50 ORDER BY document_id LIMIT 1")
def src09_first_covering_tile(t):
    k = lambda c: F.floor(C(c) / 1000).cast("long")
    return t.v_poi.select("document_id", k("x_m").alias("kx"), k("y_m").alias("ky")).where("kx = 50").orderBy("document_id").limit(1)


@query("SELECT document_id, title FROM v_poi WHERE x_m >= 1000 AND x_m < 9000 AND y_m >= 0 AND y_m < 50000")
def src08_bbox_scan(t):
    return t.v_poi.where("x_m >= 1000 AND x_m < 9000 AND y_m >= 0 AND y_m < 50000").select("document_id", "title")


@query("SELECT cleabs, CASE WHEN cleabs % 3 = 0 THEN 'trimmed' WHEN cleabs % 3 = 1 THEN 'full' WHEN hauteur * 1000 >= 3000000 THEN 'remote' ELSE 'download' END AS source FROM v_footprint")
def src07_source_policy(t):
    k = C("cleabs") % 3
    return t.v_footprint.select("cleabs", F.when(k == 0, "trimmed").when(k == 1, "full").when(C("hauteur") * 1000 >= 3000000, "remote").otherwise("download").alias("source"))


@query("SELECT * FROM (SELECT p_partkey, x, y FROM v_hd ORDER BY p_partkey LIMIT 100 OFFSET 100)")
def src13_paged_scan(t):
    return t.v_hd.select("p_partkey", "x", "y").orderBy("p_partkey").offset(100).limit(100)


@query("SELECT x, y FROM v_hd WHERE p_partkey % 4 = 0 EXCEPT SELECT x, y FROM v_hd WHERE p_partkey % 6 = 0")
def src39_fetch_missing(t):
    return t.v_hd.where("p_partkey % 4 = 0").select("x", "y").distinct().join(t.v_hd.where("p_partkey % 6 = 0").select("x", "y"), ["x", "y"], "left_anti")


_DIST = "m AS (SELECT track_id, seq, x_cm, y_cm, coalesce(sqrt((x_cm - px) * (x_cm - px) + (y_cm - py) * (y_cm - py)), 0)::DOUBLE AS step, ts FROM (SELECT *, lag(x_cm) OVER w AS px, lag(y_cm) OVER w AS py FROM v_track WINDOW w AS (PARTITION BY track_id ORDER BY ts, seq))), c AS (SELECT *, sum(step) OVER (PARTITION BY track_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS dist FROM m)"


@query(f"WITH {_DIST} SELECT track_id, seq, round(dist, 4) AS dist FROM c")
def win01_cumulative_distance(t):
    return tracks.cumulative_distance(t.v_track, "track_id", ["ts", "seq"], "x_cm", "y_cm").select("track_id", "seq", F.round("dist", 4).alias("dist"))


@query(f"""WITH {_DIST}, b AS (SELECT track_id, max(dist) AS high FROM c GROUP BY track_id), q AS (SELECT track_id, d::DOUBLE AS d, least(greatest(d, 0), high) AS pos FROM b, (VALUES (-5), (15), (5000), (20000), (99999999)) v(d)),
 s AS (SELECT *, lead(dist) OVER w AS nd, lead(x_cm) OVER w AS nx, lead(y_cm) OVER w AS ny FROM c WINDOW w AS (PARTITION BY track_id ORDER BY dist, ts, seq)),
 f AS (SELECT q.track_id, d, x_cm, y_cm, nx, ny, CASE WHEN nd IS NULL THEN 0 ELSE (pos - dist) / (nd - dist) END AS k FROM q JOIN s ON q.track_id = s.track_id AND pos >= dist AND ((nd IS NULL AND pos = dist) OR (pos < nd AND nd > dist)))
 SELECT track_id, d, round(x_cm + (coalesce(nx, x_cm) - x_cm) * k, 3) AS x_cm, round(y_cm + (coalesce(ny, y_cm) - y_cm) * k, 3) AS y_cm FROM f""")
def win02_point_at(t):
    m = tracks.cumulative_distance(t.v_track, "track_id", ["ts", "seq"], "x_cm", "y_cm")
    asked = t.v_track.select("track_id").distinct().withColumn("d", F.explode(F.array(*[F.lit(float(v)) for v in (-5, 15, 5000, 20000, 99999999)])))
    return tracks.point_at(m, asked, "track_id", ["x_cm", "y_cm"]).select("track_id", "d", F.round("x_cm", 3).alias("x_cm"), F.round("y_cm", 3).alias("y_cm"))


@query("""WITH RECURSIVE o AS (SELECT track_id, seq, x_cm::DOUBLE AS v, epoch(ts) / 3600.0::DOUBLE AS h, row_number() OVER (PARTITION BY track_id ORDER BY ts, seq) AS n FROM v_track),
 r AS (SELECT track_id, seq, n, v AS s, h FROM o WHERE n = 1 UNION ALL SELECT o.track_id, o.seq, o.n, r.s + (o.v - r.s) * (1 - exp(-(o.h - r.h) / 5.0)), o.h FROM r JOIN o ON o.track_id = r.track_id AND o.n = r.n + 1) SELECT track_id, seq, round(s, 4) AS smooth FROM r""")
def win03_exponential_smoothing(t):
    hours = F.unix_micros(C("ts").cast("timestamp")) / 1e6 / 3600.0
    return tracks.exponential_smooth(t.v_track, "track_id", ["ts", "seq"], "x_cm", hours, 5.0).select("track_id", "seq", F.round("smooth", 4).alias("smooth"))


@query("""WITH RECURSIVE l AS (SELECT waypoint_type AS k, document_id AS id, x_m AS x0, y_m AS y0, x_m + 4000 AS x1, y_m + 3000 AS y1, row_number() OVER (PARTITION BY waypoint_type ORDER BY document_id) AS n FROM v_poi),
 r AS (SELECT k, 1::BIGINT AS n, [{'id': id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}] AS kept FROM l WHERE n = 1
 UNION ALL SELECT r.k, l.n, CASE WHEN len(list_filter(r.kept, lambda b: l.x0 < b.x1 AND l.x1 > b.x0 AND l.y0 < b.y1 AND l.y1 > b.y0)) = 0 THEN list_append(r.kept, {'id': l.id, 'x0': l.x0, 'y0': l.y0, 'x1': l.x1, 'y1': l.y1}) ELSE r.kept END FROM r JOIN l ON l.k = r.k AND l.n = r.n + 1)
 SELECT k, b.id FROM (SELECT k, unnest(kept) AS b FROM r QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC) = 1)""".replace("SELECT k, unnest(kept) AS b FROM r QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC) = 1", "SELECT k, unnest(arg_max(kept, n)) AS b FROM r GROUP BY k"))
def win05_declutter(t):
    labels = t.v_poi.select(C("waypoint_type").alias("k"), C("document_id").alias("id"), C("x_m").alias("x0"), C("y_m").alias("y0"), (C("x_m") + 4000).alias("x1"), (C("y_m") + 3000).alias("y1"))
    return tracks.declutter(labels, "k", ["id"]).select("k", "id")


@query("SELECT track_id, seq, CAST(floor((x_cm - 1000) / 8000.0 * 256) AS BIGINT) AS px, CAST(floor((1000 + 8000 - y_cm) / 8000.0 * 256) AS BIGINT) AS py FROM v_track WHERE floor((x_cm - 1000) / 8000.0 * 256) BETWEEN 0 AND 255 AND floor((1000 + 8000 - y_cm) / 8000.0 * 256) BETWEEN 0 AND 255")
def ana22_trace_pixels(t):
    p = t.v_track.select("track_id", "seq", C("x_cm").alias("x"), C("y_cm").alias("y"))
    return tracks.paint(p, "track_id", ["seq"], (1000.0, 1000.0, 8000.0))


@query("SELECT document_id, round(degrees(asin(sin(radians(46.5)) * sin(d) + cos(radians(46.5)) * cos(d) * cos(radians((document_id % 24 - 12) * 15.0)))), 6) AS altitude FROM (SELECT document_id, radians(-23.44) * cos(2 * pi() * (document_id % 365 + 10) / 365.0) AS d FROM v_poi)")
def scl39_solar_altitude(t):
    d = C("document_id")
    return t.v_poi.select("document_id", F.round(tracks.solar_altitude(d % 24, d % 365, 46.5), 6).alias("altitude"))


@query("SELECT track_id, count(*) AS points, CAST(max(x_cm) AS BIGINT) AS top FROM v_track GROUP BY track_id HAVING count(*) > 1")
def src28_tracks_with_points(t):
    return t.v_track.groupBy("track_id").agg(F.count("*").alias("points"), F.max("x_cm").alias("top")).where("points > 1")


@query("SELECT conv_id, arg_max(text, turn) AS latest, max(turn) AS turn FROM conversations GROUP BY conv_id")
def str03_latest_wins(t):
    return t.conversations.groupBy("conv_id").agg(F.max_by("text", "turn").alias("latest"), F.max("turn").alias("turn"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT track_id) AS tracks FROM v_track GROUP BY event_type")
def msc06_traces_flattened(t):
    return t.v_track.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("track_id").alias("tracks"))


@query("SELECT document_id, round((least(1.0, greatest(-1.0, (document_id % 300 - 150) / 100.0)) + 1) / 2, 6)::DOUBLE AS r FROM v_poi")
def msc22_recolour(t):
    v = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (C("document_id") % 300 - 150) / 100.0))
    return t.v_poi.select("document_id", F.round((v + 1) / 2, 6).alias("r"))
