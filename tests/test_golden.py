"""Values that are known beforehand."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import frames, geometry, text, tiles


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(cols)]).first())


def lit(v):
    return F.lit(v)


def test_l93_origin_and_a_point(spark):
    x, y = one(spark, *frames.geodetic_to_l93(lit(3.0), lit(46.5)))
    assert (x, y) == pytest.approx((700000, 6600000), abs=1e-6)
    x, y = one(spark, *frames.geodetic_to_l93(lit(6.359697), lit(44.922199)))
    assert (x, y) == pytest.approx((965029.7006, 6430417.0258), abs=1e-3)


def test_round_trips(spark):
    for frame in ("l93", "work"):
        back = one(spark, *frames.convert(*frames.convert(lit(6.1), lit(45.2), "geodetic", frame), frame, "geodetic"))
        assert back == pytest.approx((6.1, 45.2), abs=1e-11)


def test_tile_sizes():
    assert frames.work_tile_size(11) == pytest.approx(13715.3078, abs=1e-3)
    assert frames.work_tile_size(15) == pytest.approx(857.2067, abs=1e-3)


def test_level_invariant():
    with pytest.raises(ValueError):
        frames.check_levels(15, 15)


@pytest.mark.parametrize("source,x,y,z,expected", [("ortho", 1057, 736, 11, (10, 528, 368)), ("plan", 4000, 3000, 20, (17, 500, 375))])
def test_imagery_tile(spark, source, x, y, z, expected):
    assert one(spark, *tiles.imagery_tile(lit(source), lit(x), lit(y), lit(z))) == expected


def test_mercator_bounds_halve(spark):
    x0, y0, s = one(spark, *frames.mercator_bounds(lit(0), lit(0), lit(0)))
    assert (x0, y0, s) == pytest.approx((-20037508.342789244, -20037508.342789244, 40075016.685578488))
    parent, child = (one(spark, *frames.mercator_bounds(lit(z), lit(x), lit(y))) for z, x, y in ((5, 3, 3), (6, 6, 6)))
    assert child[2] * 2 == pytest.approx(parent[2]) and child[0] == pytest.approx(parent[0]) and child[1] == pytest.approx(parent[1] + child[2])


def test_tile_path_of_job(spark):
    assert one(spark, tiles.tile_path(lit(16948), lit(11778), lit(15)))[0] == "1059.736/4/4.2.glb"
    assert one(spark, *tiles.parse_tile_path(lit("1059.736/4/4.2.glb"))) == (15, 16948, 11778)
    assert one(spark, *tiles.parse_tile_path(lit("readme.txt"))) == (None, None, None)


def test_required_cells_of_job(spark):
    from cairn.plans.tiling import required_km_cells

    jobs = spark.createDataFrame([(16948, 11778)], "x long, y long")
    assert {(r.x_km, r.y_km) for r in required_km_cells(jobs, 15).collect()} == {(x, y) for x in (951, 952) for y in (6446, 6447)}


def test_stems(spark):
    assert one(spark, *tiles.km_cell_of_stem(lit("LHD_FXX_0963_6423_PTS.copc.laz"))) == (963, 6422)
    assert one(spark, tiles.stem_of_km_cell(lit(963), lit(6422)))[0] == "0963_6423"


@pytest.mark.parametrize("altitude,azimuth,expected", [(90, 0, (0, 0, 1)), (0, 0, (0, 1, 0)), (0, 90, (1, 0, 0)), (0, 180, (0, -1, 0)), (0, 270, (-1, 0, 0)), (-90, 0, (0, 0, -1))])
def test_sun_direction(spark, altitude, azimuth, expected):
    assert one(spark, *geometry.sun_direction(lit(altitude), lit(azimuth))) == pytest.approx(expected, abs=1e-12)


@pytest.mark.parametrize("low,high,expected", [(-3, 4, 0), (-20, 20, 0), (3, 30, 8), (-30, -3, -8), (-5, 0, -2)])
def test_representative_angle(spark, low, high, expected):
    assert one(spark, geometry.representative_angle(lit(low), lit(high)))[0] == expected


@pytest.mark.parametrize("a,b,hit", [((0, 0), (10, 10), True), ((0, 0), (1, 1), False), ((5, 0), (5, 9), True), ((0, 7), (9, 7), False), ((4, 4), (4, 4), True)])
def test_segment_hits_box(spark, a, b, hit):
    args = [lit(float(v)) for v in (*a, *b, 3, 3, 6, 6)]
    assert one(spark, geometry.segment_hits_box(*args))[0] is hit


def test_track_interpolation(spark):
    from cairn.operators import tracks

    p = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 30.0, 0.0, 30.0), (1, 2, 30.0, 40.0, 130.0)], "id long, seq long, x double, y double, z double")
    m = tracks.cumulative_distance(p, "id", ["seq"], "x", "y")
    assert [r.dist for r in m.orderBy("seq").collect()] == [0, 30, 70]
    asked = spark.createDataFrame([(1, d) for d in (15.0, 50.0, -5.0, 999.0)], "id long, d double")
    got = {r.d: (r.x, r.y, r.z) for r in tracks.point_at(m, asked, "id", ["x", "y", "z"]).collect()}
    assert got == {15.0: (15, 0, 15), 50.0: (30, 20, 80), -5.0: (0, 0, 0), 999.0: (30, 40, 130)}


def test_level_walk(spark):
    from cairn.operators.catalog import max_levels

    present = spark.createDataFrame([(4, 0, 0), (5, 0, 0), (6, 0, 0), (4, 1, 1)], "level long, x long, y long")
    asked = spark.createDataFrame([(0, 0), (1, 1)], "x long, y long")
    assert {(r.x, r.max_level) for r in max_levels(asked, present, 4, 8).collect()} == {(0, 6), (1, 4)}


def test_image_tags(spark):
    raw = "a [img=12 right] one [/img] b [img=7]two[/img] [img=12]again[/img]"
    assert one(spark, text.image_ids(lit(raw)))[0] == ["12", "7"]
    assert one(spark, text.drop_image_tags(lit(raw)))[0] == "a one b two again"
    assert one(spark, text.image_ids(lit("none")))[0] == []


def test_gpx(spark):
    from cairn.sources.documents import parse_gpx

    doc = '<gpx><trk><trkseg><trkpt lat="45" lon="6"><ele>10</ele></trkpt><trkpt lat="46" lon="7"/></trkseg><trkseg><trkpt lat="1" lon="1"/></trkseg></trk></gpx>'
    assert [[tuple(p) for p in s] for s in one(spark, parse_gpx(lit(doc)))[0]] == [[(6, 45, 10), (7, 46, 0)]]
    route = '<gpx><rte><rtept lat="45" lon="6"/><rtept lat="x" lon="7"/><rtept lat="46" lon="8"/></rte></gpx>'
    assert [len(s) for s in one(spark, parse_gpx(lit(route)))[0]] == [2]


def test_pack_round_trip(spark):
    values = F.array(*[lit(v) for v in (0, 1, 255, 256, 65535)])
    assert one(spark, text.unpack_u16(text.pack_u16(values)))[0] == [0, 1, 255, 256, 65535]
    assert one(spark, text.pack_bits(F.array(*[lit(b) for b in [True] + [False] * 8 + [True]])))[0] == "0102"


def test_morton_round_trip(spark):
    df = spark.range(500).select((F.col("id") * 37 % 4096).alias("x"), (F.col("id") * 91 % 4096).alias("y"))
    x, y = tiles.demorton(tiles.morton(F.col("x"), F.col("y")))
    assert df.where((x != F.col("x")) | (y != F.col("y"))).isEmpty()


def test_kernels():
    from cairn.operators import kernels

    side = np.arange(8)
    v = np.array([(x, y, 0.0) for y in side for x in side])
    f = np.array([t for y in range(7) for x in range(7) for a in [y * 8 + x] for t in ((a, a + 1, a + 8), (a + 1, a + 9, a + 8))])
    v2, f2 = kernels.simplify(v, f, 20)
    p = v2[f2]
    assert len(f2) <= 20 and np.abs(np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])[:, 2]).sum() / 2 == pytest.approx(49)
    ring = np.array([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)], float)
    area = lambda t: abs((ring[t[1]][0] - ring[t[0]][0]) * (ring[t[2]][1] - ring[t[0]][1]) - (ring[t[1]][1] - ring[t[0]][1]) * (ring[t[2]][0] - ring[t[0]][0])) / 2
    assert len(kernels.triangulate(ring)) == 3 and sum(map(area, kernels.triangulate(ring))) == pytest.approx(10)
    assert len(kernels.triangulate(ring[::-1])) == 3


def test_subtree_layout():
    from cairn.operators.catalog import subtree

    b = subtree(bytes([1]) + bytes(10), bytes([2]) + bytes(10), bytes(32))
    assert b[:4] == b"subt" and len(b) % 8 == 0 and int.from_bytes(b[16:24], "little") == 16 + 16 + 32
    n = int.from_bytes(b[8:16], "little")
    meta, body = json.loads(b[24 : 24 + n]), b[24 + n :]
    assert [(v["byteOffset"], v["byteLength"]) for v in meta["bufferViews"]] == [(0, 11), (16, 11), (32, 32)] and meta["buffers"] == [{"byteLength": 64}]
    assert meta["contentAvailability"] == [{"bitstream": 1}] and meta["childSubtreeAvailability"] == {"bitstream": 2} and (body[0], body[16]) == (1, 2)
    alone = subtree(bytes(11), bytes(11), True)
    assert json.loads(alone[24 : 24 + int.from_bytes(alone[8:16], "little")])["childSubtreeAvailability"] == {"constant": 1}


def test_scans_in_order(spark):
    from cairn.operators import events, tracks

    rows = [(1, 1, 0.0, 0, 0), (1, 2, 1.0, 0, 0), (1, 3, 5.0, 0, 0), (1, 4, 6.0, 9, 0), (1, 5, None, 9, 9), (2, 1, 0.0, None, 0), (2, 2, 0.5, 1, 1), (2, 3, 0.6, 1, 1), (None, 1, 0.0, 1, 1)]
    e = spark.createDataFrame(rows, "k long, seq long, t double, x long, y long")
    got = lambda df: sorted((tuple(r) for r in df.select("k", "seq").collect()), key=str)
    assert got(events.throttle(e, "k", ["seq"], F.col("t"), 4.0, "x", "y")) == sorted([(1, 1), (1, 4), (2, 1), (None, 1)], key=str)
    assert got(events.double_clicks(e, "k", ["seq"], F.col("t"), 1.0, 2.0, "x", "y")) == [(1, 2), (2, 3)]
    assert events.throttle(e.limit(0), "k", ["seq"], F.col("t"), 4.0, "x", "y").count() == 0
    s = {(r["k"], r["seq"]): r["smooth"] for r in tracks.exponential_smooth(e, "k", ["seq"], "x", F.col("t"), 1.0).collect()}
    assert s[(1, 4)] == pytest.approx(9 * (1 - np.exp(-1))) and s[(1, 5)] == s[(1, 4)] and s[(2, 1)] is None and s[(2, 3)] == 1
    assert events.retry(e.limit(0).select("k"), lambda j: j.withColumn("ok", F.lit(True)), 3).count() == 0


def test_declutter_against_brute_force(spark):
    from cairn.operators.tracks import declutter

    rng = np.random.default_rng(3)
    boxes = [(int(k), n, int(x), int(y), int(x + w), int(y + h)) for n, (k, x, y, w, h) in enumerate(zip(rng.integers(0, 3, 400), rng.integers(-300, 300, 400), rng.integers(-300, 300, 400), rng.integers(1, 60, 400), rng.integers(1, 90, 400), strict=True))]
    kept = []
    for b in boxes:
        if not any(b[0] == k[0] and b[2] < k[4] and b[4] > k[2] and b[3] < k[5] and b[5] > k[3] for k in kept):
            kept.append(b)
    df = spark.createDataFrame(boxes, "k long, n long, x0 long, y0 long, x1 long, y1 long")
    assert sorted(r["n"] for r in declutter(df, "k", ["n"]).collect()) == [b[1] for b in kept]


def test_ply_and_glb_round_trip():
    from cairn.sources import meshes

    v, f = np.array([(0, 0, 1), (1, 0, 2), (0, 1, 3)], float), np.array([(0, 1, 2)])
    v2, f2 = meshes.decode_ply(meshes.encode_ply(v, f))
    assert (v2 == v).all() and (f2 == f).all()
    text_ = b"ply\nformat ascii 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n1 1 0\n0 1 0\n4 0 1 2 3\n"
    assert meshes.decode_ply(text_)[1].tolist() == [[0, 1, 2], [0, 2, 3]]
    glb = meshes.encode_glb(v, f)
    assert len(glb) % 4 == 0 and meshes.glb_heights(glb) == (1, 3) and meshes.glb_heights(b"nope") is None


def test_places_and_percentiles(spark):
    from cairn.operators.ordered import numbered, percentiles

    rows = [(None if n % 7 == 0 else n % 3, n * 37 % 101, n) for n in range(500)]
    df = spark.createDataFrame(rows, "k long, v long, n long")
    want, seen = {}, {}
    for k, v, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        seen[k] = seen.get(k, 0) + 1
        want[n] = seen[k]
    assert {r["n"]: r["place"] for r in numbered(df, ["k"], ["v", "n"], "place").collect()} == want
    assert sorted(r["place"] for r in numbered(df, [], ["v"], "place").collect()) == list(range(1, 501))
    assert numbered(df.limit(0), ["k"], ["v"], "place").count() == 0 == percentiles(df.limit(0), ["k"], "v", {"a": 0.5}).count()
    for r in percentiles(df, ["k"], "v", {"low": 0.05, "mid": 0.5, "top": 1.0}).collect():
        values = [v for k, v, _ in rows if k == r["k"]]
        assert (r["low"], r["mid"], r["top"]) == pytest.approx(tuple(np.percentile(values, [5, 50, 100])))
