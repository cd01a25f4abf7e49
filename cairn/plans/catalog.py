"""Queries on tile catalogues."""

from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import catalog as cat
from cairn.operators.ordered import percentiles
from cairn.plans.registry import query

C = F.col


@query("SELECT round(quantile_cont(bytes, 0.5), 4)::DOUBLE AS p50, round(quantile_cont(bytes, 0.05), 4)::DOUBLE AS p5, round(quantile_cont(bytes, 0.95), 4)::DOUBLE AS p95, level FROM v_tile WHERE bytes > 0 GROUP BY level")
def agg15_percentile(t):
    found = percentiles(t.v_tile.where("bytes > 0"), ["level"], "bytes", {"p50": 0.5, "p5": 0.05, "p95": 0.95})
    return found.select("level", *[F.round(k, 4).alias(k) for k in ("p50", "p5", "p95")])


_BEST = "b AS (SELECT level, x, y, max(bytes) AS bytes FROM v_tile GROUP BY ALL)"
_WANT = "w AS (SELECT l AS level, cx * CAST(power(2, l - 11) AS BIGINT) + i AS x, cy * CAST(power(2, l - 11) AS BIGINT) + j AS y FROM (SELECT DISTINCT cx, cy FROM v_tile) c, range(11, 15) r(l), range(8) a(i), range(8) d(j) WHERE i < power(2, l - 11) AND j < power(2, l - 11))"


def _required(t):
    side = F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2), C("level") - 11).cast("long") - 1)
    c = t.v_tile.select("cx", "cy").distinct().withColumn("level", F.explode(F.sequence(F.lit(11).cast("long"), F.lit(14).cast("long"))))
    n = F.pow(F.lit(2), C("level") - 11).cast("long")
    return c.withColumn("i", F.explode(side)).withColumn("j", F.explode(side)).select("level", (C("cx") * n + C("i")).alias("x"), (C("cy") * n + C("j")).alias("y"))


@query(f"WITH {_BEST}, {_WANT} SELECT level, count(*) AS total, count(*) FILTER (WHERE coalesce(bytes, 0) = 0) AS missing, round(coalesce(quantile_cont(bytes / 1000.0::DOUBLE, 0.5) FILTER (WHERE bytes > 0), 0), 6)::DOUBLE AS median_kb, round(coalesce(quantile_cont(bytes / 1000.0::DOUBLE, 0.05) FILTER (WHERE bytes > 0), 0), 6)::DOUBLE AS p5_kb, round(coalesce(quantile_cont(bytes / 1000.0::DOUBLE, 0.95) FILTER (WHERE bytes > 0), 0), 6)::DOUBLE AS p95_kb FROM w LEFT JOIN b USING (level, x, y) GROUP BY level")
def agg16_level_stats(t):
    return cat.level_stats(_required(t), t.v_tile).withColumns({k: F.round(k, 6) for k in ("median_kb", "p5_kb", "p95_kb")})


@query("SELECT string_agg(x, ',' ORDER BY x, y, max_level, z_hi) AS xs, string_agg(y, ',' ORDER BY x, y, max_level, z_hi) AS ys, string_agg(max_level, ',' ORDER BY x, y, max_level, z_hi) AS levels, string_agg(z_hi, ',' ORDER BY x, y, max_level, z_hi) AS z, greatest(max(x) - min(x), max(y) - min(y)) / 2.0::DOUBLE + 20000 AS radius FROM v_hd WHERE p_partkey < 500")
def agg17_snk07_assemble_pack(t):
    return cat.assemble_pack(t.v_hd.where("p_partkey < 500")).withColumns({k: F.array_join(k, ",") for k in ("xs", "ys", "levels", "z")})


@query("SELECT x // 16 AS cx, y // 16 AS cy, greatest(max(z_hi), 0) AS z, count(*) AS tiles FROM v_hd GROUP BY ALL")
def agg18_cell_z_range(t):
    cells = t.v_hd.groupBy(F.floor(C("x") / 16).cast("long").alias("cx"), F.floor(C("y") / 16).cast("long").alias("cy")).agg(F.collect_list("z_hi").alias("zs"))
    return cells.select("cx", "cy", F.greatest(F.coalesce(F.array_max("zs"), F.lit(0)), F.lit(0)).cast("long").alias("z"), F.size("zs").cast("long").alias("tiles"))


@query("SELECT cx, cy, max(level) AS finest FROM v_tile WHERE bytes > 0 GROUP BY ALL")
def agg19_finest_level(t):
    doc = t.v_tile.where("bytes > 0").groupBy("cx", "cy").agg(F.to_json(F.struct(F.max("level").alias("availableLevels"))).alias("doc"))
    return doc.select("cx", "cy", F.from_json("doc", "availableLevels bigint")["availableLevels"].alias("finest"))


_WALK = """h AS (SELECT DISTINCT level, x, y FROM v_tile WHERE bytes > 0), s AS (SELECT DISTINCT x, y FROM h WHERE level = 13),
 g AS (SELECT s.x, s.y, l, h.x IS NOT NULL AS here FROM s, range(13, 19) r(l) LEFT JOIN h ON h.level = l AND h.x = s.x * CAST(power(2, l - 13) AS BIGINT) AND h.y = s.y * CAST(power(2, l - 13) AS BIGINT))"""


@query(f"WITH {_WALK} SELECT x, y, CAST(coalesce(min(l) FILTER (WHERE NOT here), 19) - 1 AS INT) AS max_level FROM g GROUP BY x, y")
def agg20_level_walk(t):
    held = t.v_tile.where("bytes > 0").select("level", "x", "y")
    return cat.max_levels(held.where("level = 13").select("x", "y").distinct(), held, 13, 18)


@query("SELECT DISTINCT level - u AS level, x >> u::INT AS x, y >> u::INT AS y FROM v_tile, range(8) r(u) WHERE level - u >= 11 AND bytes > 0")
def agg21_ancestor_closure(t):
    return cat.closure(t.v_tile.where("bytes > 0"), C("level"), 11)


_MORTON = " + ".join(f"((lx >> {k}) & 1) * {4**k} + ((ly >> {k}) & 1) * {2 * 4**k}" for k in range(4))


_PLACES = "p AS (SELECT DISTINCT cx, cy, level - 11 AS d, x - cx * CAST(power(2, level - 11) AS BIGINT) AS lx, y - cy * CAST(power(2, level - 11) AS BIGINT) AS ly FROM v_tile WHERE level < 15 AND bytes > 0)"


def _bits(places, name):
    """SQL of each cell's bits as hex, from its places."""
    return f"""{name}a AS (SELECT DISTINCT cx, cy, CAST((power(4, d) - 1) / 3 AS BIGINT) + {_MORTON} AS pos FROM {places}),
 {name}b AS (SELECT cx, cy, pos // 8 AS k, CAST(sum(1 << (pos % 8)::INT) AS BIGINT) AS v FROM {name}a GROUP BY ALL),
 {name}f AS (SELECT c.cx, c.cy, k, coalesce(v, 0) AS v FROM (SELECT DISTINCT cx, cy FROM {name}a) c CROSS JOIN range(11) r(k) LEFT JOIN {name}b USING (cx, cy, k)),
 {name} AS (SELECT cx, cy, upper(string_agg(lpad(to_hex(v), 2, '0'), '' ORDER BY k)) AS bits FROM {name}f GROUP BY cx, cy)"""


def _places(t):
    n = F.pow(F.lit(2), C("level") - 11).cast("long")
    return t.v_tile.where("level < 15 AND bytes > 0").select("cx", "cy", (C("level") - 11).alias("d"), (C("x") - C("cx") * n).alias("lx"), (C("y") - C("cy") * n).alias("ly"))


@query(f"WITH {_PLACES}, {_bits('p', 'own')} SELECT cx, cy, bits FROM own")
def agg22_availability_bits(t):
    return cat.availability_bits(_places(t), 4)


#: The JSON of a subtree of 85 places without children, padded to a multiple of 8.
_SUBTREE = '{"buffers":[{"byteLength":27}],"bufferViews":[{"buffer":0,"byteOffset":0,"byteLength":11},{"buffer":0,"byteOffset":16,"byteLength":11}],"tileAvailability":{"bitstream":0},"contentAvailability":[{"bitstream":1}],"childSubtreeAvailability":{"constant":0}}'
_SUBTREE += " " * (-len(_SUBTREE) % 8)
_HEAD = (b"subt" + b"".join(n.to_bytes(size, "little") for n, size in ((1, 4), (len(_SUBTREE), 8), (32, 8)))).hex()


@query(f"""WITH {_PLACES}, up AS (SELECT DISTINCT cx, cy, d - u AS d, lx >> u::INT AS lx, ly >> u::INT AS ly FROM p, range(4) r(u) WHERE u <= d), {_bits('p', 'own')}, {_bits('up', 'every')},
 s AS (SELECT cx, cy, from_hex('{_HEAD}') || encode('{_SUBTREE}') || from_hex(every.bits || '0000000000' || own.bits || '0000000000') AS b FROM own JOIN every USING (cx, cy))
 SELECT cx, cy, octet_length(b) AS n_bytes, sha256(b) AS digest FROM s""")
def snk06_subtree_bytes(t):
    return cat.subtrees(_places(t), 4).select("cx", "cy", F.length("subtree").alias("n_bytes"), F.sha2("subtree", 256).alias("digest"))


@query("SELECT CASE WHEN bytes > 0 THEN 'ok' ELSE 'failed' END AS outcome, count(*) AS n FROM v_tile GROUP BY ALL")
def agg24_job_counters(t):
    return t.v_tile.groupBy(F.when(C("bytes") > 0, "ok").otherwise("failed").alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT level, round(100.0 * sum(bytes) / (SELECT sum(bytes) FROM v_tile), 6) AS share FROM v_tile GROUP BY level")
def agg25_timing_shares(t):
    from pyspark.sql import Window

    per = t.v_tile.groupBy("level").agg(F.sum("bytes").alias("b"))
    return per.select("level", F.round(F.lit(100.0) * C("b") / F.sum("b").over(Window.partitionBy()), 6).alias("share"))


@query("SELECT level, CAST(sum(floor(bytes / 1000.0)) AS BIGINT) AS kb, count(*) AS n FROM v_tile GROUP BY level")
def agg29_box_report(t):
    return t.v_tile.groupBy("level").agg(F.sum(F.floor(C("bytes") / 1000.0)).cast("long").alias("kb"), F.count("*").alias("n"))


@query("SELECT x, y FROM v_hd EXCEPT SELECT x, y FROM v_tile WHERE level = 15 AND bytes > 0")
def jon06_missing_tiles(t):
    return t.v_hd.select("x", "y").distinct().join(t.v_tile.where("level = 15 AND bytes > 0").select("x", "y").distinct(), ["x", "y"], "left_anti")


@query("SELECT cx, cy, CAST(l AS INT) AS level FROM (SELECT DISTINCT cx, cy FROM v_tile) c, range(11, 19) r(l) WHERE NOT EXISTS (SELECT 1 FROM v_tile t WHERE t.cx = c.cx AND t.cy = c.cy AND t.level = l AND bytes > 60000)")
def jon07_ana24_missing_levels(t):
    return cat.missing_levels(t.v_tile, t.v_tile.where("bytes > 60000"), list(range(11, 19)))


@query("SELECT p_partkey, h.x, h.y, max_level, coalesce(n, 0) AS stored FROM v_hd h LEFT JOIN (SELECT x >> (level - 11)::INT AS ax, y >> (level - 11)::INT AS ay, count(*) AS n FROM v_tile GROUP BY ALL) k ON h.x >> 4 = ax AND h.y >> 4 = ay")
def jon14_leaf_lookup(t):
    sr = lambda c, k: F.call_function("shiftright", c, k)
    up = (C("level") - 11).cast("int")
    k = t.v_tile.groupBy(sr(C("x"), up).alias("ax"), sr(C("y"), up).alias("ay")).agg(F.count("*").alias("n"))
    h = t.v_hd.withColumn("ax", sr(C("x"), F.lit(4))).withColumn("ay", sr(C("y"), F.lit(4)))
    return h.join(k, ["ax", "ay"], "left").select("p_partkey", "x", "y", "max_level", F.coalesce("n", F.lit(0)).alias("stored"))


@query("SELECT count(*) AS selected, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM v_tile t WHERE t.level = 15 AND t.x = h.x AND t.y = h.y AND bytes > 0)) AS built FROM v_hd h")
def jon24_built_counts(t):
    built = t.v_tile.where("level = 15 AND bytes > 0").select("x", "y").distinct().withColumn("b", F.lit(1))
    return t.v_hd.join(built, ["x", "y"], "left").agg(F.count("*").alias("selected"), F.count("b").alias("built"))


_LACK = "h AS (SELECT DISTINCT level, x, y FROM v_tile WHERE bytes > 0), s AS (SELECT DISTINCT x, y FROM h WHERE level = 15 AND NOT EXISTS (SELECT 1 FROM v_hd v WHERE v.x = h.x AND v.y = h.y)), g AS (SELECT s.x, s.y, l, h.x IS NOT NULL AS here FROM s, range(15, 19) r(l) LEFT JOIN h ON h.level = l AND h.x = s.x * CAST(power(2, l - 15) AS BIGINT) AND h.y = s.y * CAST(power(2, l - 15) AS BIGINT))"


@query(f"WITH {_LACK} SELECT x, y, CAST(max_level AS BIGINT) AS max_level, z_hi, false AS added FROM v_hd UNION ALL SELECT x, y, coalesce(min(l) FILTER (WHERE NOT here), 19) - 1, 0, true FROM g GROUP BY x, y")
def ana23_catalogue_repair(t):
    return cat.repair(t.v_hd, t.v_tile, 15, 18)


@query("SELECT o_orderkey, level, bytes, back, total FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY o_orderkey DESC) AS back, count(*) OVER (PARTITION BY level) AS total FROM v_tile) WHERE back <= 5")
def win06_src32_last_entries(t):
    return cat.last_entries(t.v_tile, "level", [C("o_orderkey").desc()], 5).select("o_orderkey", "level", "bytes", C("back").cast("long").alias("back"), "total")


@query("SELECT DISTINCT concat(cx, '.', cy) AS prefix FROM v_tile")
def src21_common_prefixes(t):
    from cairn.functions.tiles import tile_path

    return t.v_tile.select(F.substring_index(tile_path(C("x"), C("y"), C("level")), "/", 1).alias("prefix")).distinct()


@query("SELECT x, y, max(bytes) AS bytes FROM v_tile WHERE level = 14 GROUP BY ALL")
def src22_src36_list_level(t):
    from cairn.functions.tiles import parse_tile_path, tile_path

    listing = t.v_tile.select(tile_path(C("x"), C("y"), C("level")).alias("path"), "bytes")
    level, x, y = parse_tile_path(C("path"))
    return listing.select(level.alias("level"), x.alias("x"), y.alias("y"), "bytes").where("level = 14").groupBy("x", "y").agg(F.max("bytes").alias("bytes"))


@query("SELECT DISTINCT cx, cy, level FROM v_tile WHERE bytes > 0 AND level IN (12, 15)")
def src23_existence_probe(t):
    asked = t.v_tile.select("cx", "cy", "level").where("level IN (12, 15)").distinct()
    return asked.join(t.v_tile.where("bytes > 0").select("cx", "cy", "level"), ["cx", "cy", "level"], "left_semi")


@query("SELECT p_partkey, coalesce(lv, 11) AS level FROM v_hd LEFT JOIN (SELECT DISTINCT x, y, level AS lv FROM v_tile WHERE level = 15) k USING (x, y)")
def src25_default_on_missing(t):
    return t.v_hd.join(t.v_tile.where("level = 15").select("x", "y", C("level").alias("lv")).distinct(), ["x", "y"], "left").select("p_partkey", F.coalesce("lv", F.lit(11)).cast("long").alias("level"))


@query("SELECT cx, cy, '[' || string_agg(DISTINCT concat('[', x, ',', y, ']'), ',' ORDER BY concat('[', x, ',', y, ']')) || ']' AS jobs FROM v_tile WHERE level = 12 GROUP BY cx, cy")
def snk09_job_list(t):
    job = F.concat(F.lit("["), C("x").cast("string"), F.lit(","), C("y").cast("string"), F.lit("]"))
    return t.v_tile.where("level = 12").groupBy("cx", "cy").agg(F.array_sort(F.collect_set(job)).alias("j")).select("cx", "cy", F.concat(F.lit("["), F.array_join("j", ","), F.lit("]")).alias("jobs"))


@query("SELECT string_agg(k, ',' ORDER BY k) AS manifest FROM (SELECT DISTINCT concat(cx, '.', cy) AS k FROM v_tile)")
def snk10_manifest(t):
    return t.v_tile.select(F.concat_ws(".", "cx", "cy").alias("k")).distinct().agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("manifest"))


@query("SELECT cleabs, x0, y0, coalesce(hauteur, 0)::DOUBLE AS hauteur, concat('[', x0, ',', y0, ',', x1, ',', y1, ']') AS geometry FROM v_footprint WHERE x1 > x0")
def snk08_footprint_table(t):
    box = F.concat(F.lit("["), F.concat_ws(",", *[C(k).cast("string") for k in ("x0", "y0", "x1", "y1")]), F.lit("]"))
    return t.v_footprint.where("x1 > x0").select("cleabs", "x0", "y0", F.coalesce("hauteur", F.lit(0)).cast("double").alias("hauteur"), box.alias("geometry"))


@query("SELECT level, concat('{', string_agg(concat('\"', cx, '.', cy, '\":', n), ',' ORDER BY concat(cx, '.', cy)), '}') AS doc FROM (SELECT level, cx, cy, count(*) AS n FROM v_tile GROUP BY ALL) GROUP BY level")
def snk14_manifest_json(t):
    per = t.v_tile.groupBy("level", F.concat_ws(".", "cx", "cy").alias("k")).agg(F.count("*").alias("n"))
    return per.groupBy("level").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n"))))).alias("doc"))


@query("SELECT level, count(*) AS jobs, count(*) FILTER (WHERE bytes = 0) AS failed, count(*) FILTER (WHERE bytes > 0) = 0 AS all_failed FROM v_tile GROUP BY level")
def msc02_msc11_partial_failure(t):
    return t.v_tile.groupBy("level").agg(F.count("*").alias("jobs"), F.count_if(C("bytes") == 0).alias("failed"), (F.count_if(C("bytes") > 0) == 0).alias("all_failed"))


@query("SELECT level, printf('%2d %8d %8.1f', level, n, kb) AS line FROM (SELECT level, count(*) AS n, floor(sum(bytes) / 100.0) / 10.0 AS kb FROM v_tile GROUP BY level)")
def msc13_text_report(t):
    per = t.v_tile.groupBy("level").agg(F.count("*").alias("n"), (F.floor(F.sum("bytes") / 100.0) / 10.0).alias("kb"))
    return per.select("level", F.format_string("%2d %8d %8.1f", "level", "n", "kb").alias("line"))


@query("SELECT DISTINCT cx, cy, arg_max(level, o_orderkey) OVER (PARTITION BY cx, cy) AS level FROM v_tile")
def msc08_last_wins(t):
    return t.v_tile.groupBy("cx", "cy").agg(F.max_by("level", "o_orderkey").alias("level"))


@query("SELECT document_id, CAST(floor(x_m / 1000.0) - 768 AS BIGINT) AS cx, CAST(floor(y_m / 1000.0) - 6144 AS BIGINT) AS cy FROM v_poi")
def msc25_screen_cell(t):
    return t.v_poi.select("document_id", (F.floor(C("x_m") / 1000) - 768).cast("long").alias("cx"), (F.floor(C("y_m") / 1000) - 6144).cast("long").alias("cy"))


@query("SELECT p_partkey, greatest(3.0::DOUBLE, 400.0 / power(2, max_level - 13)) AS half FROM v_hd")
def msc28_coverage_map(t):
    return t.v_hd.select("p_partkey", F.greatest(F.lit(3.0), F.lit(400.0) / F.pow(F.lit(2.0), C("max_level") - 13)).alias("half"))


@query("SELECT cx, cy, level, count(*) AS n, concat(cx, '.', cy, ':', level) AS params FROM v_tile GROUP BY ALL")
def msc17_job_params(t):
    return t.v_tile.groupBy("cx", "cy", "level").agg(F.count("*").alias("n")).withColumn("params", F.concat(F.concat_ws(".", "cx", "cy"), F.lit(":"), C("level").cast("string")))
