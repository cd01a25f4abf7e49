"""Derived views over the driver's tables: one portable SQL text each, read by Spark and by the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from cairn.session import read_table

#: View name -> (source table, SQL). "{t}" stands for the table.
VIEWS = {
    "v_point": (
        "lineitem",
        """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
 5000000 + (l_partkey * 1009) % 2700000 AS lon_u,
 43800000 + (l_suppkey * 27011 + l_orderkey * 13) % 2700000 AS lat_u,
 (l_partkey * 7919 + l_orderkey * 101) % 1000000 AS x_cm,
 (l_suppkey * 104729 + l_orderkey * 37) % 1000000 AS y_cm,
 CAST(floor(l_extendedprice * 4) AS BIGINT) AS z_cm,
 CASE l_linenumber WHEN 1 THEN 2 WHEN 2 THEN 5 WHEN 3 THEN 9 WHEN 4 THEN 1 WHEN 5 THEN 3 WHEN 6 THEN 10 ELSE 6 END AS classification,
 l_suppkey % 16 AS source_id,
 CAST(l_quantity AS INT) - 25 AS scan_angle,
 CAST(year(l_shipdate) * 372 + month(l_shipdate) * 31 + day(l_shipdate) AS DOUBLE) AS gps_time
FROM {t}""",
    ),
    "v_tile": (
        "orders",
        """SELECT o_orderkey, level, cx, cy, cx * n + (o_orderkey * 31) % n AS x, cy * n + (o_orderkey * 17) % n AS y, bytes
FROM (SELECT o_orderkey, 11 + o_orderkey % 8 AS level, CAST(power(2, o_orderkey % 8) AS BIGINT) AS n,
 1057 + o_custkey % 6 AS cx, 735 + (o_orderkey * 7) % 6 AS cy,
 CASE WHEN o_orderstatus = 'P' THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS bytes FROM {t}) t""",
    ),
    "v_hd": (
        "part",
        """SELECT p_partkey, 16912 + p_partkey % 96 AS x, 11760 + CAST(floor(CAST(p_partkey AS DOUBLE) / 96) AS BIGINT) AS y,
 15 + p_size % 5 AS max_level, CAST(floor(p_retailprice * 4) AS BIGINT) AS z_hi FROM {t}""",
    ),
    "v_poi": (
        "customer",
        """SELECT c_custkey AS document_id, c_name AS title,
 CASE c_mktsegment WHEN 'BUILDING' THEN 'hut' WHEN 'AUTOMOBILE' THEN 'access' WHEN 'MACHINERY' THEN 'pass' WHEN 'HOUSEHOLD' THEN 'summit' ELSE 'other' END AS waypoint_type,
 CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS elevation,
 (c_custkey * 7919) % 100000 AS x_m, (c_custkey * 104729) % 100000 AS y_m FROM {t}""",
    ),
    "v_footprint": (
        "supplier",
        """SELECT s_suppkey AS cleabs, (s_suppkey * 977) % 5000 AS x0, (s_suppkey * 1409) % 5000 AS y0,
 (s_suppkey * 977) % 5000 + 20 + s_suppkey % 37 AS x1, (s_suppkey * 1409) % 5000 + 15 + s_suppkey % 23 AS y1,
 CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal END AS hauteur FROM {t}""",
    ),
    "v_track": (
        "events",
        """SELECT user_id AS track_id, event_id AS seq, ts, event_type, CAST(round(value * 100) AS BIGINT) AS x_cm,
 (event_id * 613) % 10000 AS y_cm FROM {t}""",
    ),
    "v_doc": (
        "documents",
        """SELECT doc_id, concat('[img=', CAST(doc_id % 50 AS VARCHAR(20)), ' right] ', lang, ' [/img] text [img=', CAST(doc_id % 7 AS VARCHAR(20)), ']', source, '[/img]') AS raw FROM {t}""",
    ),
    "v_raster": (
        "",
        """SELECT r.id AS row, c.id AS col, CASE WHEN (r.id * 5 + c.id * 3) % 17 = 0 THEN NULL ELSE (r.id * 37 + c.id * 91 + r.id * c.id) % 400 END AS z
FROM range(64) AS r(id) CROSS JOIN range(64) AS c(id)""",
    ),
    "v_mesh_vertex": ("", "SELECT r.id * 24 + c.id AS vid, c.id * 10 AS x, r.id * 10 AS y, (r.id * 37 + c.id * 91) % 50 AS z FROM range(24) AS r(id) CROSS JOIN range(24) AS c(id)"),
    "v_mesh_face": (
        "",
        """SELECT (r.id * 23 + c.id) * 2 + k.id AS fid, r.id * 24 + c.id + CASE WHEN k.id = 0 THEN 0 ELSE 1 END AS a,
 r.id * 24 + c.id + CASE WHEN k.id = 0 THEN 1 ELSE 25 END AS b, r.id * 24 + c.id + 24 AS c
FROM range(23) AS r(id) CROSS JOIN range(23) AS c(id) CROSS JOIN range(2) AS k(id)
WHERE c.id <> 13 AND r.id <> 5 AND (r.id * 7 + c.id * 5) % 11 <> 0""",
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, sql = VIEWS[name]
    if not table:
        return spark.sql(sql)
    return spark.sql(sql.format(t="{source}"), source=read_table(spark, sf_dir, table))


def with_views(sql: str) -> str:
    """The oracle's text, preceded by the views that it names."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    text = ", ".join(f"{v} AS ({VIEWS[v][1].format(t=VIEWS[v][0])})" for v in used)
    if not used:
        return sql
    body = sql.strip()
    if re.match(r"(?i)with recursive\b", body):
        return f"WITH RECURSIVE {text}, {body[14:]}"
    return f"WITH {text}, {body[4:]}" if re.match(r"(?i)with\b", body) else f"WITH {text} {body}"
