"""Queries on event streams, in batch form."""

from pyspark.sql import functions as F

from cairn.operators import events as ev
from cairn.operators.ordered import numbered
from cairn.plans.registry import query

C = F.col
_O = "o AS (SELECT track_id, seq, ts, x_cm, y_cm, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY track_id ORDER BY ts, seq) AS n FROM v_track)"


def _seconds():
    return F.unix_micros(C("ts").cast("timestamp")) / 1e6


@query(f"WITH {_O} SELECT track_id, seq FROM (SELECT *, lead(t) OVER (PARTITION BY track_id ORDER BY ts, seq) AS nt FROM o) WHERE nt IS NULL OR nt - t >= 7200")
def str01_debounce(t):
    return ev.debounce(t.v_track, "track_id", ["ts", "seq"], _seconds(), 7200.0).select("track_id", "seq")


@query(f"""WITH RECURSIVE {_O}, r AS (SELECT track_id, seq, n, t AS lt, x_cm AS lx, y_cm AS ly, true AS ok FROM o WHERE n = 1 UNION ALL SELECT o.track_id, o.seq, o.n, CASE WHEN k THEN o.t ELSE lt END, CASE WHEN k THEN o.x_cm ELSE lx END, CASE WHEN k THEN o.y_cm ELSE ly END, k
 FROM (SELECT r.track_id, r.n AS rn, lt, lx, ly, o.seq, o.n, o.t, o.x_cm, o.y_cm, (o.t - lt >= 14400 AND (o.x_cm <> lx OR o.y_cm <> ly)) AS k FROM r JOIN o ON o.track_id = r.track_id AND o.n = r.n + 1) o) SELECT track_id, seq FROM r WHERE ok""")
def str02_throttle(t):
    return ev.throttle(t.v_track, "track_id", ["ts", "seq"], _seconds(), 14400.0, "x_cm", "y_cm").select("track_id", "seq")


@query(f"""WITH RECURSIVE {_O}, r AS (SELECT track_id, seq, n, t, x_cm, y_cm, false AS hit FROM o WHERE n = 1 UNION ALL SELECT o.track_id, o.seq, o.n, o.t, o.x_cm, o.y_cm, NOT r.hit AND o.t - r.t <= 14400 AND power(o.x_cm - r.x_cm, 2) + power(o.y_cm - r.y_cm, 2) <= power(4000, 2)
 FROM r JOIN o ON o.track_id = r.track_id AND o.n = r.n + 1) SELECT track_id, seq FROM r WHERE hit""")
def str04_double_click(t):
    return ev.double_clicks(t.v_track, "track_id", ["ts", "seq"], _seconds(), 14400.0, 4000.0, "x_cm", "y_cm").select("track_id", "seq")


@query(f"WITH {_O} SELECT track_id, seq, round(sum(d) OVER (PARTITION BY track_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 4) AS travelled FROM (SELECT *, least(coalesce(t - lag(t) OVER (PARTITION BY track_id ORDER BY ts, seq), 0), 600.0) * 15 AS d FROM o)")
def str05_playback(t):
    return ev.playback(t.v_track, "track_id", ["ts", "seq"], _seconds(), 15.0, 600.0).select("track_id", "seq", F.round("travelled", 4).alias("travelled"))


@query("SELECT o_orderkey, level, row_number() OVER w AS done, count(*) OVER (PARTITION BY level) AS total FROM v_tile WINDOW w AS (PARTITION BY level ORDER BY o_orderkey)")
def str06_progress(t):
    jobs = t.v_tile.select("o_orderkey", "level")
    return numbered(jobs, ["level"], ["o_orderkey"], "done").join(jobs.groupBy("level").agg(F.count("*").alias("total")), "level")
