"""Debounce, throttle, double clicks and periodic sync over streams of (key, seq, t, x, y)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "key long, seq long, t double, x double, y double"


def debounce(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Per burst (no gap of ``gap`` or longer): key, the last event's seq, and the burst's size, when the watermark has
    passed it. ``events`` has key, seq and a timestamp ts; events more than ``late`` behind the latest are dropped."""
    w = events.withWatermark("ts", late).groupBy("key", F.session_window("ts", gap).alias("burst"))
    return w.agg(F.max(F.struct("ts", "seq")).alias("last"), F.count("*").alias("n")).select("key", F.col("last.seq").alias("seq"), "n")


def _stateful(events: DataFrame, state_schema: str, accept) -> DataFrame:
    def run(key, frames, state: GroupState):
        now = list(state.get) if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["t", "seq"])
        flags = []
        for r in rows.itertuples(index=False):
            ok, now = accept(now, r)
            flags.append(ok)
        if now is not None:
            state.update(tuple(now))
        yield rows[flags]

    return events.select("key", "seq", "t", "x", "y").groupBy("key").applyInPandasWithState(run, SCHEMA, state_schema, "append", GroupStateTimeout.NoTimeout)


def throttle(events: DataFrame, gap: float) -> DataFrame:
    """Events accepted at least ``gap`` seconds after the key's last accepted one and at another place.

    The state is one row a key; within a micro-batch events are taken in order of time.
    """

    def accept(now, r):
        if now is None or (r.t - now[0] >= gap and (r.x, r.y) != (now[1], now[2])):
            return True, [r.t, r.x, r.y]
        return False, now

    return _stateful(events, "t double, x double, y double", accept)


def double_clicks(events: DataFrame, gap: float, distance: float) -> DataFrame:
    """The second event of each pair within ``gap`` seconds and ``distance``; an event is in one pair."""

    def accept(now, r):
        if now is not None and now[3] and r.t - now[0] <= gap and (r.x - now[1]) ** 2 + (r.y - now[2]) ** 2 <= distance**2:
            return True, [r.t, r.x, r.y, False]
        return False, [r.t, r.x, r.y, True]

    return _stateful(events, "t double, x double, y double, open boolean", accept)


def sync(tiles: DataFrame, target: str, checkpoint: str, every: str = "60 seconds", once: bool = False):
    """Append new tiles to ``target`` by cell and level, periodically or, with ``once``, until what is there is done."""
    writer = tiles.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).partitionBy("cell", "level").outputMode("append")
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime=every).start()


def progress(jobs: DataFrame) -> DataFrame:
    """Running counts per phase: done, failed, mean seconds. For output mode complete or update."""
    return jobs.groupBy("phase").agg(F.count("*").alias("done"), F.count_if(F.col("exit_code") != 0).alias("failed"), F.avg("seconds").alias("mean_seconds"))
