"""Event handling in batch form: debounce, throttle, pairing, playback, retries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from cairn.operators.ordered import scan_in_order
from cairn.session import materialize


def debounce(events: DataFrame, key: str, order: list[str], time: Column, gap: float) -> DataFrame:
    """The last event of each burst: no later one of the same key follows within ``gap``."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("_t", time).withColumn("_next", F.lead("_t").over(w)).where(F.col("_next").isNull() | (F.col("_next") - F.col("_t") >= gap)).drop("_t", "_next")


def throttle(events: DataFrame, key: str, order: list[str], time: Column, gap: float, x: str, y: str) -> DataFrame:
    """Events accepted at least ``gap`` after the last accepted one and at another place. Without a time an event isn't accepted."""

    def start():
        was = None

        def accept(t, px, py) -> bool:
            nonlocal was
            ok = t is not None and (was is None or (t - was[0] >= gap and (px, py) != was[1:]))
            was = (t, px, py) if ok else was
            return ok

        return accept

    return _accepted(events, key, order, time, x, y, start)


def double_clicks(events: DataFrame, key: str, order: list[str], time: Column, gap: float, distance: float, x: str, y: str) -> DataFrame:
    """The second event of each pair within ``gap`` and ``distance``; an event is in one pair, one without time or place in none."""

    def start():
        was = None

        def accept(t, px, py) -> bool:
            nonlocal was
            whole = None not in (t, px, py)
            hit = whole and was is not None and t - was[0] <= gap and (px - was[1]) ** 2 + (py - was[2]) ** 2 <= distance**2
            was = (t, px, py) if whole and not hit else None
            return hit

        return accept

    return _accepted(events, key, order, time, x, y, start)


def _accepted(events: DataFrame, key: str, order: list[str], time: Column, x: str, y: str, start) -> DataFrame:
    return scan_in_order(events.withColumn("_t", time), key, order, ["_t", x, y], "_ok", BooleanType(), start).where("_ok").drop("_t", "_ok")


def playback(ticks: DataFrame, key: str, order: list[str], seconds: Column, speed: float, longest_step: float) -> DataFrame:
    """``travelled`` at each tick: time steps, each cut to ``longest_step``, times ``speed``."""
    w = Window.partitionBy(key).orderBy(*order)
    step = F.least(F.coalesce(F.col("_t") - F.lag("_t").over(w), F.lit(0.0)), F.lit(longest_step)) * speed
    return ticks.withColumn("_t", seconds).withColumn("_s", step).withColumn("travelled", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_t", "_s")


def retry(jobs: DataFrame, run: Callable[[DataFrame], DataFrame], attempts: int) -> DataFrame:
    """Jobs run until they succeed, ``attempts`` times at most: ``run``'s rows of each job's last attempt, and ``attempt``.

    ``run`` is given the jobs still open with their ``attempt`` and returns them with a Boolean ``ok`` (null: failed). Each
    round is a table, so only failed jobs run again and a finished one never does.
    """
    done, todo = None, jobs
    for k in range(1, attempts + 1):
        now = materialize(run(todo.withColumn("attempt", F.lit(k))), "attempt")
        ok = F.coalesce(F.col("ok"), F.lit(False))
        rows = now if k == attempts else now.where(ok)
        done = rows if done is None else done.unionByName(rows)
        todo = now.where(~ok).select(jobs.columns)
        if todo.isEmpty():
            break
    return done
