"""Mixing sources to target weights by weighted fair queueing (DataFrame operations only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_BUCKET = 4_000


def n_words(text: Column) -> Column:
    """Number of words of a text as a long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...], max_repeats: int) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources in code point order, null last, take ``weights`` in turn and share the total size. Where a weight would give
    a source over ``max_repeats`` times its size, it stops there and the rest is shared by weight: the common level is
    the first one, in order of cap / weight, that leaves the next source below its cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    totals = totals.withColumn("cap", F.col("source_size") * max_repeats).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    totals = totals.withColumns(
        {
            "left": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
            "rank": F.row_number().over(order),
        }
    ).withColumn("level", F.col("left") / F.col("open"))
    level = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("rank"))).over(everything)
    return totals.withColumn("target", F.least(F.col("weight") * level, F.col("cap").cast("double"))).select("source", "source_size", "target")


def running_starts(by_part: DataFrame, ranges: int) -> DataFrame:
    """source, part, start: part_size of all parts of the source before it; null sources are one.

    Parts are summed by blocks of about the root of their number, so each window holds the root of ``ranges`` rows of a
    source at most.
    """
    fan = math.isqrt(ranges) + 1
    parts = by_part.withColumn("block", F.floor(F.col("part") / fan))
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda column, *by: F.coalesce(F.sum(column).over(earlier(*by)), F.lit(0))
    blocks = parts.groupBy("source", "block").agg(F.sum("part_size").alias("block_size"))
    blocks = blocks.select("source", "block", before("block_size", "source", "block").alias("base")).alias("b")
    inner = parts.withColumn("within", before("part_size", "source", "block", "part")).alias("i")
    joined = inner.join(blocks, F.col("i.source").eqNullSafe(F.col("b.source")) & (F.col("i.block") == F.col("b.block")))
    return joined.select("i.source", "part", (F.col("base") + F.col("within")).alias("start"))


def _crossing(by_span: DataFrame, before: int, total: int):
    """The first span whose running sum, from ``before`` on, exceeds ``total``: span, span_size, upto; None if none does."""
    upto = F.sum("span_size").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, 0)) + F.lit(before)
    return by_span.withColumn("upto", upto).where(F.col("upto") > total).orderBy("span").first()


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_repeats: int = 3, seed: str = "mix") -> DataFrame:
    """Mix documents to target weights; one row per input row with doc_id, source, size, source_size, target, taken.

    Each source's documents stand in a shuffled order (md5 of doc_id and ``seed``) and are queued ``max_repeats`` times.
    A queued document's virtual finish time is the cumulative size of its source so far divided by the source's target.
    The queue is sorted globally by finish time, range by range, and cut at the total budget; ``taken`` is the document's
    size times the repeats that stand before the cut.

    The cumulative sizes are prefix sums in three levels over ranges of the shuffled order, and the cut is searched in two
    levels of spans of finish time, so a window holds about the root of the number of ranges.
    Null or empty text has size 0 and taken 0; null source is a source of its own, the last; rows with equal doc_id are
    queued each by itself; an empty table gives an empty result; other columns of ``docs`` are ignored.
    """
    sized = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    ranges = max(1, sized.count() // ROWS_PER_BUCKET)
    shuffled = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|" + seed)).cast("binary"))
    part = F.floor(F.conv(F.substring("u", 1, 7), 16, 10).cast("long") * ranges / 16**7)
    sized = sized.withColumn("u", shuffled).withColumn("part", part)

    by_part = running_starts(sized.groupBy("source", "part").agg(F.sum("size").alias("part_size")), ranges)
    targets = source_targets(sized, weights, max_repeats)
    by_part = by_part.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.*", "source_size", "target")

    joined = sized.alias("s").join(by_part.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("s.part") == F.col("p.part")))
    order = [F.col("u"), F.col("doc_id").asc_nulls_last(), F.col("size")]
    running = Window.partitionBy("source", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    queue = materialize(
        joined.select("doc_id", "s.source", "size", "u", "s.part", "start", "source_size", "target").select(
            "doc_id", "source", "size", "u", "source_size", "target", (F.col("start") + F.sum("size").over(running)).alias("reached")
        ),
        "mix-queue",
    )

    finish = lambda e: (F.lit(e) * F.col("source_size") + F.col("reached")) / F.col("target")
    key = lambda e: F.struct(finish(e).alias("finish"), F.col("source").isNull().alias("last"), F.coalesce("source", F.lit("")).alias("source"), F.col("u").alias("u"), F.col("size").alias("size"), F.lit(e).alias("repeat"))
    queued = queue.where((F.col("size") > 0) & (F.col("target") > 0))
    entries = queued.select("size", F.explode(F.array(*[key(e) for e in range(max_repeats)])).alias("key"))
    span = F.least(F.floor(F.col("key.finish") * ranges), F.lit(4 * ranges))
    entries = entries.withColumn("span", span)
    total = sized.agg(F.sum("size")).first()[0] or 0
    fan = math.isqrt(4 * ranges) + 1
    by_span = materialize(entries.groupBy("span").agg(F.sum("size").alias("span_size")), "mix-spans")
    crossing = _crossing(by_span.groupBy(F.floor(F.col("span") / fan).alias("span")).agg(F.sum("span_size").alias("span_size")), 0, total)
    if crossing is not None:
        crossing = _crossing(by_span.where(F.floor(F.col("span") / fan) == crossing["span"]), crossing["upto"] - crossing["span_size"], total)
    if crossing is None:
        taken_repeats = F.when((F.col("size") > 0) & (F.col("target") > 0), F.lit(max_repeats)).otherwise(0)
    else:
        within = Window.partitionBy("span").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
        at_cut = entries.where(F.col("span") == crossing["span"]).withColumn("upto", F.sum("size").over(within) + (crossing["upto"] - crossing["span_size"]))
        cut = at_cut.where(F.col("upto") <= total).agg(F.max("key").alias("cut")).first()["cut"]
        if cut is None:
            passes = lambda e: F.floor(finish(e) * ranges) < crossing["span"]
        else:
            edge = F.struct(F.lit(cut["finish"]), F.lit(cut["last"]), F.lit(cut["source"]), F.lit(cut["u"]), F.lit(cut["size"]).cast("long"), F.lit(cut["repeat"]))
            passes = lambda e: key(e) <= edge
        repeats = sum((F.when(passes(e), 1).otherwise(0) for e in range(max_repeats)), F.lit(0))
        taken_repeats = F.when((F.col("size") > 0) & (F.col("target") > 0), repeats).otherwise(0)
    return queue.select("doc_id", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), (F.col("size") * taken_repeats).cast("long").alias("taken"))


#: The same in DuckDB: one plain window where the operator has two levels.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|mix') AS u
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM totals),
capped AS (SELECT *, 3 * source_size AS cap, (3 * source_size) / weight AS ratio FROM weighted),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level,
         row_number() OVER (ORDER BY ratio, source NULLS LAST) AS rank
  FROM capped WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT arg_min(level, rank) AS level FROM levels WHERE level <= ratio),
targets AS (SELECT source, source_size, least(weight * chosen.level, cap::DOUBLE) AS target FROM levels, chosen),
queue AS (
  SELECT doc_id, s.source, size, u, source_size, target,
         CAST(sum(size) OVER (PARTITION BY s.source ORDER BY u, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS reached
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
entries AS (
  SELECT doc_id, source, u, size, e, (e * source_size + reached)::DOUBLE / target AS finish
  FROM queue, range(3) AS r(e) WHERE size > 0 AND target > 0),
cut AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source IS NULL, coalesce(source, ''), u, size, e ROWS UNBOUNDED PRECEDING)
              <= (SELECT sum(size) FROM sized) AS inside FROM entries),
taken AS (SELECT doc_id, source, size, u, finish, CASE WHEN inside THEN size ELSE 0 END AS taken, e FROM cut),
per_doc AS (SELECT doc_id, source, size, CAST(sum(taken) AS BIGINT) AS taken FROM taken GROUP BY doc_id, source, size)
SELECT q.doc_id, q.source, q.size, q.source_size, coalesce(q.target, 0) AS target, coalesce(p.taken, 0) AS taken
FROM queue q LEFT JOIN per_doc p ON q.doc_id IS NOT DISTINCT FROM p.doc_id AND q.source IS NOT DISTINCT FROM p.source AND q.size = p.size
"""
