"""Operations on rows in order: recurrences along a key, places and exact percentiles within keys of any size."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

from cairn.session import materialize


def scan_in_order(rows: DataFrame, key: str, order: list[str], inputs: list[str], out: str, kind: DataType, start: Callable[[], Callable]) -> DataFrame:
    """``rows`` with the column ``out``: ``start()`` is called for each key and its result on ``inputs`` of each row in order.

    Rows are dealt by key, sorted by Spark (which spills) and streamed in Arrow batches, so a task holds one batch and
    one key's state, never a key's rows. Null keys are one key; nulls in ``order`` come first; an empty table stays empty.
    """

    def run(batches):
        last, step = object(), None
        for batch in batches:
            found = []
            for k, *values in zip(batch.column(key).to_pylist(), *(batch.column(c).to_pylist() for c in inputs), strict=True):
                if step is None or k != last:
                    last, step = k, start()
                found.append(step(*values))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, to_arrow_type(kind))], names=[*batch.schema.names, out])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, StructType([*rows.schema.fields, StructField(out, kind)]))


def numbered(rows: DataFrame, keys: list[str], order: list[str | Column], out: str) -> DataFrame:
    """``rows`` with ``out``: the place, from 1, of each row among those of equal ``keys`` in ``order``; for any number of
    keys, few or none included.

    Rows are dealt by ranges of (keys, order), counted per range, and placed within their range after the rows of the
    ranges before it: a key that holds all rows is in many tasks. The ranges are kept as a table, so that they are the
    same when a task is run again. Equal rows stand in any order; null keys are one key; an empty table stays empty.
    """
    ranges = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialize(rows.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_{i}"))
    within = Window.partitionBy(*keys, "_range").orderBy(*order)
    placed = dealt.withColumn("_row", F.row_number().over(within)).join(starts, same)
    return placed.select(*rows.columns, (F.col("_before") + F.col("_row")).alias(out))


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per key the exact percentiles of ``value``, interpolated, as doubles: one column for each name of ``shares``.

    Places are those of numbered(), so no task holds all values of a key. Null values don't count; a key without any
    value has no row.
    """
    places = numbered(rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")), keys, ["_v"], "_place")
    totals = places.groupBy(*keys).agg(F.count("*").alias("_n")).select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], "_n")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_{i}"))

    def at(q: float) -> Column:
        exact = (F.col("_n") - 1) * F.lit(q) + 1
        low = F.floor(exact)
        return F.sum(F.when(F.col("_place") == low, F.col("_v") * (low + 1 - exact)).when(F.col("_place") == low + 1, F.col("_v") * (exact - low)))

    return places.join(totals, same).groupBy(*keys).agg(*[at(q).alias(name) for name, q in shares.items()])
