"""Joins whose keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the left side's rows is hot. At most HOT_KEYS keys can be.
HOT_KEYS = 1000


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], rows: str | Column, total: int, distinct: bool = False) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row a key and in ``rows`` how many ``left`` has of it.

    Rows of a hot key, one with over ``total`` / HOT_KEYS rows, stay where they are: the right side of these keys, at
    most HOT_KEYS rows as the shares of all keys add up to one, is broadcast. The others are shuffled by key, of which
    none is hot. Keys are compared with ``=``; both sides should be tables, as each is read twice. With ``distinct``
    repeated rows of the result are one, which for the others needs no shuffle after that of the join.
    """
    rows = F.col(rows) if isinstance(rows, str) else rows
    right = right.withColumn("__hot", F.coalesce(rows * HOT_KEYS > total, F.lit(False)))
    hot = F.broadcast(right.where("__hot"))
    marked = left.join(F.broadcast(right.where("__hot").select(*keys, "__hot")), keys, "left")
    few = left.join(hot.drop("__hot"), keys)
    rest = marked.where("__hot IS NULL").drop("__hot").join(right.where("NOT __hot").drop("__hot"), keys)
    return few.distinct().unionByName(rest.distinct()) if distinct else few.unionByName(rest)
