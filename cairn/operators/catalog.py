"""Tile catalogues: availability, packing, verification, summaries."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.tiles import morton
from cairn.operators.ordered import percentiles
from cairn.session import materialize


def best_tiles(stored: DataFrame) -> DataFrame:
    """One row per (level, x, y): the largest stored object, zero bytes meaning not built."""
    return stored.groupBy("level", "x", "y").agg(F.max("bytes").alias("bytes"))


def max_levels(tiles: DataFrame, present: DataFrame, level: int, deepest: int) -> DataFrame:
    """For tiles (x, y) at ``level``: the deepest level of the unbroken chain of north-west descendants in ``present``."""
    chain = tiles.withColumn("l", F.explode(F.sequence(F.lit(level), F.lit(deepest))))
    shift = F.pow(F.lit(2), F.col("l") - level).cast("long")
    keyed = chain.select("x", "y", "l", (F.col("x") * shift).alias("dx"), (F.col("y") * shift).alias("dy"))
    held = present.select(F.col("level").cast("int").alias("l"), F.col("x").alias("dx"), F.col("y").alias("dy")).distinct().withColumn("here", F.lit(True))
    walked = keyed.join(held, ["l", "dx", "dy"], "left")
    first_gap = F.min(F.when(F.col("here").isNull() & (F.col("l") > level), F.col("l")))
    return walked.groupBy("x", "y").agg((F.coalesce(first_gap, F.lit(deepest + 1)) - 1).alias("max_level"))


def closure(tiles: DataFrame, level: Column, root: int) -> DataFrame:
    """All (level, x, y) of the tiles and their ancestors down to level ``root``."""
    ups = tiles.withColumn("_up", F.explode(F.sequence(F.lit(0), (level - root).cast("int"))))
    up = lambda c: F.call_function("shiftright", F.col(c), F.col("_up"))
    return ups.select((level - F.col("_up")).alias("level"), up("x").alias("x"), up("y").alias("y")).distinct()


def availability_bits(tiles: DataFrame, depth: int, bits: str = "bits") -> DataFrame:
    """Per root cell (cx, cy): which tiles of ``depth`` levels below it there are, level by level in Morton order, as hex
    bytes with the least significant bit first.

    ``tiles`` has cx, cy, d (levels below the cell), lx, ly (place within the cell); repeats count once. Bits are merged to
    bytes in a partial aggregation, so a cell sends its bytes, not its tiles.
    """
    n_bytes = (sum(4**d for d in range(depth)) + 7) // 8
    start = ((F.pow(F.lit(4), F.col("d")) - 1) / 3).cast("long")
    held = tiles.where((F.col("d") >= 0) & (F.col("d") < depth)).withColumn("at", start + morton(F.col("lx"), F.col("ly"), depth))
    one = F.call_function("shiftleft", F.lit(1), (F.col("at") % 8).cast("int"))
    blank = held.select("cx", "cy").distinct().select("cx", "cy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bytes - 1).cast("long"))).alias("k"), F.lit(0).alias("v"))
    set_bytes = held.groupBy("cx", "cy", F.floor(F.col("at") / 8).alias("k")).agg(F.bit_or(one).alias("v"))
    merged = set_bytes.unionByName(blank).groupBy("cx", "cy", "k").agg(F.bit_or("v").alias("v"))
    in_order = F.array_sort(F.collect_list(F.struct("k", F.lpad(F.hex("v"), 2, "0").alias("h"))))
    return merged.groupBy("cx", "cy").agg(F.array_join(F.transform(in_order, lambda s: s["h"]), "").alias(bits))


def with_ancestors(tiles: DataFrame) -> DataFrame:
    """cx, cy, d, lx, ly of tiles within their root cells, and of all tiles above them down to d = 0."""
    ups = tiles.select("cx", "cy", "d", "lx", "ly", F.explode(F.sequence(F.lit(0).cast("long"), F.col("d").cast("long"))).alias("up"))
    above = lambda c: F.call_function("shiftright", F.col(c), F.col("up").cast("int")).alias(c)
    return ups.select("cx", "cy", (F.col("d") - F.col("up")).alias("d"), above("lx"), above("ly")).distinct()


def subtree(tile_bits: bytes, content_bits: bytes, children: bytes | bool = False) -> bytes:
    """A 3D Tiles subtree: 24-byte header, JSON padded to 8 with spaces, buffers padded to 8 with zeros.

    Bit streams 0 and 1 are of tiles and of contents; ``children`` is the third, or a constant.
    """
    padded = lambda b, fill: b.ljust(-(-len(b) // 8) * 8, fill)
    streams = [tile_bits, content_bits, *([children] if isinstance(children, bytes) else [])]
    views, buffer = [], b""
    for bits in streams:
        buffer = padded(buffer, b"\0")
        views.append({"buffer": 0, "byteOffset": len(buffer), "byteLength": len(bits)})
        buffer += bits
    below = {"bitstream": 2} if isinstance(children, bytes) else {"constant": int(children)}
    meta = {"buffers": [{"byteLength": len(buffer)}], "bufferViews": views, "tileAvailability": {"bitstream": 0}, "contentAvailability": [{"bitstream": 1}], "childSubtreeAvailability": below}
    text, body = padded(json.dumps(meta, separators=(",", ":")).encode(), b" "), padded(buffer, b"\0")
    return struct.pack("<4sIQQ", b"subt", 1, len(text), len(body)) + text + body


def subtrees(tiles: DataFrame, depth: int) -> DataFrame:
    """cx, cy, subtree: the packed subtree of each root cell from its contents (cx, cy, d, lx, ly).

    Tiles are the contents and all that stand above them. No subtree has children.
    """

    @F.pandas_udf("binary")
    def pack(tile_bits: pd.Series, content_bits: pd.Series) -> pd.Series:
        return pd.Series([subtree(bytes.fromhex(a), bytes.fromhex(b)) for a, b in zip(tile_bits, content_bits, strict=True)])

    contents = tiles.where((F.col("d") >= 0) & (F.col("d") < depth))
    both = availability_bits(with_ancestors(contents), depth, "tile_bits").join(availability_bits(contents, depth, "content_bits"), ["cx", "cy"])
    return both.select("cx", "cy", pack("tile_bits", "content_bits").alias("subtree"))


def missing_levels(cells: DataFrame, stored: DataFrame, levels: list[int]) -> DataFrame:
    """Cells with the required levels of which nothing is stored."""
    wanted = cells.select("cx", "cy").distinct().withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))
    held = stored.where("bytes > 0").select("cx", "cy", F.col("level").cast("int").alias("level")).distinct()
    return wanted.join(held, ["cx", "cy", "level"], "left_anti")


def level_stats(required: DataFrame, stored: DataFrame) -> DataFrame:
    """Per level: required tiles, missing ones, and exact percentiles of the stored sizes in kB; 0 where there are none."""
    joined = required.join(best_tiles(stored), ["level", "x", "y"], "left")
    held = F.when(F.col("bytes") > 0, F.col("bytes") / 1000.0)
    joined = materialize(joined.select("level", held.alias("kb")), "sizes")
    found = percentiles(joined, ["level"], "kb", {"median_kb": 0.5, "p5_kb": 0.05, "p95_kb": 0.95})
    counted = joined.groupBy("level").agg(F.count("*").alias("total"), F.count_if(F.col("kb").isNull()).alias("missing")).join(found, "level", "left")
    return counted.select("level", "total", "missing", *[F.coalesce(k, F.lit(0.0)).alias(k) for k in ("median_kb", "p5_kb", "p95_kb")])


def repair(catalogue: DataFrame, stored: DataFrame, level: int, deepest: int) -> DataFrame:
    """The catalogue with the stored tiles it lacks, their levels walked: x, y, max_level, z_hi, added."""
    held = stored.where("bytes > 0").select("level", "x", "y")
    lacking = held.where(F.col("level") == level).select("x", "y").distinct().join(catalogue.select("x", "y"), ["x", "y"], "left_anti")
    added = max_levels(lacking, held, level, deepest).select("x", "y", F.col("max_level").cast("long").alias("max_level"), F.lit(0).cast("long").alias("z_hi"), F.lit(True).alias("added"))
    return catalogue.select("x", "y", F.col("max_level").cast("long").alias("max_level"), "z_hi", F.lit(False).alias("added")).unionByName(added)


def assemble_pack(cells: DataFrame) -> DataFrame:
    """One document of all cells: packed columns in order of cell, and the bounding sphere's radius.

    Cells are one row per catalogue cell, so the document is bounded by the catalogue; it is sorted before it is joined.
    """
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("x", "y", "max_level", "z_hi"))), lambda s: s[c])
    span = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    return cells.agg(ordered("x").alias("xs"), ordered("y").alias("ys"), ordered("max_level").alias("levels"), ordered("z_hi").alias("z"), (span / 2.0 + 20000).alias("radius"))


def last_entries(log: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The last ``n`` rows of each key with how many it has in all."""
    w = Window.partitionBy(key)
    return log.withColumn("total", F.count("*").over(w)).withColumn("back", F.row_number().over(w.orderBy(*order))).where(F.col("back") <= n)
