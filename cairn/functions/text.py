"""String, JSON, array and binary expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE_TAG = r"\[img=(\d+)([^\]]*)\](.*?)\[/img\]"


def image_url(name: Column, size: str) -> Column:
    """The size's code goes before the extension."""
    return F.regexp_replace(name, r"\.([a-zA-Z0-9]+)$", size + r".$1")


def image_ids(raw: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(raw, F.lit(IMAGE_TAG), F.lit(1)))


def drop_image_tags(raw: Column) -> Column:
    """Image tags replaced by their trimmed captions."""
    return F.regexp_replace(raw, r"\[img=\d+[^\]]*\]\s*(.*?)\s*\[/img\]", "$1")


def label(parts: list[Column], separator: str) -> Column:
    """Non-empty parts joined."""
    return F.concat_ws(separator, *[F.nullif(p.cast("string"), F.lit("")) for p in parts])


def clock(minutes: Column) -> Column:
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    return F.concat(two(F.call_function("div", minutes, F.lit(60))), F.lit(":"), two(minutes % 60))


def pack_u16(values: Column) -> Column:
    """Little-endian 16-bit values as base64 without line breaks."""
    hexed = F.transform(values, lambda v: F.concat(F.lpad(F.hex(v % 256), 2, "0"), F.lpad(F.hex(F.floor(v / 256)), 2, "0")))
    return F.regexp_replace(F.base64(F.unhex(F.array_join(hexed, ""))), "[^A-Za-z0-9+/=]", "")


def unpack_u16(packed: Column) -> Column:
    hexed = F.hex(F.unbase64(packed))
    n = F.call_function("div", F.length(hexed), F.lit(4)).cast("int")
    value = lambda i: F.conv(F.concat(F.substring(hexed, i * 4 + 3, F.lit(2)), F.substring(hexed, i * 4 + 1, F.lit(2))), 16, 10).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), value)).otherwise(F.array().cast("array<int>"))


def pack_bits(flags: Column) -> Column:
    """Booleans as hex bytes, least significant bit first."""
    n = F.ceil(F.size(flags) / 8).cast("int")
    bit = lambda i, k: F.when(F.coalesce(F.get(flags, i * 8 + k), F.lit(False)), F.lit(1 << k)).otherwise(0)
    byte = lambda i: F.lpad(F.hex(sum((bit(i, k) for k in range(8)), F.lit(0))), 2, "0")
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), byte), "")).otherwise("")


def strip_suffix(name: Column, suffix: str) -> Column:
    return F.when(name.endswith(suffix), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(name)


def lines_of(kind: Column, line: Column, lines: Column) -> Column:
    """A list of lines, whether the geometry is one or several."""
    return F.when(kind == "MultiLineString", lines).otherwise(F.array(line))
