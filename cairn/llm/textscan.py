"""Arrow helpers for operators that read whole texts in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maps A-Z to a-z, and nothing else.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Arrow batches between the JVM and Python hold about this many bytes at most; a task holds a few at once.
BATCH_BYTES = 16 << 20
#: A piece of this many bytes of text is worked on at a time.
PIECE_BYTES = 4 << 20


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.to_pylist()]


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit on Arrow batches to BATCH_BYTES where it is higher."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "64m").lower()
    unit = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now.rstrip("b")[-1:] if not now.rstrip("b")[-1:].isdigit() else "b", 1)
    number = int("".join(c for c in now if c.isdigit() or c == "-") or -1)
    if number < 0 or number * unit > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def kept(batch: pa.RecordBatch, names: list[str]) -> list[pa.Array]:
    """Columns of ``batch`` to hand on; text as a string again."""
    return [batch.column(k).cast(pa.string()) if k == "text" else batch.column(k) for k in names]


def rows(batch: pa.RecordBatch, at_once: int = 2048) -> Iterator[dict]:
    """The batch's rows, made into Python objects a few at a time."""
    for k in range(0, batch.num_rows, at_once):
        yield from batch.slice(k, at_once).to_pylist()


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose ``column`` holds about ``limit`` bytes; at least one row each."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)


def map_texts(docs: DataFrame, keep: list[str], work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text") -> DataFrame:
    """Run ``work`` on pieces of (``keep`` columns, ``text`` as UTF-8 bytes); each piece gives one batch.

    With "text" in ``keep`` the text is handed back as it came.
    """

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                yield work(piece)

    small_batches(docs.sparkSession)
    others = [k for k in keep if k != "text"]
    return docs.select(*others, F.col(text).cast("binary").alias("text")).mapInArrow(run, schema)
