"""Token counts: a separator scan over flat token files that have no index."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.textscan import pieces


#: Bytes of a block, a multiple of every token width. Blocks end wherever they end, in the middle of documents too.
BLOCK_BYTES = 1 << 20
END_OF_DOCUMENT = 50_256
_ENCODINGS: dict[str, object] = {}


def encoding(path: str):
    """A byte-level BPE from a file of base64 tokens and ranks, loaded once by a worker process."""
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def pack(docs: DataFrame, tokenizer: str | None = None, block_bytes: int = BLOCK_BYTES, separator: int = END_OF_DOCUMENT) -> DataFrame:
    """Flat files of 16-bit token ids, each document followed by the separator: file, block, doc_ids, data.

    Each task's documents are one file, cut into blocks of ``block_bytes``; ``doc_ids`` are the documents whose
    separator stands in the block, in order, of the type they have. Null and empty texts are documents without tokens,
    very long ones span blocks; null and repeated doc_ids are kept, each row being a document; an empty table gives no
    block; other columns are ignored.
    """
    path, kind = tokenizer or default_tokenizer(), dict(docs.dtypes)["doc_id"]

    def run(batches):
        from pyspark import TaskContext

        encode, end = encoding(path).encode_ordinary, np.array([separator], "<u2")
        file, block, rest, ids, size = TaskContext.get().partitionId(), 0, [], [], 0
        ends: list[int] = []  # where each waiting document's separator ends, in bytes of what waits

        def give(data: bytes, last: bool):
            nonlocal block, rest, ids, ends, size
            while len(data) >= block_bytes or (last and data):
                part, data = data[:block_bytes], data[block_bytes:]
                n = int(np.searchsorted(ends, len(part), "right"))
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([ids[:n]], schema.field("doc_ids").type), pa.array([part])], schema=schema)
                ids, ends, block = ids[n:], [e - len(part) for e in ends[n:]], block + 1
            rest, size = ([data] if data else []), len(data)

        schema = None
        for batch in (piece for b in batches for piece in pieces(b)):
            schema = schema or pa.schema([("file", pa.int64()), ("block", pa.int64()), ("doc_ids", pa.list_(batch.schema.field("doc_id").type)), ("data", pa.binary())])
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                tokens = np.array(encode(text or ""), "<u2").tobytes() + end.tobytes()
                rest.append(tokens)
                size += len(tokens)
                ids.append(doc_id)
                ends.append(size)
                if size >= 4 * block_bytes:
                    yield from give(b"".join(rest), False)
        yield from give(b"".join(rest), True)

    return docs.select("doc_id", "text").mapInArrow(run, f"file long, block long, doc_ids array<{kind}>, data binary")


def read_flat(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Real flat token files as file, block, data; the files are numbered in order of their paths.

    Each file is read by one task; very large files should be written in parts that an executor can hold.
    """
    files = spark.read.format("binaryFile").load(path)
    names = files.select("path").distinct().withColumn("file", (F.row_number().over(Window.orderBy("path")) - 1).cast("long"))

    def split(batches):
        for b in batches:
            for file, data in zip(b.column("file").to_pylist(), b.column("content").to_pylist(), strict=True):
                for k in range(0, len(data), block_bytes):
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k // block_bytes]), pa.array([data[k : k + block_bytes]])], names=["file", "block", "data"])

    return files.join(names, "path").select("file", "content").mapInArrow(split, "file long, block long, data binary")


def find_separators(data: bytes, width: int, separator: int) -> np.ndarray:
    """Indices, in tokens, of the separator in a block."""
    return np.flatnonzero(np.frombuffer(data, f"<u{width}") == separator)


def count(blocks: DataFrame, separator: int = END_OF_DOCUMENT, width: int = 2) -> DataFrame:
    """From blocks of flat files (file, block, data, any other columns) to file, block, index, n_tokens per document.

    Each block is searched for the separator by itself. Its summary, the number of its tokens and the last separator's
    index, is joined to those before it in the file by a running sum and a running maximum; the tokens of a document
    that spans blocks are then the distance from the last separator in any earlier block. ``index`` numbers the block's
    separators from 0; tokens after a file's last separator are no document. Separator excluded from n_tokens.
    """

    def scan(batches):
        for b in batches:
            for k in range(b.num_rows):
                data = b.column("data")[k].as_py() or b""
                found = find_separators(data, width, separator)
                yield pa.RecordBatch.from_arrays([b.column("file").slice(k, 1), b.column("block").slice(k, 1), pa.array([len(data) // width]), pa.array([found], pa.list_(pa.int64()))], names=["file", "block", "n", "found"])

    summary = blocks.select("file", "block", "data").mapInArrow(scan, "file long, block long, n long, found array<long>")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = summary.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    last = F.when(F.size("found") > 0, F.element_at("found", -1) + F.col("start"))
    placed = placed.withColumn("before", F.coalesce(F.max(last).over(earlier), F.lit(-1).cast("long")))
    previous = F.concat(F.array(F.col("before") - F.col("start")), F.slice("found", 1, F.greatest(F.size("found") - 1, F.lit(0))))
    lengths = F.zip_with("found", previous, lambda at, was: at - was - 1)
    return placed.where(F.size("found") > 0).select("file", "block", F.posexplode(lengths).alias("index", "n_tokens"))


def document_counts(blocks: DataFrame, separator: int = END_OF_DOCUMENT) -> DataFrame:
    """doc_id, n_tokens for every document of blocks made by pack(): the k-th separator of a block ends its k-th id."""
    ids = blocks.select("file", "block", F.posexplode("doc_ids").alias("index", "doc_id"))
    return ids.join(count(blocks, separator), ["file", "block", "index"]).select("doc_id", "n_tokens")
