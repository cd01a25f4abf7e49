"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all items."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.textscan import kept, map_texts, text_bytes

WINDOW = 10
#: Words of benchmark text in one automaton (about 60 trie nodes of 50 bytes each); more items take further automata.
BLOCK_WORDS = 40_000
#: A-Z lower-cased, 0-9 and all bytes of other scripts kept, the rest of ASCII a space.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "n_words long, hits array<struct<start:int,end:int>>, items array<string>, spans array<struct<start:int,end:int>>"
_BUILT: dict[str, ahocorasick.Automaton | None] = {}


def windows(text: bytes, n: int = WINDOW) -> set[bytes]:
    """The windows of an item, words between single spaces: all of ``n`` words, or the whole of a shorter item."""
    words = text.translate(NORMAL).split()
    return {b" " + b" ".join(words[k : k + n]) + b" " for k in range(max(1, len(words) - n + 1))} if words else set()


def build(items: Iterable[tuple[str, bytes]], n: int = WINDOW) -> ahocorasick.Automaton | None:
    """Automaton of (item id, text) pairs; a match's value is its number of words and the ids of the items that have it.

    Text goes in as Latin-1, one character a byte. None if no item has a word.
    """
    owners: dict[bytes, set[str]] = {}
    for item, text in items:
        for w in windows(text, n):
            owners.setdefault(w, set()).add(item)
    if not owners:
        return None
    automaton = ahocorasick.Automaton()
    for w, ids in owners.items():
        automaton.add_word(w.decode("latin-1"), (w.count(b" ") - 1, tuple(sorted(ids))))
    automaton.make_automaton()
    return automaton


def built(key: str, sent, n: int) -> ahocorasick.Automaton | None:
    """The automaton of a broadcast block, made once by a worker process."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = build(sent.value, n)
    return _BUILT[key]


def scan(automaton: ahocorasick.Automaton | None, text: bytes) -> tuple[int, list[tuple[int, int]], list[str]]:
    """Words of a text, the ranges of words that windows cover (merged, in order), and the items whose windows occur."""
    words = text.translate(NORMAL).split()
    if not words or automaton is None:
        return len(words), [], []
    joined = b" " + b" ".join(words) + b" "
    found = list(automaton.iter(joined.decode("latin-1")))
    if not found:
        return len(words), [], []
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    ends = np.searchsorted(spaces, [e for e, _ in found])
    ranges = sorted({(int(e) - value[0], int(e)) for e, (_, value) in zip(ends, found, strict=True)})
    merged = [list(ranges[0])]
    for start, end in ranges[1:]:
        if start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return len(words), [(s, e) for s, e in merged], sorted({i for _, (_, ids) in found for i in ids})


def original_spans(text: bytes, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words as ranges of code points of the original text, end exclusive."""
    if not hits:
        return []
    at = [m.span() for m in WORD.finditer(text.decode("utf-8", "surrogateescape"))]
    return [(at[s][0], at[e - 1][1]) for s, e in hits]


def _blocks(bench: DataFrame) -> list[list[tuple[str, bytes]]]:
    """The items in blocks of about BLOCK_WORDS words; one block is on the driver at a time, but for the list of texts."""
    sized = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("binary").alias("text")).where(F.octet_length("text") > 0)
    blocks, count = [[]], 0
    for row in sized.orderBy("item_id", "text").toLocalIterator():
        n = len(bytes(row["text"]).translate(NORMAL).split())
        if blocks[-1] and count + n > BLOCK_WORDS:
            blocks.append([])
            count = 0
        blocks[-1].append((row["item_id"], bytes(row["text"])))
        count += n
    return blocks


def find(docs: DataFrame, bench: DataFrame, keep: list[str] | None = None, n: int = WINDOW) -> DataFrame:
    """doc_id (and other ``keep`` columns), n_words, hits, items, spans for every row.

    A window is ``n`` consecutive words of an item, or the whole of a shorter item with a word. hits are the merged
    ranges of document words inside any occurrence of a window, spans the same as code points of the original text,
    items the item_ids (as strings, sorted) with an occurring window. Null and empty texts have no words; null item_id
    is the empty string; repeated items count once; other columns of either table are ignored.

    The benchmark's size is counted first: up to BLOCK_WORDS words one automaton scans each text once. A larger
    benchmark is cut into blocks of that size, each scanned in its own pass, and the passes are merged by text.
    """
    keep = ["doc_id", *(k for k in keep or [] if k != "doc_id")]
    sc, types = docs.sparkSession.sparkContext, dict(docs.dtypes)
    passes = []
    blocks = _blocks(bench)
    source = docs if len(blocks) == 1 else docs.select("text", *[F.xxhash64(*x).alias(k) for k, x in (("t1", ["text"]), ("t2", [F.lit(1), "text"]))]).dropDuplicates(["t1", "t2"])
    own = keep if len(blocks) == 1 else ["t1", "t2"]
    for block in blocks:
        sent, key = sc.broadcast(block), uuid.uuid4().hex

        def work(batch: pa.RecordBatch, sent=sent, key=key) -> pa.RecordBatch:
            texts = text_bytes(batch.column("text"))
            automaton = built(key, sent, n)
            rows = [scan(automaton, t) for t in texts]
            pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            as_pairs = lambda ranges: [{"start": s, "end": e} for s, e in ranges]
            return pa.RecordBatch.from_arrays(
                [
                    *kept(batch, own),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([as_pairs(r[1]) for r in rows], pair),
                    pa.array([r[2] for r in rows], pa.list_(pa.string())),
                    pa.array([as_pairs(original_spans(t, r[1])) for t, r in zip(texts, rows, strict=True)], pair),
                ],
                names=[*own, "n_words", "hits", "items", "spans"],
            )

        kinds = dict(source.dtypes)
        passes.append(map_texts(source, own, work, ", ".join([*[f"`{k}` {kinds[k]}" for k in own], SCHEMA])))
    if len(passes) == 1:
        return passes[0]
    merged = passes[0]
    for more in passes[1:]:
        merged = merged.unionByName(more)
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    merged = merged.groupBy("t1", "t2").agg(F.first("n_words").alias("n_words"), flat("hits"), flat("items"), flat("spans"))
    keyed = docs.select(*keep, F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    return keyed.join(merged, ["t1", "t2"]).select(*keep, "n_words", "hits", "items", "spans")


def report(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: what find() gives, as counts and a digest."""
    found = find(docs, bench)
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("upto")),
        lambda a, x: F.struct((a["sum"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["upto"]))).alias("sum"), F.greatest(x["end"], a["upto"]).alias("upto")),
        lambda a: a["sum"].cast("long"),
    )
    return found.select("doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


#: The same in DuckDB by joining every document window with every item window.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS x FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw ON dw.x = bw.x AND dw.n = bw.n),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
