"""Removal of byte strings that stand twice in a corpus, by sharded suffix arrays."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.textscan import map_texts, rows, text_bytes
from cairn.session import materialize

LENGTH = 400
#: Bytes of the grams that anchors are chosen from.
GRAM = 16
#: Bytes of run texts under one suffix array.
SHARD_BYTES = 1 << 19
#: Different run texts of one anchor from which its texts are dealt over several shards.
HOT_TEXTS = 2_000
_CHUNK = 1 << 19


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every GRAM-byte gram."""
    n = len(b) - GRAM + 1
    raw = b.tobytes()
    low = np.ndarray((n,), "<u8", raw, 0, (1,))
    high = np.ndarray((n,), "<u8", raw, 8, (1,))
    h = low * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += high
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours: prefix and suffix minima of blocks of that width."""
    n = len(key)
    padded = np.full(-(-n // width) * width, np.iinfo(key.dtype).max, key.dtype)
    padded[:n] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, count, anchor's place and anchor's hash of the runs of window starts.

    A window of ``length`` bytes has as anchor its gram of least hash, the leftmost of equal ones: equal windows have
    equal anchors at equal places. Consecutive window starts with the same anchor are one run.
    """
    starts, counts, places, anchors = [], [], [], []
    for base in range(0, len(text) - length + 1, _CHUNK):
        b = np.frombuffer(text, np.uint8)[base : base + _CHUNK + length - 1]
        h = gram_hashes(b)
        place = np.arange(len(h), dtype=np.uint64)
        at = (sliding_min((h >> np.uint64(20) << np.uint64(20)) | place, length - GRAM + 1) & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        starts.append(first + base)
        counts.append(np.diff(np.r_[first, len(at)]))
        places.append(at[first] + base)
        anchors.append(h[at[first]])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(places), np.concatenate(anchors)


def suffix_array(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts laid end to end, the place where each byte's text ends, and the suffix array of all places.

    Larsson-Sadakane refinement: places are ranked by 8 bytes, then groups of equal rank are refined by the rank of the
    place as far ahead as is sorted already, which doubles; groups of one are left alone. Each text ends with a
    sentinel of its own, so no comparison runs on into the next text.
    """
    lengths = np.array([len(t) for t in texts])
    b = np.frombuffer(b"".join(texts), np.uint8)
    n = len(b)
    ends = np.repeat(np.cumsum(lengths), lengths)
    owner = np.repeat(np.arange(len(texts)), lengths)
    packed = np.ndarray((n,), ">u8", b.tobytes() + bytes(8), 0, (1,)).astype(np.uint64)
    tail = np.concatenate([np.arange(max(0, e - m, e - 7), e) for e, m in zip(np.cumsum(lengths).tolist(), lengths.tolist(), strict=True)]) if n else np.zeros(0, np.int64)
    left = (ends[tail] - tail).astype(np.uint64)
    packed[tail] &= ~(~np.uint64(0) >> (left * np.uint64(8)))
    sa = np.argsort(packed)
    first = packed[sa]
    same = first[1:] == first[:-1]
    # a place nearer than 8 to its end stands by itself: before longer ones, shorter ones first, then in order of its text
    near = np.zeros(n, np.int64)
    near[tail] = (left.astype(np.int64) - 8) * len(texts) + owner[tail] - len(texts)
    group = np.cumsum(np.r_[False, ~same][:n])
    mixed = np.zeros(n, bool)
    mixed[group[near[sa] < 0]] = True
    again = np.flatnonzero(mixed[group])
    sa[again] = sa[again][np.lexsort((near[sa[again]], group[again]))]
    same &= (near[sa][1:] == 0) & (near[sa][:-1] == 0)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(n), 0)) if n else np.zeros(0, np.int64)
    h = 8
    open_ = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
    while len(open_):
        places = sa[open_]
        ahead = places + h
        second = np.where(ahead < ends[places], rank[np.minimum(ahead, n - 1)] + len(texts), owner[places])
        key = rank[places] * (n + len(texts)) + second
        order = np.argsort(key)
        places, key = places[order], key[order]
        sa[open_] = places
        new = np.r_[True, key[1:] != key[:-1]]
        rank[places] = np.maximum.accumulate(np.where(new, open_, 0))
        open_ = open_[np.r_[~new[1:], False] | ~new]
        h *= 2
    return b, ends, sa


def common_prefixes(b: np.ndarray, ends: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each suffix but the first, in order of ``sa``, the bytes it shares with the one before it.

    Kasai's rule: where a place and its predecessor in order follow equal bytes, the prefix is one shorter than that of
    the place before. All other places are compared directly, 8 bytes at a time and together.
    """
    n = len(sa)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    begins = np.r_[True, ends[1:] != ends[:-1]] if n else np.zeros(0, bool)
    first_before = before == -1
    inner = ~begins & ~first_before
    inner[inner] = ~begins[before[inner]] & (b[place[inner] - 1] == b[before[inner] - 1])
    prefix = np.zeros(n, np.int64)
    todo = np.flatnonzero(~inner & ~first_before)
    words = np.ndarray((n,), "<u8", b.tobytes() + bytes(8), 0, (1,))
    done = np.zeros(len(todo), np.int64)
    live = np.arange(len(todo))
    while len(live):
        i, j = todo[live] + done[live], before[todo[live]] + done[live]
        room = np.minimum(ends[todo[live]] - i, ends[before[todo[live]]] - j)
        go = room > 0
        x = np.where(go, words[np.minimum(i, n - 1)] ^ words[np.minimum(j, n - 1)], 0)
        low = x & (~x + np.uint64(1))
        equal = np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8)
        step = np.where(go, np.minimum(equal, room), 0)
        done[live] += step
        live = live[(step == 8) & (room > 8)]
    prefix[todo] = done
    direct = np.maximum.accumulate(np.where(~inner, place, 0))
    prefix = np.where(inner, prefix[direct] - (place - direct), prefix)
    return prefix[sa[1:]]


def _intervals(flags: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(text number, start, end) of the stretches of flagged places."""
    offsets = np.r_[0, np.cumsum(lengths)]
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    owner = np.searchsorted(offsets, edges[::2], "right") - 1
    return [(int(o), int(s - offsets[o]), int(e - offsets[o])) for o, s, e in zip(owner, edges[::2], edges[1::2], strict=True)]


def shard_repeats(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flags of the places whose next ``length`` bytes stand elsewhere in the shard, the suffix array, the prefixes."""
    b, ends, sa = suffix_array(texts)
    prefix = common_prefixes(b, ends, sa)
    flags = np.zeros(len(b), bool)
    repeated = prefix >= length
    flags[sa[1:][repeated]] = True
    flags[sa[:-1][repeated]] = True
    return flags, sa, prefix


def _shared(x: bytes, y: bytes) -> int:
    """Length of the common prefix of two different or equal byte strings."""
    low, high = 0, min(len(x), len(y))
    while low < high:
        middle = (low + high + 1) // 2
        if x[low:middle] == y[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def trim(rows: list[dict], length: int) -> list[dict]:
    """What of an anchor's run texts can hold a repeat: each text's longest agreement with any other to the right of
    the anchor, and to the left of it, bound the windows; a text whose two together are short of a window goes.

    A text's longest agreement on one side is with a neighbour in sorted order.
    """
    reach = {}
    for side, cut in (("right", lambda r: r["piece"][r["at"] :]), ("left", lambda r: r["piece"][: r["at"]][::-1])):
        order = sorted(range(len(rows)), key=lambda k: cut(rows[k]))
        best = [0] * len(rows)
        for i, j in zip(order, order[1:]):
            n = _shared(cut(rows[i]), cut(rows[j]))
            best[i], best[j] = max(best[i], n), max(best[j], n)
        reach[side] = best
    out = []
    for r, left, right in zip(rows, reach["left"], reach["right"], strict=True):
        if left + right >= length:
            out.append({**r, "piece": r["piece"][r["at"] - left : r["at"] + right], "skip": r["at"] - left})
    return out


def _shards(frames, limit: int, length: int):
    """Rows sorted by (fp, slot), in lists of whole groups of about ``limit`` bytes; groups in one slot are trimmed."""
    held, size, group = [], 0, []

    def ended():
        nonlocal held, size
        left = trim(group, length) if group and group[0]["slots"] == 1 else group
        held += left
        size += sum(len(r["piece"]) for r in left)

    for batch in frames:
        for row in rows(batch):
            if group and (row["fp"], row["slot"]) != (group[0]["fp"], group[0]["slot"]):
                ended()
                group = []
                if size >= limit:
                    yield held
                    held, size = [], 0
            group.append(row | {"skip": 0})
    ended()
    if held:
        yield held


def _shard_work(length: int, limit: int):
    """Repeats within each shard as (rh, start, end); for hot anchors also each window that another shard may hold."""

    def run(batches):
        for held in _shards(batches, limit, length):
            texts = [r["piece"] for r in held]
            flags, sa, prefix = shard_repeats(texts, length)
            lengths = np.array([len(t) for t in texts])
            found = [{"rh": held[o]["rh"], "start": s + held[o]["skip"], "end": e + held[o]["skip"], "fp": None, "bucket": None, "slot": None, "digests": None, "places": None} for o, s, e in _intervals(flags, lengths)]
            hot = np.flatnonzero([r["slots"] > 1 for r in held])
            if len(hot):
                found += _offers(held, texts, lengths, flags, sa, prefix, length, hot)
            yield pa.RecordBatch.from_pylist(found, schema=_OFFER)

    return run


_OFFER = pa.schema([("rh", pa.binary()), ("start", pa.int32()), ("end", pa.int32()), ("fp", pa.int64()), ("bucket", pa.int32()), ("slot", pa.int32()), ("digests", pa.binary()), ("places", pa.binary())])


def _offers(held, texts, lengths, flags, sa, prefix, length, hot) -> list[dict]:
    """One row for each hot anchor and bucket: sorted digests of its different windows, and where each stands.

    Windows are taken in order of the suffix array, one of each set of equals.
    """
    offsets = np.r_[0, np.cumsum(lengths)]
    firsts = sa[np.r_[True, prefix < length]]
    owner = np.searchsorted(offsets, firsts, "right") - 1
    fits = (offsets[owner + 1] - firsts >= length) & np.isin(owner, hot)
    by_bucket: dict[tuple[int, int, int], list] = {}
    for place, o in zip(firsts[fits].tolist(), owner[fits].tolist(), strict=True):
        row, at = held[o], place - int(offsets[o])
        digest = xxhash.xxh3_64_intdigest(texts[o][at : at + length])
        by_bucket.setdefault((row["fp"], digest % row["slots"], row["slot"]), []).append((digest, row["rh"], at))
    out = []
    for (fp, bucket, slot), items in by_bucket.items():
        items.sort()
        digests = np.array([i[0] for i in items], "<u8").tobytes()
        places = b"".join(i[1] + i[2].to_bytes(4, "little") for i in items)
        out.append({"rh": None, "start": None, "end": None, "fp": fp, "bucket": bucket, "slot": slot, "digests": digests, "places": places})
    return out


def merge_shards(frame: pd.DataFrame) -> pd.DataFrame:
    """Windows of a hot anchor that stand in two shards: each shard's sorted digests are searched in the others'."""
    lists = [np.frombuffer(d, "<u8") for d in frame["digests"]]
    found: list[tuple[bytes, int, int]] = []
    everything = np.sort(np.concatenate(lists))
    for own, places in zip(lists, frame["places"], strict=True):
        shared = np.searchsorted(everything, own, "right") - np.searchsorted(everything, own, "left") > 1
        for k in np.flatnonzero(shared).tolist():
            record = places[20 * k : 20 * k + 20]
            at = int.from_bytes(record[16:], "little")
            found.append((record[:16], at, at + 1))
    return pd.DataFrame(found, columns=["rh", "start", "end"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, hot_texts: int = HOT_TEXTS) -> DataFrame:
    """t1, t2 (a text's two hashes) and spans, the byte ranges of the text that repeated strings cover.

    1. Each window start is put in a run by its anchor; a run that a text holds several times is one row. A string that stands twice has the same anchor both times, so
       only runs with an anchor found twice are looked at further.
    2. Runs that are equal as a whole need no comparison. Of the others each different text is fetched once and goes,
       by anchor, to a shard, trimmed to where it can agree with another; a shard's suffix array and common prefixes show its repeats.
    3. An anchor with more than ``hot_texts`` different texts is dealt over several shards, and the shards' sorted
       windows are merged by binary search, bucket by bucket.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.coalesce("text", F.lit("")).alias("text")).select("text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    run_type = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("at", pa.int32()), ("fp", pa.int64()), ("rh", pa.binary()), ("k", pa.int32())]))

    def find_runs(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t in text_bytes(batch.column("text")):
            starts, counts, places, anchors = runs(t, length)
            each: dict[bytes, dict] = {}
            own: list[list[int]] = []  # where runs stand that the text itself repeats, merged
            for s, n, a, f in zip(starts.tolist(), counts.tolist(), places.tolist(), anchors.view(np.int64).tolist(), strict=True):
                rh = xxhash.xxh3_128_digest(t[s : s + n + length - 1])
                if rh not in each:
                    each[rh] = {"start": s, "n": n, "at": a - s, "fp": f, "rh": rh, "k": 1}
                    continue
                each[rh]["k"] += 1
                if own and s <= own[-1][1]:
                    own[-1][1] = s + n
                else:
                    own.append([s, s + n])
            out.append([*each.values(), *({"start": s, "n": e - s, "k": 0} for s, e in own)])
        return pa.RecordBatch.from_arrays([batch.column("t1"), batch.column("t2"), pa.array(out, run_type)], names=["t1", "t2", "runs"])

    long_enough = keyed.where(F.octet_length("text") >= length)
    every = map_texts(long_enough, ["t1", "t2"], find_runs, "t1 long, t2 long, runs array<struct<start:int,n:int,at:int,fp:long,rh:binary,k:int>>")
    every = materialize(every.select("t1", "t2", F.explode("runs").alias("r")).select("t1", "t2", "r.*"), "runs")
    anchors = every.where("k > 0").groupBy("fp").agg(F.sum("k").alias("found"), (F.min("rh") != F.max("rh")).alias("mixed")).where("found > 1").select("fp", "mixed")
    found = materialize(every.join(anchors, "fp"), "repeated-runs")

    mixed = found.where("mixed").groupBy("fp", "rh").agg(F.sum("k").alias("copies"), F.min(F.struct("t1", "t2", "start", "n", "at")).alias("one"))
    mixed = materialize(mixed.select("fp", "rh", "copies", "one.*"), "mixed-runs")
    slots = mixed.groupBy("fp").agg(F.ceil(F.count("*") / hot_texts).cast("int").alias("slots"))
    dealt = mixed.join(slots, "fp").withColumn("slot", F.pmod(F.xxhash64("rh"), F.col("slots")).cast("int"))
    wanted = dealt.groupBy("t1", "t2").agg(F.collect_list(F.struct("fp", "slot", "slots", "rh", "start", "n", "at")).alias("wanted"))
    # texts of equal hashes are equal: one row of each is enough, and the runs it gives are told apart by rh
    pieces = keyed.join(wanted, ["t1", "t2"]).select(F.col("text").cast("binary").alias("b"), F.explode("wanted").alias("w"))
    pieces = pieces.select("w.fp", "w.slot", "w.slots", "w.rh", "w.at", F.substring(F.col("b"), F.col("w.start") + 1, F.col("w.n") + length - 1).alias("piece")).dropDuplicates(["fp", "slot", "rh"])
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shards = pieces.repartition(n, "fp", "slot").sortWithinPartitions("fp", "slot", "rh")
    offers = materialize(shards.mapInArrow(_shard_work(length, shard_bytes), "rh binary, start int, end int, fp long, bucket int, slot int, digests binary, places binary"), "shards")
    inside = offers.where("digests IS NULL").select("rh", "start", "end")
    across = offers.where("digests IS NOT NULL").groupBy("fp", "bucket").applyInPandas(merge_shards, "rh binary, start int, end int")
    partly = inside.union(across).join(mixed.where("copies = 1").select("rh", "t1", "t2", F.col("start").alias("run")), "rh")

    whole = found.where("NOT mixed").select("t1", "t2", "start", (F.col("start") + F.col("n")).alias("end"))
    copied = found.join(mixed.where("copies > 1").select("fp", "rh"), ["fp", "rh"]).select("t1", "t2", "start", (F.col("start") + F.col("n")).alias("end"))
    inner = every.where("k = 0").select("t1", "t2", "start", (F.col("start") + F.col("n")).alias("end"))
    spans = whole.union(copied).union(inner).union(partly.select("t1", "t2", F.col("run") + F.col("start"), F.col("run") + F.col("end"))).distinct()
    return spans.groupBy("t1", "t2").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("end") + length - 1).alias("end")))).alias("spans"))


def cut(text: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed, and the number of maximal removed runs."""
    kept, upto, removed, n = [], 0, 0, 0
    for s in spans or []:
        start, end = s["start"], s["end"]
        if start > upto or (n == 0 and start == upto):
            n += 1
            kept.append(text[upto:start])
            removed += end - start
        elif end > upto:
            removed += end - upto
        upto = max(upto, end)
    kept.append(text[upto:])
    return b"".join(kept), removed, n


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, length: int = LENGTH, with_text: bool = False, **limits: int) -> DataFrame:
    """doc_id (and other ``keep`` columns), n_bytes, n_removed, n_spans, kept_sha256 for every row; the bytes left, if asked.

    Every byte is removed that a string of ``length`` bytes covers which also starts anywhere else, in the same text or
    another row's; strings are judged on the input. Texts are UTF-8 bytes, null is empty; texts shorter than ``length``
    lose nothing. Rows of equal text lose all of it if it is long enough. A null doc_id is a row like any other; an
    empty table gives an empty result; columns that aren't kept are ignored.
    """
    keep = ["doc_id", *(k for k in keep or [] if k != "doc_id")]
    spans = repeated_spans(docs, length, **limits)
    texts = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text")).withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), F.col("text"))})
    joined = texts.join(spans, ["t1", "t2"], "left").select(*keep, "text", "spans")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = text_bytes(batch.column("text"))
        done = [cut(t, s) for t, s in zip(raw, batch.column("spans").to_pylist(), strict=True)]
        columns = [
            *[batch.column(k) for k in keep],
            pa.array([len(t) for t in raw], pa.int64()),
            pa.array([d[1] for d in done], pa.int64()),
            pa.array([d[2] for d in done], pa.int64()),
            pa.array([hashlib.sha256(d[0]).hexdigest() for d in done]),
            *([pa.array([d[0] for d in done], pa.binary())] if with_text else []),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])])

    types = dict(docs.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keep], "n_bytes long, n_removed long, n_spans long, kept_sha256 string", *(["kept binary"] if with_text else [])])
    return map_texts(joined, [*keep, "spans"], work, schema)


#: The same in DuckDB by hashing every string of 400 bytes of the texts' hex forms.
ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(length(hex(encode(coalesce(text, '')))) / 2 AS BIGINT) AS n FROM documents),
w AS (SELECT r, p, md5(substring(h, 2 * p + 1, 800)) AS k FROM (SELECT r, h, unnest(range(0, n - 399)) AS p FROM d WHERE n >= 400)),
f AS (SELECT r, p FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
g AS (SELECT r, p, sum(CASE WHEN p - was <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS g FROM (SELECT *, lag(p) OVER (PARTITION BY r ORDER BY p) AS was FROM f)),
runs AS (SELECT r, min(p) AS s, max(p) + 400 AS e FROM g GROUP BY r, g),
edges AS (SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS a, s AS b FROM runs UNION ALL SELECT r, max(e), any_value(n) FROM runs JOIN d USING (r) GROUP BY r),
left_ AS (SELECT r, sha256(unhex(string_agg(substring(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a))) AS digest FROM edges JOIN d USING (r) GROUP BY r),
sums AS (SELECT r, CAST(sum(e - s) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(digest, sha256(unhex(h))) AS kept_sha256
FROM d LEFT JOIN sums USING (r) LEFT JOIN left_ USING (r)
"""
