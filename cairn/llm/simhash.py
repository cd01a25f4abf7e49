"""SimHash near-duplicates, linked through anchor points of a covering code."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.graph import components
from cairn.llm.textscan import LOWER, kept, map_texts, text_bytes
from cairn.session import drop_tables, materialize

SHINGLE = 3
THRESHOLD = 3
SEED = 42
#: Each half of a fingerprint is covered by the perfect [31, 26] Hamming code over 31 of its 32 bits.
CODE_BITS = 31
SMALL_GROUP = 8
BIG_GROUP = 128
REPLICATED_AT_ONCE = 4096
#: near_copies(): words of a shingle, and the least similarity of a link as a fraction.
COPY_SHINGLE = 5
COPY_SIMILARITY = (3, 4)
#: Rows that the order of shingles is made from, about, and the frequent shingles that stand last in it, at most. Any order
#: gives the same links.
ORDER_ROWS = 20_000
FREQUENT = 50_000
FREQUENT_FROM = 3
#: Pairs of a shingle's texts that are compared at once, the bits of a set's parities, and those of the sets that may still
#: link to another group after a first look.
COMPARED_AT_ONCE = 1 << 17
PARITY_BITS = 512
WIDE_BITS = 2048


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of a UTF-8 text's word shingles, repeats included; of the whole sequence if it is shorter; none without words."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray, n_words: int = 1) -> np.ndarray:
    """``n_words`` words of 64 bits: bit i of the first is 1 if it is set in over half the hashes; the further words do
    the same with the hashes mixed anew. All 0 without hashes."""
    out = np.zeros(n_words, np.uint64)
    for k in range(n_words if len(hashes) else 0):
        ones = np.zeros(64, np.int64)
        for start in range(0, len(hashes), 8192):
            h = hashes[start : start + 8192]
            if k:
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                h ^= h >> np.uint64(31)
            ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0]
    return out


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text: bit i is 1 if it is set in over half the XXH64 of its word shingles; 0 without words."""
    return int(majority(shingle_hashes(text, shingle))[0])


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = SHINGLE, n_words: int = 1) -> DataFrame:
    """The ``keep`` columns of every row, fp, its fingerprint as a signed long, and further words w1, w2, ..."""
    names = ["fp", *(f"w{k}" for k in range(1, n_words))]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = np.array([majority(shingle_hashes(t, shingle), n_words) for t in text_bytes(batch.column("text"))], np.uint64).reshape(-1, n_words).view(np.int64)
        return pa.RecordBatch.from_arrays([*kept(batch, keep), *(pa.array(words[:, k]) for k in range(n_words))], names=[*keep, *names])

    types = dict(docs.dtypes)
    return map_texts(docs, keep, work, ", ".join([*[f"`{k}` {types[k]}" for k in keep], *(f"{k} long" for k in names)]))


def _syndrome(v: np.ndarray) -> np.ndarray:
    s = np.zeros(v.shape, np.uint64)
    for bit in range(5):
        mask = np.uint64(sum(1 << (i - 1) for i in range(1, CODE_BITS + 1) if i >> bit & 1))
        s |= (np.bitwise_count(v & mask).astype(np.uint64) & np.uint64(1)) << np.uint64(bit)
    return s


def anchors(*words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For fingerprints of one or more words (uint64 arrays), the index of each replica and its anchor.

    Of two one-word fingerprints with 3 or fewer differing bits, one half differs in at most 1. The code's covering
    radius is 1, so the codeword next to the one half is within 1 + 1 of the other: both are found at an anchor if each
    goes to every codeword within 2 of its half. These are 16 (1 for a codeword): flip the bit that the syndrome names,
    or any two bits whose numbers add up to the syndrome. Halves that differ in 2 bits share one, too.
    """
    index, out = [], []
    number = np.arange(len(words[0]))
    one = np.uint64(1)
    for half in range(2 * len(words)):
        v = (words[half // 2] >> np.uint64(32 * (half % 2))) & np.uint64((1 << CODE_BITS) - 1)
        s = _syndrome(v)
        tag = np.uint64(half << 40)
        home = np.where(s > 0, v ^ (one << (np.maximum(s, one) - one)), v)
        index.append(number)
        out.append(home | tag)
        for i in range(1, CODE_BITS + 1):
            j = s ^ np.uint64(i)
            at = (s > 0) & (j > i)
            index.append(number[at])
            out.append((v[at] ^ np.uint64(1 << (i - 1)) ^ (one << (j[at] - one))) | tag)
    return np.concatenate(index), np.concatenate(out)


def _replicate(batches):
    """Rows of fp and further words to (anchor, fp)."""
    for b in batches:
        words = [b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(b.num_columns)]
        at_once = REPLICATED_AT_ONCE // len(words)
        for k in range(0, b.num_rows, at_once):
            part = [w[k : k + at_once] for w in words]
            at, anchor = anchors(*(w.view(np.uint64) for w in part))
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(part[0][at])], names=["anchor", "fp"])


def link_group(fp: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links within one anchor's different fingerprints: each link's two ends.

    Of a group of at most BIG_GROUP, fingerprints that are near no other are left out first, all at once.
    Grown breadth first: a fingerprint is compared with those not reached yet, so a dense group takes few comparisons
    and no list of all its pairs is made.
    """
    if len(fp) <= BIG_GROUP:
        fp = fp[(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= threshold).sum(1) > 1]
    found, left = [], fp
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= threshold
            if near.any():
                new = left[near]
                found.append((np.full(len(new), x), new))
                queue.extend(new)
                left = left[~near]
    return found


def link_sorted(anchor: np.ndarray, fp: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal ``anchor``; runs of up to SMALL_GROUP all at once, shift by shift, each larger one
    as a spanning forest."""
    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(anchor)])
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for k in np.flatnonzero(sizes > SMALL_GROUP):
        for x, y in link_group(np.unique(fp[starts[k] : starts[k] + sizes[k]]), threshold):
            a.append(x)
            b.append(y)
    small = np.repeat(sizes <= SMALL_GROUP, sizes)
    anchor, fp = anchor[small], fp[small]
    for shift in range(1, int(sizes[sizes <= SMALL_GROUP].max(initial=1))):
        same = np.flatnonzero(anchor[shift:] == anchor[:-shift])
        if not len(same):
            break
        x, y = fp[same], fp[same + shift]
        near = (np.bitwise_count(x ^ y) <= threshold) & (x != y)
        a.append(x[near])
        b.append(y[near])
    return np.concatenate(a), np.concatenate(b)


def _links(batches, threshold: int = THRESHOLD) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor; the last run of a batch waits for the next batch."""
    rest = (np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def give(anchor, fp):
        a, b = link_sorted(anchor, fp, threshold)
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        anchor = np.r_[rest[0], batch.column("anchor").to_numpy(zero_copy_only=False)]
        fp = np.r_[rest[1], batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)]
        if len(anchor):
            cut = int(np.searchsorted(anchor, anchor[-1]))
            rest = (anchor[cut:], fp[cut:])
            if cut:
                yield give(anchor[:cut], fp[:cut])
    if len(rest[0]):
        yield give(*rest)


def near_duplicates(docs: DataFrame, keep: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """doc_id (and other ``keep`` columns), fingerprint as 16 hex digits, component_id for every row.

    Fingerprints link at THRESHOLD or fewer differing bits; component_id is the smallest doc_id reachable through
    links, rows of equal fingerprint included. Null and empty texts have the fingerprint 0, linked like any other.
    Repeated rows share a component. A null doc_id takes part, but isn't a component_id unless its component has no
    other. An empty table gives an empty result; columns that aren't kept are ignored.

    Rows of equal fingerprint are one node. Each anchor's group gives a spanning forest of its links, not its pairs;
    the forests are joined by rounds of star contraction.
    """
    keep = ["doc_id", *(k for k in keep or [] if k != "doc_id")]
    rows = materialize(fingerprints(docs, keep, shingle), "simhash")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    replicas = nodes.select("fp").mapInArrow(_replicate, "anchor long, fp long")
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    links = replicas.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(_links, "a long, b long")
    roots = components(links)
    grouped = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = grouped.select("fp", "root").join(named, "root").select("fp", "component_id")
    return rows.join(labels, "fp").select(*keep, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of about ORDER_ROWS texts have, sorted, and the number of these texts; at most FREQUENT."""
    every = max(1, docs.count() // ORDER_ROWS)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(shingle_hashes(t, COPY_SHINGLE)) for t in text_bytes(batch.column("text"))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], names=["token"])

    some = docs.where(F.pmod(F.xxhash64(F.lit(2), "text"), F.lit(every)) == 0).select("text").distinct()
    counts = map_texts(some, [], work, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT_FROM)
    counts = materialize(counts, "shingle-counts")  # and so the shuffled texts and shingles go
    top = counts.orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    drop_tables(counts)
    token, n = top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def copy_prefix(tokens: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first of a set's tokens in an order that all sets share, frequent ones last: as many as it takes for a set
    that is similar enough to have one of them among its own first."""
    known, counts = frequent
    n = np.zeros(len(tokens), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        n = np.where(known[at] == tokens, counts[at], 0)
    over, under = COPY_SIMILARITY
    return tokens[np.lexsort((tokens, n))][: len(tokens) - -(-len(tokens) * over // under) + 1 if len(tokens) else 0]


def by_token(give) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by token, handed to ``give`` in batches that end with a token's last row."""

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            if not table.num_rows:
                continue
            token = table.column("token").to_numpy()
            cut = int(np.searchsorted(token, token[-1]))
            whole = table.to_batches()[0]
            rest = whole.slice(cut)
            if cut:
                yield give(whole.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield give(rest)

    return run


def _shared_tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of tokens that two nodes or more have, and the least of these nodes."""
    token, node = (batch.column(k).to_numpy() for k in ("token", "node"))
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    sizes = np.diff(np.r_[starts, len(token)])
    least = np.repeat(np.minimum.reduceat(node, starts), sizes)
    many = np.repeat(sizes > 1, sizes)
    return pa.RecordBatch.from_arrays([*(pa.array(c[many]) for c in (token, node, batch.column("place").to_numpy(), least))], names=["token", "node", "place", "least"])


def parities(tokens: np.ndarray, n_bits: int = PARITY_BITS) -> bytes:
    """A bit for each remainder of a token by ``n_bits``: whether an odd number of tokens has it. Each token that only
    one of two sets has changes one bit, so at least as many tokens differ as bits."""
    odd = np.bincount((tokens & np.uint64(n_bits - 1)).astype(np.int64), minlength=n_bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _sizes_near(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    over, under = COPY_SIMILARITY
    return np.minimum(n, m) * under >= np.maximum(n, m) * over


def _few(differ: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m tokens may be similar if ``differ`` tokens at least differ."""
    over, under = COPY_SIMILARITY
    return differ * (over + under) <= (n + m) * (under - over)


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _by_parities(batches):
    """Of rows of a, b, their sizes and parities the pairs that may be similar."""
    for batch in batches:
        if batch.num_rows:
            n, m = batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy()
            differ = np.bitwise_count(_words(batch.column("a_bits")) ^ _words(batch.column("b_bits"))).sum(1, dtype=np.int64)
            good = _sizes_near(n, m) & _few(differ, n, m)
            yield batch.select(["a", "b"]).filter(pa.array(good))


def _apart(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a token's rows of different groups that may be similar, by their sizes, by what follows the token and by how
    many tokens differ at least: both rows, and that number. Each pair comes both ways, all those of a row at once."""
    token, place, group = (batch.column(k).to_numpy() for k in ("token", "place", "group"))
    n, rest = place >> 32, (place >> 32) - (place & 0xFFFFFFFF)
    bits = _words(batch.column("bits"))
    over, under = COPY_SIMILARITY
    starts = np.r_[np.flatnonzero(np.r_[True, token[1:] != token[:-1]]), len(token)]
    at_once = max(1, COMPARED_AT_ONCE // bits.shape[1])
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if (group[s:e] == group[s]).all():
            continue
        y, rows_at_once = np.arange(s, e)[None, :], max(1, COMPARED_AT_ONCE // (e - s))
        for i in range(s, e, rows_at_once):
            x = np.arange(i, min(e, i + rows_at_once))[:, None]
            p, q = np.nonzero((group[x] != group[y]) & _sizes_near(n[x], n[y]) & (np.minimum(rest[x], rest[y]) * (over + under) >= (n[x] + n[y]) * over))
            p, q = p + i, q + s
            differ = np.zeros(len(p), np.int64)
            for k in range(0, len(p), at_once):
                differ[k : k + at_once] = np.bitwise_count(bits[p[k : k + at_once]] ^ bits[q[k : k + at_once]]).sum(1, dtype=np.int64)
            few = _few(differ, n[p], n[q])
            if few.any():
                yield p[few], q[few], differ[few]


def _nearest_apart(batch: pa.RecordBatch) -> pa.RecordBatch:
    """For each node that may be similar to nodes of other groups the one of them that seems most so, and how far it seems."""
    node, n = batch.column("node").to_numpy(), batch.column("place").to_numpy() >> 32
    found = [np.zeros((0, 3), np.int64)]
    for p, q, differ in _apart(batch):
        far = (differ << 20) // np.maximum(1, n[p] + n[q])
        order = np.lexsort((node[q], far, p))
        first = order[np.r_[True, p[order][1:] != p[order][:-1]]]
        found.append(np.stack([node[p[first]], far[first], node[q[first]]], 1))
    best = np.concatenate(found)
    best = best[np.lexsort((best[:, 2], best[:, 1], best[:, 0]))]
    best = best[np.flatnonzero(np.r_[True, best[1:, 0] != best[:-1, 0]])] if len(best) else best
    return pa.RecordBatch.from_arrays([pa.array(best[:, k]) for k in range(3)], names=["a", "far", "b"])


def _apart_pairs(batch: pa.RecordBatch) -> pa.RecordBatch:
    """All pairs of a token's nodes of different groups that may be similar."""
    node = batch.column("node").to_numpy()
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *(np.stack([node[p], node[q]], 1)[node[p] < node[q]] for p, q, _ in _apart(batch))])
    pairs = np.unique(pairs, axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _wide_parities(batches):
    """Rows of node, tokens to node and its wide parities."""
    for batch in batches:
        tokens, ends = batch.column("tokens").flatten().to_numpy().view(np.uint64), np.cumsum(np.r_[0, batch.column("tokens").value_lengths().to_numpy()]).tolist()
        bits = [parities(tokens[s:e], WIDE_BITS) for s, e in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(bits, pa.binary())], names=["node", "bits"])


def _similar(batches):
    """Of rows of a, b and their sets the pairs that are similar enough."""
    over, under = COPY_SIMILARITY
    for batch in batches:
        first, second = batch.column("a_set"), batch.column("b_set")
        x, y, i, j = first.flatten().to_numpy(), second.flatten().to_numpy(), *(np.cumsum(np.r_[0, c.value_lengths().to_numpy()]).tolist() for c in (first, second))
        good = []
        for k in range(batch.num_rows):
            u, v = x[i[k] : i[k + 1]], y[j[k] : j[k + 1]]
            both = np.sort(np.concatenate([u, v]))
            common = int((both[1:] == both[:-1]).sum())
            good.append(common * under >= (len(both) - common) * over)
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def similar_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of ``pairs`` (a, b) those whose sets (node, tokens) have a similarity of COPY_SIMILARITY or more."""
    side = lambda k: sets.select(F.col("node").alias(k), F.col("tokens").alias(k + "_set"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_set", "b_set").mapInArrow(_similar, "a long, b long")


def near_copies(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id (and other ``keep`` columns) and component_id for every row: near copies by 5-word shingles.

    Two texts link if their sets of shingles have a similarity (common ones by all) of COPY_SIMILARITY or more. No link
    is left out: in any order of all shingles, similar sets share one of the first quarter of their own (the prefix
    filter). Texts with the same set are one node.

    1. Each node is compared with the least node of each of its first shingles; what links is a group.
    2. Twice, each node is compared with the one node of other groups that shares one of its first shingles and, by
       parities, seems the most similar: one pair a node, however large the groups are. What links joins the groups.
    3. Of each such shingle all nodes of groups that are still different are compared. A large group of near copies is one
       group by then, so what is left is pairs just short of a link, and the few links that 2 didn't find.

    Pairs are left out if their sizes, the shingle's places (in 2 and 3) and the parities of their sets rule a link out;
    nodes without any other pair after the first look in 2 are done. Of the others, and of these only, the whole sets are
    made again and compared, by 64-bit hashes; their parities have WIDE_BITS from then on. Nulls, empty texts, repeated rows
    and empty tables are as in near_duplicates().
    """
    keep = ["doc_id", *(k for k in keep or [] if k != "doc_id")]
    frequent = frequent_shingles(docs)

    def prefixes(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes(t, COPY_SHINGLE)) for t in text_bytes(batch.column("text"))]
        first = [copy_prefix(s, frequent).view(np.int64) for s in sets]
        node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        offsets = pa.array(np.cumsum([0, *map(len, first)]), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *first])))
        return pa.RecordBatch.from_arrays([*kept(batch, [*keep, "_key"]), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array([parities(s) for s in sets], pa.binary()), lists], names=[*keep, "_key", "node", "n", "bits", "first"])

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes(t, COPY_SHINGLE)) for t in text_bytes(batch.column("text"))]
        offsets = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column("node"), lists], names=["node", "tokens"])

    types = dict(docs.dtypes)
    keyed = docs.withColumn("_key", F.xxhash64("text"))
    columns = ", ".join(f"`{k}` {types[k]}" for k in keep)
    full = materialize(map_texts(keyed, [*keep, "_key"], prefixes, columns + ", _key long, node long, n long, bits binary, first array<long>"), "prefixes")
    rows = materialize(full.select(*keep, "node"), "copy-rows")
    firsts = full.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min("_key").alias("_key"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("first").alias("first"))
    firsts = materialize(firsts, "copy-firsts")
    drop_tables(full)
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tokens = firsts.select("node", "n", F.posexplode("first").alias("at", "token")).select("token", "node", (F.shiftleft("n", 32) + F.col("at")).alias("place"))
    shared = materialize(tokens.repartition(parts, "token").sortWithinPartitions("token").mapInArrow(by_token(_shared_tokens), "token long, node long, place long, least long"), "shared-shingles")
    nodes = materialize(firsts.drop("first"), "copy-nodes")
    drop_tables(firsts)

    def whole_sets(asked: DataFrame, tag: str) -> DataFrame:
        texts = keyed.select("_key", "text").join(nodes.join(asked, "node").select("_key", "node"), "_key").dropDuplicates(["_key"])
        return materialize(map_texts(texts, ["node"], whole, "node long, tokens array<long>"), tag)

    def apart(rows: DataFrame, links: DataFrame, bits: DataFrame, give, schema: str) -> DataFrame:
        grouped = rows.join(components(links), "node", "left").join(bits, "node").select("token", "node", "place", F.coalesce("root", "node").alias("group"), "bits")
        return grouped.repartition(parts, "token").sortWithinPartitions("token").mapInArrow(by_token(give), schema)

    def nearest(rows: DataFrame, links: DataFrame, bits: DataFrame) -> DataFrame:
        found = apart(rows, links, bits, _nearest_apart, "a long, far long, b long")
        return materialize(found.groupBy("a").agg(F.min(F.struct("far", "b")).alias("x")).select("a", F.col("x.b").alias("b")), "nearest-apart")

    side = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(k + "_n"), F.col("bits").alias(k + "_bits"))
    stars = shared.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    stars = materialize(stars.join(side("b"), "b").join(side("a"), "a").mapInArrow(_by_parities, "a long, b long"), "star-pairs")
    sets = whole_sets(stars.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "star-sets")
    links = materialize(similar_pairs(stars, sets), "star-links")
    drop_tables(sets)

    pairs = nearest(shared, links, nodes.select("node", "bits"))
    sets = whole_sets(pairs.select(F.col("a").alias("node")), "apart-sets")
    wide = materialize(sets.mapInArrow(_wide_parities, "node long, bits binary"), "wide-parities")
    left = materialize(shared.select("token", "node", "place").join(wide.select("node"), "node"), "apart-shingles")
    drop_tables(shared)
    links = links.union(materialize(similar_pairs(pairs, sets), "apart-links"))
    links = links.union(materialize(similar_pairs(nearest(left, links, wide), sets), "apart-links"))
    pairs = materialize(apart(left, links, wide, _apart_pairs, "a long, b long").distinct(), "apart-pairs")
    more = materialize(similar_pairs(pairs, sets), "apart-links")
    drop_tables(sets)
    roots = components(links.union(more))
    grouped = nodes.select("node", "least_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labels = grouped.select("node", "root").join(named, "root").select("node", "component_id")
    return rows.join(labels, "node").select(*keep, "component_id")
