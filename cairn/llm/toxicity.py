"""Toxicity: a learned lexicon, Levenshtein automata over its trie, and context windows around the hits."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.textscan import kept, map_texts, text_bytes

#: The classifier is fitted on about this many labelled texts at most, drawn by a hash of doc_id.
FIT_ROWS = 20_000
MAX_TERMS = 2_000
#: A term stands in this many families of toxic texts at least, and its smoothed odds are this many times the corpus's.
SUPPORT = 6
ODDS = 20.0
STEMS = (5, 6, 7)
#: Terms shorter than this are matched exactly only.
FUZZY_LENGTH = 5
#: What a term is: a whole word, a stem, or both.
WORD, STEM, BOTH = 0, 1, 2
#: Words on each side of a hit that are its context.
CONTEXT = 6
#: Distinct words known to be no hit that a worker remembers.
REMEMBERED = 400_000
WORDS = re.compile(r"[^\W_]+")
QUOTES = "\"“”„«»"
# Words that report speech, and words that address someone.
REPORTING = frozenset("said says say quote quoted quotes wrote word words term called sagte schrieb zitat wort dit mot citation dijo palabra cita".split())
ADDRESS = frozenset("you your youre ur du dein deine ihr euch sie tu toi ton ta vous votre usted tus eres".split())
FEATURES = ("exact", "stem", "fuzzy", "quoted", "addressed", "strongest", "density")


@dataclass
class LexiconAutomaton:
    """The lexicon's trie crossed with a Levenshtein automaton of distance 1, made deterministic as words walk it.

    A state is the set of (trie node, edits so far); transitions are kept once made, so a word costs one dictionary
    look-up a letter and ends at its first letter that no term within distance 1 allows. A stem matches any word that
    starts with it, without edits; a term that is BOTH also matches as a word, with them.
    """

    terms: dict[str, int]
    limit: int = 200_000
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: dict[int, str] = field(default_factory=dict)
    fuzzy: list[bool] = field(default_factory=lambda: [False])
    known: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        for term, what in sorted(self.terms.items()):
            node = 0
            near = what != STEM and len(term) >= FUZZY_LENGTH
            self.fuzzy[0] |= near
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.fuzzy.append(False)
                node = self.children[node][c]
                self.fuzzy[node] |= near
            self.ends[node] = term
        self.start = self.closed({(0, 0)})

    def closed(self, state: set) -> frozenset:
        """With the terms' letters that a word may leave out."""
        return frozenset(state | {(m, 1) for n, e in state if e == 0 for m in self.children[n].values() if self.fuzzy[m]})

    def step(self, state: frozenset, c: str) -> frozenset:
        out = set()
        for n, e in state:
            if n in self.ends and self.terms[self.ends[n]] and e == 0:
                out.add((n, 0))
            for label, m in self.children[n].items():
                if label == c and (e == 0 or self.fuzzy[m]):
                    out.add((m, e))
                elif label != c and e == 0 and self.fuzzy[m]:
                    out.add((m, 1))
            if e == 0 and self.fuzzy[n]:
                out.add((n, 1))
        return self.closed(out)

    def match(self, word: str) -> tuple[str, str] | None:
        """(kind, term) of the best match: exact, then stem, then fuzzy; None without one."""
        state = self.start
        for c in word:
            after = self.known.get((state, c))
            if after is None:
                if len(self.known) > self.limit:
                    self.known.clear()
                after = self.known[(state, c)] = self.step(state, c)
            if not after:
                return None
            state = after
        exact = [self.ends[n] for n, e in state if e == 0 and n in self.ends]
        if word in exact:
            return "exact", word
        if stems := [t for t in exact if self.terms[t] and word.startswith(t)]:
            return "stem", max(stems, key=len)
        near = sorted(self.ends[n] for n, e in state if e == 1 and n in self.ends and self.fuzzy[n] and self.terms[self.ends[n]] != STEM and len(self.ends[n]) >= FUZZY_LENGTH)
        return ("fuzzy", near[0]) if near else None


@dataclass
class Model:
    terms: dict[str, int]
    weights: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    bias: float = -3.0
    key: str = ""


class Reader:
    """Finds hits in texts; remembers words that are none, up to REMEMBERED of them."""

    def __init__(self, terms: dict[str, int]) -> None:
        self.automaton = LexiconAutomaton(terms)
        self.clean: set[str] = set()
        self.hits: dict[str, tuple[str, str]] = {}

    def features(self, text: str) -> list[float]:
        lower = text.lower()
        words = WORDS.findall(lower)
        seen = set(words)
        for w in seen - self.clean:
            if w not in self.hits:
                if found := self.automaton.match(w):
                    self.hits[w] = found
                else:
                    self.clean.add(w)
        if len(self.clean) > REMEMBERED:
            self.clean.clear()
        if not seen & self.hits.keys():
            return [0.0] * len(FEATURES)
        return self.in_context(lower, words)

    def in_context(self, lower: str, words: list[str]) -> list[float]:
        """Sums over the hits; a hit between quotation marks, or after a reporting word, counts as quoted."""
        spans = [m.span() for m in WORDS.finditer(lower)]
        sums, strongest = Counter(), 0.0
        for i, w in enumerate(words):
            if w not in self.hits:
                continue
            near = words[max(0, i - CONTEXT) : i + CONTEXT + 1]
            start, end = spans[max(0, i - CONTEXT)][0], spans[min(len(spans) - 1, i + CONTEXT)][1]
            before, after = lower[start : spans[i][0]], lower[spans[i][1] : end + 1]
            inside = any(q in before for q in QUOTES) and any(q in after for q in QUOTES)
            quoted = inside or bool(REPORTING & set(words[max(0, i - 3) : i]))
            addressed = bool(ADDRESS & set(near))
            kind = "quoted" if quoted else self.hits[w][0]
            sums[kind] += 1
            sums["addressed"] += addressed and not quoted
            strongest = max(strongest, {"exact": 1.0, "stem": 0.8, "fuzzy": 0.6}[self.hits[w][0]] * (0.3 if quoted else 1.0))
        total = sum(sums[k] for k in ("exact", "stem", "fuzzy"))
        return [*(float(np.log1p(sums[k])) for k in FEATURES[:5]), strongest, min(1.0, 20.0 * total / max(20, len(words)))]


_READERS: dict[str, Reader] = {}


def reader(key: str, terms: dict[str, int]) -> Reader:
    """One reader for a lexicon in a worker process."""
    if key not in _READERS:
        _READERS.clear()
        _READERS[key] = Reader(terms)
    return _READERS[key]


def family(text: str) -> int:
    """Smallest hash of the text's 3-word shingles: near copies mostly share it."""
    words = WORDS.findall(text.lower())
    return min((xxhash.xxh64_intdigest(" ".join(words[k : k + 3])) for k in range(max(1, len(words) - 2))), default=0) >> 1


def _with_family(batches):
    for b in batches:
        texts = [t or "" for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(texts), b.column("toxic"), pa.array([family(t) for t in texts], pa.int64())], names=["text", "toxic", "family"])


def _count_terms(frames):
    """Texts of each label with each word and stem, summed within the task."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for frame in frames:
        for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
            words = {w for w in WORDS.findall(text.lower()) if 3 <= len(w) <= 24}
            counts[int(toxic)].update(words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k})
    terms = sorted(counts[1])  # a term that no toxic text of the task has only matters as a clean count
    rest = sorted(counts[0].keys() - counts[1].keys())
    for part, toxic in ((terms, True), (rest, False)):
        for k in range(0, len(part), 50_000):
            chunk = part[k : k + 50_000]
            yield pd.DataFrame({"term": chunk, "clean": [counts[0][t] for t in chunk], "toxic": [counts[1][t] if toxic else 0 for t in chunk]})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def lexicon(chosen: Iterable[str]) -> dict[str, int]:
    """Words and stems (ending in ``*``) as terms. Longer stems of a stem go; a word stays, for its misspellings."""
    terms: dict[str, int] = {}
    for term in sorted(chosen, key=lambda t: (len(t), t)):
        word, what = term.rstrip("*"), STEM if term.endswith("*") else WORD
        if what == WORD or not any(terms.get(word[:k]) for k in range(3, len(word))):
            terms[word] = BOTH if terms.get(word, what) != what else what
    return terms


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learn the lexicon and the weights from labelled texts whose doc_id isn't held out.

    One text of each family of near copies is read. The lexicon is what toxic texts have far more often than others:
    words, and stems of 5 to 7 letters. Only terms over the thresholds (MAX_TERMS at most) and the feature rows of the
    bounded sample come to the driver.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = max(1, known.count())
    share = min(1.0, rows / n)
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = docs.select("doc_id", "text").join(known, "doc_id").select("text", "toxic").mapInArrow(_with_family, "text string, toxic int, family long")
    sample = sample.groupBy("family", "toxic").agg(F.min("text").alias("text")).select("text", "toxic").persist()
    try:
        sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
        if not sizes.get(1):
            return Model({}, key="none")
        base = (sizes[1] + 1) / (sizes.get(0, 0) + 1)
        counted = sample.mapInPandas(_count_terms, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        odds = (F.col("toxic") + 0.5) / (F.col("clean") + 0.5) / base
        chosen = counted.where((F.col("toxic") >= min(SUPPORT, max(2, sizes[1] // 8))) & (odds >= ODDS)).orderBy(F.desc(odds), F.desc("toxic"), "term").limit(MAX_TERMS).collect()
        terms = lexicon(r["term"] for r in chosen)
        model = Model(terms, key=xxhash.xxh64_hexdigest(repr(sorted(terms.items()))))
        table = sorted((tuple(r["features"]), r["toxic"]) for r in _features(sample.withColumn("row", F.lit(0)), ["toxic"], model).collect())
    finally:
        sample.unpersist()
    x, y = np.array([t[0] for t in table]), np.array([t[1] for t in table], float)
    model.weights, model.bias = logistic(x, y)
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[list[float], float]:
    """Ridge logistic regression by Newton steps; a hit of any kind never lowers a score, so no weight is negative."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        step = np.where(np.r_[w[:-1] < 0, False], 0, step)
        w[:-1] = np.maximum(w[:-1], 0)
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w[:-1]], float(w[-1])


def _features(docs: DataFrame, keep: list[str], model: Model) -> DataFrame:
    terms, key = model.terms, model.key

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        read = reader(key, terms)
        rows = [read.features(t.decode("utf-8", "replace")) for t in text_bytes(batch.column("text"))]
        return pa.RecordBatch.from_arrays([*kept(batch, keep), pa.array(rows, pa.list_(pa.float64()))], names=[*keep, "features"])

    types = dict(docs.dtypes)
    return map_texts(docs, keep, work, ", ".join([*[f"`{k}` {types[k]}" for k in keep], "features array<double>"]))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """doc_id (and other ``keep`` columns), held_out, score, predicted for every row, from the whole text alone.

    Null and empty texts have no hit and the score of a text without one. A null doc_id isn't held out. Repeated rows
    score alike; an empty table gives an empty result; columns that aren't kept are ignored.
    """
    keep = ["doc_id", *(k for k in keep or [] if k != "doc_id")]
    total: Column = F.lit(model.bias)
    for i, w in enumerate(model.weights):
        total = total + F.lit(w) * F.get("features", F.lit(i))
    return _features(docs, keep, model).select(*keep, held_out(F.col("doc_id")).alias("held_out"), (1 / (1 + F.exp(-total))).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
