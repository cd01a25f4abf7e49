"""Quality rules as weak supervision: rules vote or abstain, EM weighs them (DataFrame operations only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import materialize

#: Votes: 1 good, -1 bad, 0 abstains. At most 3 ** len(RULES) distinct rows of votes reach the driver.
RULES = ("length", "word_length", "symbols", "symbol_share", "repeats", "duplicate_lines", "digits", "capitals")
PRIOR_GOOD = 0.75
ROUNDS = 50


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_digits, n_capitals.

    A null text has no words. Repeated 5-word windows are found in the row by sorting the windows' 64-bit hashes with
    their places, so time and memory are those of one text's words; no text is cut.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    removed = lambda chars: (F.length("marks") - F.length(F.translate("marks", chars, ""))).cast("long")
    base = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_replace("text", r"[^#*$%&|<>0-9A-Z]+", "").alias("marks"),
    )
    n = F.size("words")
    base = base.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        removed("#*$%&|<>").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        removed("0123456789").alias("n_digits"),
        removed("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        F.when(n >= 5, F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(F.slice("words", i, 5)))).alias("hashes"),
    )
    # (hash of the window, its place), sorted, equal windows neighbours; only for texts with a repeated window
    placed = F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    base = base.withColumn("windows", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), placed)).drop("hashes")
    m = F.size("windows")
    at = lambda k: F.get("windows", k)["h"]
    twice = F.filter(F.sequence(F.lit(0), m - 1), lambda k: at(k).eqNullSafe(at(k - 1)) | at(k).eqNullSafe(at(k + 1)))
    base = base.withColumn("places", F.array_sort(F.transform(F.when(m > 0, twice), lambda k: F.get("windows", k)["i"]))).drop("windows")
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("sum"), F.lit(-9).alias("last")),
        lambda a, i: F.struct((a["sum"] + F.least(F.lit(5), i - a["last"])).alias("sum"), i.alias("last")),
        lambda a: a["sum"].cast("long"),
    )
    return base.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("places")


def votes(c: dict[str, Column]) -> list[Column]:
    """One vote per name in RULES; shares near the borders abstain, and so does a rule with little to go by."""
    vote = lambda good, bad: F.when(bad, -1).when(good, 1).otherwise(0).cast("int")
    words = F.greatest(c["n_words"], F.lit(1))
    chars = F.greatest(c["word_chars"], F.lit(1))
    mean = c["word_chars"] / words
    return [
        vote(c["n_words"] >= 10, c["n_words"] < 10),
        vote((mean >= 3) & (mean <= 12), (mean < 2) | (mean > 20)),
        vote(c["n_symbols"] < 0.05 * words, c["n_symbols"] > 0.2 * words),
        vote(c["n_symbols"] < 0.01 * chars, c["n_symbols"] > 0.05 * chars),
        vote(c["n_repeat_words"] < 0.1 * words, c["n_repeat_words"] > 0.2 * words),
        F.when(c["n_lines"] < 4, 0).otherwise(vote(c["n_dup_lines"] < 0.1 * c["n_lines"], c["n_dup_lines"] > 0.3 * c["n_lines"])).cast("int"),
        vote(c["n_digits"] < 0.25 * chars, c["n_digits"] > 0.5 * chars),
        vote(c["n_capitals"] < 0.2 * chars, c["n_capitals"] > 0.5 * chars),
    ]


#: What is believed of any rule before the data: how a good and a bad document are voted on (bad, abstain, good).
BELIEF = ((0.005, 0.2, 0.795), (0.25, 0.2, 0.55))
#: Documents that the belief counts as, as a share of all.
BELIEF_SHARE = 0.05


def fit_accuracies(counts: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS, prior: float = PRIOR_GOOD) -> tuple[float, list[tuple[tuple[float, ...], tuple[float, ...]]]]:
    """Expectation-maximisation over counted vote rows: the share of good documents, and for each rule the
    probabilities of its votes (bad, abstain, good) on good and on bad documents.

    ``counts`` holds each distinct row of votes once, so the work doesn't depend on the number of documents. BELIEF
    keeps a rule that hardly votes near its start and the classes from changing places.
    """
    n = len(counts[0][0]) if counts else len(RULES)
    size = sum(k for _, k in counts)
    weight = BELIEF_SHARE * size + 10
    rates, good = [BELIEF] * n, prior
    for _ in range(rounds):
        seen = [[[weight * b for b in BELIEF[c]] for c in (0, 1)] for _ in range(n)]
        total_good = weight * prior
        for row, k in counts:
            p = 1 / (1 + math.exp(-max(-60.0, min(60.0, log_odds(row, good, rates)))))
            total_good += k * p
            for r, v in enumerate(row):
                seen[r][0][v + 1] += k * p
                seen[r][1][v + 1] += k * (1 - p)
        good = min(0.99, total_good / (size + weight))
        rates = [tuple(tuple(x / sum(of) for x in of) for of in rule) for rule in seen]
    return good, rates


def log_odds(row: tuple[int, ...], good: float, rates: list) -> float:
    return math.log(good / (1 - good)) + sum(math.log(on_good[v + 1] / on_bad[v + 1]) for v, (on_good, on_bad) in zip(row, rates, strict=True))


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and p_good (the posterior probability of good quality).

    Every document has one row. Null and empty texts have no words, fail the base rule and aren't kept. Repeated rows
    are judged each by itself; an empty table gives an empty result; other columns of ``docs`` are ignored. The counts
    are written once to the shared folder; only counts of distinct vote rows (3 ** 8 at most) come to the driver.
    """
    counted = text_counts(docs)
    table = materialize(counted.select("*", *[v.alias(f"vote_{r}") for r, v in zip(RULES, votes({c: F.col(c) for c in counted.columns}), strict=True)]), "quality")
    cols = [f"vote_{r}" for r in RULES]
    seen = [(tuple(r[c] for c in cols), r["count"]) for r in table.groupBy(*cols).count().collect()]
    good, rates = fit_accuracies(sorted(seen))
    score: Column = F.lit(math.log(good / (1 - good)))
    for c, (on_good, on_bad) in zip(cols, rates, strict=True):
        gain = [math.log(g / b) for g, b in zip(on_good, on_bad, strict=True)]
        score = score + F.when(F.col(c) < 0, gain[0]).when(F.col(c) > 0, gain[2]).otherwise(gain[1])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    p_good = 1 / (1 + F.exp(-score))
    return table.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (p_good >= threshold)).alias("kept"), p_good.alias("p_good"),
    )
