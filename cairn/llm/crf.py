"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, scoring and decoding."""

from __future__ import annotations

import io
from functools import lru_cache

import numpy as np
import pyarrow as pa

KINDS = ("email", "ip", "card", "phone")
#: O, then B and I of each kind.
TAGS = 1 + 2 * len(KINDS)
WINDOW = 64
STRIDE = 32
EMBED, HIDDEN = 10, 16
_SPECIAL = "@.-_+()%/: \n,\"'=#"
_N_CLASSES = 6 + len(_SPECIAL)


def _classes() -> np.ndarray:
    table = np.zeros(129, np.int64)  # 0: padding
    for c in range(129):
        s = chr(c)
        table[c] = 5 if c == 128 else 6 + _SPECIAL.index(s) if s in _SPECIAL else 1 if s.isdigit() else 2 if s.islower() else 3 if s.isupper() else 4
    return table


CLASS = _classes()


def char_classes(text: str) -> np.ndarray:
    """One small integer a code point; all beyond ASCII share one."""
    return CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(x: np.ndarray, p: dict, d: str, keep: bool) -> tuple[np.ndarray, list]:
    """x: (T, B, 4H) inputs to the gates. Hidden states (T, B, H) and, to learn, what each step needs again."""
    t, b, _ = x.shape
    h, c, w, out, steps = np.zeros((b, HIDDEN)), np.zeros((b, HIDDEN)), p["Wh" + d], np.empty((t, b, HIDDEN)), []
    for k in range(t):
        z = x[k] + h @ w
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        if keep:
            steps.append((h, before, i, f, o, g, tc))
        h = o * tc
        out[k] = h
    return out, steps


def _lstm_back(dout: np.ndarray, steps: list, p: dict, d: str) -> tuple[np.ndarray, np.ndarray]:
    t, b, _ = dout.shape
    dh, dc, dw, dx = np.zeros((b, HIDDEN)), np.zeros((b, HIDDEN)), np.zeros_like(p["Wh" + d]), np.empty((t, b, 4 * HIDDEN))
    for k in range(t - 1, -1, -1):
        h, before, i, f, o, g, tc = steps[k]
        dh = dh + dout[k]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        dw += h.T @ dz
        dx[k] = dz
        dh, dc = dz @ p["Wh" + d].T, dc * f
    return dx, dw


def emissions(ids: np.ndarray, p: dict) -> np.ndarray:
    """Tag scores (B, T, TAGS) of windows of classes (B, T)."""
    x = ids.T
    forward, _ = _lstm((p["E"] @ p["Wxf"] + p["bf"])[x], p, "f", False)
    backward, _ = _lstm((p["E"] @ p["Wxb"] + p["bb"])[x[::-1]], p, "b", False)
    return (np.concatenate([forward, backward[::-1]], 2) @ p["Wo"] + p["bo"]).transpose(1, 0, 2)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis)) + np.squeeze(m, axis)


def _crf_gradients(e: np.ndarray, y: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of tags y (T, B) and its gradients, by forward-backward."""
    t, b, k = e.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for i in range(1, t):
        alpha[i] = e[i] + _logsum(alpha[i - 1][:, :, None] + trans, 1)
    for i in range(t - 2, -1, -1):
        beta[i] = _logsum(trans + (e[i + 1] + beta[i + 1])[:, None, :], 2)
    z = _logsum(alpha[-1], 1)
    de = np.exp(alpha + beta - z[None, :, None])
    pair = np.exp(alpha[:-1][:, :, :, None] + trans + (e[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None]).sum((0, 1))
    rows, cols = np.arange(t)[:, None], np.arange(b)[None, :]
    loss = z.sum() - e[rows, cols, y].sum() - trans[y[:-1], y[1:]].sum()
    de[rows, cols, y] -= 1
    np.subtract.at(pair, (y[:-1].ravel(), y[1:].ravel()), 1)
    return loss / b, de / b, pair / b


def train(ids: np.ndarray, tags: np.ndarray, steps: int = 220, batch: int = 64, rate: float = 0.025, seed: int = 7) -> dict[str, np.ndarray]:
    """Fit on windows of classes and tags, both (N, WINDOW), by Adam; the same input gives the same model."""
    rng = np.random.default_rng(seed)
    init = lambda *shape: rng.normal(0, 0.25, shape)
    p = {"E": init(_N_CLASSES, EMBED), "Wo": init(2 * HIDDEN, TAGS), "bo": np.zeros(TAGS), "T": np.zeros((TAGS, TAGS))}
    for d in "fb":
        p |= {"Wx" + d: init(EMBED, 4 * HIDDEN), "Wh" + d: init(HIDDEN, 4 * HIDDEN), "b" + d: np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        at = rng.integers(0, len(ids), batch)
        x, y = ids[at].T, tags[at].T
        emb = {"f": p["E"][x], "b": p["E"][x[::-1]]}
        out, kept = {}, {}
        for d in "fb":
            out[d], kept[d] = _lstm(emb[d] @ p["Wx" + d] + p["b" + d], p, d, True)
        hidden = np.concatenate([out["f"], out["b"][::-1]], 2)
        _, de, dt = _crf_gradients(hidden @ p["Wo"] + p["bo"], y, p["T"])
        g = {"Wo": hidden.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS), "bo": de.sum((0, 1)), "T": dt, "E": np.zeros_like(p["E"])}
        dh = de @ p["Wo"].T
        for d, part in (("f", dh[:, :, :HIDDEN]), ("b", dh[::-1, :, HIDDEN:])):
            dx, g["Wh" + d] = _lstm_back(part, kept[d], p, d)
            flat = dx.reshape(-1, 4 * HIDDEN)
            g["Wx" + d], g["b" + d] = emb[d].reshape(-1, EMBED).T @ flat, flat.sum(0)
            np.add.at(g["E"], (x if d == "f" else x[::-1]).ravel(), flat @ p["Wx" + d].T)
        norm = np.sqrt(sum((v * v).sum() for v in g.values()))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, v in g.items():
            v = v * min(1.0, 5.0 / (norm + 1e-12))
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.999 * second[k] + 0.001 * v * v
            p[k] = p[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return p


def viterbi(e: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags (B, T) of padded scores (B, T, TAGS)."""
    b, t, _ = e.shape
    score, back = e[:, 0].copy(), np.zeros((b, t, TAGS), np.int8)
    for k in range(1, t):
        step = score[:, :, None] + trans
        best = step.argmax(1)
        after = np.take_along_axis(step, best[:, None, :], 1)[:, 0] + e[:, k]
        live = (k < lengths)[:, None]
        back[:, k] = np.where(live, best, np.arange(TAGS))
        score = np.where(live, after, score)
    tags = np.zeros((b, t), np.int8)
    tags[:, -1] = score.argmax(1)
    for k in range(t - 1, 0, -1):
        tags[:, k - 1] = back[np.arange(b), k, tags[:, k]]
    return tags


def certainty(e: np.ndarray, lengths: np.ndarray, trans: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Posterior probability (B, T) of each place's tag of ``tags`` under the CRF, by forward-backward; padding has any."""
    b, t, _ = e.shape
    alpha = np.empty(e.shape, np.float32)
    alpha[:, 0] = e[:, 0]
    for k in range(1, t):
        alpha[:, k] = e[:, k] + _logsum(alpha[:, k - 1, :, None] + trans, 1)
    z = _logsum(alpha[np.arange(b), lengths - 1], 1)
    out, beta = np.empty((b, t)), np.zeros((b, TAGS))
    for k in range(t - 1, -1, -1):
        at = tags[:, k].astype(np.int64)
        out[:, k] = np.exp(np.minimum(0, alpha[np.arange(b), k, at] + beta[np.arange(b), at] - z))
        if k:
            beta = np.where((k < lengths)[:, None], _logsum(trans + (e[:, k] + beta)[:, None, :], 2), 0)
    return out


def decode(segments: list[np.ndarray], p: dict) -> list[list[tuple[int, int, int, float]]]:
    """For each segment of classes: (kind number, start, end, confidence) of its spans.

    Overlapping windows are scored apart. Each place's scores are then averaged, a window's middle counting most, and
    one CRF path is decoded over the whole segment, so that windows can't disagree. A span's confidence is the mean
    posterior probability of its tags.
    """
    windows, owner = [], []
    for s, ids in enumerate(segments):
        for start in range(0, max(1, len(ids) - WINDOW + STRIDE), STRIDE):
            part = ids[start : start + WINDOW]
            windows.append(np.pad(part, (0, WINDOW - len(part))))
            owner.append((s, start))
    sums = [np.zeros((len(ids), TAGS)) for ids in segments]
    weights = [np.zeros(len(ids)) for ids in segments]
    tent = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(float)
    for k in range(0, len(windows), 1024):
        scores = emissions(np.stack(windows[k : k + 1024]), p)
        for (s, start), e in zip(owner[k : k + 1024], scores, strict=True):
            n = min(WINDOW, len(segments[s]) - start)
            sums[s][start : start + n] += e[:n] * tent[:n, None]
            weights[s][start : start + n] += tent[:n]
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in segments]
    order = sorted(range(len(segments)), key=lambda s: len(segments[s]))
    k = 0
    while k < len(order):  # segments of like length together, 100,000 places at most unless one alone is longer
        size = next((j for j in range(1, min(512, len(order) - k)) if len(segments[order[k + j]]) * (j + 1) > 100_000), min(512, len(order) - k))
        group = order[k : k + size]
        k += size
        lengths = np.array([len(segments[s]) for s in group])
        if not lengths[-1]:
            continue
        e = np.zeros((len(group), lengths[-1], TAGS))
        for row, s in enumerate(group):
            e[row, : lengths[row]] = sums[s] / weights[s][:, None]
        tags = viterbi(e, lengths, p["T"])
        prob = certainty(e, lengths, p["T"], tags)
        for row in np.flatnonzero(((tags > 0) & (np.arange(lengths[-1]) < lengths[:, None])).any(1)):
            t = tags[row, : lengths[row]]
            start = None
            for i in range(len(t) + 1):
                kind = (t[start] - 1) // 2 if start is not None else -1
                if start is not None and (i == len(t) or t[i] != 2 * kind + 2):
                    out[group[row]].append((int(kind), start, i, float(prob[row, start:i].mean())))
                    start = None
                if i < len(t) and start is None and t[i] > 0:
                    start = i
    return out


def _example(rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A window's text and its spans (kind number, start, end): invented words in prose, lists, tables and marked-up text,
    at most one span, or a look-alike."""
    pick = lambda *x: x[rng.integers(len(x))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    hexed = lambda n: "".join(pick(*"0123456789abcdef") for _ in range(n))
    syllables = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "é", "è", "ung", "sch", "ä", "ción", "ñ", "que", "eau")
    marks, bar = rng.random() < 0.3, rng.random() < 0.2

    def word() -> str:
        w = "".join(pick(*syllables) for _ in range(rng.integers(1, 5)))
        if rng.random() < 0.12:
            w = w.capitalize()
        if marks and rng.random() < 0.5:
            w += pick("%", "*", "#", "$", "&", "<", ">", "~") * int(rng.integers(1, 4))
        return w + pick(".", ",", "\n", ":") if rng.random() < 0.1 else w

    words = lambda n: (" | " if bar else " ").join(word() for _ in range(n))
    name = lambda: pick("".join(pick(*"abcdefghiklmnoprstu") for _ in range(rng.integers(2, 10))), "".join(pick("th", "er", "on", "an", "re", "he", "in", "sch", "ung", "que", "ti") for _ in range(rng.integers(1, 4))))
    kind = int(rng.integers(-4, len(KINDS)))
    if kind == 0:
        local = name() + pick("", "." + digits(2), "_" + name(), "." + name(), "+" + name(), digits(2))
        middle = pick("@", "@", " @ ", " (at) ", "[at]", " [at] ")
        span = local + middle + pick("mail", "post", "web") + pick("", digits(1)) + "." + pick("example", name()) + "." + pick("com", "org", "net", "de", "fr")
    elif kind == 1:
        dot = pick(".", ".", " . ", "[.]")
        span = dot.join(str(v) for v in rng.integers(1, 256, 4))
    elif kind == 2:
        d = digits(int(rng.integers(14, 17)))
        span = pick(d, *(gap.join(d[k : k + 4] for k in range(0, len(d), 4)) for gap in " -./"))
    elif kind == 3:
        span = pick("+", "+", "00", "00") + digits(int(rng.integers(1, 3))) + pick(" ", " (", "-") + digits(3) + pick(") ", " ", "-") + digits(3) + pick("-", " ", "") + digits(4)
        if rng.random() < 0.25:
            span = "(" + digits(3) + ") " + digits(3) + "-" + digits(4)
    elif kind == -1:
        span = pick("", "Version 2.0.", "version 3.", "BY-NC 4.0.", f"password={hexed(14)}", "AKIA" + "".join(pick(*"ABCDEFGHJKQRSTXYZ234567") for _ in range(16)), str(rng.integers(1900, 2030)), digits(int(rng.integers(1, 6))), f"{digits(2)}.{digits(2)} EUR", f"{rng.integers(1990, 2030)}-{digits(2)}-{digits(2)}", f"@{name()}", f"v{digits(1)}.{digits(1)}.{digits(2)}")
    elif kind == -2:
        span = pick('token = "', "id=", "sha256:", "") + hexed(int(rng.integers(16, 40))) + pick('"', "", ";")
    else:
        span = ""
    before = words(8)[-int(rng.integers(1, 40)) :] + (" | " if bar else pick(" ", " ", "\n", ". ", ", ", ": ", ' "', " (", "**", "<"))
    ending = (pick("%", "*", "#", "$", "&") * int(rng.integers(1, 4)) + " ") if marks else " | " if bar else pick(" ", " ", ".", ",", "\n", ". ", '"', ")", ">")
    text = before + span + ending + words(12)
    shift = int(rng.integers(0, 12)) if rng.random() < 0.15 else 0
    text = text[shift:][:WINDOW]
    start, end = len(before) - shift, min(WINDOW, len(before) - shift + len(span))
    return text, [(kind, max(0, start), end)] if kind >= 0 and end > max(0, start) else []


def training_windows(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` labelled windows as classes and tags."""
    rng = np.random.default_rng(seed)
    ids, tags = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    for k in range(n):
        text, spans = _example(rng)
        ids[k, : len(text)] = char_classes(text)
        for kind, start, end in spans:
            tags[k, start:end] = 2 * kind + 2
            tags[k, start] = 2 * kind + 1
    return ids, tags


@lru_cache(maxsize=1)
def trained(n: int = 5000, seed: int = 7) -> dict[str, np.ndarray]:
    """The tagger, trained once in a process on ``n`` labelled windows."""
    return train(*training_windows(n, seed), seed=seed)


_FITTED: dict[tuple[int, int], dict[str, np.ndarray]] = {}


def fit(spark, n: int = 5000, seed: int = 7) -> dict[str, np.ndarray]:
    """The tagger trained in one task (a worker's numpy has one thread, which suits its small matrices); kept for the process."""

    def run(batches):
        for _ in batches:
            out = io.BytesIO()
            np.savez(out, **trained(n, seed))
            yield pa.RecordBatch.from_pydict({"model": [out.getvalue()]})

    if (n, seed) not in _FITTED:
        row = spark.range(0, 1, 1, 1).mapInArrow(run, "model binary").first()
        with np.load(io.BytesIO(row["model"])) as found:
            _FITTED[(n, seed)] = {k: found[k] for k in found.files}
    return _FITTED[(n, seed)]
