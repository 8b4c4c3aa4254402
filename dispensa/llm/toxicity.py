"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is a row of words (lower-cased runs of letters and digits).  Each word's
input is the sum of its word vector (words the training rows hold often enough;
others share one) and the mean vector of its character n-grams, ends marked, so
unseen and disguised words are read by their characters.  Windows of ``WINDOW``
words, each overlapping the next by ``WINDOW - STRIDE``, cover the whole text
(the last one ends with it).  Two gated recurrent units read a window from both
sides, attention pools their states, a logistic unit scores it.  A document's
score comes from its highest windows (``document_inputs``), calibrated on whole
documents that were not learned from, each class weighing as among all labels.

Training (numpy, on the driver) takes a bounded sample: at most ``max_rows``
labelled texts of each class (``common.bounded_rows``) and at most
``max_windows`` windows of each, spread evenly over the whole text.  A label
belongs to a document, not to a window: each word and n-gram starts with the
log odds of its training documents being toxic, in standard errors
(``evidence``), as one component of its vector; a first network learns from the
windows of toxic documents that hold the strongest word, against all windows of
the others.  The windows of toxic documents that it finds toxic, and all windows
that it finds harmless, teach the final one.  Scoring takes all windows of all
documents.

The input projections of a word are computed once per distinct word of a batch;
n-gram means are remembered in a bounded table.  Labels, lang, source and doc_id
are never inputs.

Defined results: null text and text without a letter or digit score 0; without
rows of both classes every other text scores the toxic share of the labels (0.5
without labels); conflicting labels of one id give one training row each;
repeated rows score alike and train once; extra columns are ignored; empty
table: no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, bounded_rows, remainder, slices

NO_WORD = r"[^\pL\pN]+"
WINDOW, STRIDE = 24, 16
HIDDEN, INPUT = 8, 12
ORDERS = (3, 4, 5)
GRAMS, WORDS, LEAST = 32_768, 8_192, 3   # vocabulary sizes, least documents of an entry
CHUNK = 2048                             # windows that are scored at a time
MEMO = 200_000
RANKS = (0, 2, 4)                        # the windows of a text, from the highest, that make its score
DOUBT = 1.0                              # standard errors that count as chance
STEPS = 400                              # least steps of a network, however few its windows
THRESHOLD = 0.3  # fixed value of the contract
FOLDS, HELD = 4, 2  # fixed values of the contract: crc32(id) mod 4 = 2 is held out


# -- texts to windows -----------------------------------------------------------

def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of several texts in a row, and each text's bounds."""
    parts = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), NO_WORD)
    at = parts.offsets.to_numpy().astype(np.int64)
    flat = parts.values.slice(at[0], at[-1] - at[0])
    some = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    upto = np.concatenate([[0], np.cumsum(some)])
    return flat.filter(pa.array(some)), upto[at - at[0]]


def window_starts(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text of every window."""
    n = np.diff(bounds)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(k * STRIDE, np.maximum(n[doc] - WINDOW, 0))
    return bounds[doc] + start, np.minimum(n[doc], WINDOW), doc


def grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i:i + n] for n in ORDERS for i in range(len(w) - n + 1)]


# -- the network ------------------------------------------------------------------

def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class Network:
    """Weights of the network and its vocabularies (word 0: any other)."""
    words: dict[str, int]
    grams: dict[str, int]
    p: dict[str, np.ndarray]
    slope: np.ndarray = field(default_factory=lambda: np.eye(len(RANKS))[0])   # of a text's highest windows
    offset: float = 0.0
    base: float | None = None   # the score of every text, where nothing was learned
    memo: Memo = field(default_factory=lambda: Memo(MEMO), repr=False)

    def __getstate__(self):
        return {**self.__dict__, "memo": None}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.memo = Memo(MEMO)

    @classmethod
    def start(cls, words: dict[str, int], gram_numbers: dict[str, int], rng,
              odds: tuple[np.ndarray, np.ndarray] | None = None) -> Network:
        """Random weights; ``odds`` (of words and n-grams) fill the first two components."""
        draw = lambda *shape, by=0.1: (rng.standard_normal(shape) * by).astype(np.float32)
        p = {"word": draw(len(words) + 1, INPUT), "gram": draw(len(gram_numbers) + 1, INPUT)}
        if odds is not None:
            p["word"][:, 0], p["gram"][:, 1] = odds
        p["gram"][0] = 0
        for side in "fb":
            p["in_" + side], p["bias_" + side] = draw(INPUT, 3 * HIDDEN, by=0.4), np.zeros(3 * HIDDEN, np.float32)
            p["rec_" + side] = draw(HIDDEN, 3 * HIDDEN, by=0.3)
        p["att"], p["ask"] = draw(2 * HIDDEN, HIDDEN, by=0.4), draw(HIDDEN, by=0.4)
        p["out"], p["out_bias"] = draw(2 * HIDDEN, by=0.4), np.zeros(1, np.float32)
        return cls(words, gram_numbers, p)

    def numbers(self, word: str) -> list[int]:
        """Numbers of a word's known n-grams (0 alone if none is known)."""
        g = self.grams
        return [g[x] for x in grams(word) if x in g] or [0]

    def inputs(self, distinct: list[str]) -> np.ndarray:
        """The input vector of each distinct word."""
        memo, p = self.memo, self.p
        new = memo.missing(distinct)
        if new:
            found = [self.numbers(w) for w in new]
            size = np.array([len(f) for f in found])
            flat = np.array([i for f in found for i in f], dtype=np.int64)
            v = np.add.reduceat(p["gram"][flat], np.cumsum(size) - size, axis=0) / size[:, None]
            v = v.astype(np.float32) + p["word"][[self.words.get(w, 0) for w in new]]
            memo.update(zip(new, v))
        out = np.array([memo[w] for w in distinct], dtype=np.float32).reshape(-1, INPUT)
        memo.settle(w for w in new if len(w) > 40)
        return out

    def logits(self, x: np.ndarray, codes: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Scores of windows: ``codes`` (windows x WINDOW) are rows of ``x``;
        a window shorter than WINDOW ends after ``length`` words."""
        p = self.p
        sides = {s: x @ p["in_" + s] + p["bias_" + s] for s in "fb"}
        out = np.empty(len(codes), dtype=np.float32)
        for a in range(0, len(codes), CHUNK):
            c, n = codes[a:a + CHUNK].T, length[a:a + CHUNK]
            h = np.empty((WINDOW, c.shape[1], 2 * HIDDEN), dtype=np.float32)
            short = int(n.min()) < WINDOW
            for side, steps, place in (("f", range(WINDOW), slice(0, HIDDEN)), ("b", range(WINDOW - 1, -1, -1), slice(HIDDEN, None))):
                state = np.zeros((c.shape[1], HIDDEN), dtype=np.float32)
                for t in steps:
                    new = _step(sides[side][c[t]], state, p["rec_" + side])[0]
                    state = np.where((t < n)[:, None], new, state) if short else new
                    h[t, :, place] = state
            e = np.tanh(h @ p["att"]) @ p["ask"]
            if short:
                e[np.arange(WINDOW)[:, None] >= n] = -np.inf
            w = np.exp(e - e.max(axis=0))
            w /= w.sum(axis=0)
            out[a:a + CHUNK] = np.einsum("tn,tnh->nh", w, h) @ p["out"] + p["out_bias"]
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The score of each whole text."""
        flat, bounds = split_words(texts)
        out = np.zeros(len(texts))
        some = np.diff(bounds) > 0
        if self.base is not None:
            out[some] = self.base
            return out
        if not len(flat):
            return out
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        x = self.inputs(coded.dictionary.to_pylist())
        start, length, doc = window_starts(bounds)
        z = np.empty(len(start), dtype=np.float32)
        for a in range(0, len(start), 16 * CHUNK):
            s, n = start[a:a + 16 * CHUNK], length[a:a + 16 * CHUNK]
            at = np.minimum(s[:, None] + np.arange(WINDOW), len(codes) - 1)
            z[a:a + 16 * CHUNK] = self.logits(x, codes[at], n)
        top = document_inputs(z, doc, len(texts))
        out[some] = _sigmoid(top[some] @ self.slope + self.offset)
        return out


def _step(x: np.ndarray, state: np.ndarray, rec: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of a gated recurrent unit: the new state, the gates and the
    recurrent part of the proposal."""
    r = state @ rec
    gates = _sigmoid(x[:, :2 * HIDDEN] + r[:, :2 * HIDDEN])
    z, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
    new = np.tanh(x[:, 2 * HIDDEN:] + reset * r[:, 2 * HIDDEN:])
    return new + z * (state - new), z, reset, new, r[:, 2 * HIDDEN:]


# -- training -----------------------------------------------------------------------

class Words:
    """Distinct words of the training windows, with their n-gram numbers."""

    def __init__(self, net: Network, distinct: list[str]):
        found = [net.numbers(w) for w in distinct]
        self.size = np.array([len(f) for f in found], dtype=np.int64)
        self.flat = np.array([i for f in found for i in f], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.word = np.array([net.words.get(w, 0) for w in distinct], dtype=np.int64)

    def rows(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n-gram numbers of the words ``k`` in a row, and whose each is."""
        n = self.size[k]
        owner = np.repeat(np.arange(len(k)), n)
        return self.flat[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[k], n)], owner


def _scatter(rows: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` by row number."""
    out = np.empty((rows, values.shape[1]), dtype=np.float32)
    for j in range(values.shape[1]):
        out[:, j] = np.bincount(at, weights=values[:, j], minlength=rows)
    return out


def gradient(net: Network, words: Words, codes: np.ndarray, length: np.ndarray, y: np.ndarray,
             weight: np.ndarray, hide: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean weighted logistic loss of some windows and its gradient.  ``hide``
    marks distinct words (by number) that count as unknown words this time."""
    p, n = net.p, len(codes)
    k, inverse = np.unique(codes, return_inverse=True)
    c = inverse.reshape(codes.shape).T
    word = words.word[k] if hide is None else np.where(hide[k], 0, words.word[k])
    flat, owner = words.rows(k)
    size = words.size[k][:, None].astype(np.float32)
    x = p["word"][word] + _scatter(len(k), owner, p["gram"][flat]) / size
    live = (np.arange(WINDOW)[:, None] < length)[:, :, None].astype(np.float32)
    h = np.empty((WINDOW, n, 2 * HIDDEN), dtype=np.float32)
    kept = {}
    for side, steps, place in (("f", range(WINDOW), slice(0, HIDDEN)), ("b", range(WINDOW - 1, -1, -1), slice(HIDDEN, None))):
        proj = x @ p["in_" + side] + p["bias_" + side]
        state = np.zeros((n, HIDDEN), dtype=np.float32)
        for t in steps:
            new, *rest = _step(proj[c[t]], state, p["rec_" + side])
            kept[side, t] = (state, *rest)
            state = state + live[t] * (new - state)
            h[t, :, place] = state
    a = np.tanh(h @ p["att"])
    e = np.where(live[:, :, 0] > 0, a @ p["ask"], -np.inf)
    w = np.exp(e - e.max(axis=0))
    w /= w.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", w, h)
    logit = pooled @ p["out"] + p["out_bias"]
    loss = float((weight * (np.logaddexp(0, logit) - y * logit)).mean())

    g: dict[str, np.ndarray] = {}
    d_logit = (weight * (_sigmoid(logit) - y) / n).astype(np.float32)
    g["out"], g["out_bias"] = pooled.T @ d_logit, np.array([d_logit.sum()], np.float32)
    d_pooled = d_logit[:, None] * p["out"]
    d_w = np.einsum("tnh,nh->tn", h, d_pooled)
    d_e = w * (d_w - (w * d_w).sum(axis=0))
    g["ask"] = np.einsum("tn,tnk->k", d_e, a)
    d_a = d_e[:, :, None] * p["ask"] * (1 - a * a)
    g["att"] = np.einsum("tnh,tnk->hk", h, d_a)
    d_h = w[:, :, None] * d_pooled + d_a @ p["att"].T
    d_x = np.zeros((len(k), INPUT), dtype=np.float32)
    for side, steps, place in (("f", range(WINDOW - 1, -1, -1), slice(0, HIDDEN)), ("b", range(WINDOW), slice(HIDDEN, None))):
        rec = p["rec_" + side]
        d_proj = np.empty((WINDOW, n, 3 * HIDDEN), dtype=np.float32)
        d_rec = np.zeros_like(rec)
        d_state = np.zeros((n, HIDDEN), dtype=np.float32)
        for t in steps:
            state, z, reset, new, r = kept[side, t]
            d_state = d_state + d_h[t, :, place]
            d = d_state * live[t]
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (state - new) * z * (1 - z)
            d_reset = d_new * r * reset * (1 - reset)
            d_proj[t] = np.concatenate([d_z, d_reset, d_new], axis=1)
            d_r = np.concatenate([d_z, d_reset, d_new * reset], axis=1)
            d_rec += state.T @ d_r
            d_state = d_state - d + d * z + d_r @ rec.T
        g["rec_" + side] = d_rec
        by_word = _scatter(len(k), c.ravel(), d_proj.reshape(-1, 3 * HIDDEN))
        g["in_" + side], g["bias_" + side] = x.T @ by_word, by_word.sum(axis=0)
        d_x += by_word @ p["in_" + side].T
    g["word"] = _scatter(len(p["word"]), word, d_x)
    g["gram"] = _scatter(len(p["gram"]), flat, (d_x / size)[owner])
    g["gram"][0] = 0
    return loss, g


def vocabulary(docs: list[set[str]], keys_of, most: int, least: int) -> dict[str, int]:
    """Entries of at least ``least`` documents, the most frequent ``most``,
    numbered from 1."""
    n: Counter = Counter()
    for words in docs:
        n.update({k for w in words for k in keys_of(w)})
    found = sorted((k for k, c in n.items() if c >= least), key=lambda k: (-n[k], k))[:most]
    return {k: i + 1 for i, k in enumerate(found)}


def evidence(docs: list[set[str]], keys_of, numbers: dict[str, int], toxic: np.ndarray) -> np.ndarray:
    """Log odds of each entry's documents being toxic, in standard errors, the
    first ``DOUBT`` of them taken off; 0 for entry 0."""
    n = np.zeros((2, len(numbers) + 1))
    for words, y in zip(docs, toxic):
        found = {numbers[k] for w in words for k in keys_of(w) if k in numbers}
        n[int(y), list(found)] += 1
    total = np.array([[max(1, (toxic == 0).sum())], [max(1, (toxic == 1).sum())]])
    prior = total / total.sum()  # one document in all, dealt as the classes are
    z = (np.log((n + prior) / (total + 1))[1] - np.log((n + prior) / (total + 1))[0]) / np.sqrt((1 / (n + prior)).sum(axis=0))
    z = np.sign(z) * np.maximum(0, np.abs(z) - DOUBT)
    z[0] = 0
    return np.clip(z, -4, 4).astype(np.float32)


def train(windows: list[list[str]], doc: np.ndarray, toxic: np.ndarray, share: float | None = None, seed: int = 13,
          epochs: tuple[int, int] = (3, 3), batch: int = 256, rate: float = 0.01) -> Network:
    """Learn from windows (lists of words); ``doc`` is the text of each window,
    ``toxic`` the label of each text, ``share`` the toxic share of all labels
    (as in the sample, if not given)."""
    rng = np.random.default_rng(seed)
    # every fourth text of each class is kept back for the calibration, if they are enough
    place = np.zeros(len(toxic), dtype=np.int64)
    for x in (0, 1):
        k = rng.permutation(np.flatnonzero(toxic == x))
        place[k] = np.arange(len(k))
    enough = min((toxic == 0).sum(), (toxic == 1).sum()) >= 20
    back = (place % 4 == 3) & enough
    sets: list[set[str]] = [set() for _ in toxic]
    for w, d in zip(windows, doc):
        sets[d].update(w)
    least = LEAST if len(toxic) > 50 else 1
    known = (vocabulary(sets, lambda w: (w,), WORDS, least), vocabulary(sets, lambda w: set(grams(w)), GRAMS, least))
    learned = [(w, y) for w, y, b in zip(sets, toxic, back) if not b]
    marks = np.array([y for _, y in learned])
    odds = tuple(evidence([w for w, _ in learned], keys, numbers, marks)
                 for keys, numbers in ((lambda w: (w,), known[0]), (grams, known[1])))
    net = Network.start(*known, rng, odds)
    distinct = sorted(set().union(*sets))
    at = {w: i for i, w in enumerate(distinct)}
    words = Words(net, distinct)
    codes = np.zeros((len(windows), WINDOW), dtype=np.int64)
    length = np.array([len(w) for w in windows])
    for i, w in enumerate(windows):
        codes[i, :len(w)] = [at[x] for x in w]
    # the first examples: of a toxic text, the windows of its strongest word
    strong = np.array([max(odds[0][known[0].get(x, 0)] for x in w) for w in windows])
    most = np.full(len(toxic), -np.inf)
    np.maximum.at(most, doc, strong)
    y = toxic[doc].astype(np.float32)
    rows = np.flatnonzero(~back[doc] & ((y == 0) | (strong >= most[doc])))
    for phase, rounds in enumerate(epochs):
        if phase:
            # a toxic text's windows that look toxic are examples, the highest one always; those that look
            # harmless count so, the others are left out; and a new network learns from that
            z = net.logits(net.inputs(distinct), codes, length)
            top = np.full(len(toxic), -np.inf)
            np.maximum.at(top, doc, z)
            good = z >= np.minimum(top[doc], np.maximum(0.0, 0.5 * top[doc]))
            y = np.where((z < 0) & ~good, 0, y).astype(np.float32)
            rows = np.flatnonzero(~back[doc] & ((y == 0) | good))
            net = Network.start(*known, rng, odds)
        m = {k: np.zeros_like(x) for k, x in net.p.items()}
        v = {k: np.zeros_like(x) for k, x in net.p.items()}
        step = 0
        weight = np.ones(len(windows), dtype=np.float32)
        n_toxic = y[rows].sum()
        if n_toxic:  # both classes weigh alike, toxic windows at most 20 times as much
            weight[y > 0] = min(20.0, max(1.0, (len(rows) - n_toxic) / n_toxic))
        for _ in range(max(rounds, -(-STEPS // max(1, -(-len(rows) // batch))))):
            order = rng.permutation(rows)
            for s in range(0, len(order), batch):
                b = order[s:s + batch]
                hide = rng.random(len(distinct)) < 0.3
                _, g = gradient(net, words, codes[b], length[b], y[b], weight[b], hide)
                step += 1
                lr = rate * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
                for key, d in g.items():
                    m[key] += 0.1 * (d - m[key])
                    v[key] += 0.001 * (d * d - v[key])
                    net.p[key] -= (lr * m[key] / (np.sqrt(v[key]) + 1e-8)).astype(np.float32)
        net.memo = Memo(MEMO)
    # calibration: the highest windows of each text against its label
    top = document_inputs(net.logits(net.inputs(distinct), codes, length), doc, len(toxic))
    seen = (np.bincount(doc, minlength=len(toxic)) > 0) & (back if enough else True)
    net.slope, net.offset = calibrate(top[seen], toxic[seen], share)
    net.memo = Memo(MEMO)
    return net


def document_inputs(z: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per text the scores of its highest, third and fifth highest window (the
    lowest, where it has fewer): one word of a clean text may look toxic, and
    lies in two windows at most.  Texts without a window: zeros."""
    order = np.lexsort((-z, doc))
    count = np.bincount(doc, minlength=n)
    start = np.cumsum(count) - count
    out = np.zeros((n, len(RANKS)))
    some = np.flatnonzero(count)
    for j, r in enumerate(RANKS):
        out[some, j] = z[order[start[some] + np.minimum(r, count[some] - 1)]]
    return out


def calibrate(x: np.ndarray, y: np.ndarray, share: float | None = None, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic curve, by Newton steps on softened
    labels and a small penalty, so it stays finite where classes part.  The
    classes weigh as they do among all labels (``share`` of them toxic)."""
    n_pos, n_neg = (y == 1).sum(), (y == 0).sum()
    weight = np.ones(len(y))
    if share is not None and n_pos and n_neg:
        weight = np.where(y == 1, share / n_pos, (1 - share) / n_neg) * len(y)
    goal = np.where(y == 1, (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2))
    scale = max(float(np.abs(x).max(initial=0)), 1e-6)
    x = np.c_[x / scale, np.ones(len(x))]
    small = 1e-2 * np.eye(x.shape[1])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        s = _sigmoid(x @ w)
        step = np.linalg.solve((x * (weight * s * (1 - s))[:, None]).T @ x + small, x.T @ (weight * (s - goal)) + small @ w)
        w -= step * min(1.0, 4 / max(1e-9, float(np.abs(step).max())))
    return w[:-1] / scale, float(w[-1])


# -- Spark ------------------------------------------------------------------

def _windows(most: int):
    """(text number in the sample, label, its windows as lines of words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, n in slices(b.column(1)):
                flat, bounds = split_words(b.column(1).slice(s, n))
                start, length, doc = window_starts(bounds)
                lines = []
                for i in range(n):
                    mine = np.flatnonzero(doc == i)
                    if len(mine) > most:
                        mine = mine[np.linspace(0, len(mine) - 1, most).round().astype(np.int64)]
                    lines.append([" ".join(flat.slice(int(start[j]), int(length[j])).to_pylist()) for j in mine])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, n), pa.array(lines, pa.list_(pa.string()))],
                                                 names=["label", "windows"])
    return run


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 1_200, max_windows: int = 96, seed: int = 13) -> Network:
    """Learn from rows whose crc32(doc_id) mod 4 is not 2; ``max_rows`` bounds
    the texts of each class, ``max_windows`` the windows of a text."""
    marks = labels.filter(F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_label"))
    rows = docs.select("doc_id", "text").filter(F.coalesce(remainder(F.col("doc_id"), FOLDS) != HELD, F.lit(False)))
    ids = marks.join(rows.select("doc_id").distinct(), F.col("_id") == F.col("doc_id"), "left_semi")
    share = ids.agg(F.avg("_label")).first()[0]
    sample = bounded_rows(rows, marks, "_label", max_rows, seed)
    got = sample.select("_label", "text").mapInArrow(_windows(max_windows), "label int, windows array<string>").collect()
    got = sorted((r["label"], tuple(r["windows"])) for r in got)
    toxic = np.array([r[0] for r in got], dtype=np.int64)
    windows = [w.split(" ") for r in got for w in r[1]]
    doc = np.repeat(np.arange(len(got)), [len(r[1]) for r in got]).astype(np.int64)
    if len(set(toxic[doc].tolist())) < 2:
        empty = Network.start({}, {}, np.random.default_rng(seed))
        empty.base = 0.5 if share is None else float(share)
        return empty
    return train(windows, doc, toxic, share, seed)


def _score(model_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_b.value
        for b in batches:
            for start, length in slices(b.column(2), 2 << 20):
                s = model.scores(b.column(2).slice(start, length))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(start, length), b.column(1).slice(start, length), pa.array(s, pa.float64()),
                     pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
    return run


def score_documents(docs: DataFrame, model: Network) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    b = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_score(b), f"doc_id {kind}, held_out boolean, score double, predicted int")
