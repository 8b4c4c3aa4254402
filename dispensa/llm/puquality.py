"""Quality classifier by positive-unlabelled learning.

Trusted positives (quality 1) and unlabelled web text (trainable documents
without a quality label; all trainable ones if every document has a label) are
drawn as bounded samples (documented parameter ``max_rows`` for each).  Rows
labelled 0 are not used.  The share of positives in the unlabelled text is
estimated first: a plain positive-against-unlabelled classifier ranks held-back
rows of both, and the prior is the smallest ratio of the unlabelled to the
positive share above a threshold (best-bin estimate, with a margin for few
rows).  Then a linear model minimises the non-negative unbiased risk
``p * R(P, +1) + max(0, R(U, -1) - p * R(P, -1))`` with the logistic loss, so
its output is a probability; where the second term falls below zero the step
goes the other way.

Inputs are statistics of the whole text (shares of each byte value, words,
lines, repetition); labels, lang, source and doc_id are never among them.

Defined results: empty and null texts get a score like any other (all shares
zero); without positives or unlabelled rows the score is 0.5 throughout;
an id with conflicting labels is a positive; repeated rows are scored alike and
count once (``max_rows`` bounds rows, whatever ids repeat); extra columns are ignored; empty table: no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, held_out, trainable

STATS = 12
WIDTH = 256 + STATS
THRESHOLD = 0.3  # fixed value of the contract


def features(text: str | None) -> np.ndarray:
    """Statistics of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(WIDTH, dtype=np.float32)
    if not raw:
        return out
    hist = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    out[:256] = np.sqrt(hist / len(raw))
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    top = max(Counter(words).values(), default=0)
    upper = hist[65:91].sum()
    lower = hist[97:123].sum()
    out[256:] = (
        np.log1p(len(raw)) / 10, np.log1p(n) / 10, n and (len(raw) - hist[[32, *range(9, 14)]].sum()) / n / 20,
        n and len(set(words)) / n, n and top / n, n > 1 and sum(map(eq, words, words[1:])) / (n - 1),
        len(lines) and 1 - len(set(lines)) / len(lines), upper / max(1, upper + lower),
        hist[48:58].sum() / len(raw), (hist[33:48].sum() + hist[58:65].sum() + hist[91:97].sum() + hist[123:127].sum()) / len(raw),
        hist[128:].sum() / len(raw), n < 10)
    return out


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([features(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())],
            names=["positive", "x"])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = standard(x, self.mean, self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -6, 6)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _adam(x_p: np.ndarray, x_u: np.ndarray, gradient, steps: int, rate: float, decay: float) -> np.ndarray:
    w = np.zeros(x_p.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = gradient(x_p @ w, x_u @ w) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def estimate_prior(p: np.ndarray, u: np.ndarray, steps: int = 250) -> float:
    """Share of positives in ``u``: train positive against unlabelled on the
    even rows, rank the odd rows, take the best bin from the top."""
    one = lambda x: np.c_[x, np.ones(len(x))]
    xp, xu = one(p[::2]), one(u[::2])

    def gradient(zp, zu):
        return (xp.T @ (_sigmoid(zp) - 1)) / len(xp) + (xu.T @ _sigmoid(zu)) / len(xu)
    w = _adam(xp, xu, gradient, steps, 0.02, 1e-3)
    sp, su = np.sort(one(p[1::2]) @ w), np.sort(one(u[1::2]) @ w)
    if not len(sp) or not len(su):
        return 0.5
    at = np.unique(sp)
    share_p = 1 - np.searchsorted(sp, at, side="left") / len(sp)
    share_u = 1 - np.searchsorted(su, at, side="left") / len(su)
    margin = np.sqrt(np.log(20) / 2 / len(su)) + np.sqrt(np.log(20) / 2 / len(sp))
    usable = share_p >= 0.1
    ratio = (share_u + margin) / np.maximum(share_p, 1e-9)
    best = at[usable][np.argmin(ratio[usable])]
    p_c, u_c = (sp >= best).mean(), (su >= best).mean()
    return float(np.clip(u_c / p_c, 0.05, 0.98))


def fit_arrays(p: np.ndarray, u: np.ndarray, steps: int = 500, rate: float = 0.02, decay: float = 1e-3) -> Model:
    """Minimise the non-negative unbiased risk on positives p, unlabelled u."""
    both = np.concatenate([p, u])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    if not len(p) or not len(u):
        return Model(mean, scale, np.zeros(WIDTH), 0.0, 0.5)
    sp, su = standard(p, mean, scale).astype(np.float64), standard(u, mean, scale).astype(np.float64)
    prior = estimate_prior(sp, su)
    xp, xu = np.c_[sp, np.ones(len(sp))], np.c_[su, np.ones(len(su))]

    def gradient(zp, zu):
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_minus = xu.T @ _sigmoid(zu) / len(xu) - prior * (xp.T @ _sigmoid(zp)) / len(xp)
        if negative < 0:
            return -g_minus
        return prior * (xp.T @ (_sigmoid(zp) - 1)) / len(xp) + g_minus
    w = _adam(xp, xu, gradient, steps, rate, decay)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6_000, seed: int = 5) -> Model:
    """Learn from trainable rows; ``max_rows`` bounds the rows of each of the two samples."""
    marks = labels.filter(F.col("quality").isNotNull()).select(F.col("doc_id").alias("_id"), "quality")
    rows = docs.select("doc_id", "text").filter(trainable(F.col("doc_id")))
    ids = rows.select("doc_id").distinct()
    marked = ids.join(marks, F.col("doc_id") == F.col("_id"), "left") \
        .groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("positive"), F.count("quality").alias("n"))
    every = marked.filter("n = 0").isEmpty()
    kind = F.when(F.col("n") == 0, F.array(F.lit(False)))
    kind = kind.when(F.col("positive"), F.array(F.lit(True), F.lit(False)) if every else F.array(F.lit(True)))
    if every:
        kind = kind.otherwise(F.array(F.lit(False)))
    chosen = marked.select(F.col("doc_id").alias("_id"), F.explode(kind).alias("positive"))
    sample = bounded_rows(rows, chosen, "positive", max_rows, seed).select("positive", "text")
    vectors = sample.mapInArrow(_feature_batches, "positive boolean, x binary").collect()
    rows_of = lambda flag: np.array([np.frombuffer(r["x"], dtype=np.float32) for r in sorted(
        (r for r in vectors if r["positive"] == flag), key=lambda r: bytes(r["x"]))], dtype=np.float32).reshape(-1, WIDTH)
    rng = np.random.default_rng(seed)  # sorted, then shuffled: the order of arrival has no part
    p, u = rng.permutation(rows_of(True)), rng.permutation(rows_of(False))
    if not len(p) or not len(u):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, 0.5)
    return fit_arrays(p, u)


def _score(model_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            s = model_b.value.score(np.array([features(t) for t in texts]).reshape(-1, WIDTH))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])
    return run


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    b = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_score(b), f"doc_id {kind}, held_out boolean, score double, predicted int")
