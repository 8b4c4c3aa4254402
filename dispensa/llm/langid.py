"""Language identification by word-first backoff.

A word that the training texts hold is scored by its log frequency in each
language.  An unseen word falls back to its character n-grams (with word
boundaries): the mean log frequency of its known 5-grams, or if none is known
its 4-grams, and so on down to single characters.  A text's language has the
largest sum over all its words; the score is its share of the softmax.

The counts come from a bounded sample of trainable rows (documented parameter
``max_rows``; a seeded hash of the id picks them) and are summed by Spark; the
model keeps the ``max_words`` most frequent words and, for each n,
``max_grams`` n-grams, so its size is bounded whatever the corpus.  Only the
text is read to predict; lang is read to learn, source and doc_id are not.

Defined results: null text or text without a letter is ``und`` with score 0;
without training rows everything is ``und``; a text of which no word gives any
evidence gets the most frequent training language, with its share as score;
ties go to the first language by code point.  Repeated rows are scored alike;
extra columns are ignored; empty table: no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispensa.plans.lineage import materialize

from .common import bounded_sample, held_out, slices, trainable

NO_WORD = r"[^\pL]+"
ORDERS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
SMOOTH = 0.5
MEMO = 150_000


def split_words(texts: pa.Array) -> pa.ListArray:
    """Lower-cased runs of letters of each text, with empty words where a text
    starts or ends with another character."""
    return pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), NO_WORD)


def grams(word: str, n: int) -> list[str]:
    if n == 1:
        return list(word)
    w = f"^{word}$"
    return [w[i:i + n] for i in range(len(w) - n + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n, key, count): words as n = 0, n-grams weighted by word count.
    Sums are handed on before they outgrow a task's memory."""
    by: dict[str, Counter] = {}

    def flush():
        rows: Counter = Counter()
        for lang, counts in by.items():
            for w, c in counts.items():
                rows[lang, 0, w] += c
                for n in ORDERS:
                    for g in grams(w, n):
                        rows[lang, n, g] += c
        by.clear()
        keys = list(rows)
        return pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
            pa.array([k[2] for k in keys], pa.string()), pa.array(list(rows.values()), pa.int64())],
            names=["lang", "n", "key", "count"])

    for b in batches:
        for start, length in slices(b.column(1)):
            langs = b.column(0).slice(start, length).to_pylist()
            for lang, found in zip(langs, split_words(b.column(1).slice(start, length))):
                by.setdefault(lang, Counter()).update(w for w in found.as_py() if w)
                if sum(map(len, by.values())) > 40_000:
                    yield flush()
    if by:
        yield flush()


class Model:
    """Log frequencies per language, ready to score."""

    def __init__(self, langs: list[str], shares: list[float], rows: list[tuple]):
        """``rows``: (n, key, [(lang, count), ...])."""
        self.langs, self.shares = langs, np.array(shares)
        at = {x: i for i, x in enumerate(langs)}
        self.places: dict[int, dict[str, int]] = {n: {} for n in (0, *ORDERS)}
        self.rows = np.zeros((len(rows), len(langs)))
        for i, (n, key, counts) in enumerate(rows):
            self.places[n][key] = i
            for lang, count in counts:
                self.rows[i, at[lang]] += count
        for places in self.places.values():
            if places:
                k = np.array(list(places.values()))
                c = self.rows[k]
                self.rows[k] = np.log((c + SMOOTH) / (c.sum(axis=0) + SMOOTH * len(k)))
        self.memo: dict[str, np.ndarray] = {}

    def backoff(self, word: str) -> list[int]:
        """Rows of the longest n-grams of an unseen word that are known."""
        for n in ORDERS:
            place = self.places[n]
            found = [place[g] for g in grams(word, n) if g in place]
            if found:
                return found
        return []

    def evidence(self, words: list[str]) -> np.ndarray:
        """Log frequency per language of each word; nan: no evidence."""
        known, memo = self.places[0], self.memo
        if len(memo) > MEMO:
            memo.clear()
        new = [w for w in words if w and w not in known and w not in memo]
        if new:
            found = [self.backoff(w) for w in new]
            sizes = np.array([len(f) for f in found])
            flat = np.array([i for f in found for i in f], dtype=np.int64)
            means = np.full((len(new), len(self.langs)), np.nan)
            some = np.flatnonzero(sizes)
            if len(some):
                ends = np.cumsum(sizes[some])
                means[some] = np.add.reduceat(self.rows[flat], ends - sizes[some], axis=0) / sizes[some][:, None]
            memo.update(zip(new, means))
        out = np.full((len(words), len(self.langs)), np.nan)
        place = np.array([known.get(w, -1) for w in words], dtype=np.int64)
        out[place >= 0] = self.rows[place[place >= 0]]
        for i in np.flatnonzero(place < 0):
            if words[i]:
                out[i] = memo[words[i]]
        return out

    def predict(self, texts: pa.Array) -> list[tuple[str, float]]:
        """(language, score) of each whole text."""
        parts = split_words(texts)
        bounds = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds - bounds[0]
        distinct = coded.dictionary.to_pylist()
        lettered = np.array([bool(w) for w in distinct], dtype=bool)
        codes = coded.indices.to_numpy()
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        table = self.evidence(distinct)
        usable = ~np.isnan(table[:, 0])
        table = np.where(usable[:, None], table, 0.0)
        out = []
        for s, e in zip(bounds[:-1], bounds[1:]):
            c = codes[s:e]
            if not lettered[c].any():
                out.append((UNKNOWN, 0.0))
            elif not usable[c].any():
                best = int(self.shares.argmax())
                out.append((self.langs[best], float(self.shares[best])))
            else:
                total = table[c].sum(axis=0)
                share = np.exp(total - total.max())
                best = int(total.argmax())
                out.append((self.langs[best], float(share[best] / share.sum())))
        return out


def fit(docs: DataFrame, max_rows: int = 12_000, max_words: int = 40_000, max_grams: int = 12_000,
        seed: int = 3) -> Model:
    """Learn from trainable rows with text and lang (see ``common.trainable``)."""
    rows = docs.filter(trainable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(per)
    if not langs:
        return Model([], [], [])
    sample = bounded_sample(rows, F.col("doc_id"), max_rows, sum(per.values()), seed)
    counted = sample.select("lang", "text").mapInArrow(_count, "lang string, n int, key string, count bigint") \
        .groupBy("lang", "n", "key").agg(F.sum("count").alias("count"))
    counts = materialize(counted, "lang-counts")
    # the most frequent keys of each level
    ranked = []
    for n in (0, *ORDERS):
        top = counts.filter(F.col("n") == n).groupBy("key").agg(F.sum("count").alias("all")) \
            .orderBy(F.desc("all"), "key").limit(max_grams if n else max_words)
        ranked.append(top.select(F.lit(n).alias("_n"), F.col("key").alias("_key")))
    chosen = ranked[0]
    for r in ranked[1:]:
        chosen = chosen.unionByName(r)
    kept = counts.join(chosen, (F.col("n") == F.col("_n")) & (F.col("key") == F.col("_key"))) \
        .groupBy("n", "key").agg(F.collect_list(F.struct("lang", "count")).alias("counts"))
    total = sum(per.values())
    return Model(langs, [per[x] / total for x in langs], sorted(
        (r["n"], r["key"], [(c["lang"], c["count"]) for c in r["counts"]]) for r in kept.collect()))


def _predict(model_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_b.value
        for b in batches:
            for start, length in slices(b.column(2)):
                got = model.predict(b.column(2).slice(start, length))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(start, length), b.column(1).slice(start, length),
                     pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    b = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_predict(b), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
