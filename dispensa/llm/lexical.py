"""Ranked lexical search by range-maximum tables over posting lists.

Terms are lower-cased (A-Z only) runs of ASCII letters, digits and all
characters beyond ASCII.  A document's score for an item is an integer sum over
the item's terms, once each (``Scoring``).  One pass over all whole texts counts
each document's terms and keeps those that some item holds; from it come the
corpus statistics (documents, terms, document frequencies) of all rows.

The documents a task reads are indexed in blocks of bounded size: per term a
posting list in document order, and over all lists one sparse table with the
place of the largest impact in every range of 2^j postings.  A search keeps a
frontier of document intervals; an interval's bound is the sum over the item's
terms of the largest impact inside it (two table lookups each), and it is split
at the document that holds the largest of these impacts, which is scored in
full.  The best intervals are split first, ``WAVE`` at a time, until no bound
reaches the k-th best score.  Scores equal to it are still opened, as a smaller
id may win.  Documents of one length and equal counts of all items' terms have
the same scores, so a block holds them once, with their k smallest ids.

The items are a stated query set, taken in blocks of ``BLOCK_TERMS`` terms; each
block is broadcast and meets all rows.  Spark merges the tasks' best k.

Defined results: null text and text without a term are no documents (they count
nowhere); items without a term that occurs return nothing; items of one item_id
are one item with the terms of all; a null item_id is an id of its own; a null
doc_id comes last among ties (2^63 - 1 stands for it and is not a valid id);
repeated rows are documents of their own; extra columns are ignored; empty
tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dispensa.plans.lineage import materialize

from .common import slices

BLOCK_TERMS = 300_000
# documents and postings of one index block, intervals split at a time
BLOCK_DOCS, BLOCK_POSTINGS, WAVE = 1 << 13, 1 << 20, 256
# cells of the table of places of one item
CELLS = 1 << 22
NO_ID = (1 << 63) - 1
# fixed values: bytes that are no part of a term become spaces, A-Z become a-z
_TERM = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _TERM else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of one text, repeats included."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split(b" ") if text else []


def split_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of several texts in a row (with empty ones where separators
    meet) and the bounds of each text."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = bytes(texts.buffers()[2] or b"")[at[0]:at[-1]].translate(TABLE) if len(texts) else b""
    plain = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer((at - at[0]).tobytes()), pa.py_buffer(raw)])
    parts = pc.split_pattern(plain, b" ")
    bounds = parts.offsets.to_numpy().astype(np.int64)
    return parts.values.slice(bounds[0], bounds[-1] - bounds[0]), bounds - bounds[0]


# -- scoring ----------------------------------------------------------------

@dataclass
class Scoring:
    """Corpus statistics: documents with a term, all their terms with repeats,
    and each known term's document frequency."""
    documents: int
    all_terms: int
    frequency: np.ndarray

    def weights(self) -> np.ndarray:
        n = self.documents
        return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) if d else 0
                         for d in self.frequency.tolist()], dtype=np.int64)

    def length_part(self, n_terms: int) -> int:
        return 50 + 50 * n_terms * self.documents // self.all_terms


def impacts(counts: np.ndarray, length_part: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * counts // (1000 * counts + 20 * length_part)


# -- one index block ----------------------------------------------------------

class Block:
    """Posting lists of some documents with the sparse table over them."""

    def __init__(self, docs: list[tuple], scoring: Scoring):
        """``docs``: (number of terms, term numbers, counts, sorted ids)."""
        self.ids = [d[3] for d in docs]
        self.n = len(docs)
        size = np.array([len(d[1]) for d in docs], dtype=np.int64)
        term = np.concatenate([np.empty(0, np.int32), *[d[1] for d in docs]])
        count = np.concatenate([np.empty(0, np.int32), *[d[2] for d in docs]]).astype(np.int64)
        doc = np.repeat(np.arange(self.n, dtype=np.int32), size)
        length = np.repeat(np.array([scoring.length_part(d[0]) for d in docs], dtype=np.int64), size)
        order = np.argsort(term, kind="stable")
        self.doc, self.impact = doc[order], impacts(count, length)[order]
        self.starts = np.searchsorted(term[order], np.arange(len(scoring.frequency) + 1))
        longest = int(np.diff(self.starts).max(initial=1))
        levels = [np.arange(len(order), dtype=np.int32)]
        for j in range(1, max(1, longest).bit_length()):
            below, half = levels[-1], 1 << (j - 1)
            row = below.copy()
            a, b = below[:-half], below[half:]
            row[:-half] = np.where(self.impact[b] > self.impact[a], b, a)
            levels.append(row)
        self.table = np.stack(levels)
        self.log = np.zeros(longest + 1, dtype=np.int64)
        for j in range(1, len(levels)):
            self.log[1 << j:] = j

    def search(self, wanted: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Puts the block's documents among the best of one item."""
        wanted = wanted[(self.starts[wanted + 1] > self.starts[wanted]) & (weights[wanted] > 0)]
        if len(wanted):
            # an item of very many terms takes the documents in parts, so that the table of places stays small
            step = max(1, CELLS // len(wanted))
            for first in range(0, self.n, step):
                self._search(wanted, weights[wanted], best, first, min(self.n, first + step))

    def _search(self, wanted: np.ndarray, w: np.ndarray, best: Best, first: int, stop: int) -> None:
        """``search`` in the documents from ``first`` up to ``stop``, which
        count from 0 here."""
        # per document border and term: the place of the first posting behind it
        places = np.zeros((stop - first + 1, len(wanted)), dtype=np.int64)
        for k, t in enumerate(wanted):
            mine = self.doc[self.starts[t]:self.starts[t + 1]]
            i, j = np.searchsorted(mine, [first, stop])
            places[mine[i:j] - first + 1, k] = 1
            places[0, k] = self.starts[t] + i
        np.cumsum(places, axis=0, out=places)
        end = len(self.doc) - 1

        def bounds(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Of intervals lo..hi: the bound and the document to split at."""
            s, e = places[lo], places[hi + 1]
            n = e - s
            j = self.log[n]
            a = self.table[j, np.minimum(s, end)]
            b = self.table[j, np.maximum(e - (1 << j), 0)]
            x, y = self.impact[a], self.impact[b]
            most = np.where(n > 0, np.maximum(x, y) * w, 0)
            k = most.argmax(axis=1)
            rows = np.arange(len(lo))
            at = np.where(y[rows, k] > x[rows, k], b[rows, k], a[rows, k])
            return most.sum(axis=1), self.doc[at].astype(np.int64) - first

        lo, hi = np.array([0]), np.array([stop - first - 1])
        bound, split = bounds(lo, hi)
        while True:
            alive = bound >= best.needed()
            lo, hi, bound, split = lo[alive], hi[alive], bound[alive], split[alive]
            if not len(lo):
                return
            if len(lo) > WAVE:
                part = np.argpartition(-bound, WAVE - 1)
                now, later = part[:WAVE], part[WAVE:]
            else:
                now, later = np.arange(len(lo)), np.empty(0, np.int64)
            d = split[now]
            s, e = places[d], places[d + 1]
            best.add((np.where(e > s, self.impact[np.minimum(s, end)], 0) * w).sum(axis=1), d + first, self.ids)
            left, right = lo[now] < d, d < hi[now]
            new_lo = np.concatenate([lo[now][left], d[right] + 1])
            new_hi = np.concatenate([d[left] - 1, hi[now][right]])
            new_bound, new_split = bounds(new_lo, new_hi)
            lo, hi = np.concatenate([lo[later], new_lo]), np.concatenate([hi[later], new_hi])
            bound, split = np.concatenate([bound[later], new_bound]), np.concatenate([split[later], new_split])


class Best:
    """The best k (score, id) of one item so far: score falling, id rising."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.id = np.empty(0, np.int64), np.empty(0, np.int64)

    def needed(self) -> int:
        """Least score that may still enter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, docs: np.ndarray, ids: list) -> None:
        enter = np.flatnonzero(score >= self.needed())
        if not len(enter):
            return
        each = [ids[d] for d in docs[enter]]
        s = np.concatenate([self.score, np.repeat(score[enter], [len(x) for x in each])])
        i = np.concatenate([self.id, *[np.array(x, dtype=np.int64) for x in each]])
        order = np.lexsort((i, -s))[:self.k]
        self.score, self.id = s[order], i[order]


# -- Spark ------------------------------------------------------------------

def _forward(vocabulary_b):
    """Per document with a term: its number of terms and, of the terms that
    items hold, their numbers and counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary_b.value, pa.large_binary())
        v = len(known)
        for b in batches:
            for start, length in slices(b.column(1)):
                flat, bounds = split_terms(b.column(1).slice(start, length))
                doc = np.repeat(np.arange(length), np.diff(bounds))
                some = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
                n = np.bincount(doc[some], minlength=length)
                at = pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                pairs, counts = np.unique(doc[at >= 0] * v + at[at >= 0], return_counts=True)
                cuts = np.searchsorted(pairs, np.arange(length + 1) * v).tolist()
                ids, tfs = (pairs % v).astype("<i4").tobytes(), counts.astype("<i4").tobytes()
                rows = np.flatnonzero(n)
                slice_of = lambda x: pa.array([x[4 * cuts[i]:4 * cuts[i + 1]] for i in rows], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(start, length).take(pa.array(rows)), pa.array(n[rows]), slice_of(ids), slice_of(tfs)],
                    names=["doc_id", "n_terms", "ids", "counts"])
    return run


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            raw = b"".join(b.column(0).to_pylist())
            total += np.bincount(np.frombuffer(raw, dtype="<i4"), minlength=size)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["term", "n"])
    return run


def _search(items_b, scoring_b, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, scoring = items_b.value, scoring_b.value
        weights = scoring.weights()
        best = [Best(k) for _ in items]
        held: dict[tuple, list] = {}
        postings = 0

        def settle() -> None:
            """Indexes the documents held, shorter ones first, and searches."""
            docs = [(n, np.frombuffer(t, "<i4"), np.frombuffer(c, "<i4"), sorted(ids)[:k])
                    for (n, t, c), ids in sorted(held.items(), key=lambda x: x[0][0])]
            block = Block(docs, scoring)
            for (_, wanted), b in zip(items, best):
                block.search(wanted, weights, b)

        for b in batches:
            ids = b.column(0).fill_null(NO_ID).to_pylist()
            for d, key in zip(ids, zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))):
                if not key[1]:
                    continue
                if key not in held:
                    if held and (len(held) >= BLOCK_DOCS or postings >= BLOCK_POSTINGS):
                        settle()
                        held, postings = {}, 0
                    held[key] = []
                    postings += len(key[1]) // 4
                same = held[key]
                same.append(d)
                if len(same) >= 4 * k:
                    same[:] = sorted(same)[:k]
        if held:
            settle()
        for (item, _), b in zip(items, best):
            if len(b.id):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(b.id), pa.int64()), pa.array(b.id, mask=b.id == NO_ID), pa.array(b.score)],
                    names=["item_id", "doc_id", "score"])
    return run


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """(item_id, terms) in blocks of at most BLOCK_TERMS terms (at least one
    item), streamed to the driver in the order of ids."""
    block, size = [], 0
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).orderBy("i")
    for r in rows.toLocalIterator():
        mine = {t for t in terms(r["t"]) if t}
        if block and block[-1][0] == r["i"]:
            block[-1][1].update(mine)
            continue
        if block and size + len(mine) > BLOCK_TERMS:
            yield block
            block, size = [], 0
        block.append((r["i"], mine))
        size += len(mine)
    if block:
        yield block


OUT = "item_id bigint, rank int, doc_id bigint, score bigint"


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank (from 1), doc_id,
    score; only scores above 0."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").isNotNull())
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    out = []
    for block in item_blocks(items, item_id, text):
        vocabulary = sorted(set().union(*(t for _, t in block)))
        if not vocabulary:
            continue
        number = {t: i for i, t in enumerate(vocabulary)}
        wanted = [(i, np.array(sorted(number[t] for t in mine), dtype=np.int64)) for i, mine in block]
        forward = materialize(rows.mapInArrow(_forward(sc.broadcast(vocabulary)),
                                              "doc_id bigint, n_terms bigint, ids binary, counts binary"), "lexical-forward")
        total = forward.agg(F.count("*"), F.sum("n_terms")).first()
        frequency = np.zeros(len(vocabulary), dtype=np.int64)
        counted = forward.select("ids").mapInArrow(_frequencies(len(vocabulary)), "term bigint, n bigint")
        for r in counted.groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():  # a row per term of the block
            frequency[r["term"]] = r["n"]
        scoring = Scoring(total[0], total[1] or 1, frequency)
        found = forward.mapInArrow(_search(sc.broadcast(wanted), sc.broadcast(scoring), k),
                                   "item_id bigint, doc_id bigint, score bigint")
        best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        out.append(best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    if not out:
        return spark.createDataFrame([], OUT)
    if len(out) > 1:  # each block is a pass of its own
        out = [materialize(x, "lexical-block") for x in out]
    return reduce(DataFrame.unionByName, out)
