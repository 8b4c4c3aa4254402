"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased runs of letters and digits, so punctuation and case do
not hide a copy; texts are split and looked up a batch at a time by Arrow.  A first pass counts in how many documents each n-gram of the
test items occurs.  A second pass finds the items' n-grams in each document;
hits of one item that lie on nearby diagonals form a window, which is aligned
if it holds a rare n-gram or at least ``MANY`` hits of any kind (so a passage
that the corpus repeats thousands of times, whose n-grams are all frequent, is
aligned too); of a short item, as few hits as an edited copy of it can have
left (``hits_needed``).  The local alignment (match 2, mismatch -1, gap -1) gives the
span and the number of equal words; it is a leak if they are at least
``similarity`` of the longer of item and span (0.8).

With 3-word seeds every copy of 15 words or more with up to a fifth of its
words edited keeps a whole seed.

The benchmark is taken in blocks of bounded size; each block is one broadcast
(at most ``BLOCK_WORDS`` words) and one stated query set against all rows.
Whole texts are read; nothing is joined or shuffled but the n-gram counts.

Defined results: null or blank texts have no leak; an item with fewer words
than a seed (3) is too short to be evidence and matches nothing; a null
item_id is reported as null; repeated items and documents are each reported;
several copies of an item in one text give one row with the best, by score,
then first; ``n_spans`` counts them.  Empty tables: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col

N = 3
SIMILARITY = 0.8
RARE_SHARE = 1e-4
RARE_LEAST = 3
MANY = 3
BLOCK_WORDS = 300_000
MATCH, MISMATCH, GAP = 2, -1, -1
NO_WORD = r"[^\pL\pN]+"
WORD = regex.compile(r"[\p{L}\p{N}]+")

HIT = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("score", T.IntegerType()),
    T.StructField("similarity", T.DoubleType()), T.StructField("equal_words", T.IntegerType()),
    T.StructField("item_words", T.IntegerType()), T.StructField("char_start", T.LongType()),
    T.StructField("char_end", T.LongType()), T.StructField("n_spans", T.IntegerType())]))


def split_words(texts: pa.Array) -> pa.ListArray:
    """The words of each text.  A text that starts or ends with another
    character gets an empty word there; a null text has one empty word."""
    return pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), NO_WORD)


def words(text: str | None) -> list[str]:
    return [w for w in split_words(pa.array([text], pa.string()))[0].as_py() if w]


@dataclass
class Index:
    """The n-grams of one block of items."""
    item_ids: list
    items: list[np.ndarray]      # word numbers of each item
    vocabulary: dict[str, int]
    codes: np.ndarray            # sorted distinct n-gram codes
    starts: np.ndarray           # code -> range in owners
    owners: np.ndarray           # (item, offset) rows
    rare: np.ndarray             # per code
    known: pa.Array | None = None

    @classmethod
    def build(cls, rows: list[tuple]) -> Index:
        vocabulary: dict[str, int] = {}
        items = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words(t)], dtype=np.int64) for _, t in rows]
        v = len(vocabulary) + 1
        assert v ** N < 2 ** 63, "a block holds at most 2^21 different words"
        code, owner = [], []
        for i, a in enumerate(items):
            if len(a) >= N:
                code.append(_codes(a, v)[0])
                owner.append(np.stack([np.full(len(a) - N + 1, i), np.arange(len(a) - N + 1)], axis=1))
        if not code:
            empty = np.empty(0, dtype=np.int64)
            return cls([r[0] for r in rows], items, vocabulary, empty, np.zeros(1, np.int64), empty.reshape(0, 2), empty.astype(bool))
        code, owner = np.concatenate(code), np.concatenate(owner)
        order = np.argsort(code, kind="stable")
        codes, counts = np.unique(code, return_counts=True)
        return cls([r[0] for r in rows], items, vocabulary, codes, np.concatenate([[0], np.cumsum(counts)]),
                   owner[order], np.ones(len(codes), dtype=bool))

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers (-1: in no item, or empty) of several texts, and the
        bounds of each text's words."""
        parts = split_words(texts)
        bounds = parts.offsets.to_numpy().astype(np.int64)
        if self.known is None:
            self.known = pa.array(list(self.vocabulary), pa.large_string())
        found = pc.fill_null(pc.index_in(parts.values, value_set=self.known), -1).to_numpy(zero_copy_only=False)
        return found.astype(np.int64)[bounds[0]:bounds[-1]], bounds - bounds[0]

    def hits(self, flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions whose n-gram is in an item, the n-gram's place in codes,
        and the text it is in."""
        if len(flat) < N or not len(self.codes):
            return (np.empty(0, np.int64),) * 3
        code, at = _codes(flat, len(self.vocabulary) + 1)
        place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        same = np.flatnonzero(self.codes[place] == code)
        at, place = at[same], place[same]
        doc = np.searchsorted(bounds, at, side="right") - 1
        inside = at + N <= bounds[doc + 1]
        return at[inside], place[inside], doc[inside]


def _codes(a: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram codes where all words are known, and their positions."""
    known = a >= 0
    ok = reduce(np.logical_and, [known[k:len(a) - N + 1 + k] for k in range(N)])
    at = np.flatnonzero(ok)
    code = np.zeros(len(at), dtype=np.int64)
    for k in range(N):
        code = code * v + a[at + k]
    return code, at


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int, int]:
    """Smith-Waterman over word numbers: (score, equal words, text start, text
    end) of the best local alignment, the first one on ties."""
    m, n = len(item), len(text)
    h = np.zeros((m + 1, n + 1), dtype=np.int32)
    ramp = np.arange(n + 1, dtype=np.int32) * -GAP
    for i in range(1, m + 1):
        row = np.zeros(n + 1, dtype=np.int32)
        row[1:] = np.maximum(h[i - 1, :-1] + np.where(text == item[i - 1], MATCH, MISMATCH), h[i - 1, 1:] + GAP)
        np.maximum(row, 0, out=row)
        # gaps along the text: best earlier cell less one per step
        h[i] = np.maximum.accumulate(row + ramp) - ramp
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    score, end, equal = int(h[i, j]), int(j), 0
    while i and j and h[i, j] > 0:
        same = text[j - 1] == item[i - 1]
        if h[i, j] == h[i - 1, j - 1] + (MATCH if same else MISMATCH):
            equal += int(same)
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, equal, int(j), end


def hits_needed(lengths: np.ndarray, similarity: float) -> np.ndarray:
    """Hits at which a window without a rare n-gram is aligned: those that a
    copy keeps at least, with as many words replaced (N n-grams each) or as
    many put in between (N - 1 each) as ``similarity`` leaves room for; 1 to
    MANY."""
    replaced = np.floor(lengths * (1 - similarity) + 1e-9).astype(np.int64)
    added = np.floor(lengths / similarity - lengths + 1e-9).astype(np.int64)
    kept = lengths - (N - 1) - np.maximum(N * replaced, (N - 1) * added)
    return np.clip(kept, 1, MANY)


def leaks_in(index: Index, texts: pa.Array, similarity: float) -> list[list[dict]]:
    """For each text the leaked items, best alignment each, in item order."""
    flat, bounds = index.numbers(texts)
    found: list[list[dict]] = [[] for _ in range(len(texts))]
    at, place, doc = index.hits(flat, bounds)
    if not len(at):
        return found
    n = index.starts[place + 1] - index.starts[place]
    k = np.repeat(np.arange(len(at)), n)
    owner = index.owners[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(index.starts[place], n)]
    item, begin = owner[:, 0], at[k] - owner[:, 1]
    order = np.lexsort((begin, item, doc[k]))
    k, item, begin = k[order], item[order], begin[order]
    lengths = np.array([len(a) for a in index.items])
    d = doc[k]
    # a window goes on while the next hit's diagonal is within half an item
    cut = np.concatenate([[True], (d[1:] != d[:-1]) | (item[1:] != item[:-1])
                          | (begin[1:] - begin[:-1] > lengths[item[1:]] // 2)])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(k))
    rare = np.add.reduceat(index.rare[place[k]].astype(np.int64), first)
    best: dict[tuple[int, int], dict] = {}
    for w in np.flatnonzero((rare > 0) | (last - first >= hits_needed(lengths, similarity)[item[first]])):
        i, x = int(item[first[w]]), int(d[first[w]])
        m = int(lengths[i])
        lo = max(int(bounds[x]), int(begin[first[w]]) - m // 2)
        hi = min(int(bounds[x + 1]), int(begin[last[w] - 1]) + m + m // 2)
        score, equal, s, e = align(index.items[i], flat[lo:hi])
        like = equal / max(m, e - s)
        if like >= similarity:
            got = best.get((x, i))
            spans = (got["n_spans"] if got else 0) + 1
            if got is None or score > got["score"]:
                got = {"item_id": index.item_ids[i], "score": score, "similarity": like, "equal_words": equal,
                       "item_words": m, "char_start": lo + s - int(bounds[x]), "char_end": lo + e - int(bounds[x])}
                best[x, i] = got
            got["n_spans"] = spans
    spans_of: dict[int, list] = {}
    for (x, _), hit in sorted(best.items()):
        if x not in spans_of:  # word places become character places in the text
            text = texts[x].as_py()
            spans_of[x] = [m.span() for m in WORD.finditer(text)]
            if not WORD.match(text):
                spans_of[x].insert(0, (0, 0))  # the empty word in front
        hit["char_start"] = spans_of[x][hit["char_start"]][0]
        hit["char_end"] = spans_of[x][hit["char_end"] - 1][1]
        found[x].append(hit)
    return found


# -- Spark ------------------------------------------------------------------

def benchmark_blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """The items in blocks of at most BLOCK_WORDS words (at least one item),
    streamed to the driver partition by partition."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        n = len(words(r[1]))
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    if block:
        yield block


def _count(index_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_b.value
        total = np.zeros(len(index.codes), dtype=np.int64)
        for b in batches:
            flat, bounds = index.numbers(b.column(0))
            at, place, doc = index.hits(flat, bounds)
            if len(at):
                pairs = np.unique(doc * len(index.codes) + place)
                total += np.bincount(pairs % len(index.codes), minlength=len(total))
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["gram", "n"])
    return run


def build_index(docs: DataFrame, block: list[tuple], n_docs: int):
    """The block's index with its rare n-grams, as a broadcast: those in at
    most max(RARE_LEAST, RARE_SHARE * n_docs) documents."""
    sc = docs.sparkSession.sparkContext
    index = Index.build(block)
    counted = docs.select("text").mapInArrow(_count(sc.broadcast(index)), "gram bigint, n bigint") \
        .groupBy("gram").agg(F.sum("n").alias("n"))
    often = counted.filter(F.col("n") > max(RARE_LEAST, int(RARE_SHARE * n_docs))).select("gram")
    for r in often.toLocalIterator():  # at most one row per n-gram of the block
        index.rare[r[0]] = False
    return sc.broadcast(index)


def _find(index_b, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = leaks_in(index_b.value, b.column(1), similarity)
            rows = [(i, h) for i, found in enumerate(hits) for h in found]
            if rows:
                names = [f.name for f in HIT.elementType.fields]
                types = [pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array([i for i, _ in rows])),
                     *[pa.array([h[n] for _, h in rows], t) for n, t in zip(names, types)]], names=["doc_id", *names])
    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document and leaked item: doc_id, item_id, score,
    similarity, equal_words, item_words, char_start, char_end, n_spans."""
    rows = docs.select("doc_id", "text")
    fields = [T.StructField("doc_id", rows.schema["doc_id"].dataType), *HIT.elementType.fields]
    n_docs = docs.count()
    found = [rows.mapInArrow(_find(build_index(docs, block, n_docs), similarity), T.StructType(fields))
             for block in benchmark_blocks(benchmark)]
    if not found:
        return docs.sparkSession.createDataFrame([], T.StructType(fields))
    return reduce(DataFrame.unionByName, found)


def _clean(index_b, similarity: float, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = leaks_in(index_b.value, b.column(b.schema.get_field_index(text)), similarity)
            yield b.filter(pa.array([not h for h in hits], pa.bool_()))
    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without a leak, with the columns of ``docs``."""
    out, n_docs = docs, docs.count()
    for block in benchmark_blocks(benchmark):
        out = out.mapInArrow(_clean(build_index(docs, block, n_docs), similarity, "text"), docs.schema)
    return out.select(*[col(c) for c in docs.columns])
