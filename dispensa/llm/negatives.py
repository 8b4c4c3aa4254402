"""Hard-negative mining by exact integer scores in a residue number system.

Vector components become integers (``floor(scale * x)``), so a score is an
integer inner product.  It is computed without rounding by float32 matrix
products: the components are reduced modulo several small primes (centred, so
that a sum over one piece of the dimensions stays below 2^24 and float32 holds
it exactly), one product per prime, and the signed score comes back by Chinese
remaindering (Garner's mixed radix with balanced digits).  The number of primes
follows from the largest component and dimension of the table.

Anchors are a stated query set; they are taken in blocks of ``BLOCK`` rows, each
block is broadcast and meets all rows, a tile at a time.  A first pass keeps
per task the best rows of the anchor's label, a second the best rows of other
labels whose score lies in the window [low, high] per cent of the positive's;
Spark merges the tasks' heads.  Rows of one label and equal components have
equal scores with everything, so only as many of them as could be returned (the
smallest ids) are candidates: a vector that a third of all rows share costs no
more than a rare one.

Defined results: a row without label or vector, or with a null or non-finite
component, takes no part; vectors of different length count as filled with
zeros; an empty vector scores 0; a null id is no anchor and comes last among
ties (2^63 - 1 stands for it and is not a valid id); repeated rows are
rows of their own, an anchor is only not its own positive; ties go to the
smaller id; extra columns are ignored; an empty table gives no rows.  Scores
must fit 62 bits, else ValueError.  The label is a whole number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dispensa.plans.lineage import materialize

# anchors of one broadcast, rows of one tile, dimensions of one exact float32 sum
BLOCK, TILE, PIECE = 2048, 512, 1024
EXACT = 1 << 24  # fixed value: float32 holds every integer up to it
NO_ID = (1 << 63) - 1


# -- residue arithmetic -----------------------------------------------------

def _primes_below(limit: int) -> list[int]:
    sieve = np.ones(limit + 1, dtype=bool)
    sieve[:3] = False
    sieve[4::2] = False
    for i in range(3, int(limit ** 0.5) + 1, 2):
        if sieve[i]:
            sieve[i * i::2 * i] = False
    return np.flatnonzero(sieve).tolist()[::-1]


@dataclass
class Residues:
    """Odd primes, large enough together for every score."""
    primes: list[int]

    @classmethod
    def for_scores(cls, dims: int, largest: int) -> Residues:
        bound = max(1, dims * largest * largest)
        if bound >= 1 << 62:
            raise ValueError("scores do not fit 62 bits; use a smaller scale")
        # half * half * piece < 2^24, and Garner's products (2 * half * half) too
        half = min(int(((EXACT - 1) / max(1, min(dims, PIECE))) ** 0.5), 1 << 11)
        chosen, product = [], 1
        for p in _primes_below(2 * half + 1):
            if product > 2 * bound:
                break
            chosen.append(p)
            product *= p
        return cls(chosen)

    def split(self, x: np.ndarray) -> list[np.ndarray]:
        """Centred residues of an integer matrix, one float32 matrix a prime."""
        return [((x + p // 2) % p - p // 2).astype(np.float32) for p in self.primes]

    def products(self, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """The exact integer matrix ``a @ b.T`` from the residues of both."""
        digits: list[np.ndarray] = []
        for i, p in enumerate(self.primes):
            dims = a[i].shape[1]
            r = np.zeros((a[i].shape[0], b[i].shape[0]), dtype=np.float32)
            for s in range(0, dims, PIECE):
                r += _centre(a[i][:, s:s + PIECE] @ b[i][:, s:s + PIECE].T, p)
                if dims > PIECE:
                    r = _centre(r, p)
            # mixed radix: the digits before are taken off, then divided out
            for q, digit in zip(self.primes, digits):
                r -= digit
                r *= _signed_inverse(q, p)
                r = _centre(r, p)
            digits.append(r)
        total = np.zeros(digits[0].shape, dtype=np.int64)
        for p, digit in zip(self.primes[::-1], digits[::-1]):
            total *= p
            total += digit.astype(np.int64)
        return total


def _signed_inverse(q: int, p: int) -> np.float32:
    x = pow(q, -1, p)
    return np.float32(x - p if x > p // 2 else x)


def _centre(r: np.ndarray, p: int) -> np.ndarray:
    """Whole numbers below 2^24 to their residue nearest to 0.  The first
    quotient may be off by one; from the second on it is exact."""
    for _ in range(2):
        r -= np.float32(p) * np.rint(r * np.float32(1 / p))
    return r


# -- heads: the best rows per slot -------------------------------------------

@dataclass
class Heads:
    """The best ``k`` (score, id) pairs of each of ``n`` slots."""
    n: int
    k: int
    slot: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    score: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    vec_id: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    print: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def __post_init__(self):
        # score and id that a full slot's last pair has
        self.last = np.full(self.n, np.iinfo(np.int64).min)
        self.last_id = np.full(self.n, NO_ID)

    def add(self, slot: np.ndarray, score: np.ndarray, vec_id: np.ndarray, prints: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score = np.concatenate([self.slot, slot]), np.concatenate([self.score, score])
        vec_id, prints = np.concatenate([self.vec_id, vec_id]), np.concatenate([self.print, prints])
        order = np.lexsort((vec_id, -score, slot))
        slot, score, vec_id, prints = slot[order], score[order], vec_id[order], prints[order]
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        place = np.arange(len(slot)) - np.repeat(first, np.diff(first, append=len(slot)))
        keep = place < self.k
        self.slot, self.score, self.vec_id, self.print = slot[keep], score[keep], vec_id[keep], prints[keep]
        full = np.flatnonzero(place == self.k - 1)
        self.last[slot[full]], self.last_id[slot[full]] = score[full], vec_id[full]


# -- Spark ------------------------------------------------------------------

def prepare(vectors: DataFrame, scale: float = 256, vec_id: str = "vec_id", vector: str = "embedding",
            label: str = "label") -> DataFrame:
    """The rows that take part: vec_id, label, c (integer components) and
    print (a hash of them)."""
    inf = float("inf")
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < inf))
    rows = vectors.filter(F.col(label).isNotNull() & F.col(vector).isNotNull()).filter(good)
    c = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), c.alias("c")) \
        .withColumn("print", F.xxhash64("c"))


def candidates(rows: DataFrame, most: int) -> DataFrame:
    """Of the rows of one label and equal components the ``most`` smallest ids
    (each task prunes before the shuffle)."""
    w = Window.partitionBy("label", "c").orderBy(F.col("vec_id").asc_nulls_last())
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Integer vectors as the rows of a matrix, filled up with zeros."""
    at = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)[at[0]:at[-1]]
    size = np.diff(at)
    if len(size) and (size == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(size), dims), dtype=np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(at[:-1] - at[0], size)] = flat
    return out


@dataclass
class Anchors:
    """One block of anchors, as broadcast."""
    residues: Residues
    dims: int
    vec_id: np.ndarray
    label: np.ndarray
    print: np.ndarray
    matrix: np.ndarray
    low: np.ndarray | None = None    # per anchor and positive: scores of the window
    high: np.ndarray | None = None

    def parts(self) -> list[np.ndarray]:
        return self.residues.split(self.matrix)


def _tiles(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for s in range(0, b.num_rows, TILE):
            t = b.slice(s, TILE)
            ids = t.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            yield ids, t.column(1).to_numpy(zero_copy_only=False), t.column(3).to_numpy(zero_copy_only=False), \
                _matrix(t.column(2), dims)


def _emit(heads: Heads) -> pa.RecordBatch:
    ids = pa.array(heads.vec_id, mask=heads.vec_id == NO_ID)
    return pa.RecordBatch.from_arrays([pa.array(heads.slot), pa.array(heads.score), ids, pa.array(heads.print)],
                                      names=["slot", "score", "vec_id", "print"])


def _same_label(anchors_b, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = anchors_b.value
        of = {int(x): np.flatnonzero(a.label == x) for x in np.unique(a.label)}
        parts = a.parts()
        mine = {x: [p[k] for p in parts] for x, k in of.items()}
        heads = Heads(len(a.label), most)
        for ids, label, prints, matrix in _tiles(batches, a.dims):
            for x in np.unique(label):
                if int(x) not in of:
                    continue
                k, rows = of[int(x)], np.flatnonzero(label == x)
                s = a.residues.products(a.residues.split(matrix[rows]), mine[int(x)])
                r, c = np.nonzero((s > heads.last[k]) | ((s == heads.last[k]) & (ids[rows][:, None] < heads.last_id[k])))
                heads.add(k[c], s[r, c], ids[rows[r]], prints[rows[r]])
        yield _emit(heads)
    return run


def _in_window(anchors_b, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = anchors_b.value
        parts = a.parts()
        n, k = a.low.shape
        heads = Heads(n * k, most)
        for ids, label, prints, matrix in _tiles(batches, a.dims):
            s = a.residues.products(a.residues.split(matrix), parts)
            # the widest window of each anchor first, then each of its windows
            floor = np.maximum(a.low, heads.last.reshape(n, k))
            r, c = np.nonzero((s >= floor.min(axis=1)) & (s <= a.high.max(axis=1)) & (label[:, None] != a.label))
            score = s[r, c]
            for j in range(k):
                slot = c * k + j
                ok = (score >= a.low[c, j]) & (score <= a.high[c, j]) & (
                    (score > heads.last[slot]) | ((score == heads.last[slot]) & (ids[r] < heads.last_id[slot])))
                heads.add(slot[ok], score[ok], ids[r[ok]], prints[r[ok]])
        yield _emit(heads)
    return run


HEAD = "slot bigint, score bigint, vec_id bigint, print bigint"


def _merge(rows: DataFrame, most: int) -> DataFrame:
    w = Window.partitionBy("slot").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def _positives(merged: DataFrame, a: Anchors, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and scores of each anchor's first ``n`` other rows (one row equal to
    the anchor is the anchor itself) and how many there are.  At most BLOCK *
    (n + 1) rows reach the driver."""
    ids, scores, found = (np.zeros((len(a.label), n), np.int64) for _ in range(3))
    count, seen = np.zeros(len(a.label), np.int64), np.zeros(len(a.label), bool)
    for r in sorted(merged.collect(), key=lambda r: (r["slot"], r["rank"])):
        i = r["slot"]
        if not seen[i] and r["vec_id"] == a.vec_id[i] and r["print"] == a.print[i]:
            seen[i] = True
        elif count[i] < n:
            ids[i, count[i]], scores[i, count[i]] = NO_ID if r["vec_id"] is None else r["vec_id"], r["score"]
            found[i, count[i]] = 1
            count[i] += 1
    return ids, scores, found.astype(bool)


def anchor_blocks(anchors: DataFrame, residues: Residues, dims: int) -> Iterator[Anchors]:
    """The anchors in blocks of at most BLOCK rows, streamed partition by
    partition."""
    held: list = []

    def block() -> Anchors:
        c = pa.array([r["c"] for r in held], pa.list_(pa.int64()))
        at = [np.array([r[k] for r in held], dtype=np.int64) for k in ("vec_id", "label", "print")]
        return Anchors(residues, dims, *at, _matrix(c, dims))

    for r in anchors.toLocalIterator():
        held.append(r)
        if len(held) == BLOCK:
            yield block()
            held = []
    if held:
        yield block()


OUT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def mine(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Hard negatives of the rows (see ``prepare``) that ``is_anchor`` marks:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score,
    with ``low * positive <= 100 * negative <= high * positive``."""
    spark = rows.sparkSession
    sc = spark.sparkContext
    pool = materialize(candidates(rows, max(positives + 1, negatives)), "mine-pool")
    asked = materialize(rows.filter(is_anchor), "mine-anchors")
    got = pool.agg(F.max(F.size("c")), F.max(F.array_max(F.transform("c", F.abs)))).first()
    dims, largest = max(1, int(got[0] or 0)), int(got[1] or 0)
    out = []
    for a in anchor_blocks(asked, Residues.for_scores(dims, largest), dims):
        first = _merge(pool.mapInArrow(_same_label(sc.broadcast(a), positives + 1), HEAD), positives + 1)
        ids, scores, found = _positives(first, a, positives)
        # whole scores s with low * p <= 100 * s <= high * p; none where there is no positive
        a.low = np.where(found, -((-low * scores) // 100), np.iinfo(np.int64).max)
        a.high = np.where(found, (high * scores) // 100, np.iinfo(np.int64).min)
        best = _merge(pool.mapInArrow(_in_window(sc.broadcast(a), negatives), HEAD), negatives)
        at = spark.createDataFrame(
            [(int(i * positives + j), int(a.vec_id[i]), None if ids[i, j] == NO_ID else int(ids[i, j]), int(scores[i, j]))
             for i, j in zip(*np.nonzero(found))], "_slot bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
        named = best.join(F.broadcast(at), F.col("slot") == F.col("_slot"))  # at most BLOCK * positives rows
        out.append(named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
                                F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    if not out:
        return spark.createDataFrame([], OUT)
    if len(out) > 1:  # each block is a pass of its own
        out = [materialize(x, "mine-block") for x in out]
    return reduce(DataFrame.unionByName, out)
