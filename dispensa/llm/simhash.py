"""SimHash near-duplicates by anchor-point covering.

Fingerprint: words (runs without white space, A-Z lower-cased), shingles of
``shingle`` words with repeats (a shorter text is one shingle, a text without
words has fingerprint zero); a bit is 1 if it is set in over half of the
shingles' XXH64 values (seed 42).

Links (fingerprints at most 2 bits apart) are found with a covering code.
Anchors are the words of the perfect binary Golay code [23, 12], covering
radius 3, one for bits 0-22 and one for bits 23-45: 2^24 anchors with covering
radius 6.  A fingerprint has one home anchor (radius) and visits every anchor
that a fingerprint within the threshold of it could call home, which are
anchors within covering radius plus threshold: block distances up to 3 + d1
and 3 + d2 with d1 + d2 <= 2.  If x and y differ in d1 + d2 + d3 <= 2 bits, y
is within 3 + d1 and 3 + d2 of x's home, so it visits it; each anchor compares
its home fingerprints with all its visitors, and no link is lost.

Only distinct fingerprints take part, so exact copies cost one row.  An anchor
with over ``HOMES_PER_TASK`` home fingerprints is dealt out: its homes are
salted, its visitors replicated to each salt.  Anchors are compared as sorted
streams; each batch of pairs is reduced to a spanning forest before it leaves
the task, so a group of n near copies gives about n links, not n^2.
Components come from alternating large-star and small-star rounds on those
links, each written to the shared folder; only counts reach the driver.

Defined results: null text is a text without words; a null doc_id never names
a component (one whose ids are all null has a null component_id); repeated
rows get the same component; extra columns are ignored (``drop_duplicates``
keeps them); empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispensa.plans.lineage import materialize, materialize_observed

from .common import col, fresh

SEED = 42  # fixed value of the fingerprint
THRESHOLD = 2
GOLAY = 0xC75  # fixed value: generator x^11+x^10+x^6+x^5+x^4+x^2+1 of the [23, 12] code
BLOCK = 23
HOMES_PER_TASK = 20_000
PAIRS_AT_ONCE = 1 << 21

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)  # byte -> its 8 bits


# -- fingerprints -----------------------------------------------------------

def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    # bytes.lower() and bytes.split() are exactly A-Z and the six ASCII spaces
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[k:] for k in range(shingle)]))
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), grams), dtype=np.uint64)
    # one histogram per byte place gives all 64 bit counts
    places = h.view(np.uint8).reshape(-1, 8).astype(np.int64) + (np.arange(8) << 8)
    hist = np.bincount(places.ravel(), minlength=2048).reshape(8, 256)
    ones = (hist @ _BITS).ravel() * 2 > len(h)
    return int(np.packbits(ones, bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = b.schema.get_field_index("text")
        prints = np.array([fingerprint(t, shingle) for t in b.column(at).to_pylist()], dtype=np.uint64)
        columns = [b.column(i) for i in range(b.num_columns) if i != at]
        names = [n for i, n in enumerate(b.schema.names) if i != at]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(prints.view(np.int64))], names=[*names, "fp"])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, text_hash (64-bit, of the whole text) and fp (as signed long)."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_fingerprint_batches, shingle=shingle),
                           f"doc_id {kind}, text_hash bigint, fp bigint")


# -- the covering code ------------------------------------------------------

@lru_cache(1)
def _code() -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Syndrome tables of the low 12 and high 11 bits, and for each syndrome
    the error patterns of weight <= 3 (one), 4 and 5, padded with -1."""
    def rest(v: int) -> int:
        for i in range(BLOCK - 1, 10, -1):
            if v >> i & 1:
                v ^= GOLAY << (i - 11)
        return v
    unit = [rest(1 << i) for i in range(BLOCK)]

    def table(first: int, n: int) -> np.ndarray:
        t = np.zeros(1 << n, dtype=np.int64)
        for i in range(n):
            t[1 << i:2 << i] = t[:1 << i] ^ unit[first + i]
        return t
    low, high = table(0, 12), table(12, 11)

    def patterns(weight: int) -> np.ndarray:
        p = np.zeros(1, dtype=np.int64)
        last = np.full(1, -1)
        for _ in range(weight):
            grown = [(p[last < i] | (1 << i), i) for i in range(BLOCK)]
            last = np.concatenate([np.full(len(q), i) for q, i in grown])
            p = np.concatenate([q for q, _ in grown])
        return p

    errors = []
    for weights in ((0, 1, 2, 3), (4,), (5,)):
        e = np.concatenate([patterns(w) for w in weights])
        s = low[e & 0xFFF] ^ high[e >> 12]
        order = np.argsort(s, kind="stable")
        e, s = e[order], s[order]
        counts = np.bincount(s, minlength=2048)
        place = np.arange(len(s)) - np.repeat(np.cumsum(counts) - counts, counts)
        padded = np.full((2048, counts.max()), -1, dtype=np.int64)
        padded[s, place] = e
        errors.append(padded)
    return low, high, errors


def _near(block: np.ndarray) -> list[list[np.ndarray]]:
    """For each need 0, 1, 2: code words at distance <= 3, 4, 5 of each block
    value, as (n, k) arrays padded with -1."""
    low, high, errors = _code()
    s = low[block & 0xFFF] ^ high[block >> 12]
    return [np.where(e[s] < 0, -1, e[s] ^ block[:, None]) for e in errors]


def anchors(fp: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fp, anchor, is_home) of every anchor that a fingerprint
    visits; its home anchor is the row with is_home."""
    u = fp.view(np.uint64)
    mask = np.uint64((1 << BLOCK) - 1)
    one = _near((u & mask).astype(np.int64))
    two = _near(((u >> np.uint64(BLOCK)) & mask).astype(np.int64))
    index, anchor, home = [], [], []
    for i in range(threshold + 1):
        for j in range(threshold + 1 - i):
            a = np.where((one[i][:, :, None] >= 0) & (two[j][:, None, :] >= 0),
                         (one[i][:, :, None] << BLOCK) | two[j][:, None, :], -1).reshape(len(u), -1)
            at, k = np.nonzero(a >= 0)
            index.append(at)
            anchor.append(a[at, k])
            home.append(np.full(len(at), i == 0 and j == 0))
    return np.concatenate(index), np.concatenate(anchor), np.concatenate(home)


def _anchor_batches(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        whole = b.column(0).to_numpy(zero_copy_only=False)
        for start in range(0, len(whole), 4096):
            fp = whole[start:start + 4096].astype(np.int64)
            index, anchor, home = anchors(fp, threshold)
            # a home row leads; the same fingerprint also visits its home
            h = np.flatnonzero(home)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([anchor[h], anchor])),
                pa.array(np.concatenate([np.ones(len(h), bool), np.zeros(len(anchor), bool)])),
                pa.array(fp[np.concatenate([index[h], index])])], names=["anchor", "home", "fp"])


# -- comparing per anchor ---------------------------------------------------

def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the connected components of links (a, b): each node
    but the smallest of its component, and that smallest one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _compare_batches(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, salt, home first).  The homes of the group that
    a batch ends in are carried into the next batch."""
    carry_key, carry = None, np.empty(0, dtype=np.int64)
    for b in batches:
        anchor, salt, home, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if not len(anchor):
            continue
        if carry_key == (anchor[0], salt[0]) and len(carry):
            n = len(carry)
            anchor = np.concatenate([np.full(n, carry_key[0]), anchor])
            salt = np.concatenate([np.full(n, carry_key[1]), salt])
            home = np.concatenate([np.ones(n, bool), home])
            fp = np.concatenate([carry, fp])
        home = home.astype(bool)
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])]))
        ends = np.append(new[1:], len(anchor))
        group = np.repeat(np.arange(len(new)), ends - new)
        homes = np.bincount(group[home], minlength=len(new))
        carry_key = (anchor[-1], salt[-1])
        carry = fp[new[-1]:new[-1] + homes[-1]].copy()
        # every home row against every visitor row of its group, in bounded slices
        first_visitor = new + homes
        visitors = ends - first_visitor
        at = np.flatnonzero(home & (visitors[group] > 0))
        work = visitors[group[at]]
        start = 0
        while start < len(at):
            upto = int(np.searchsorted(np.cumsum(work[start:]), PAIRS_AT_ONCE, side="right"))
            part = at[start:start + max(upto, 1)]
            start += max(upto, 1)
            n = visitors[group[part]]
            left = np.repeat(part, n)
            right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first_visitor[group[part]], n)
            bits = np.bitwise_count((fp[left] ^ fp[right]).view(np.uint64))
            link = np.flatnonzero((bits <= threshold) & (fp[left] != fp[right]))
            if len(link):
                x, y = forest(fp[left[link]], fp[right[link]])
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``distinct``: fp (long, distinct).  Returns links a, b (long) whose
    connected components are those of all pairs within ``threshold`` bits."""
    rows = distinct.select("fp").mapInArrow(partial(_anchor_batches, threshold=threshold),
                                            "anchor bigint, home boolean, fp bigint")
    hot = materialize(rows.filter("home").groupBy("anchor").count()
                      .filter(F.col("count") > HOMES_PER_TASK)
                      .select(F.col("anchor").alias("_a"), F.ceil(F.col("count") / HOMES_PER_TASK).cast("int").alias("salts")),
                      "simhash-hot")
    if hot.isEmpty():
        dealt = rows.select("anchor", F.lit(0).alias("salt"), "home", "fp")
    else:
        salts = F.coalesce(F.col("salts"), F.lit(1))
        own = F.array(F.pmod(F.xxhash64("fp"), salts).cast("int"))
        dealt = rows.join(hot, F.col("anchor") == F.col("_a"), "left").select(
            "anchor", F.explode(F.when(F.col("home"), own).otherwise(F.sequence(F.lit(0), salts - 1))).alias("salt"),
            "home", "fp")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "anchor", "salt").sortWithinPartitions("anchor", "salt", F.desc("home"))
    found = dealt.mapInArrow(partial(_compare_batches, threshold=threshold), "a bigint, b bigint")
    return found.distinct()


# -- components -------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's smallest node) for every node of the links
    a, b, by alternating large-star and small-star rounds until nothing moves."""
    signature = {"n": F.count("*"), "s": F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))}
    now, was = materialize_observed(edges.filter("a <> b").distinct(), "star", signature)
    while True:
        # large star: larger neighbours of each node go to its smallest neighbour
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).select(F.col("a").alias("_u"), "m")
        large = both.join(low, F.col("a") == F.col("_u")).filter("b > a") \
            .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large, _ = materialize_observed(large, "star", {"n": F.count("*")})
        # small star: a node and its smaller neighbours go to the smallest of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_u"), "m")
        small = down.join(low, F.col("a") == F.col("_u")).select(
            F.explode(F.array(F.struct(F.col("b").alias("x"), "m"), F.struct(F.col("a").alias("x"), "m"))).alias("e")) \
            .select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct()
        now, got = materialize_observed(small, "star", signature)
        if got == was:
            break
        was = got
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, fp, component (the smallest
    fingerprint of its component) and component_id (the smallest doc_id)."""
    prints = materialize(fingerprints(docs, shingle), "simhash-fp")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct, threshold))
    mapped = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("component"))
    least = mapped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = mapped.join(least.withColumnRenamed("component", "_c"), F.col("component") == F.col("_c")) \
        .select(F.col("fp").alias("_fp"), "component", "component_id")
    return prints.join(named, F.col("fp") == F.col("_fp")).drop("_fp")


def drop_duplicates(docs: DataFrame, shingle: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each component, with the columns of ``docs``: the one
    with the smallest doc_id (null last; then the smallest text hash)."""
    rows = near_duplicates(docs, shingle, threshold)
    per = rows.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    kept = per.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n")).alias("k"))
    i, h, n = (fresh(docs.columns, x) for x in ("_id", "_hash", "_n"))
    kept = materialize(kept.select(F.col("k.doc_id").alias(i), F.col("k.text_hash").alias(h), F.col("k.n").alias(n)), "simhash-kept")
    key = F.col("doc_id").eqNullSafe(col(i)) & (F.xxhash64("text") == col(h))
    out = docs.join(kept.filter(col(n) == 1), key, "left_semi")
    several = kept.filter(col(n) > 1)
    if several.isEmpty():
        return out
    # rows that repeat both id and text: the smallest of them by all columns
    boxed = fresh(docs.columns, "_row")
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    rest = docs.join(several, key, "left_semi") \
        .groupBy(F.col("doc_id").alias(i), F.xxhash64("text").alias(h)) \
        .agg(F.min_by(F.struct(*[col(c) for c in docs.columns]), F.struct(*[col(c) for c in plain])).alias(boxed)) \
        .select(*[F.col(boxed).getField(c).alias(c) for c in docs.columns])
    return out.unionByName(rest)

