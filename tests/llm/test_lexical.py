"""Ranked lexical search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from dispensa.llm import lexical

from .helpers import AWKWARD, LONG, WORDS, documents, row

ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()),
                      T.StructField("doc_id", T.StringType()), T.StructField("rank", T.StringType())])
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items, k):
    """Every document scored for every item."""
    rows = [(d, Counter(t), len(t)) for d, text in docs if (t := split(text))]
    n, every = len(rows), sum(r[2] for r in rows)
    df = Counter(t for r in rows for t in r[1])
    merged = {}
    for i, text in items:
        merged.setdefault(i, set()).update(split(text))
    out = []
    for i, wanted in merged.items():
        scores = []
        for d, tf, length in rows:
            m = 100 - 50 + (50 * length * n) // every
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 20 * m))
                    for t in wanted if tf[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k])]
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


def check(spark, rows, items, k):
    got = lexical.rank_documents(documents(spark, rows).repartition(3),
                                 spark.createDataFrame([(i, t, "x", "y") for i, t in items], ITEMS), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = slow([(r[0], r[1]) for r in rows], items, k)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    return want


def test_against_scoring_everything(spark, monkeypatch):
    # small blocks, waves and tables of places: every path is taken
    for name, value in (("BLOCK_DOCS", 32), ("WAVE", 3), ("CELLS", 90), ("BLOCK_TERMS", 25)):
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(3)
    words = WORDS + ["straße", "Ünder", "数字", "x2"]
    rows = [row(i, " ".join(rng.choices(words, weights=range(1, len(words) + 1), k=rng.randint(1, 40)))) for i in range(150)]
    rows += [row(1000 - i, "the same text many times, the same") for i in range(60)] + AWKWARD
    items = [(i, " ".join(rng.sample(words, rng.randint(1, 9)))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "no such terms here zzz"), (23, "many times the same"), (23, "FOX. fox-dog"), (None, "quick cats"),
              (24, LONG), (25, " ... ")]
    want = check(spark, rows, items, 7)
    assert {r[0] for r in want} >= {23, 24, None} and not {r[0] for r in want} & {20, 21, 25}


def test_empty_tables(spark):
    assert check(spark, [], [(1, "a b")], 5) == []
    assert check(spark, AWKWARD, [], 5) == []
    assert check(spark, [row(1, None), row(2, " .. ")], [(1, "a b")], 5) == []


def test_terms_of_a_batch():
    texts = ["Ab-c  d", None, "", "..", "ÄÖ x²y 1_2", "z" * 10]
    flat, bounds = lexical.split_terms(pa.array(["skip", *texts, "skip"]).slice(1, len(texts)))
    for t, s, e in zip(texts, bounds, bounds[1:]):
        assert [x.decode() for x in flat.to_pylist()[s:e] if x] == split(t) == [x.decode() for x in lexical.terms(t) if x]


def test_range_maximum_tables():
    rng = np.random.default_rng(1)
    docs = [(int(rng.integers(3, 50)), np.sort(rng.choice(5, rng.integers(1, 5), replace=False)).astype("<i4"), None, [i])
            for i in range(40)]
    docs = [(n, t, rng.integers(1, 4, len(t)).astype("<i4"), i) for n, t, _, i in docs]
    block = lexical.Block(docs, lexical.Scoring(40, 900, np.full(5, 20)))
    for s, e in zip(block.starts, block.starts[1:]):
        for a in range(s, e):
            for b in range(a + 1, e + 1):
                j = block.log[b - a]
                got = max(block.impact[block.table[j, a]], block.impact[block.table[j, b - (1 << j)]])
                assert got == block.impact[a:b].max()
