"""Hard-negative mining: exact residue products, and mining against a plain loop."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dispensa.llm import negatives

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("label", T.IntegerType()),
                        # names that the operator itself uses
                        *[T.StructField(n, T.StringType()) for n in ("c", "print", "slot", "score", "rank", "_n", "_slot", "low")]])


@pytest.mark.parametrize("dims,largest", [(64, 256), (64, 5000), (3000, 40_000), (5, 2 ** 29), (1, 1), (1500, 3), (2, 1 << 30)])
def test_products_are_exact(dims, largest):
    rng = np.random.default_rng(dims)
    a, b = rng.integers(-largest, largest + 1, (17, dims)), rng.integers(-largest, largest + 1, (13, dims))
    a[0], b[0], b[1] = largest, -largest, largest  # the extreme scores of both signs
    r = negatives.Residues.for_scores(dims, largest)
    want = a.astype(object) @ b.T.astype(object)
    assert (r.products(r.split(a), r.split(b)).astype(object) == want).all()
    assert all(p % 2 for p in r.primes) and math.prod(r.primes) > 2 * dims * largest ** 2


def test_scores_beyond_62_bits_are_refused():
    with pytest.raises(ValueError):
        negatives.Residues.for_scores(64, 1 << 29)


def slow(rows, every, n_pos, n_neg, low=50, high=95):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows
          if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    by = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for k, (i, v, y) in enumerate(ok):
        if i is None or i % every:
            continue
        same = sorted(((dot(v, w), j) for m, (j, w, z) in enumerate(ok) if m != k and z == y), key=by)[:n_pos]
        for p, j in same:
            neg = sorted(((dot(v, w), h) for h, w, z in ok if z != y and low * p <= 100 * dot(v, w) <= high * p), key=by)
            out += [(i, j, r + 1, h, p, s) for r, (s, h) in enumerate(neg[:n_neg])]
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


def run(spark, rows, every=3, n_pos=4, n_neg=2):
    table = spark.createDataFrame([(*r, *"cpsnrlxy") for r in rows], VECTORS).repartition(3)
    got = negatives.mine(negatives.prepare(table), F.col("vec_id") % every == 0, n_pos, n_neg)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in got.collect()), key=key)


def test_against_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 7)  # several blocks of anchors
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).round(1).tolist(), int(rng.integers(3))) for i in range(60)]
    hot = [0.5, -0.25, 0.125, 1.0, 0.0, 0.75]
    rows += [(100 + i, hot, i % 2) for i in range(40)]  # a vector that many rows share
    rows += [(200, None, 1), (201, hot, None), (202, [0.5, None] + hot[2:], 1), (203, [float("nan")] + hot[1:], 1),
             (204, [float("inf")] + hot[1:], 0), (205, [-float("inf")] + hot[1:], 0), (None, hot, 1), (None, hot, 0),
             (300, hot, 1), (300, hot, 1), (303, hot, 0), (303, hot[::-1], 0), (306, [], 2), (309, hot[:3], 1)]
    assert run(spark, rows) == sorted(slow(rows, 3, 4, 2), key=key)


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(3, [1.0, 2.0], 1)]) == []
    rows = [(3, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (5, [0.75, 0.5], 2), (6, [0.0, 0.0], 2), (7, [-1.0, 0.0], 2)]
    assert run(spark, rows) == sorted(slow(rows, 3, 4, 2), key=key)
