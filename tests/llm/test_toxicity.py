"""Toxicity: gradients, windows, whole-text scoring, held-out accuracy, awkward rows."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from dispensa.llm import toxicity
from dispensa.llm.common import bounded_rows, read_table
from dispensa.llm.queries import op13_toxicity

from .helpers import AWKWARD, documents
from .test_models import auc

SF_TENTH = "/root/testdata/sf0.1"  # enough labels to learn four languages from


def small_network(seed=1):
    rng = np.random.default_rng(seed)
    words = {"bad": 1, "good": 2, "day": 3}
    grams = {g: i + 1 for i, g in enumerate(sorted({g for w in words for g in toxicity.grams(w)}))}
    return toxicity.Network.start(words, grams, rng)


def test_gradient_against_differences():
    net = small_network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = toxicity.Words(net, ["bad", "good", "day", "unknown"])
    rng = np.random.default_rng(2)
    length = np.array([toxicity.WINDOW, 5, 1])
    codes = rng.integers(0, 4, (3, toxicity.WINDOW)) * (np.arange(toxicity.WINDOW) < length[:, None])
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    _, g = toxicity.gradient(net, words, codes, length, y, weight)
    for key, value in net.p.items():
        for at in rng.choice(value.size, min(value.size, 6), replace=False):
            i = np.unravel_index(at, value.shape)
            if key == "gram" and i[0] == 0:  # the row of "no n-gram" stays zero
                continue
            old, both = value[i], []
            for step in (1e-3, -1e-3):
                value[i] = old + step
                both.append(toxicity.gradient(net, words, codes, length, y, weight)[0])
            value[i] = old
            assert abs((both[0] - both[1]) / 2e-3 - g[key][i]) < 2e-3, (key, i)


def test_windows_cover_each_text():
    for n in (0, 1, toxicity.WINDOW - 1, toxicity.WINDOW, toxicity.WINDOW + 1, 100, 1001):
        start, length, doc = toxicity.window_starts(np.array([0, 3, 3 + n]))
        mine = doc == 1
        seen = np.zeros(n, dtype=int)
        for s, k in zip(start[mine], length[mine]):
            seen[s - 3:s - 3 + k] += 1
        assert (seen > 0).all() and (length <= toxicity.WINDOW).all()
        order = start[mine]
        assert (np.diff(order) <= toxicity.STRIDE).all()  # neighbours overlap


def test_scores_come_from_the_highest_windows():
    """Batched scoring against each window of each text scored alone."""
    net = small_network(3)
    net.slope, net.offset = np.array([1.5, 0.7, -0.3]), -0.2
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["bad", "good", "day", "other", "BAD!"], n)) for n in (1, 7, 24, 25, 60, 333)]
    texts += ["", None, "... !!!"]
    got = net.scores(pa.array(texts, pa.string()))
    for text, score in zip(texts, got):
        flat, bounds = toxicity.split_words(pa.array([text], pa.string()))
        words = flat.to_pylist()
        if not words:
            assert score == 0
            continue
        start, length, _ = toxicity.window_starts(bounds)
        alone = []
        for s, n in zip(start, length):
            x = net.inputs(words[s:s + n])
            codes = np.zeros((1, toxicity.WINDOW), dtype=int)
            codes[0, :n] = np.arange(n)
            alone.append(net.logits(x, codes, np.array([n]))[0])
        alone.sort(reverse=True)
        first, third, fifth = (alone[min(r, len(alone) - 1)] for r in (0, 2, 4))
        assert abs(score - 1 / (1 + np.exp(-(1.5 * first + 0.7 * third - 0.3 * fifth - 0.2)))) < 1e-5


def test_toxicity_held_out(spark):
    docs, labels = read_table(spark, SF_TENTH, "documents"), read_table(spark, SF_TENTH, "labels")
    got = op13_toxicity(spark, SF_TENTH).cache()
    assert got.count() == docs.count()
    rows = got.collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
               and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    rows = got.join(labels.filter("toxic is not null"), "doc_id").filter("held_out").collect()
    assert auc([r["toxic"] for r in rows], [r["score"] for r in rows]) >= 0.93
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.95 * len(rows)


def test_toxicity_awkward(spark):
    docs = documents(spark, AWKWARD)
    marks = "doc_id bigint, quality int, toxic int"
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (6, 1, 0), (8, None, 1), (7, 1, None), (None, 1, 0)], marks)
    got = toxicity.score_documents(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in got if r["doc_id"] in (1, 2, 3)} == {0.0}
    # one class only: its share among the labels; none: 0.5; texts without a word stay 0
    one = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert {r["score"] for r in toxicity.score_documents(docs, one).collect()} == {0.0}
    none = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score_documents(docs, none).collect()} == {0.0, 0.5}
    assert toxicity.score_documents(docs.limit(0), none).count() == 0
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q"))
    assert sorted(map(str, toxicity.score_documents(other, one).collect())) == \
        sorted(map(str, toxicity.score_documents(docs, one).collect()))


def test_sample_bound_holds_for_an_id_on_many_rows(spark):
    rows = spark.range(900).select(F.when(F.col("id") < 300, 5).otherwise(F.col("id")).alias("doc_id"),
                                   F.concat(F.lit("text "), (F.col("id") % 450).cast("string")).alias("text"))
    marks = rows.select(F.col("doc_id").alias("_id"), (F.col("doc_id") % 2).cast("int").alias("y")).distinct()
    got = bounded_rows(rows, marks, "y", 40, 3).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in got} == {0: 40, 1: 40}
