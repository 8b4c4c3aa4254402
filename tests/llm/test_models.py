"""Language id and the quality classifier: held-out accuracy, awkward rows."""

import numpy as np
from pyspark.sql import functions as F

from dispensa.llm import langid, puquality
from dispensa.llm.common import read_table
from dispensa.llm.queries import op2_language, op5_quality

from ..conftest import SF_CHECK
from .helpers import AWKWARD, crc_mod5, documents


def test_language_held_out(spark):
    docs = read_table(spark, SF_CHECK, "documents")
    got = op2_language(spark, SF_CHECK).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r["held_out"] == (crc_mod5(r["doc_id"]) == 0) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)


def test_backoff_to_shorter_grams():
    rows = [(0, "known", [("x", 5)]), (3, "abc", [("x", 9)]), (2, "zz", [("y", 4)]), (1, "q", [("y", 2)]),
            (2, "vv", [("x", 4)])]
    m = langid.Model(["x", "y"], [0.5, 0.5], rows)
    assert m.backoff("abcd") == [1] and m.backoff("azz") == [2] and m.backoff("q") == [3] and m.backoff("o") == []
    import pyarrow as pa
    got = m.predict(pa.array(["known", "KNOWN known q", "abcd", "azzt", "ooo", "", None, "12 !"]))
    assert [g[0] for g in got] == ["x", "x", "x", "y", "x", "und", "und", "und"]


def test_language_awkward(spark):
    docs = documents(spark, AWKWARD)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert got[1] == got[2] == got[3] == got[9] == "und" and got[6] != "und"
    nothing = langid.identify(docs, langid.fit(docs.limit(0))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"} and len(nothing) == len(AWKWARD)
    assert langid.identify(docs.limit(0), langid.fit(docs)).count() == 0


def auc(labels, scores):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    pos = np.array(labels) == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_quality_held_out(spark):
    labels = read_table(spark, SF_CHECK, "labels")
    got = op5_quality(spark, SF_CHECK)
    assert got.filter("predicted <> CASE WHEN score >= 0.3 THEN 1 ELSE 0 END OR score < 0 OR score > 1").count() == 0
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert auc([r["quality"] for r in rows], [r["score"] for r in rows]) >= 0.95
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.93 * len(rows)


def test_prior_and_risk_on_a_known_mixture():
    rng = np.random.default_rng(0)
    good = lambda n: np.c_[rng.normal(1.5, 1, (n, 3)), np.zeros((n, puquality.WIDTH - 3))].astype(np.float32)
    bad = lambda n: np.c_[rng.normal(-1.5, 1, (n, 3)), np.zeros((n, puquality.WIDTH - 3))].astype(np.float32)
    p, u = good(1500), rng.permutation(np.concatenate([good(1200), bad(800)]))
    m = puquality.fit_arrays(p, u)
    assert 0.5 < m.prior < 0.7  # 0.6 of the unlabelled rows are positive
    assert (m.score(good(500)) > 0.5).mean() > 0.93 and (m.score(bad(500)) < 0.5).mean() > 0.93


def test_quality_awkward(spark):
    docs = documents(spark, AWKWARD)
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (6, 1, 0), (7, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = puquality.score_documents(docs, puquality.fit(docs, labels)).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in got)
    none = puquality.fit(docs, labels.limit(0))
    assert {r["score"] for r in puquality.score_documents(docs, none).collect()} == {0.5}
    assert puquality.score_documents(docs.limit(0), none).count() == 0


def test_lang_and_labels_are_no_inputs(spark):
    docs = documents(spark, AWKWARD)
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q"))
    m = langid.fit(docs)
    assert sorted(map(str, langid.identify(docs, m).collect())) == sorted(map(str, langid.identify(other, m).collect()))


def test_quality_sample_is_bounded_in_rows(spark, monkeypatch):
    """An id with many different texts brings no more than ``max_rows`` vectors."""
    docs = spark.range(600).select(F.when(F.col("id") < 400, 1).otherwise(F.col("id")).alias("doc_id"),
                                   F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(i, 1, 0) for i in [1, *range(400, 500)]], "doc_id bigint, quality int, toxic int")
    seen = []
    monkeypatch.setattr(puquality, "fit_arrays", lambda p, u: seen.append((len(p), len(u))))
    puquality.fit(docs, labels, max_rows=30)
    assert seen == [(30, 30)]
    every = labels.unionByName(docs.selectExpr("doc_id", "0 as quality", "0 as toxic").distinct())
    puquality.fit(docs, every, max_rows=30)
    assert seen[1] == (30, 30)
