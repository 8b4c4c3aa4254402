"""Mixing: shares by brute force, the words taken, and awkward rows."""

import re
from collections import Counter

from dispensa.llm import mixing

from .helpers import AWKWARD, documents, row


def shares(sizes, budget=1.5, cap=2.0):
    """Reshare round by round, as stated."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, open_ = budget * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > cap * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = cap * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_and_words(spark):
    rows = [row(i, " ".join(["w"] * (1 + i * 37 % 90)), source="hot" if i % 3 else f"s{i % 11}") for i in range(900)]
    got = mixing.mix_sizes(documents(spark, rows)).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += words(r[1])
    want, taken = shares(sizes), Counter()
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, r["target"]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * r["copies"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 20 for s in want), (taken, want)
    again = mixing.mix_sizes(documents(spark, list(reversed(rows))).repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_inclusion_follows_the_share(spark):
    """A document's odds do not hang on its place: with half to take, both
    halves of the ids give about half."""
    rows = [row(i, "w w w", source="b" if i < 2000 else "a") for i in range(2100)]
    got = [r for r in mixing.mix_sizes(documents(spark, rows)).collect() if r["source"] == "b"]
    low = sum(r["copies"] for r in got if r["doc_id"] < 1000)
    high = sum(r["copies"] for r in got if r["doc_id"] >= 1000)
    assert abs(low - high) < 0.1 * (low + high)


def test_awkward_rows(spark):
    got = mixing.mix_sizes(documents(spark, AWKWARD)).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], words(r[1])) for r in AWKWARD)
    assert mixing.mix_sizes(documents(spark, [])).count() == 0
    nothing = mixing.mix_sizes(documents(spark, [row(1, None), row(2, "  ", source=None)])).collect()
    assert {(r["target"], r["taken"]) for r in nothing} == {(0.0, 0)}


def test_documents_are_repeated_as_planned(spark):
    docs = documents(spark, AWKWARD)
    plan = Counter()
    for r in mixing.mix_sizes(docs).collect():
        plan[r["doc_id"]] += r["copies"]
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == +plan


def test_one_id_or_text_on_a_third_of_the_rows(spark):
    """Rows that share an id (with one text or several), or a text without an
    id, are taken row by row: every source comes near its target."""
    rows = [row(i, " ".join(["w"] * (1 + i * 37 % 90)), source="hot") for i in range(2000)]
    rows += [row(7, " ".join(["v"] * 50), source="hot")] * 500  # identical
    rows += [row(7, f"n{i} " + " ".join(["v"] * (20 + i % 40)), source="hot") for i in range(500)]  # one id, own texts
    rows += [row(None, " ".join(["x"] * 50), source="idle")] * 1500 + [row(i, "z " * 30, source="idle") for i in range(3000, 3500)]
    rows += [row(9000, "q " * 40, source="z")] * 2500
    docs = documents(spark, rows)
    got = mixing.mix_sizes(docs).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((r[0], r[3], words(r[1])) for r in rows)
    taken, target = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    # the share of a source that is at no cap hangs on the draw
    assert any(0.05 < t / s % 1 < 0.95 for t, s in {(r["target"], r["source_size"]) for r in got})
    assert all(abs(taken[s] - target[s]) <= 50 for s in target), (taken, target)
    mixed = mixing.mix_documents(docs)
    out = Counter((r["doc_id"], r["source"], words(r["text"])) for r in mixed.collect())
    plan = Counter()
    for r in got:
        plan[r["doc_id"], r["source"], r["size"]] += r["copies"]
    assert out == +plan
    again = mixing.mix_documents(documents(spark, rows[::-1]).repartition(5))
    assert Counter(map(tuple, mixed.collect())) == Counter(map(tuple, again.collect()))


def test_keys_of_repeated_rows_differ_and_others_stay(spark, monkeypatch):
    docs = documents(spark, [row(1, "a"), row(2, "b"), row(2, "b"), row(2, "c"), row(None, "d"), row(None, "d")])
    thin = mixing.thin(docs, 7)
    plain = {r["doc_id"]: r["key"] for r in thin.collect()}
    one = mixing.own_keys(thin, mixing.repeated_keys(thin)).collect()
    assert len({r["key"] for r in one}) == 6 and {r["key"] for r in one if r["doc_id"] == 1} == {plain[1]}
    monkeypatch.setattr(mixing, "MAX_BROADCAST_KEYS", 0)
    two = mixing.own_keys(thin, mixing.repeated_keys(thin)).collect()
    assert Counter(map(tuple, one)) == Counter(map(tuple, two))


def test_a_column_of_maps_is_carried(spark):
    docs = spark.createDataFrame([(1, "a b", "s", {"k": 1}), (1, "a b", "s", {"k": 1}), (2, "c", "s", None)],
                                 "doc_id long, text string, source string, m map<string,int>")
    assert sum(r["copies"] for r in mixing.mix_sizes(docs).collect()) == mixing.mix_documents(docs).count()
