"""Decontamination: alignment against a plain Smith-Waterman, planted copies."""

import random

import numpy as np
import pyarrow as pa

from dispensa.llm import decontam

from .helpers import AWKWARD, documents, row


def slow_score(item, text):
    h = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, x in enumerate(item, 1):
        for j, y in enumerate(text, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_score():
    rng = random.Random(1)
    for _ in range(60):
        item = np.array([rng.randrange(6) for _ in range(rng.randrange(1, 15))])
        text = np.array([rng.randrange(-1, 6) for _ in range(rng.randrange(1, 40))])
        score, equal, start, end = decontam.align(item, text)
        assert score == slow_score(item.tolist(), text.tolist())
        assert 0 <= equal <= min(len(item), end - start)


def vocabulary(n, rng):
    return ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def planted():
    rng = random.Random(5)
    known = vocabulary(400, rng)
    items = [(i, " ".join(rng.choice(known) for _ in range(20 + i))) for i in range(12)]
    items += [(None, "two words"), (50, None), (51, "")]
    rows, want = [], set()
    for d in range(300):
        body = [rng.choice(known) for _ in range(rng.randrange(200))]
        if d % 3 == 0:
            i = rng.randrange(12)
            copy = items[i][1].split()
            kind = d % 4
            for k in range(0, len(copy), 7):  # one word in seven edited
                if kind == 1:
                    copy[k] = "zzz"
                elif kind == 2:
                    copy[k] += " zzz"
            text = " ".join(copy)
            if kind == 3:
                text = text.upper().replace(" ", ", ")
            body.insert(rng.randrange(len(body) + 1), text)
            want.add((d, i))
        elif d % 3 == 1:  # half an item is no leak
            half = items[d % 12][1].split()
            body.append(" ".join(half[:len(half) // 2]))
        rows.append(row(d, " ".join(body)))
    return items, rows, want


def test_planted_copies_and_spans(spark, monkeypatch):
    items, rows, want = planted()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (300_000, 60):  # one block, and many
        monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
        got = decontam.find_leaks(documents(spark, rows).repartition(3), bench).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        span = texts[r["doc_id"]][r["char_start"]:r["char_end"]]
        assert len(decontam.words(span)) >= 0.8 * r["item_words"] and span == span.strip(" ,")
    left = decontam.drop_leaks(documents(spark, rows), bench)
    assert {r["doc_id"] for r in left.collect()} == set(texts) - {d for d, _ in want}


def test_a_passage_that_is_everywhere_is_found(spark):
    items, rows, _ = planted()
    rows = [row(d, f"x{d} " + items[0][1]) for d in range(400)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert decontam.find_leaks(documents(spark, rows), bench).count() == 400


def test_several_copies_and_word_places():
    index = decontam.Index.build([(1, "one two three four five")])
    text = "¡One two three four five! ... one TWO three four five"
    (hit,), none = decontam.leaks_in(index, pa.array([text, None]), 0.8)
    assert none == [] and hit["n_spans"] == 2 and text[hit["char_start"]:hit["char_end"]] == "One two three four five"


def test_awkward_rows(spark):
    bench = spark.createDataFrame([(1, AWKWARD[8][1])], "item_id bigint, text string")
    docs = documents(spark, AWKWARD)
    assert {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()} == {(6, 1), (7, 1)}
    out = decontam.drop_leaks(docs, bench)
    assert out.columns == docs.columns and out.count() == len(AWKWARD) - 2
    assert decontam.find_leaks(documents(spark, []), bench).count() == 0
    assert decontam.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontam.drop_leaks(docs, bench.limit(0)).count() == len(AWKWARD)


def test_short_items_in_many_documents(spark):
    """Copies of items of 3 to 14 words are found however many documents hold
    them, exact or with as many edits as the similarity allows."""
    assert decontam.hits_needed(np.array([3, 4, 5, 8, 10, 11, 15, 59]), 0.8).tolist() == [1, 1, 1, 2, 2, 3, 3, 3]
    benchmark = spark.createDataFrame([(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in (3, 4, 8, 10, 14)],
                                      "item_id long, text string")
    rows, want = [], set()
    for d in range(400):
        n = (3, 4, 8, 10, 14)[d % 5]
        copy = [f"i{n}w{k}" for k in range(n)]
        if n == 10 and d % 2:
            copy[2] = copy[6] = "zzz"  # 2 of 8 n-grams stay
        if n == 8 and d % 2:
            copy[2] += " zzz"
            copy[4] += " zzz"  # 2 of 6 stay
        rows.append(row(d, "some words " + " ".join(copy) + " after it"))
        want.add((d, n))
    docs = documents(spark, rows + [row(900, "i3w0 i3w1 other words"), row(901, "i14w0 i14w1 i14w2 alone here")])
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, benchmark).collect()}
    assert got == want
    assert {r["doc_id"] for r in decontam.drop_leaks(docs, benchmark).collect()} == {900, 901}
