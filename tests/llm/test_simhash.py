"""SimHash: fingerprints, covering and components against brute force."""

import random
from collections import Counter

import numpy as np
import xxhash

from dispensa.llm import simhash

from .helpers import AWKWARD, WORDS, documents, row


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] * bool(word)
            word = ""
        else:
            word += c
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_components(prints, threshold=2):
    """prints: (doc_id, fp) rows -> component_id of each row."""
    distinct = sorted({f for _, f in prints})
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, x in enumerate(distinct):
        for y in distinct[i + 1:]:
            if (x ^ y).bit_count() <= threshold:
                root[find(x)] = find(y)
    least = {}
    for d, f in prints:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [least.get(find(f)) for _, f in prints]


def test_fingerprints(spark):
    texts = [r[1] for r in AWKWARD] + ["A b", "A  b\tC", "É b c D", "x " * 7]
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_spark_and_python_hash_alike(spark):
    from pyspark.sql import functions as F
    got = spark.createDataFrame([("a b c é",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got & (2 ** 64 - 1) == xxhash.xxh64_intdigest("a b c é".encode(), 42)


def test_golay_code_is_perfect():
    low, high, errors = simhash._code()
    assert (errors[0] >= 0).sum(axis=1).tolist() == [1] * 2048  # one pattern of weight <= 3 per syndrome


def test_near_pairs_meet_at_an_anchor():
    rng = random.Random(1)
    for _ in range(400):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.choice([0, 1, 2])):
            y ^= 1 << b
        fp = np.array([x, y], dtype=np.uint64).view(np.int64)
        index, anchor, home = simhash.anchors(fp)
        mine = anchor[home & (index == 0)]
        assert len(mine) == 1 and mine[0] in anchor[index == 1]


def test_components_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for g in range(60):
        words = [rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(300)]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(words)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = "new"
            rows.append(row(rng.randrange(10 ** 6), " ".join(copy)))
    rows += AWKWARD
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    have = Counter((r["doc_id"], r["fp"] & (2 ** 64 - 1), r["component_id"]) for r in got)
    prints = [(r[0], slow_fingerprint(r[1])) for r in rows]
    want = Counter((d, f, c) for (d, f), c in zip(prints, slow_components(prints)))
    assert have == want
    kept = simhash.drop_duplicates(documents(spark, rows)).collect()
    comps = {f: c for (_, f), c in zip(prints, slow_components(prints))}
    assert Counter(comps[slow_fingerprint(r["text"])] for r in kept) == Counter(set(comps.values()))


def test_random_fingerprints_and_hot_anchor(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOMES_PER_TASK", 8)  # so that a cluster of near prints is dealt out
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(25):
        x = rng.choice(sorted(prints))
        for _ in range(12):
            prints.add(x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    base = rng.getrandbits(64)
    prints |= {base ^ 1 << i for i in range(46, 64)} | {base ^ 1 << i ^ 1 << j for i in range(46, 64) for j in range(46, 64)}
    signed = [int(np.uint64(x).view(np.int64)) for x in prints]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"))
    root = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    ids = {x: i for i, x in enumerate(sorted(prints))}
    want = slow_components([(ids[x], x) for x in sorted(prints)])
    groups = {}
    for x, c in zip(sorted(prints), want):
        s = int(np.uint64(x).view(np.int64))
        groups.setdefault(c, set()).add(root.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_batches_carry_a_group_on(monkeypatch):
    import pyarrow as pa
    x = np.array([1, 2, 3, 7, 1, 2, 3, 7], dtype=np.int64)
    home = np.array([True] * 4 + [False] * 4)
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 3)
    for cut in range(1, 8):
        batches = [pa.RecordBatch.from_arrays([pa.array([5] * len(p)), pa.array([0] * len(p)), pa.array(home[s]), pa.array(p)],
                                              names=["anchor", "salt", "home", "fp"])
                   for s in (slice(0, cut), slice(cut, 8)) for p in [x[s]]]
        edges = [(a, b) for r in simhash._compare_batches(iter(batches), 1) for a, b in zip(*(c.to_pylist() for c in r.columns))]
        seen = {1}
        for _ in range(8):
            seen |= {y for a, b in edges for y in (a, b) if a in seen or b in seen}
        assert seen == {1, 2, 3, 7}


def test_empty(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.drop_duplicates(documents(spark, [])).count() == 0
