"""Sharding: laws of the result and the shuffle itself."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from dispensa.llm import sharding
from dispensa.llm.queries import op7_shards

from ..conftest import SF_SMALL
from .helpers import AWKWARD, documents, row


def check(rows, shards=16):
    by = {}
    for s, slot in rows:
        by.setdefault(s, []).append(slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(by) <= set(range(shards))


def test_fisher_yates_is_a_uniform_order():
    assert sorted(sharding.fisher_yates(50, 1)) == list(range(50))
    assert len(sharding.fisher_yates(0, 1)) == 0
    firsts = Counter(int(sharding.fisher_yates(4, s)[0]) for s in range(4000))
    assert all(900 < firsts[i] < 1100 for i in range(4))
    orders = Counter(tuple(sharding.fisher_yates(3, s)) for s in range(6000))
    assert len(orders) == 6 and min(orders.values()) > 850


def test_query(spark):
    got = op7_shards(spark, SF_SMALL).collect()
    check([(r["shard"], r["slot"]) for r in got])
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}


def test_many_buckets_agree_on_reruns(spark):
    rows = [row(i, "copy" if i % 3 else f"text {i}") for i in range(700)]
    one = sharding.shuffle_documents(documents(spark, rows), bucket_bytes=4000)
    names = one.columns[-2:]
    a = sorted((r["doc_id"], r[names[0]], r[names[1]]) for r in one.collect())
    two = sharding.shuffle_documents(documents(spark, rows[::-1]).repartition(7), bucket_bytes=4000)
    assert a == sorted((r["doc_id"], r[names[0]], r[names[1]]) for r in two.collect())
    check([(s, k) for _, s, k in a])
    # copies and neighbouring ids are spread
    spread = Counter(s for d, s, _ in a if d % 3)
    assert max(spread.values()) < 2 * min(spread.values())
    order = np.array([d for d, s, k in sorted(a, key=lambda x: x[1:])])
    assert abs(np.corrcoef(order[:-1], order[1:])[0, 1]) < 0.15


def test_awkward_rows(spark):
    docs = documents(spark, AWKWARD)
    out = sharding.shuffle_documents(docs, shards=3)
    assert out.columns == [*docs.columns, "shard_", "slot_"]
    got = out.collect()
    check([(r["shard_"], r["slot_"]) for r in got], 3)
    assert Counter(tuple(r)[:-2] for r in got) == Counter(map(tuple, AWKWARD))
    assert sharding.shuffle_documents(docs.limit(0)).count() == 0
    few = sharding.shuffle_documents(docs.limit(2)).collect()
    check([(r["shard_"], r["slot_"]) for r in few])


def test_a_row_on_a_third_of_the_table_is_spread(spark, monkeypatch):
    """Identical rows go to buckets one by one: no bucket holds more than
    memory-sized ones may, reruns agree and no row is lost."""
    def watched(*names):
        run = shuffler(*names)

        def counted(table):
            out = run(table)
            return out.set_column(out.schema.get_field_index("lang"), "lang", pa.array([str(out.num_rows)] * out.num_rows))
        return counted

    shuffler = sharding._shuffler
    same = [row(7, "the same row " * 5)] * 3000
    rows = same + [row(i, f"text {i} " + "word " * 12, source="b") for i in range(6000)]
    docs = documents(spark, rows)
    first = sharding.shuffle_documents(docs, bucket_bytes=40_000).collect()
    check([(r["shard_"], r["slot_"]) for r in first])
    assert Counter(tuple(r)[:-2] for r in first) == Counter(rows)
    again = sharding.shuffle_documents(documents(spark, rows[::-1]).repartition(7), bucket_bytes=40_000).collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, again))
    copies = Counter(r["shard_"] for r in first if r["doc_id"] == 7 and r["source"] == "a")
    assert len(copies) == 16 and max(copies.values()) < 1.5 * min(copies.values())
    monkeypatch.setattr(sharding, "_shuffler", watched)
    seen = [int(r["lang"]) for r in sharding.shuffle_documents(docs, bucket_bytes=40_000).collect()]
    assert max(seen) < 700, max(seen)


def test_paths_of_copy_numbers_agree(spark, monkeypatch):
    """Whether all rows are grouped or only those that repeat, and in blocks
    or not, each row has the same numbers."""
    rows = [row(i % 40, f"t {i % 40}") for i in range(200)] + [row(1000 + i, "x") for i in range(50)] + [row(5000, "h")] * 2500
    docs = documents(spark, rows)
    one = Counter(map(tuple, sharding.number_copies(docs, 11, "n_").collect()))
    monkeypatch.setattr(sharding, "MAX_BROADCAST_KEYS", 0)
    assert one == Counter(map(tuple, sharding.number_copies(docs, 11, "n_").collect()))
    left = Counter(rows)
    assert one == Counter(r + (i,) for r, n in left.items() for i in range(1, n + 1))


def test_all_columns_count_in_the_bucket_size(spark):
    docs = spark.createDataFrame([(1, "ab", "x" * 100, [1, 2], {"k": "v"})], "doc_id long, text string, note string, a array<int>, m map<string,string>")
    assert docs.select(sharding._row_bytes(docs.schema)).first()[0] >= 64 + 2 + 100 + 8
    assert sharding.shuffle_documents(docs.union(docs)).count() == 2


def test_columns_named_like_the_operators_own(spark):
    from dispensa.llm import simhash
    docs = spark.range(40).select(
        "id", F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), (F.col("id") % 9).cast("string")).alias("text"),
        *[F.col("id").alias(c) for c in ("_b", "_offset", "_all", "_bucket", "_tie", "_position", "_copy", "_id", "_hash", "_n", "_row", "n")])
    got = sharding.shuffle_documents(docs, shards=3, bucket_bytes=400)
    assert got.columns == [*docs.columns, "shard", "slot"] and got.count() == 40
    assert {r["n"] for r in got.groupBy("shard").agg(F.count("*").alias("n")).collect()} == {13, 14}
    kept = simhash.drop_duplicates(docs.unionByName(docs))
    assert kept.columns == docs.columns and kept.select("text").distinct().count() == kept.count()
