"""The pipeline's stages against plain-Python versions of the same decisions."""

from collections import Counter

import corpus_pipeline
from dispensa.llm import decontam, mixing, rules
from dispensa.llm.common import read_table
from dispensa.plans.lineage import materialize

from ..conftest import SF_SMALL
from .test_rules import brute as base_counts
from .test_sharding import check
from .test_simhash import slow_components, slow_fingerprint


def test_stages(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF_SMALL), f"test-{name}")
        kept[name] = docs.collect()
        if name != "shard":
            assert docs.columns == columns
    # 8: what stays passes the base rules; what went fails them or a learned rule
    start = read_table(spark, SF_SMALL, "documents")
    verdicts = {r["doc_id"]: r["kept"] for r in rules.judge(start, read_table(spark, SF_SMALL, "labels")).collect()}
    assert {r["doc_id"] for r in kept["quality_rules"]} == {d for d, k in verdicts.items() if k}
    for r in kept["quality_rules"]:
        n, _, _, _, repeated = base_counts(r["text"])
        assert n >= 10 and 100 * repeated <= 20 * n
    # 4: the smallest id of each component
    prints = [(r["doc_id"], slow_fingerprint(r["text"])) for r in kept["quality_rules"]]
    assert Counter(r["doc_id"] for r in kept["near_dedup"]) == Counter(set(slow_components(prints)))
    # 1: documents that hold an item's words in a row go
    items = [" ".join(decontam.words(r["text"])) for r in read_table(spark, SF_SMALL, "benchmark").collect()]
    clean = {r["doc_id"] for r in kept["near_dedup"] if not any(i in " ".join(decontam.words(r["text"])) for i in items)}
    assert {r["doc_id"] for r in kept["decontaminate"]} == clean
    # 3: as often as the mix of these documents takes each
    before = spark.createDataFrame(kept["decontaminate"], start.schema)
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_sizes(before).collect()}
    assert Counter(r["doc_id"] for r in kept["mix_sources"]) == +Counter(plan)
    # 7: every row, shards by rows
    assert Counter(r["doc_id"] for r in kept["shard"]) == Counter(r["doc_id"] for r in kept["mix_sources"])
    check([(r["shard"], r["slot"]) for r in kept["shard"]])
    # run() gives the same rows
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_SMALL).collect())) == sorted(map(tuple, kept["shard"]))


def test_empty(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        read_table(spark, SF_SMALL, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
