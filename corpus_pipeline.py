"""A training-corpus pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir), calls one corpus operator on all rows
that its predecessor kept, and returns a DataFrame; ``run`` writes each
result as Parquet in the shared folder and rereads it for the next stage.  All
stages but the last return the columns of documents; the last adds the shard
and slot of each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dispensa.llm import decontam, mixing, rules, sharding, simhash
from dispensa.llm.common import read_table
from dispensa.plans.lineage import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    return rules.keep_documents(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash of 3-word
    shingles, at most 2 bits apart, groups by links."""
    return simhash.drop_duplicates(docs, shingle=3, threshold=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it (0 to 2 times)."""
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in random order over 16 shards, with shard and slot."""
    return sharding.shuffle_documents(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
          ("mix_sources", mix_sources), ("shard", shard)]

# The decision list is learned and fingerprints are XXH64: no SQL states the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
