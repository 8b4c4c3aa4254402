"""Cutting lineage with written tables.

Iterative jobs (admission and payment fixpoints) and multi-stage pipelines
write their intermediate tables as Parquet under the session's checkpoint
folder (shared storage on a cluster) and read them back.  Each write is a
single job; the read-back plan is a plain scan, so a lost executor
recomputes from the written files instead of from the whole iteration
history, and AQE plans later joins from the files' real sizes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation

from dispensa.session import scratch_dir


def materialize(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_dir(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.parquet(path)


def materialize_observed(df: DataFrame, name: str, metrics: dict) -> tuple[DataFrame, dict]:
    """``materialize`` that also returns aggregate metrics of the written rows
    (``{name: Column}``), gathered by the write job itself through
    ``DataFrame.observe`` instead of a second job."""
    spark = df.sparkSession
    obs = Observation(f"{name}-{uuid.uuid4().hex}")
    observed = df.observe(obs, *[c.alias(k) for k, c in metrics.items()])
    path = scratch_dir(spark, f"{name}-{uuid.uuid4().hex}")
    observed.write.parquet(path)
    return spark.read.parquet(path), dict(obs.get)
