"""Structured Streaming forms of the ledger balance (S1) and daily sales.

Both read a growing Parquet source with ``readStream`` and write through
``foreachBatch`` into Parquet folders, so that every micro-batch runs the
same DataFrame operators as the batch jobs and nothing is held in the
driver.  Outputs and the per-drug balance state live under the session's
checkpoint folder (shared storage on a cluster), with a streaming checkpoint
for progress; each micro-batch writes its own epoch folder with
overwrite, so a replayed batch replaces its output instead of adding to it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dispensa.operators import ledger as L
from dispensa.session import scratch_dir


# ---------------------------------------------------------------------- S1
def ledger_stream(spark: SparkSession, source: str, schema: T.StructType, to_movements,
                  out_dir: str | None = None, max_files_per_trigger: int = 1):
    """Continuous ledger balance.  Each micro-batch of movements gets
    balances continuing from the per-drug balance state (by arrival: a
    lower id that comes late adds to the balance reached, earlier rows stay); the new state is
    written as a new version per batch.  Returns (query, out_dir)."""
    out = out_dir or scratch_dir(spark, f"ledger-stream-{uuid.uuid4().hex}")
    rows_path, state_root = f"{out}/rows", f"{out}/state"
    state_schema = "obat_kode string, opening long, last_id long"

    def step(batch: DataFrame, epoch: int) -> None:
        sess = batch.sparkSession
        mov = to_movements(batch)
        prev = sess.read.schema(state_schema).parquet(f"{state_root}/v{epoch - 1}") if epoch > 0 else \
            sess.createDataFrame([], state_schema)
        rows = L.ledger_balance(mov, order=["id"], opening=prev.select("obat_kode", "opening"))
        rows.write.mode("overwrite").parquet(f"{rows_path}/epoch={epoch}")
        written = sess.read.parquet(f"{rows_path}/epoch={epoch}")
        last = L.latest_balance(written).select("obat_kode", F.col("saldo").alias("opening"), "last_id")
        # the balance after the batch that came last, also where its ids are lower than those seen before
        state = prev.withColumn("turn", F.lit(0)).unionByName(last.withColumn("turn", F.lit(1))).groupBy("obat_kode").agg(
            F.max_by("opening", "turn").alias("opening"), F.max("last_id").alias("last_id"))
        state.write.mode("overwrite").parquet(f"{state_root}/v{epoch}")

    q = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source)
         .writeStream.foreachBatch(step).option("checkpointLocation", f"{out}/_checkpoint")
         .trigger(availableNow=True).start())
    return q, out


def ledger_stream_rows(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(f"{out_dir}/rows")


# ---------------------------------------------------------------------- S2
def daily_sales_stream(spark: SparkSession, source: str, schema: T.StructType, to_sales,
                       out_dir: str | None = None):
    """Per-day sale count and total as sales arrive.  Each batch writes
    the counts and sums of its own sales per day under its epoch; the result
    adds them up on reading.  No state is kept between batches and no sale is
    late: a file with an older day counts whenever it comes.  Returns (query,
    out_dir)."""
    out = out_dir or scratch_dir(spark, f"daily-stream-{uuid.uuid4().hex}")
    sales = to_sales(spark.readStream.schema(schema).parquet(source))

    def step(batch: DataFrame, epoch: int) -> None:
        # one folder per epoch, overwritten when a batch is replayed
        batch.groupBy(F.to_date("tgl").alias("tgl")) \
             .agg(F.count(F.lit(1)).alias("trx"), F.sum("total").alias("total")) \
             .write.mode("overwrite").parquet(f"{out}/updates/epoch={epoch}")

    q = (sales.writeStream.foreachBatch(step)
         .option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start())
    return q, out


def daily_sales_result(spark: SparkSession, out_dir: str) -> DataFrame:
    """Count and total of each day over all batches."""
    u = spark.read.parquet(f"{out_dir}/updates")
    return u.groupBy("tgl").agg(F.sum("trx").alias("trx"), F.sum("total").alias("total"))
