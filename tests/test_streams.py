"""Streams over several micro-batches equal the batch operators."""

import uuid

from pyspark.sql import functions as F

from dispensa.operators import ledger
from dispensa.session import scratch_dir
from dispensa.sources import testdata as td
from dispensa.streaming import streams

from .conftest import SF_SMALL


def _events_to_movements(df):
    from dispensa.queries import _events_to_movements as f
    return f(df)


def test_ledger_stream_carries_state_across_batches(spark):
    ev = td.raw(spark, SF_SMALL, "events")
    src = scratch_dir(spark, f"events-split-{uuid.uuid4().hex}")
    # three files in id order: three micro-batches with maxFilesPerTrigger=1
    bounds = ev.agg(F.percentile_approx("event_id", [0.33, 0.66]).alias("b")).collect()[0].b
    parts = [ev.filter(F.col("event_id") <= bounds[0]),
             ev.filter((F.col("event_id") > bounds[0]) & (F.col("event_id") <= bounds[1])),
             ev.filter(F.col("event_id") > bounds[1])]
    for i, p in enumerate(parts):
        p.coalesce(1).write.parquet(f"{src}/part{i}")
    q, out = streams.ledger_stream(spark, f"{src}/part*/*.parquet", ev.schema, _events_to_movements)
    q.awaitTermination()
    assert q.lastProgress is not None
    got = {r.id: r.saldo for r in streams.ledger_stream_rows(spark, out).collect()}
    want = {r.id: r.saldo for r in ledger.ledger_balance(td.ledger_movements(spark, SF_SMALL), ["id"]).collect()}
    assert got == want


def test_ledger_stream_counts_lower_ids_that_come_late(spark, tmp_path):
    """Balances go on from the batch that came last, whatever its ids."""
    schema = spark.createDataFrame([], "id long, obat_kode string, qty_in int, qty_out int").schema
    source = str(tmp_path / "in")
    out = str(tmp_path / "out")
    want = {}
    for k, (i, amount, balance) in enumerate([(100, 10, 10), (50, 5, 15), (200, 1, 16)]):
        spark.createDataFrame([(i, "A", amount, 0)], schema).coalesce(1).write.mode("append").parquet(source)
        q, _ = streams.ledger_stream(spark, source, schema, lambda b: b, out_dir=out)  # a restart each time
        q.awaitTermination()
        assert q.exception() is None
        want[i] = balance
        got = {r["id"]: r["saldo"] for r in streams.ledger_stream_rows(spark, out).collect()}
        assert got == want
