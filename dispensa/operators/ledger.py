"""Stock ledger: movement union, running balance, latest balance, stock
card, header totals, stock application, controlled-drug flag.

The reference writes the ledger one row at a time ("read last balance, add,
insert").  Here a batch of movements gets its balances from one distributed
prefix sum per drug (``plans.prefix.running_sums``), which stays balanced
when one drug carries a large share of all movements.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispensa import model
from dispensa.functions.scalars import clamp, page_offset
from dispensa.plans.prefix import number_rows, running_sums

LEDGER_COLS = ["id", "tgl", "obat_kode", "batch_no", "ref_type", "ref_id", "qty_in", "qty_out", "saldo",
               "keterangan"]


# ------------------------------------------------------------------- G1
def purchase_movements(lines: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Purchase lines as stock-in rows (BELI)."""
    src = lines
    if headers is not None:
        src = lines.join(headers.select(F.col("id").alias("pembelian_id"), F.col("tgl").alias("__t")),
                         "pembelian_id")
        tgl = F.col("__t").cast("timestamp_ntz")
    else:
        tgl = F.lit(None).cast("timestamp_ntz")
    return src.select(
        F.col("id").alias("line_id"), tgl.alias("tgl"), "obat_kode", "batch_no",
        F.lit("BELI").alias("ref_type"), F.col("pembelian_id").alias("ref_id"),
        F.col("qty").cast("int").alias("qty_in"), F.lit(0).alias("qty_out"),
        F.lit("Pembelian").alias("keterangan"))


def sale_movements(lines: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Sale lines as stock-out rows (JUAL)."""
    src = lines
    if headers is not None:
        src = lines.join(headers.select(F.col("id").alias("penjualan_id"), F.col("tgl").alias("__t")),
                         "penjualan_id")
        tgl = F.col("__t").cast("timestamp_ntz")
    else:
        tgl = F.lit(None).cast("timestamp_ntz")
    return src.select(
        F.col("id").alias("line_id"), tgl.alias("tgl"), "obat_kode", "batch_no",
        F.lit("JUAL").alias("ref_type"), F.col("penjualan_id").alias("ref_id"),
        F.lit(0).alias("qty_in"), F.col("qty").cast("int").alias("qty_out"),
        F.lit("Penjualan").alias("keterangan"))


def reversal_movements(lines: DataFrame) -> DataFrame:
    """Reversed purchase lines as stock-out rows (BATAL_BELI)."""
    return lines.select(
        F.col("id").alias("line_id"), F.lit(None).cast("timestamp_ntz").alias("tgl"), "obat_kode", "batch_no",
        F.lit("BATAL_BELI").alias("ref_type"), F.col("pembelian_id").alias("ref_id"),
        F.lit(0).alias("qty_in"), F.col("qty").cast("int").alias("qty_out"),
        F.lit("Pembatalan Pembelian").alias("keterangan"))


def movement_union(*parts: DataFrame) -> DataFrame:
    """G1: one movement table from several sources (by column name)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------- E1
def ledger_balance(mov: DataFrame, order: Sequence[str] = ("id",), opening: DataFrame | None = None,
                   key: str = "obat_kode") -> DataFrame:
    """Per drug, in ``order``, ``saldo = opening + Σ(qty_in − qty_out)``
    up to and including the row.  ``opening`` (columns ``obat_kode``,
    ``opening``) defaults to 0 for every drug, as the reference starts
    balances from 0 (quirk 12)."""
    delta = (F.col("qty_in").cast("long") - F.col("qty_out").cast("long"))
    out = running_sums(mov.drop("saldo") if "saldo" in mov.columns else mov, [key], list(order),
                       {"saldo": delta})
    if opening is not None:
        o = opening.select(F.col(key).alias("__k"), F.col("opening").cast("long").alias("__open"))
        out = out.join(o, out[key] == o["__k"], "left") \
                 .withColumn("saldo", F.col("saldo") + F.coalesce(F.col("__open"), F.lit(0))) \
                 .drop("__k", "__open")
    return out


# ------------------------------------------------------------------- E2
def latest_balance(ledger: DataFrame, key: str = "obat_kode", order: str = "id") -> DataFrame:
    """The balance of each drug's last ledger row (partial/final
    aggregate: a hot drug is combined map-side)."""
    return ledger.groupBy(key).agg(F.max_by("saldo", order).alias("saldo"),
                                   F.max(order).alias("last_id"))


# ------------------------------------------------------------------- E3
def stock_cards(drugs: DataFrame, ledger: DataFrame, codes: DataFrame | None = None,
                limit: int = model.LIMIT_STOCK_CARD[0], page: int = 1) -> DataFrame:
    """Per requested drug, its header (code, name, stock, expiry) with
    one page of its ledger rows in id order.  Rows are numbered per drug with
    the skew-safe numbering, then the page is a range filter on the number."""
    limit = clamp(limit, *model.LIMIT_STOCK_CARD)
    led = ledger
    if codes is not None:
        led = led.join(codes.select(F.col("kode").alias("obat_kode")), "obat_kode", "left_semi")
    numbered = number_rows(led, ["id"], name="row_no", keys=["obat_kode"])
    lo = page_offset(limit, page)
    rows = numbered.filter((F.col("row_no") > lo) & (F.col("row_no") <= lo + limit))
    head = drugs.select(F.col("kode").alias("obat_kode"), "nama", F.col("stok").alias("stok_obat"),
                        F.col("expired_date").alias("obat_expired_date"))
    return rows.join(head, "obat_kode")


# ------------------------------------------------------------------- D7
def doc_totals(lines: DataFrame, doc: str, qty: str = "qty", price: str = "harga_jual") -> DataFrame:
    """Header total from lines, ``Σ qty × price`` per document (tax excluded)."""
    return lines.groupBy(doc).agg(F.sum(F.col(qty) * F.col(price)).alias("total"),
                                  F.count(F.lit(1)).alias("n_lines"))


# ------------------------------------------------------------------- D9
def apply_stock(drugs: DataFrame, mov: DataFrame, batch_expiry: DataFrame | None = None) -> DataFrame:
    """New drug snapshot with ``stok + Σin − Σout`` and expiry moved to
    the earliest of the current and the newly purchased batches' expiry.

    ``mov`` has ``obat_kode, qty_in, qty_out``; ``batch_expiry`` has
    ``obat_kode, expired_date`` of purchased batches.  Movements are
    pre-aggregated per drug before the join.
    """
    d = mov.groupBy("obat_kode").agg(
        (F.sum("qty_in").cast("long") - F.sum("qty_out").cast("long")).alias("__delta"))
    out = drugs.join(d.withColumnRenamed("obat_kode", "kode"), "kode", "left")
    out = out.withColumn("stok", (F.col("stok") + F.coalesce(F.col("__delta"), F.lit(0))).cast("int")) \
             .drop("__delta")
    if batch_expiry is not None:
        e = batch_expiry.groupBy(F.col("obat_kode").alias("kode")).agg(F.min("expired_date").alias("__exp"))
        out = out.join(e, "kode", "left") \
                 .withColumn("expired_date", F.least(F.col("expired_date"), F.col("__exp"))).drop("__exp")
    return out


# ------------------------------------------------------------------ D12
def controlled_flag(lines: DataFrame, drugs: DataFrame, doc: str = "penjualan_id") -> DataFrame:
    """Per sale, true when any line's drug is a controlled class."""
    d = drugs.select(F.col("kode").alias("obat_kode"),
                     F.col("golongan").isin(*model.CONTROLLED).alias("__c"))
    j = lines.select(doc, "obat_kode").join(d, "obat_kode")
    return j.groupBy(doc).agg(F.bool_or("__c").alias("narkotika_psikotropika"))


def delta_col() -> Column:
    return F.col("qty_in") - F.col("qty_out")
