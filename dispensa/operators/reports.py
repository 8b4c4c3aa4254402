"""Read-only reports: day KPIs, period and daily sales, sales by type, best
sellers, purchase list / report / totals, payables, sale detail, expiry watch.

Date filters on ``timestamp_ntz`` columns are written as half-open timestamp
ranges (``ts >= day0 AND ts < day1+1``), which equal ``DATE(ts) BETWEEN day0
AND day1`` and reach the Parquet scan as pushed filters.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispensa import model
from dispensa.functions.scalars import clamp, enum_position, money_out, page_offset
from dispensa.plans.prefix import number_rows

Day = str | dt.date


def _d(x: Day) -> dt.date:
    return dt.date.fromisoformat(x) if isinstance(x, str) else x


def _ts(day: dt.date) -> Column:
    # zone-free literal: string → timestamp_ntz, folded to a constant
    return F.lit(day.isoformat()).cast("timestamp_ntz")


def ts_on_days(c: str | Column, d_from: Day | None, d_to: Day | None) -> Column:
    """``DATE(c) BETWEEN d_from AND d_to`` (either bound optional) on a timestamp."""
    col = F.col(c) if isinstance(c, str) else c
    cond = F.lit(True)
    if d_from is not None:
        cond = cond & (col >= _ts(_d(d_from)))
    if d_to is not None:
        cond = cond & (col < _ts(_d(d_to) + dt.timedelta(days=1)))
    return cond


def date_between(c: str | Column, d_from: Day | None, d_to: Day | None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    cond = F.lit(True)
    if d_from is not None:
        cond = cond & (col >= F.lit(_d(d_from)))
    if d_to is not None:
        cond = cond & (col <= F.lit(_d(d_to)))
    return cond


# --------------------------------------------------------------------- D1–D5
def day_kpis(sales: DataFrame, purchases: DataFrame, drugs: DataFrame, as_of: Day,
             low_threshold: int = model.LOW_STOCK) -> DataFrame:
    """today's sale count and total, today's purchase total, number of
    low-stock drugs.  One pass per table; the purchase total and low-stock
    count enter as scalar subqueries (global aggregates, one value each)."""
    day = _d(as_of)
    s = sales.filter(ts_on_days("tgl", day, day)).agg(
        F.count(F.lit(1)).alias("today_penjualan_count"),
        money_out(F.coalesce(F.sum("total"), F.lit(0))).alias("today_penjualan_total"))
    p = purchases.filter(F.col("tgl") == F.lit(day)).agg(
        money_out(F.coalesce(F.sum("total"), F.lit(0)))).scalar()
    low = drugs.filter(F.col("stok") <= low_threshold).agg(F.count(F.lit(1))).scalar()
    return s.select("*", p.alias("today_pembelian_total"), low.alias("low_stock_count"))


def sales_7d(sales: DataFrame, as_of: Day) -> DataFrame:
    """Sales per day from ``as_of - 6`` on; no upper bound (as the
    reference); days without sales are absent."""
    start = _d(as_of) - dt.timedelta(days=6)
    return (sales.filter(F.col("tgl") >= _ts(start))
            .groupBy(F.to_date("tgl").alias("d"))
            .agg(money_out(F.sum("total")).alias("total"))
            .orderBy("d"))


def purchases_7d(purchases: DataFrame, as_of: Day) -> DataFrame:
    """Purchases per day from ``as_of - 6`` on (DATE column)."""
    start = _d(as_of) - dt.timedelta(days=6)
    return (purchases.filter(F.col("tgl") >= F.lit(start))
            .groupBy(F.col("tgl").alias("d"))
            .agg(money_out(F.sum("total")).alias("total"))
            .orderBy("d"))


def _period(d_from: Day | None, d_to: Day | None, as_of: Day) -> tuple[dt.date, dt.date]:
    today = _d(as_of)
    return (_d(d_from) if d_from else today.replace(day=1)), (_d(d_to) if d_to else today)


def sales_summary(sales: DataFrame, d_from: Day | None, d_to: Day | None, as_of: Day) -> DataFrame:
    """D3: count and total of sales in the period, both days inclusive;
    default period is the first of the month to today."""
    a, b = _period(d_from, d_to, as_of)
    return sales.filter(ts_on_days("tgl", a, b)).agg(
        F.count(F.lit(1)).alias("trx"), money_out(F.coalesce(F.sum("total"), F.lit(0))).alias("total"))


def sales_by_day(sales: DataFrame, d_from: Day | None, d_to: Day | None, as_of: Day) -> DataFrame:
    """Count and total per day, ascending."""
    a, b = _period(d_from, d_to, as_of)
    return (sales.filter(ts_on_days("tgl", a, b))
            .groupBy(F.to_date("tgl").alias("tgl"))
            .agg(F.count(F.lit(1)).alias("trx"), money_out(F.sum("total")).alias("total"))
            .orderBy("tgl"))


def sales_by_type(sales: DataFrame, d_from: Day | None, d_to: Day | None, as_of: Day) -> DataFrame:
    """Count and total per sale type, in the type's declaration order
    (OTC, Resep, Racik), not alphabetical."""
    a, b = _period(d_from, d_to, as_of)
    g = (sales.filter(ts_on_days("tgl", a, b))
         .groupBy("jenis")
         .agg(F.count(F.lit(1)).alias("trx"), money_out(F.sum("total")).alias("total")))
    return g.orderBy(enum_position("jenis", model.JENIS), "jenis")


# ------------------------------------------------------------------------ D6
def top_sellers(sales: DataFrame, items: DataFrame, drugs: DataFrame, d_from: Day | None,
                d_to: Day | None, as_of: Day, n: int = 10) -> DataFrame:
    """D6 + C1: per drug, quantity and revenue of sale lines whose sale falls
    in the period; top ``n`` by quantity (code breaks ties; ``n`` is clamped).

    Plan: sale ids of the period semi-join the lines; lines are aggregated
    per drug *before* meeting the drug table (partial aggregation map-side),
    so the drug join sees one row per drug; ``TakeOrderedAndProject`` ends it.
    """
    a, b = _period(d_from, d_to, as_of)
    sale_ids = sales.filter(ts_on_days("tgl", a, b)).select(F.col("id").alias("penjualan_id"))
    lines = items.select("penjualan_id", "obat_kode", "qty", "harga_jual") \
                 .join(sale_ids, "penjualan_id", "left_semi")
    per_drug = lines.groupBy("obat_kode").agg(
        F.sum("qty").cast("long").alias("qty"),
        F.sum(F.col("qty") * F.col("harga_jual")).alias("omzet"))
    named = per_drug.join(drugs.select(F.col("kode").alias("obat_kode"), "nama"), "obat_kode")
    return (named.select("obat_kode", "nama", "qty", money_out("omzet").alias("omzet"))
            .orderBy(F.desc("qty"), "obat_kode").limit(clamp(n, *model.LIMIT_TOP)))


def top_sellers_7d(sales: DataFrame, items: DataFrame, drugs: DataFrame, as_of: Day,
                   n: int = 5) -> DataFrame:
    """D6 dashboard form: the seven days up to and including ``as_of``."""
    day = _d(as_of)
    return top_sellers(sales, items, drugs, day - dt.timedelta(days=6), day, day, n)


# ------------------------------------------------------------- F2, F3, B7
def recent_sales(sales: DataFrame, n: int = 5) -> DataFrame:
    """the newest ``n`` sales by id."""
    return sales.select("id", "no_nota", money_out("total").alias("total"), "tgl") \
                .orderBy(F.desc("id")).limit(n)


def low_stock(drugs: DataFrame, threshold: int = model.LOW_STOCK) -> DataFrame:
    """Drugs with ``stok <= threshold``."""
    return drugs.filter(F.col("stok") <= threshold)


def lowest_stock(drugs: DataFrame, threshold: int = model.LOW_STOCK, n: int = 5) -> DataFrame:
    """the ``n`` lowest low-stock drugs, stock ascending then name (code breaks ties)."""
    return (low_stock(drugs, threshold).select("kode", "nama", "stok")
            .orderBy("stok", F.lower("nama"), "kode").limit(n))


# ------------------------------------------------------------ C2, B12, J4
def payable_status(saldo: str | Column) -> Column:
    """Open (HUTANG) when the balance is positive, else paid (LUNAS)."""
    c = F.col(saldo) if isinstance(saldo, str) else saldo
    return F.when(F.coalesce(c, F.lit(0)) > 0, model.PAYABLE_OPEN).otherwise(model.PAYABLE_PAID)


def purchase_list(purchases: DataFrame, payables: DataFrame, limit: int, page) -> DataFrame:
    """Purchases with their payable balance (left join; several payables
    of one purchase repeat it), newest first, one page."""
    limit = clamp(limit, *model.LIMIT_LIST)
    h = payables.select(F.col("pembelian_id"), F.col("saldo").alias("h_saldo"))
    # every purchase gives a row at least: only the newest ones can be on the page
    purchases = purchases.orderBy(F.desc("id")).limit(page_offset(limit, page) + limit)
    j = purchases.join(h, purchases.id == h.pembelian_id, "left")
    saldo = F.coalesce(F.col("h_saldo"), F.lit(0))
    out = j.select("id", "no_faktur", "tgl", "supplier_kode", money_out("pajak").alias("pajak"),
                   money_out("total").alias("total"), money_out(saldo).alias("saldo"),
                   payable_status("h_saldo").alias("status"))
    return out.orderBy(F.desc("id"), "saldo").offset(page_offset(limit, page)).limit(limit)


def purchase_report(purchases: DataFrame, items: DataFrame, d_from: Day | None = None,
                    d_to: Day | None = None, supplier: str | None = None) -> DataFrame:
    """C3 + B6: purchase lines with their header; the date range applies only
    when both bounds are given, the supplier only when given; by date, id."""
    p = purchases
    if d_from and d_to:
        p = p.filter(date_between("tgl", d_from, d_to))
    if supplier:
        p = p.filter(F.col("supplier_kode") == supplier)
    i = items.select(F.col("id").alias("item_id"), "pembelian_id", "obat_kode", "batch_no", "qty", "harga_beli")
    j = p.join(i, p.id == i.pembelian_id)
    return j.select("id", "no_faktur", "tgl", "supplier_kode", money_out("pajak").alias("pajak"),
                    money_out("total").alias("total"), "item_id", "obat_kode", "batch_no", "qty",
                    money_out("harga_beli").alias("harga_beli"),
                    money_out(F.col("qty") * F.col("harga_beli")).alias("subtotal")) \
            .orderBy("tgl", "id", "item_id")


def purchase_totals(items: DataFrame) -> DataFrame:
    """Line subtotals (``level`` 0), invoice totals (1) and the report
    total (3).  A line's subtotal is a projection; invoices add up lines, the
    report adds up invoices."""
    line = items.select("pembelian_id", F.col("id").alias("item_id"), F.lit(0).alias("level"),
                        F.lit(1).cast("long").alias("n_lines"), F.col("qty").cast("long").alias("qty"),
                        (F.col("qty") * F.col("harga_beli")).alias("subtotal"))
    add = [F.sum(c).alias(c) for c in ("n_lines", "qty", "subtotal")]
    none = F.lit(None).cast(line.schema["item_id"].dataType)
    invoice = line.groupBy("pembelian_id").agg(*add)
    whole = invoice.agg(*add)
    cols = ["pembelian_id", "item_id", "level", "n_lines", "qty", money_out("subtotal").alias("subtotal")]
    return line.select(*cols) \
        .unionByName(invoice.withColumn("item_id", none).withColumn("level", F.lit(1)).select(*cols)) \
        .unionByName(whole.withColumn("pembelian_id", F.lit(None).cast(line.schema["pembelian_id"].dataType))
                     .withColumn("item_id", none).withColumn("level", F.lit(3)).select(*cols))


def payables_report(payables: DataFrame, purchases: DataFrame, supplier: str | None = None,
                    open_only: bool = True) -> DataFrame:
    """C4: payables with their purchase, ``tagihan = total + pajak``; open
    ones only unless ``open_only`` is False; by purchase date, payable id."""
    h = payables
    if supplier:
        h = h.filter(F.col("supplier_kode") == supplier)
    if open_only:
        h = h.filter(F.col("saldo") > 0)
    p = purchases.select(F.col("id").alias("p_id"), "no_faktur", "tgl", "total", "pajak")
    j = h.join(p, h.pembelian_id == p.p_id)
    return j.select("id", "supplier_kode", "no_faktur", "tgl",
                    money_out(F.col("total") + F.col("pajak")).alias("tagihan"),
                    money_out("saldo").alias("saldo")).orderBy("tgl", "id")


# ----------------------------------------------------------------- C5, D10
def nest(headers: DataFrame, lines: DataFrame, key: str, order: str, fields: list[str],
         name: str = "items", header_key: str = "id") -> DataFrame:
    """One row per header with its lines as an array of structs sorted by
    ``order``.  The lines of one header are a document (bounded); lines are
    grouped per key with ``collect_list`` and sorted inside the array."""
    st = F.struct(F.col(order).alias("__o"), *[F.col(f) for f in fields])
    g = lines.groupBy(F.col(key).alias("__k")).agg(F.sort_array(F.collect_list(st)).alias(name))
    g = g.withColumn(name, F.transform(name, lambda x: x.dropFields("__o")))
    j = headers.join(g, headers[header_key] == g["__k"], "left").drop("__k")
    return j.withColumn(name, F.coalesce(F.col(name), F.array().cast(g.schema[name].dataType)))


def sale_detail(sales: DataFrame, items: DataFrame, drugs: DataFrame) -> DataFrame:
    """Each sale with its lines (drug name joined), lines in id order."""
    d = drugs.select(F.col("kode").alias("obat_kode"), F.col("nama").alias("obat_nama"))
    li = items.join(d, "obat_kode").select(F.col("id").alias("item_id"), "penjualan_id", "obat_kode",
                                            "obat_nama", "batch_no", "qty", "harga_jual", "dosis", "etiket")
    hdr = sales.select("id", "no_nota", "tgl", "jenis", "pelanggan_kode", "dokter_sip",
                       "narkotika_psikotropika", "total")
    return nest(hdr, li, "penjualan_id", "item_id",
                ["item_id", "obat_kode", "obat_nama", "batch_no", "qty", "harga_jual", "dosis", "etiket"])


def purchase_detail(purchases: DataFrame, items: DataFrame) -> DataFrame:
    """Each purchase with its lines, in id order (none: an empty array)."""
    li = items.select(F.col("id").alias("item_id"), "pembelian_id", "obat_kode", "batch_no", "expired_date",
                      "qty", "harga_beli")
    return nest(purchases, li, "pembelian_id", "item_id",
                ["obat_kode", "batch_no", "expired_date", "qty", "harga_beli"])


def payable_detail(payables: DataFrame, paid: DataFrame) -> DataFrame:
    """Each payable with its posted payments as numbered rows (``pos``
    from 0, in id order; without payments one row with a null ``pos``).  A
    payable may hold any share of all payments, so they are not gathered into
    an array."""
    rows = number_rows(paid.select(F.col("id").alias("bayar_id"), "hutang_id", "tgl", "nominal", "metode", "keterangan"),
                       ["bayar_id"], name="pos", keys=["hutang_id"], start=0)
    return payables.join(rows, payables["id"] == rows["hutang_id"], "left").drop("hutang_id")


# ---------------------------------------------------------------- C6, B11
def expiry_status(days_left: str | Column, days: int) -> Column:
    """Expired (< 0), near (<= days) or safe."""
    c = F.col(days_left) if isinstance(days_left, str) else days_left
    return (F.when(c < 0, model.EXPIRY_EXPIRED).when(c <= days, model.EXPIRY_NEAR)
            .otherwise(model.EXPIRY_SAFE))


def expiry_watch(batches: DataFrame, drugs: DataFrame, as_of: Day, days: int = 30) -> DataFrame:
    """Purchased batches expiring by ``as_of + days`` (already expired and
    sold-out batches included), with days left and status, by expiry date."""
    today, days = _d(as_of), clamp(days, *model.EXPIRY_DAYS)
    b = batches.filter(F.col("expired_date") <= F.lit(today + dt.timedelta(days=days)))
    d = drugs.select(F.col("kode").alias("obat_kode"), "nama")
    j = b.join(d, "obat_kode")
    left = F.datediff(F.col("expired_date"), F.lit(today)).cast("long")
    return j.select(F.col("id").alias("item_id"), "obat_kode", "batch_no", "nama", "expired_date",
                    left.alias("sisa_hari"), expiry_status(left, days).alias("status")) \
            .orderBy("expired_date", "item_id")
