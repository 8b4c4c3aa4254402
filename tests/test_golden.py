"""Golden tests on the rows of the reference's own data dump (FIXTURES.md §2)."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from dispensa import model
from dispensa.operators import ledger, reports

D = Decimal

DRUGS = [  # kode, nama, harga, stok, expired_date
    ("31", "ANTIMO", D("100000.00"), 8, dt.date(2025, 9, 9)),
    ("-", "AMLODIPIN", D("2000.00"), 194, dt.date(2027, 9, 12)),
    ("OB8FEBDD", "PARACETAMOL", D("2000.00"), 2995, dt.date(2026, 9, 16)),
    ("OB58C8E5", "AMLODIPIN", D("10000.00"), 400, dt.date(2025, 9, 7)),
    ("OB7860CF", "CEFIME", D("1000.00"), 1000, dt.date(2026, 9, 7)),
]
SALES = [  # id, tgl, total
    (1, "2025-09-07 04:54:21", 11), (2, "2025-09-07 05:22:04", 1000), (3, "2025-09-07 05:30:40", 0),
    (4, "2025-09-07 06:01:33", 102000), (5, "2025-09-07 10:41:29", 2000), (6, "2025-09-08 17:02:11", 4000),
    (7, "2025-09-08 17:02:53", 4000), (13, "2025-09-09 00:24:32", 4000), (16, "2025-09-09 00:26:00", 102000),
    (17, "2025-09-09 00:28:52", 2000), (18, "2025-09-09 00:32:19", 100000),
]
LINES = [  # id, sale, drug, qty, price
    (1, 1, "31", 11, 1), (2, 2, "OB8FEBDD", 1, 1000), (3, 3, "31", 1, 0), (4, 4, "31", 1, 100000),
    (5, 4, "OB8FEBDD", 1, 2000), (6, 5, "-", 1, 2000), (7, 6, "OB8FEBDD", 1, 2000), (8, 6, "-", 1, 2000),
    (9, 7, "-", 1, 2000), (10, 7, "OB8FEBDD", 1, 2000), (11, 13, "-", 1, 2000), (12, 13, "OB8FEBDD", 1, 2000),
    (13, 16, "-", 1, 2000), (14, 16, "31", 1, 100000), (15, 17, "-", 1, 2000), (16, 18, "31", 1, 100000),
]
LEDGER = [  # id, drug, out, stored saldo
    (1, "31", 11, -11), (2, "OB8FEBDD", 1, -1), (3, "31", 1, -12), (4, "31", 1, -13), (5, "OB8FEBDD", 1, -2),
    (6, "-", 1, -1), (7, "OB8FEBDD", 1, -3), (8, "-", 1, -2), (9, "-", 1, -3), (10, "OB8FEBDD", 1, -4),
    (11, "-", 1, -4), (12, "OB8FEBDD", 1, -5), (13, "-", 1, -5), (14, "31", 1, -14), (15, "-", 1, -6),
    (16, "31", 1, -15),
]


def _drugs(spark):
    rows = [(i + 1, k, n, None, h, s, e, "OTC", False) for i, (k, n, h, s, e) in enumerate(DRUGS)]
    return spark.createDataFrame(rows, model.OBAT)


def _sales(spark):
    rows = [(i, f"PJ{i}", dt.datetime.fromisoformat(t), "OTC", None, None, False, D(tot).quantize(D("0.01")), None)
            for i, t, tot in SALES]
    return spark.createDataFrame(rows, model.PENJUALAN)


def _lines(spark):
    rows = [(i, s, k, None, q, D(p).quantize(D("0.01")), None, None) for i, s, k, q, p in LINES]
    return spark.createDataFrame(rows, model.PENJUALAN_ITEM)


def _ledger(spark):
    rows = [(i, dt.datetime(2025, 9, 9), k, None, "JUAL", None, 0, q, None, None) for i, k, q, _ in LEDGER]
    return spark.createDataFrame(rows, model.STOK_KARTU)


def test_running_balance_equals_stored(spark):
    out = ledger.ledger_balance(_ledger(spark), order=["id"], ).select("id", "saldo").collect()
    got = {r.id: r.saldo for r in out}
    assert got == {i: s for i, _, _, s in LEDGER}


def test_running_balance_small_blocks(spark):
    # blocks of 2 ids force several blocks per drug; result must not change
    from dispensa.plans.prefix import running_sums
    mov = _ledger(spark).drop("saldo")
    out = running_sums(mov, ["obat_kode"], ["id"], {"saldo": -F.col("qty_out").cast("long")}, blocks=2)
    assert {r.id: r.saldo for r in out.collect()} == {i: s for i, _, _, s in LEDGER}


def test_header_totals(spark):
    t = ledger.doc_totals(_lines(spark), "penjualan_id").collect()
    assert {r.penjualan_id: r.total for r in t} == {i: D(tot) for i, _, tot in SALES}


def test_daily_sales_and_summary(spark):
    s = _sales(spark)
    rows = reports.sales_by_day(s, "2025-09-07", "2025-09-09", "2025-09-09").collect()
    assert [(str(r.tgl), r.trx, r.total) for r in rows] == [
        ("2025-09-07", 5, 105011.0), ("2025-09-08", 2, 8000.0), ("2025-09-09", 4, 208000.0)]
    summ = reports.sales_summary(s, "2025-09-07", "2025-09-09", "2025-09-09").collect()[0]
    assert (summ.trx, summ.total) == (11, 321011.0)


def test_best_sellers(spark):
    rows = reports.top_sellers(_sales(spark), _lines(spark), _drugs(spark), "2025-09-07", "2025-09-09",
                               "2025-09-09", n=10).collect()
    assert [(r.obat_kode, r.qty, r.omzet) for r in rows] == [
        ("31", 15, 300011.0), ("-", 6, 12000.0), ("OB8FEBDD", 5, 9000.0)]


def test_latest_five_sales(spark):
    assert [r.id for r in reports.recent_sales(_sales(spark)).collect()] == [18, 17, 16, 13, 7]


def test_latest_balance(spark):
    led = ledger.ledger_balance(_ledger(spark), order=["id"])
    got = {r.obat_kode: r.saldo for r in ledger.latest_balance(led).collect()}
    assert got == {"31": -15, "-": -6, "OB8FEBDD": -5}
