"""B10 parameter clamping and F1 page offsets (plain Python)."""

from dispensa import model
from dispensa.functions.scalars import clamp, page_offset


def test_clamp_like_an_int_cast():
    d, lo, hi = model.LIMIT_LIST
    assert clamp(None, d, lo, hi) == 20
    assert clamp("500", d, lo, hi) == 200
    assert clamp("0", d, lo, hi) == 1
    assert clamp("abc", d, lo, hi) == 1        # non-numeric text casts to 0, then clamps to 1
    assert clamp(" 37rows", d, lo, hi) == 37   # leading digits are read
    assert clamp(-3, *model.EXPIRY_DAYS) == 1
    assert clamp(400, *model.EXPIRY_DAYS) == 365


def test_page_offset():
    assert page_offset(20, None) == 0
    assert page_offset(20, "3") == 40
    assert page_offset(50, 0) == 0


def test_reports_clamp_their_parameters(spark):
    """Limits and days beyond their bounds read as the bounds."""
    import datetime as dt
    from dispensa.operators import ledger, reports
    day = dt.date(2024, 5, 1)
    drugs = spark.range(300).selectExpr("cast(id as string) AS kode", "cast(id as string) AS nama", "1 AS stok",
                                        "date'2024-01-01' AS expired_date")
    sales = spark.sql("SELECT 1L AS id, timestamp_ntz'2024-05-01 10:00:00' AS tgl")
    lines = spark.range(300).selectExpr("1L AS penjualan_id", "cast(id as string) AS obat_kode", "1 AS qty", "1.0BD AS harga_jual")
    assert reports.top_sellers(sales, lines, drugs, day, day, day, n=1000).count() == 100
    assert reports.top_sellers(sales, lines, drugs, day, day, day, n="x").count() == 1
    batches = spark.range(800).selectExpr("id", "'1' AS obat_kode", "'b' AS batch_no",
                                          "date_add(date'2024-05-01', cast(id as int)) AS expired_date")
    assert reports.expiry_watch(batches, drugs, day, days=9999).count() == 366
    card = spark.range(700).selectExpr("id", "'1' AS obat_kode")
    assert ledger.stock_cards(drugs, card, limit=9999, page="0").count() == 500
    assert ledger.stock_cards(drugs, card, limit=500, page=2).count() == 200
    buys = spark.range(300).selectExpr("id", "'f' AS no_faktur", "date'2024-05-01' AS tgl", "'s' AS supplier_kode",
                                       "0.0BD AS pajak", "1.0BD AS total")
    due = spark.sql("SELECT 5L AS pembelian_id, 1.0BD AS saldo")
    assert reports.purchase_list(buys, due, limit=5000, page=1).count() == 200


def test_payable_detail_without_payments(spark):
    """A payable without payments keeps one row; positions follow the ids."""
    from dispensa.operators import reports
    due = spark.sql("SELECT * FROM VALUES (1L, 's', 5.0BD), (2L, 's', 6.0BD) AS t(id, supplier_kode, saldo)")
    paid = spark.sql("SELECT * FROM VALUES (9L, 1L, 2.0BD), (4L, 1L, 1.0BD) AS t(id, hutang_id, nominal)") \
        .selectExpr("*", "date'2024-05-01' AS tgl", "'tunai' AS metode", "'x' AS keterangan")
    got = sorted((r["id"], r["pos"], r["bayar_id"], r["metode"]) for r in reports.payable_detail(due, paid).collect()
                 if r["pos"] is not None)
    assert got == [(1, 0, 4, "tunai"), (1, 1, 9, "tunai")]
    assert reports.payable_detail(due, paid).filter("id = 2").select("bayar_id").collect()[0][0] is None
