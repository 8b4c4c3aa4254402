"""The write path on inputs that real batches hold: bad values, blank and
taken numbers, long requests, codes that clash, late files."""

import datetime as dt
import hashlib
import uuid
from decimal import Decimal

from pyspark.sql import functions as F

from dispensa import model
from dispensa.operators import admission, changes, payments, posting, screening
from dispensa.plans.prefix import _blocked, number_rows, running_sums
from dispensa.session import scratch_dir
from dispensa.streaming import streams

DAY = dt.date(2024, 1, 31)
HDR = "req_id long, no_faktur string, tgl string, supplier_kode string, pajak string, bayar decimal(15,2)"
LINE = "req_id long, pos int, obat_kode string, batch_no string, expired_date string, qty string, harga_beli string"


def _tables(spark):
    sup = spark.createDataFrame([("S",)], "kode string")
    drugs = spark.createDataFrame([(k, "n" + k, 5, None, "OTC") for k in ("a", "b", "0")],
                                  "kode string, nama string, stok int, expired_date date, golongan string")
    return sup, drugs


def test_one_bad_value_refuses_its_own_request_only(spark):
    sup, drugs = _tables(spark)
    hdr = spark.createDataFrame([(i, None, t, "S", "0", None) for i, t in enumerate(
        ["2024-01-05", "2024-02-30", None, None, None, "2024-01-05"])], HDR)
    lines = spark.createDataFrame([
        (0, 0, "a", "x", None, "2", "10"), (1, 0, "a", "x", None, "2", "10"), (2, 0, "a", "x", "2025-02-30", "2", "10"),
        (3, 0, "a", "x", None, "abc", "10"), (4, 0, "a", "x", None, "2", "-1"), (5, 0, "a", "x", " ", "3.0", "abc")], LINE)
    v, out = admission.admit_purchases(hdr, lines, sup, drugs, DAY)
    got = {r.req_id: [e.msg for e in r.errors] for r in v.collect()}
    assert got[0] == [] and got[5] == [] and got[4] == [model.MSG_PRICE_NEG] and got[3] == [model.MSG_QTY_MIN]
    assert got[2] == [model.MSG_DATE] and len(got[1]) == 1
    rows = {r.req_id: r for r in out.collect()}
    assert rows[5].qty == 3 and rows[5].harga_beli == 0 and rows[0].expired_date == dt.date(2025, 1, 5)


def test_purchases_post_numbers_lines_and_refusals(spark):
    sup, drugs = _tables(spark)
    blank = [(i, None, "2024-01-05", "S", "0", None) for i in range(9)]
    hdr = spark.createDataFrame(blank + [(20, "OLD", None, "S", "0", None), (21, "NEW", None, "S", "0", None),
                                         (22, "NEW", None, "S", "0", None)], HDR)
    lines = spark.createDataFrame([(i, k, "a", "x", None, "1", "10") for i in (*range(9), 20, 21, 22)
                                   for k in range(150 if i == 3 else 1)], LINE)
    v, lines2 = admission.admit_purchases(hdr, lines, sup, drugs, DAY)
    stored = spark.createDataFrame([("OLD",)], "no_faktur string")
    old_lines = spark.createDataFrame([(1000,)], "id long")
    out = posting.post_purchases(v, hdr, lines2, drugs.withColumn("id", F.lit(1)), spark.createDataFrame([], model.STOK_KARTU),
                                 spark.createDataFrame([], model.HUTANG), DAY, stored, old_lines)
    heads = {r.id: r.no_faktur for r in out["pembelian"].collect()}
    refused = {r.req_id: r.error for r in out["refused"].collect()}
    assert refused[20] == refused[22] == model.MSG_NUMBER_TAKEN and 21 in heads
    assert None not in heads.values() and len(set(heads.values())) == len(heads)
    assert set(heads) | set(refused) == {*range(9), 20, 21, 22} and not set(heads) & set(refused)
    ids = sorted(r.id for r in out["pembelian_item"].collect())
    assert ids == list(range(1001, 1001 + len(ids))) and len(ids) == sum(150 if i == 3 else 1 for i in heads)
    assert {r.pembelian_id for r in out["pembelian_item"].collect()} == set(heads)


def _one_by_one(n, taken, attempts=6):
    """Codes as a loop over requests gives them: time stamp, then two hex digits."""
    used, got = set(taken), {}
    for i in range(n):
        for k in range(attempts):
            h = hashlib.md5(f"{i}:{k}".encode()).hexdigest().upper()
            code = "PB20240105000000" + (h[:2] if k else "")
            if code not in used:
                used.add(code)
                got[i] = code
                break
        else:
            got[i] = None
    return got


def test_codes_equal_one_request_at_a_time(spark):
    n = 400  # far more requests than codes
    req = spark.createDataFrame([(i, None, dt.datetime(2024, 1, 5)) for i in range(n)], "req_id long, no string, ts timestamp_ntz")
    taken = spark.createDataFrame([("PB2024010500000001",), ("PB20240105000000FF",)], "no string")
    out = posting.assign_codes(req, "no", taken, "no", "PB", "YmdHis", "ts")
    assert {r.req_id: r.no for r in out.collect()} == _one_by_one(n, [r.no for r in taken.collect()])
    assert out.filter("no IS NULL AND code_error IS NULL OR no IS NOT NULL AND code_error IS NOT NULL").count() == 0


def test_code_zero_is_blank(spark):
    _, drugs = _tables(spark)
    inter = spark.createDataFrame([], "obat1_kode string, obat2_kode string, tingkat string")
    cust = spark.createDataFrame([("0", "na"), ("c", "na")], "kode string, alergi string")
    hdr = spark.createDataFrame([(1, "OTC", None, None), (2, "OTC", "0", None), (3, "OTC", "c", None), (4, "Resep", None, "0")],
                                "req_id long, jenis string, pelanggan_kode string, dokter_sip string")
    lines = spark.createDataFrame([(1, 0, "0", 1), (2, 0, "a", 1), (3, 0, "a", 1), (4, 0, "a", 1)],
                                  "req_id long, pos int, obat_kode string, qty int")
    got = {r.req_id: r for r in admission.admit_sales(hdr, lines, drugs, cust, inter, DAY).collect()}
    assert not got[1].accepted and got[1].n_line_errors == 1 and got[2].accepted
    assert not got[3].accepted and got[4].stage1_refused
    sales = hdr.select(F.col("req_id").alias("id"), "pelanggan_kode")
    li = lines.select(F.col("req_id").alias("id"), F.col("req_id").alias("penjualan_id"), "obat_kode")
    assert [r.penjualan_id for r in screening.allergy_hits(sales, li, cust, drugs).collect()] == [3]


def test_a_change_with_a_bad_value_ends_nothing(spark):
    base = spark.createDataFrame([("a", 5), ("b", 6)], "kode string, stok int")
    feed = spark.createDataFrame([("a", "update", 1, '{"stok":"abc"}'), ("b", "update", 2, '{"stok":"7"}')],
                                 "kode string, op string, seq long, payload string")
    assert {r.kode: r.stok for r in changes.apply_changes(base, feed, "kode", ["stok"]).collect()} == {"a": None, "b": 7}


def test_payment_keeps_its_fields_and_needs_the_purchase(spark):
    h = spark.createDataFrame([(1, "S", 10, Decimal(100)), (2, "S", 11, Decimal(100))], "id long, supplier_kode string, pembelian_id long, saldo decimal(15,2)")
    pays = spark.createDataFrame([(1, 1, DAY, Decimal(40), "tunai", "x"), (2, 2, DAY, Decimal(40), None, None)],
                                 "id long, hutang_id long, tgl date, nominal decimal(15,2), metode string, keterangan string")
    out, _ = payments.post_payments(h, pays, spark.createDataFrame([(10,)], "id long"))
    got = {r.id: r for r in out.collect()}
    assert got[1].accepted and got[1].metode == "tunai" and got[2].error == model.MSG_PAY_NOT_FOUND


def test_a_late_file_counts(spark):
    src = scratch_dir(spark, f"late-{uuid.uuid4().hex}")
    schema = "id long, tgl timestamp_ntz, total decimal(15,2)"

    def put(*rows):
        spark.createDataFrame([(i, dt.datetime(2024, 1, d), Decimal(t)) for i, d, t in rows], schema).coalesce(1).write.mode("append").parquet(src)

    def run():
        q, _ = streams.daily_sales_stream(spark, src, spark.read.schema(schema).parquet(src).schema, lambda df: df, out)
        q.awaitTermination()
    out = scratch_dir(spark, f"late-out-{uuid.uuid4().hex}")
    put((1, 20, 5), (2, 21, 6), (3, 22, 7))
    run()
    put((4, 2, 8), (5, 22, 1))  # weeks older, and one more of a known day
    run()
    got = {r.tgl.day: (r.trx, int(r.total)) for r in streams.daily_sales_result(spark, out).collect()}
    assert got == {20: (1, 5), 21: (1, 6), 22: (2, 8), 2: (1, 8)}


def test_numbers_spread_over_tasks_whatever_the_values(spark):
    """Names that share eight bytes and ids a million apart are cut alike."""
    names = spark.range(5000).select(F.format_string("page_scan_%08d.jpg", "id").alias("name"), (F.col("id") * 1_000_000).alias("id"))
    for order in ("name", "id"):
        blocked = _blocked(names, [], [order], 6, "b")
        sizes = [r["count"] for r in blocked.groupBy("b").count().collect()]
        assert len(sizes) == 6 and max(sizes) < 0.4 * 5000
        got = number_rows(names, [order], blocks=6).orderBy("id").collect()
        assert [r.rn for r in got] == list(range(1, 5001))


def test_null_keys_are_a_key(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", 1, 7)], "k string, o long, v long")
    got = {(r.k, r.o): r.s for r in running_sums(df, ["k"], ["o"], {"s": F.col("v")}, blocks=3).collect()}
    assert got == {(None, 1): 5, (None, 2): 11, ("a", 1): 7}


def test_joint_reversals_never_oversell(spark):
    """Reversals are judged in order: against what the accepted ones left."""
    import random
    rng = random.Random(5)
    stock = {str(k): rng.randrange(0, 25) for k in range(6)}
    lines = [(i, r, str(rng.randrange(7)), rng.randrange(1, 9)) for i, r in enumerate(
        sorted(rng.randrange(40) for _ in range(90)))]
    drugs = spark.createDataFrame([(k, v) for k, v in stock.items()], "kode string, stok int")
    got = admission.admit_reversals(
        spark.createDataFrame([(r, i, k, q) for i, r, k, q in lines], "req_id long, line_id long, obat_kode string, qty int"),
        drugs).collect()
    left, want = dict(stock), {}
    for r in sorted({x[1] for x in lines}):
        mine = [(k, q) for _, rr, k, q in lines if rr == r]
        short = [k for k, q in mine if left.get(k, 0) < q]
        want[r] = (not short, len(short), short[0] if short else None)
        if not short:
            for k, q in mine:
                left[k] -= q
    assert {x["req_id"]: (x["accepted"], x["n_short"], x["first_short_drug"]) for x in got} == want


def test_sale_error_list(spark):
    """Messages in line order, with the number of line pairs of each."""
    h = spark.sql("SELECT * FROM VALUES (1L, 'OTC', 'P', NULL), (2L, 'Resep', NULL, '0'), (3L, 'OTC', NULL, NULL) "
                  "AS t(req_id, jenis, pelanggan_kode, dokter_sip)").selectExpr("*", "'n' AS no_nota", "'2024-01-01' AS tgl")
    li = spark.createDataFrame([(1, 0, "b", 1), (1, 1, "a", 1), (1, 2, "b", 99), (1, 3, "0", 1), (1, 4, "x", 1), (1, 5, "a", 0),
                                (2, 0, "a", 1)], "req_id long, pos int, obat_kode string, qty int")
    drugs = spark.sql("SELECT * FROM VALUES ('a', 'Aspirin', 5, date'2020-01-01', 'OTC'), ('b', 'Beta', 5, date'2030-01-01', 'OTC') "
                      "AS t(kode, nama, stok, expired_date, golongan)")
    cust = spark.sql("SELECT 'P' AS kode, 'BETA blockers' AS alergi")
    inter = spark.sql("SELECT 'a' AS obat1_kode, 'b' AS obat2_kode, 'major' AS tingkat")
    got = [tuple(r) for r in admission.sale_errors(h, li, drugs, cust, inter, dt.date(2024, 1, 1)).collect()]
    # lines 0, 2 are b and 1, 5 are a: b-a three times, a-b once
    assert sorted(got, key=str) == sorted([
        (1, "items.0", 0, "Alergi pasien terdeteksi", 1), (1, "items.2", 0, "Stok tidak cukup", 1),
        (1, "items.2", 1, "Alergi pasien terdeteksi", 1), (1, "items.1", 0, "Obat kadaluarsa", 1),
        (1, "items.1", 1, "Alergi pasien terdeteksi", 1), (1, "items.3", 0, "obat_kode/qty tidak valid", 1),
        (1, "items.4", 0, "Obat tidak ditemukan", 1), (1, "items.5", 0, "obat_kode/qty tidak valid", 1),
        (1, "interaksi", None, "Interaksi b-a: major", 3), (1, "interaksi", None, "Interaksi a-b: major", 1),
        (2, "dokter_sip", 0, "Wajib untuk resep/racik", 1), (3, "items", 0, "items wajib diisi", 1)], key=str)
