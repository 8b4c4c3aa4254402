"""Work that grows no faster than the input: rounds read rows in doubt only,
offsets, verdicts and pair tables are not sent whole through the driver."""

import datetime as dt

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispensa.operators import admission, payments, posting, quality
from dispensa.plans.prefix import running_sums

AS_OF = dt.date(2024, 5, 1)


def _plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def round_rows(monkeypatch):
    """Rows written by each round of a fixpoint, by module."""
    rows = []

    def watched(module):
        real = module.materialize_observed

        def wrote(df, name, metrics):
            out, m = real(df, name, metrics)
            rows.append(out.count())
            return out, m
        monkeypatch.setattr(module, "materialize_observed", wrote)
        return rows
    return watched


def _sales(spark, n_free: int, chain: int):
    """``n_free`` sales of plenty of stock and a chain of sales, each undecided
    until the one before is decided."""
    drugs = spark.createDataFrame(
        [("free", "F", 10**8, None, "OTC")] + [(f"d{i}", f"D{i}", 10, None, "OTC") for i in range(chain + 1)],
        "kode string, nama string, stok int, expired_date date, golongan string")
    lines = [(i, 0, "free", 1) for i in range(1, n_free + 1)]
    for i in range(chain):
        lines += [(n_free + 1 + i, 0, f"d{i}", 6), (n_free + 1 + i, 1, f"d{i + 1}", 6)]
    lines = spark.createDataFrame(lines, "req_id long, pos int, obat_kode string, qty int")
    headers = lines.select("req_id").distinct().selectExpr(
        "req_id", "concat('N', req_id) AS no_nota", "'2024-05-01 00:00:00' AS tgl", "'OTC' AS jenis",
        "'c' AS pelanggan_kode", "'s' AS dokter_sip")
    cust = spark.createDataFrame([], "kode string, alergi string")
    inter = spark.createDataFrame([], "obat1_kode string, obat2_kode string, tingkat string")
    return headers, lines, drugs, cust, inter


def test_decided_rows_are_not_read_again(spark, round_rows):
    wrote = round_rows(admission)
    out = admission.admit_sales(*_sales(spark, 2000, 4), AS_OF, mode="sequential").collect()
    chain = {r.req_id - 2000: r for r in out if r.req_id > 2000}
    assert {k: r.accepted for k, r in chain.items()} == {1: True, 2: False, 3: True, 4: False}
    assert {k: r.n_stock_errors for k, r in chain.items()} == {1: 0, 2: 1, 3: 0, 4: 1}
    assert all(r.accepted for r in out if r.req_id <= 2000)
    assert len(wrote) > 1 and max(wrote) <= 8


@pytest.mark.parametrize("rows", [0, 1 << 18])
def test_stock_errors_with_and_without_blocks(spark, monkeypatch, rows):
    """A refused sale's errors count each of its lines against the stock left
    by the sales accepted before it, over blocks as well."""
    from dispensa.plans import prefix
    monkeypatch.setattr(prefix, "WINDOW_ROWS", rows)
    monkeypatch.setattr(admission, "WINDOW_ROWS", rows, raising=False)
    drugs = spark.createDataFrame([("a", "A", 10, None, "OTC"), ("b", "B", 9, None, "OTC")],
                                  "kode string, nama string, stok int, expired_date date, golongan string")
    data = [(1, "a", 6), (2, "a", 3), (2, "a", 7), (2, "b", 9), (3, "a", 4), (3, "b", 9), (4, "b", 1), (5, "a", 1)]
    lines = spark.createDataFrame([(r, i, k, q) for i, (r, k, q) in enumerate(data)],
                                  "req_id long, pos int, obat_kode string, qty int")
    headers, _, _, cust, inter = _sales(spark, 5, 0)
    got = admission.admit_sales(headers, lines, drugs, cust, inter, AS_OF, mode="sequential").collect()
    assert {r.req_id: (r.accepted, r.n_stock_errors) for r in got} == {
        1: (True, 0), 2: (False, 1), 3: (True, 0), 4: (False, 1), 5: (False, 1)}


def test_block_offsets_do_not_grow_with_the_keys(spark):
    """Only keys that go on in a further block have an offset: sent to all
    tasks, the rows are not shuffled for a join."""
    n = 400
    df = spark.range(n).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    out = running_sums(df, ["k"], ["id"], {"s": F.col("id")}, blocks=4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in _plan(out)
        got = {r.id: r.s for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    sums, want = {}, {}
    for i in range(n):
        k = i % 50 if i % 3 else None
        want[i] = sums[k] = sums.get(k, 0) + i
    assert got == want


def test_payment_verdicts_stay_with_their_rows(spark):
    due = spark.sql("SELECT * FROM VALUES (1L, 10.0BD), (2L, 5.0BD) AS t(id, saldo)")
    pays = spark.sql("SELECT * FROM VALUES (1L, 1L, 8.0BD), (2L, 1L, 3.0BD), (3L, 1L, 2.0BD), (4L, 2L, -1.0BD), "
                     "(5L, 9L, 1.0BD), (6L, 2L, 5.0BD) AS t(id, hutang_id, nominal)") \
        .withColumn("tgl", F.lit(AS_OF))
    out, left = payments.post_payments(due, pays)
    assert "Join" not in _plan(out)
    got = {r.id: (r.accepted, r.error is None, r.saldo_after) for r in out.collect()}
    assert {k: v[:2] for k, v in got.items()} == {1: (True, True), 2: (False, False), 3: (True, True),
                                                 4: (False, False), 5: (False, False), 6: (True, True)}
    assert [got[i][2] for i in (1, 2, 3, 6)] == [2, 2, 0, 0] and got[4][2] is None and got[5][2] is None
    assert {r.id: r.saldo for r in left.collect()} == {1: 0, 2: 0}


def test_requested_pairs_are_not_broadcast(spark):
    req = spark.range(40).selectExpr("id", "concat('a', id % 20) AS obat1_kode", "'b' AS obat2_kode",
                                     "'major' AS tingkat", "NULL AS keterangan")
    out = quality.admit_interactions(req)
    assert "BroadcastHashJoin" not in _plan(out)
    assert {r.id: r.accepted for r in out.collect()} == {i: i < 20 for i in range(40)}


def test_first_failing_purchase_line_needs_no_sort(spark):
    hdr = spark.createDataFrame([(1, "X", "2024-02-01", "s", "0", None)],
                                "req_id long, no_faktur string, tgl string, supplier_kode string, pajak string, "
                                "bayar decimal(15,2)")
    lines = spark.createDataFrame([(1, 2, "", "B", "", 1, 1.0), (1, 1, "d", "B", "", 0, -1.0), (1, 0, "d", "B", "", 1, 1.0)],
                                  "req_id long, pos int, obat_kode string, batch_no string, expired_date string, "
                                  "qty int, harga_beli double")
    plans = []
    real = admission.materialize
    admission.materialize = lambda df, name: (plans.append(_plan(df)), real(df, name))[1]
    try:
        v, _ = admission.admit_purchases(hdr, lines, spark.sql("SELECT 's' AS kode"), spark.sql("SELECT 'd' AS kode"), AS_OF)
    finally:
        admission.materialize = real
    assert not any("SortAggregate" in p for p in plans)
    assert v.collect()[0].errors[0].field == "items.1"


def test_numbered_movements_are_not_numbered_again(spark, monkeypatch):
    calls = []
    real = posting.number_rows
    monkeypatch.setattr(posting, "number_rows", lambda *a, **k: (calls.append(a[1]), real(*a, **k))[1])
    ok = spark.sql("SELECT 1L AS req_id, true AS accepted, date'2024-05-01' AS tgl_eff")
    hdr = spark.sql("SELECT 1L AS req_id, 'X' AS no_faktur, 's' AS supplier_kode, '0' AS pajak, 0.0BD AS bayar")
    lines = spark.sql("SELECT * FROM VALUES (1L, 0, 'a', 3), (1L, 1, 'b', 2), (1L, 2, 'a', 4) AS t(req_id, pos, obat_kode, qty)") \
        .selectExpr("*", "'B' AS batch_no", "date'2025-01-01' AS expired_date", "1.0BD AS harga_beli")
    drugs = spark.sql("SELECT 'a' AS kode, 0 AS stok, date'2025-01-01' AS expired_date")
    led = spark.sql("SELECT 7L AS id, 'a' AS obat_kode, 10L AS saldo")
    stored = spark.sql("SELECT 40L AS id")
    out = posting.post_purchases(ok, hdr, lines, drugs, led, spark.sql("SELECT 1L AS id"), AS_OF, purchase_lines=stored)
    got = sorted((r.id, r.line_id, r.obat_kode, r.saldo) for r in out["stok_kartu"].collect())
    assert got == [(8, 41, "a", 13), (9, 42, "b", 2), (10, 43, "a", 17)]
    assert len(calls) == 1


def _short_stock(spark, n: int, n_drugs: int, stock: int):
    """``n`` sales of two lines that ask for many times the stock, and their replay."""
    import random
    rnd = random.Random(7)
    base = [(r, p, f"d{rnd.randrange(n_drugs)}", rnd.randint(1, 9)) for r in range(1, n + 1) for p in (0, 1)]
    _, _, _, cust, inter = _sales(spark, 1, 0)
    lines = spark.createDataFrame(base, "req_id long, pos int, obat_kode string, qty int")
    headers = lines.select("req_id").distinct().selectExpr(
        "req_id", "concat('N', req_id) AS no_nota", "'2024-05-01 00:00:00' AS tgl", "'OTC' AS jenis",
        "'c' AS pelanggan_kode", "'s' AS dokter_sip")
    drugs = spark.createDataFrame([(f"d{i}", f"D{i}", stock, None, "OTC") for i in range(n_drugs)],
                                  "kode string, nama string, stok int, expired_date date, golongan string")

    def replay(buys=()):
        left, out = {f"d{i}": stock for i in range(n_drugs)}, {}
        for r in range(1, n + 1):
            for b in (b for b in buys if b[0] == r):
                left[b[1]] += b[2]
            mine = [x for x in base if x[0] == r]
            short = sum(left[x[2]] < x[3] for x in mine)
            out[r] = (short == 0, short)
            if not short:
                for x in mine:
                    left[x[2]] -= x[3]
        return out
    return (headers, lines, drugs, cust, inter), replay


def test_scarce_stock_does_not_read_waiting_rows_each_round(spark, monkeypatch, round_rows):
    """Drugs asked for many times their stock: rows far behind wait outside the rounds."""
    monkeypatch.setattr(admission, "SPAN_ROWS", 100, raising=False)
    wrote = round_rows(admission)
    args, replay = _short_stock(spark, 400, 6, 60)
    got = admission.admit_sales(*args, AS_OF, mode="sequential").collect()
    assert {r.req_id: (r.accepted, r.n_stock_errors) for r in got} == replay()
    assert sum(wrote) < 3 * 800


def test_spans_with_purchases_and_reversals(spark, monkeypatch):
    args, replay = _short_stock(spark, 20, 3, 12)
    buys = [(r, f"d{r % 3}", 5) for r in range(1, 21, 4)]
    p = spark.createDataFrame([(*b, None) for b in buys], "req_id long, obat_kode string, qty int, expired_date date")

    def run(span_rows, **more):
        monkeypatch.setattr(admission, "SPAN_ROWS", span_rows, raising=False)
        out = admission.admit_batch(*args, AS_OF, mode="sequential", purchases=p, **more)
        return [sorted(map(tuple, out[k].drop("rounds").collect())) for k in out if out[k] is not None]
    got = {r[0]: (r[1], r[5]) for r in run(10)[0]}
    assert got == replay(buys)
    revs = p.selectExpr("req_id + 7 AS req_id", "obat_kode", "qty")
    assert run(10, reversals=revs) == run(10**9, reversals=revs)
