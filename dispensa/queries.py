"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Inputs are the driver's test tables seen through ``dispensa.sources.testdata``;
every query runs over whole tables.  Parameters (dates, page sizes, top-n)
are the reference's own report parameters.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispensa.functions.scalars import display_number, money_out, unit_price
from dispensa.operators import (admission, changes, ledger, pages, payments, posting, quality, reports,
                                screening, search)
from dispensa.sources import requests as rq
from dispensa.sources import sinks
from dispensa.sources import testdata as td

AS_OF = td.AS_OF
AS_OF_LEDGER = td.AS_OF_LEDGER
# report period used by the period reports: two and a half years up to as_of
PERIOD = (dt.date(1996, 1, 1), AS_OF)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- reports
@register("top_sellers")
def q_top_sellers(spark: SparkSession, d: str) -> DataFrame:
    """Best sellers of the period, top 10 by quantity."""
    return reports.top_sellers(td.penjualan(spark, d), td.penjualan_item(spark, d), td.obat(spark, d),
                               PERIOD[0], PERIOD[1], AS_OF, n=10)


@register("top_sellers_7d")
def q_top_sellers_7d(spark: SparkSession, d: str) -> DataFrame:
    """Dashboard best sellers: the seven days up to as_of, top 5."""
    return reports.top_sellers_7d(td.penjualan(spark, d), td.penjualan_item(spark, d), td.obat(spark, d),
                                  AS_OF, n=5)


@register("sales_summary")
def q_sales_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.sales_summary(td.penjualan(spark, d), PERIOD[0], PERIOD[1], AS_OF)


@register("sales_by_day")
def q_sales_by_day(spark: SparkSession, d: str) -> DataFrame:
    return reports.sales_by_day(td.penjualan(spark, d), PERIOD[0], PERIOD[1], AS_OF)


@register("sales_this_month")
def q_sales_this_month(spark: SparkSession, d: str) -> DataFrame:
    """Daily sales without a period: from the first of the month to as_of (H5)."""
    return reports.sales_by_day(td.penjualan(spark, d), None, None, AS_OF)


@register("top_sellers_clamped")
def q_top_sellers_clamped(spark: SparkSession, d: str) -> DataFrame:
    """Best sellers with a limit beyond the largest one, which is 100."""
    return reports.top_sellers(td.penjualan(spark, d), td.penjualan_item(spark, d), td.obat(spark, d),
                               PERIOD[0], PERIOD[1], AS_OF, n=1000)


@register("sales_by_type")
def q_sales_by_type(spark: SparkSession, d: str) -> DataFrame:
    return reports.sales_by_type(td.penjualan(spark, d), PERIOD[0], PERIOD[1], AS_OF)


@register("sales_7d")
def q_sales_7d(spark: SparkSession, d: str) -> DataFrame:
    return reports.sales_7d(td.penjualan(spark, d), AS_OF)


@register("purchases_7d")
def q_purchases_7d(spark: SparkSession, d: str) -> DataFrame:
    return reports.purchases_7d(td.pembelian(spark, d), AS_OF)


@register("day_kpis")
def q_day_kpis(spark: SparkSession, d: str) -> DataFrame:
    # low-stock threshold 20 on the mapped drugs (stock is p_size * 20)
    return reports.day_kpis(td.penjualan(spark, d), td.pembelian(spark, d), td.obat(spark, d), AS_OF,
                            low_threshold=20)


@register("recent_sales")
def q_recent_sales(spark: SparkSession, d: str) -> DataFrame:
    return reports.recent_sales(td.penjualan(spark, d), n=5)


@register("lowest_stock")
def q_lowest_stock(spark: SparkSession, d: str) -> DataFrame:
    return reports.lowest_stock(td.obat(spark, d), threshold=20, n=5)


@register("purchase_list")
def q_purchase_list(spark: SparkSession, d: str) -> DataFrame:
    """Second page of 200 purchases with payable balance and status."""
    return reports.purchase_list(td.pembelian(spark, d), td.hutang(spark, d), limit=200, page=2)


@register("purchase_report")
def q_purchase_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.purchase_report(td.pembelian(spark, d), td.pembelian_item(spark, d),
                                   dt.date(1995, 1, 1), dt.date(2001, 12, 31), None)


@register("purchase_totals")
def q_purchase_totals(spark: SparkSession, d: str) -> DataFrame:
    return reports.purchase_totals(td.pembelian_item(spark, d))


@register("payables")
def q_payables(spark: SparkSession, d: str) -> DataFrame:
    return reports.payables_report(td.hutang(spark, d), td.pembelian(spark, d), None, open_only=True)


@register("sale_detail")
def q_sale_detail(spark: SparkSession, d: str) -> DataFrame:
    """Every sale with its nested lines, read back as one row per line."""
    sd = reports.sale_detail(td.penjualan(spark, d), td.penjualan_item(spark, d), td.obat(spark, d))
    x = sd.select("id", "no_nota", F.posexplode("items").alias("pos", "it"))
    return x.select("id", "no_nota", "pos", F.col("it.item_id").alias("item_id"),
                    F.col("it.obat_kode").alias("obat_kode"), F.col("it.obat_nama").alias("obat_nama"),
                    F.col("it.qty").alias("qty"),
                    F.round(F.col("it.harga_jual"), 2).cast("double").alias("harga_jual"))


@register("expiry_watch")
def q_expiry_watch(spark: SparkSession, d: str) -> DataFrame:
    return reports.expiry_watch(td.pembelian_item(spark, d), td.obat(spark, d), AS_OF, days=30)


# ------------------------------------------------------- listing and search
@register("drug_search")
def q_drug_search(spark: SparkSession, d: str) -> DataFrame:
    """Keyword search with a live ``_`` wildcard, case-insensitive, first page of 200."""
    r = search.search(td.obat(spark, d), "Re_", limit=200, page=1)
    return r.withColumn("harga", money_out("harga"))


@register("drug_page")
def q_drug_page(spark: SparkSession, d: str) -> DataFrame:
    r = search.list_page(td.obat(spark, d), None, search.name_order(), limit=200, page=3)
    return r.withColumn("harga", money_out("harga"))


@register("purchase_detail")
def q_purchase_detail(spark: SparkSession, d: str) -> DataFrame:
    """Every purchase with its nested lines, read back as one row per line
    (a purchase without lines: one row without a line)."""
    pd = reports.purchase_detail(td.pembelian(spark, d), td.pembelian_item(spark, d))
    x = pd.select("id", "no_faktur", F.posexplode_outer("items").alias("pos", "it"))
    return x.select("id", "no_faktur", "pos", F.col("it.obat_kode").alias("obat_kode"),
                    F.col("it.batch_no").alias("batch_no"), F.col("it.expired_date").alias("expired_date"),
                    F.col("it.qty").alias("qty"), money_out("it.harga_beli").alias("harga_beli"))


@register("supplier_page")
def q_supplier_page(spark: SparkSession, d: str) -> DataFrame:
    return search.list_page(td.supplier(spark, d), ["kode", "nama", "sertifikasi", "alamat", "kontak"],
                            search.name_order(), limit=50, page=2)


@register("customer_page")
def q_customer_page(spark: SparkSession, d: str) -> DataFrame:
    return search.list_page(td.pelanggan(spark, d),
                            ["kode", "nama", "tgl_lahir", "jenis_kelamin", "no_hp", "alamat"],
                            search.name_order(), limit=200, page=2)


@register("sales_list")
def q_sales_list(spark: SparkSession, d: str) -> DataFrame:
    r = search.sales_list(td.penjualan(spark, d), None, "1997-01-01", "1997-12-31", limit=200, page=2)
    return r.withColumn("total", money_out("total"))


@register("row_filter")
def q_row_filter(spark: SparkSession, d: str) -> DataFrame:
    """Stock report rows whose displayed text contains 'psiko'."""
    rows = search.stock_report(td.obat(spark, d))
    return search.row_contains(rows, ["kode", "nama", "golongan", "stok", "expired_date"], "Psiko")


@register("lookup_keys")
def q_lookup_keys(spark: SparkSession, d: str) -> DataFrame:
    """Customer of every sale looked up at once, with a found flag."""
    cust = td.pelanggan(spark, d).select("kode", "nama", "alergi")
    return search.lookup(cust, td.penjualan(spark, d), "kode", "pelanggan_kode")


@register("bulk_lookup")
def q_bulk_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Drugs named by any purchase line (``kode IN (...)``)."""
    r = search.lookup_in(td.obat(spark, d), td.pembelian_item(spark, d), "kode", "obat_kode")
    return r.select("kode", "nama", "stok", "expired_date", "golongan")


@register("stock_report")
def q_stock_report(spark: SparkSession, d: str) -> DataFrame:
    return search.stock_report(td.obat(spark, d))


@register("customer_report")
def q_customer_report(spark: SparkSession, d: str) -> DataFrame:
    return search.customer_report(td.pelanggan(spark, d))


# ------------------------------------------------------------------ ledger
def _ledger(spark: SparkSession, d: str) -> DataFrame:
    return ledger.ledger_balance(td.ledger_movements(spark, d), order=["id"])


@register("ledger_balance")
def q_ledger_balance(spark: SparkSession, d: str) -> DataFrame:
    """Running stock balance of every ledger row (per drug, id order, from 0)."""
    return _ledger(spark, d).select("id", "obat_kode", "ref_type", "qty_in", "qty_out", "saldo")


@register("latest_balance")
def q_latest_balance(spark: SparkSession, d: str) -> DataFrame:
    return ledger.latest_balance(_ledger(spark, d))


@register("stock_card")
def q_stock_card(spark: SparkSession, d: str) -> DataFrame:
    """Second page (20 rows) of every drug's stock card."""
    cards = ledger.stock_cards(td.obat(spark, d), _ledger(spark, d), None, limit=20, page=2)
    return cards.select("obat_kode", "nama", "stok_obat", "obat_expired_date", "row_no", "id", "ref_type",
                        "qty_in", "qty_out", "saldo")


@register("ledger_from_documents")
def q_ledger_from_documents(spark: SparkSession, d: str) -> DataFrame:
    """Purchase (in) and sale (out) lines as one movement table with balances."""
    mov = ledger.movement_union(ledger.purchase_movements(td.pembelian_item(spark, d)),
                                ledger.sale_movements(td.penjualan_item(spark, d)))
    out = ledger.ledger_balance(mov, order=["line_id", "ref_type"])
    return out.select("line_id", "ref_type", "ref_id", "obat_kode", "qty_in", "qty_out", "saldo")


@register("doc_totals")
def q_doc_totals(spark: SparkSession, d: str) -> DataFrame:
    t = ledger.doc_totals(td.penjualan_item(spark, d), "penjualan_id")
    return t.select("penjualan_id", money_out("total").alias("total"), "n_lines")


@register("stock_apply")
def q_stock_apply(spark: SparkSession, d: str) -> DataFrame:
    """Drug snapshot after all purchase and sale lines: stock and earliest expiry."""
    buys = td.pembelian_item(spark, d)
    mov = ledger.movement_union(ledger.purchase_movements(buys), ledger.sale_movements(td.penjualan_item(spark, d)))
    out = ledger.apply_stock(td.obat(spark, d), mov, buys.select("obat_kode", "expired_date"))
    return out.select("kode", "stok", "expired_date")


@register("controlled_flag")
def q_controlled_flag(spark: SparkSession, d: str) -> DataFrame:
    return ledger.controlled_flag(td.penjualan_item(spark, d), td.obat(spark, d))


# ---------------------------------------------------------------- screening
@register("interaction_hits")
def q_interaction_hits(spark: SparkSession, d: str) -> DataFrame:
    """Major and contraindicated drug pairs inside each sale."""
    return screening.interaction_hits(td.penjualan_item(spark, d), td.interaksi(spark, d))


@register("allergy_hits")
def q_allergy_hits(spark: SparkSession, d: str) -> DataFrame:
    return screening.allergy_hits(td.penjualan(spark, d), td.penjualan_item(spark, d),
                                  td.pelanggan(spark, d), td.obat(spark, d))


@register("resolve_codes")
def q_resolve_codes(spark: SparkSession, d: str) -> DataFrame:
    return screening.resolve(td.typed_drug_inputs(spark, d), "obat_input", td.obat(spark, d))


@register("missing_refs")
def q_missing_refs(spark: SparkSession, d: str) -> DataFrame:
    """Typed drug inputs that name no drug code as typed."""
    return screening.missing_refs(td.typed_drug_inputs(spark, d), "obat_input", td.obat(spark, d), "kode")


@register("validate_rows")
def q_validate_rows(spark: SparkSession, d: str) -> DataFrame:
    """Drug insert requests checked with the drug rule set, one row per error."""
    v = quality.validate(td.drug_requests(spark, d), quality.RULES_DRUG)
    x = v.select("id", F.posexplode("errors").alias("pos", "e"))
    return x.select("id", "pos", F.col("e.field").alias("field"), F.col("e.msg").alias("msg"))


@register("validate_masters")
def q_validate_masters(spark: SparkSession, d: str) -> DataFrame:
    """Customer, staff, supplier, doctor and formula insert requests checked
    with their rule sets, one row per error."""
    rules = {"pelanggan": quality.RULES_CUSTOMER, "karyawan": quality.RULES_STAFF,
             "supplier": quality.RULES_SUPPLIER, "dokter": quality.RULES_DOCTOR, "formula": quality.RULES_FORMULA}
    out = None
    for entity, req in td.master_requests(spark, d).items():
        v = quality.validate(req, rules[entity]).select("id", F.posexplode("errors").alias("pos", "e"))
        x = v.select(F.lit(entity).alias("entity"), "id", "pos", F.col("e.field").alias("field"),
                     F.col("e.msg").alias("msg"))
        out = x if out is None else out.unionByName(x)
    return out


@register("admit_interactions")
def q_admit_interactions(spark: SparkSession, d: str) -> DataFrame:
    a = quality.admit_interactions(td.interaction_requests(spark, d))
    return a.select("id", "p1", "p2", "tingkat", "accepted",
                    F.coalesce(F.try_element_at("errors", F.lit(1))["msg"], F.lit("")).alias("error"))


@register("duplicates")
def q_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Batch numbers repeated inside one purchase invoice."""
    return quality.duplicates(td.pembelian_item(spark, d), ["pembelian_id", "batch_no"])


@register("duplicate_keys")
def q_duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    """Values of each declared unique key that several rows hold (codes
    and names of drug requests included)."""
    return quality.duplicate_report({
        "m_obat.kode": (td.obat(spark, d), ["kode"]),
        "m_pelanggan.kode": (td.pelanggan(spark, d), ["kode"]),
        "m_supplier.kode": (td.supplier(spark, d), ["kode"]),
        "m_formula_racik.kode": (td.formula(spark, d), ["kode"]),
        "interaksi_obat.obat1_kode,obat2_kode": (td.interaksi(spark, d), ["obat1_kode", "obat2_kode"]),
        "pembelian.no_faktur": (td.pembelian(spark, d), ["no_faktur"]),
        "penjualan.no_nota": (td.penjualan(spark, d), ["no_nota"]),
        "request.kode": (td.drug_requests(spark, d), ["kode"]),
        "request.nama": (td.drug_requests(spark, d), ["nama"]),
    })


@register("orphans")
def q_orphans(spark: SparkSession, d: str) -> DataFrame:
    drugs, sales, buys = td.obat(spark, d), td.penjualan(spark, d), td.pembelian(spark, d)
    pay = td.hutang(spark, d)
    return quality.orphan_report({
        "penjualan_item.obat_kode": (td.penjualan_item(spark, d), "obat_kode", drugs, "kode"),
        "penjualan_item.penjualan_id": (td.penjualan_item(spark, d), "penjualan_id", sales, "id"),
        "penjualan.pelanggan_kode": (sales, "pelanggan_kode", td.pelanggan(spark, d), "kode"),
        "pembelian_item.obat_kode": (td.pembelian_item(spark, d), "obat_kode", drugs, "kode"),
        "pembelian_item.pembelian_id": (td.pembelian_item(spark, d), "pembelian_id", buys, "id"),
        "pembelian.supplier_kode": (buys, "supplier_kode", td.supplier(spark, d), "kode"),
        "interaksi_obat.obat1_kode": (td.interaksi(spark, d), "obat1_kode", drugs, "kode"),
        "interaksi_obat.obat2_kode": (td.interaksi(spark, d), "obat2_kode", drugs, "kode"),
        "stok_kartu.obat_kode": (td.ledger_movements(spark, d), "obat_kode", drugs, "kode"),
        "hutang_supplier.supplier_kode": (pay, "supplier_kode", td.supplier(spark, d), "kode"),
        "hutang_supplier.pembelian_id": (pay, "pembelian_id", buys, "id"),
        "hutang_supplier_bayar.hutang_id": (td.hutang_bayar(spark, d, pay), "hutang_id", pay, "id"),
    })


@register("out_of_domain")
def q_out_of_domain(spark: SparkSession, d: str) -> DataFrame:
    from dispensa import model
    return quality.domain_report({
        "m_obat.golongan": (td.obat(spark, d), "golongan", model.GOLONGAN),
        "request.golongan": (td.drug_requests(spark, d), "golongan", model.GOLONGAN),
        "penjualan.jenis": (td.penjualan(spark, d), "jenis", model.JENIS),
        "interaksi_obat.tingkat": (td.interaksi(spark, d), "tingkat", model.TINGKAT),
        "stok_kartu.ref_type": (td.ledger_movements(spark, d), "ref_type", model.REF_TYPE),
    })


# ---------------------------------------------------------------- admission
@register("admit_purchases")
def q_admit_purchases(spark: SparkSession, d: str) -> DataFrame:
    """Purchase requests judged; first error per refused request."""
    hdr, lines = td.purchase_requests(spark, d)
    v, _ = admission.admit_purchases(hdr, lines, td.supplier(spark, d), td.obat(spark, d), AS_OF)
    first = F.try_element_at("errors", F.lit(1))
    return v.select("req_id", "accepted", F.size("errors").cast("long").alias("n_errors"),
                    first["field"].alias("error_field"), first["msg"].alias("error_msg"))


@register("default_expiry")
def q_default_expiry(spark: SparkSession, d: str) -> DataFrame:
    """Purchase lines after defaults: blank expiry is the purchase date + 1 year."""
    hdr, lines = td.purchase_requests(spark, d)
    _, out = admission.admit_purchases(hdr, lines, td.supplier(spark, d), td.obat(spark, d), AS_OF)
    return out.select("req_id", "pos", "obat_kode", "expired_date")


def _sales_verdicts(spark: SparkSession, d: str, mode: str) -> DataFrame:
    hdr, lines = td.sale_requests(spark, d)
    return admission.admit_sales(hdr, lines, td.obat(spark, d), td.pelanggan(spark, d), td.interaksi(spark, d),
                                 AS_OF, mode=mode)


@register("admit_sales_snapshot")
def q_admit_sales_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Every sale judged against opening stock: all checks, error counts per kind."""
    return _sales_verdicts(spark, d, "snapshot").drop("rounds")


@register("sale_errors")
def q_sale_errors(spark: SparkSession, d: str) -> DataFrame:
    """The error list of every refused sale, judged against opening stock."""
    hdr, lines = td.sale_requests(spark, d)
    return admission.sale_errors(hdr, lines, td.obat(spark, d), td.pelanggan(spark, d), td.interaksi(spark, d), AS_OF)


def _admitted_purchase_lines(spark: SparkSession, d: str) -> DataFrame:
    hdr, lines = td.purchase_requests(spark, d)
    v, lines2 = admission.admit_purchases(hdr, lines, td.supplier(spark, d), td.obat(spark, d), AS_OF)
    return lines2.join(v.filter("accepted").select("req_id"), "req_id", "left_semi")


@register("admit_mixed_sequential")
def q_admit_mixed_sequential(spark: SparkSession, d: str) -> DataFrame:
    """Sales and admitted purchases in one arrival order (purchase k before sale k):
    purchases add stock and can bring expiry forward for later sales."""
    hdr, lines = td.sale_requests(spark, d)
    v = admission.admit_sales(hdr, lines, td.obat(spark, d), td.pelanggan(spark, d), td.interaksi(spark, d),
                              AS_OF, mode="sequential", purchases=_admitted_purchase_lines(spark, d))
    return v.drop("rounds")


@register("admit_batch_sequential")
def q_admit_batch_sequential(spark: SparkSession, d: str) -> DataFrame:
    """Purchases, sales and reversals of every admitted purchase in one arrival order
    (purchase k and sale k at position k; the reversal of purchase k half the key
    range later): verdicts of sales and reversals."""
    hdr, lines = td.sale_requests(spark, d)
    buys = _admitted_purchase_lines(spark, d)
    # each reversal arrives half the order-key range after its purchase
    shift = td.raw(spark, d, "orders").agg(F.floor((F.max("o_orderkey") + 1) / 2)).scalar()
    revs = buys.select((F.col("req_id") + shift).alias("req_id"), "obat_kode", "qty")
    out = admission.admit_batch(hdr, lines, td.obat(spark, d), td.pelanggan(spark, d), td.interaksi(spark, d),
                                AS_OF, mode="sequential", purchases=buys, reversals=revs)
    sales = out["sales"].select(F.lit("sale").alias("kind"), "req_id", "accepted",
                                F.col("n_stock_errors").alias("n_short"))
    revs = out["reversals"].select(F.lit("reversal").alias("kind"), "req_id", "accepted",
                                   F.col("n_short").cast("long").alias("n_short"))
    return sales.unionByName(revs)


@register("admit_sales_sequential")
def q_admit_sales_sequential(spark: SparkSession, d: str) -> DataFrame:
    """Sales judged one after another in id order (refused sales use no stock)."""
    return _sales_verdicts(spark, d, "sequential").drop("rounds")


# ----------------------------------------------------------------- payments
def _payments(spark: SparkSession, d: str):
    h = td.hutang(spark, d)
    return payments.post_payments(h, td.hutang_bayar(spark, d, h), td.pembelian(spark, d))


@register("post_payments")
def q_post_payments(spark: SparkSession, d: str) -> DataFrame:
    """Payments applied in id order per payable; refused ones change nothing."""
    out, _ = _payments(spark, d)
    return out.select("id", "hutang_id", money_out("nominal").alias("nominal"), "accepted",
                      F.coalesce("error", F.lit("")).alias("error"), money_out("saldo_after").alias("saldo_after"))


@register("payable_balances")
def q_payable_balances(spark: SparkSession, d: str) -> DataFrame:
    _, h = _payments(spark, d)
    return h.select("id", "pembelian_id", money_out("saldo").alias("saldo"))


@register("payable_detail")
def q_payable_detail(spark: SparkSession, d: str) -> DataFrame:
    """Every payable with its accepted payments, numbered in id order."""
    out, h = _payments(spark, d)
    x = reports.payable_detail(h, out.filter("accepted"))
    return x.select("id", "supplier_kode", money_out("saldo").alias("saldo"), F.col("pos").cast("long").alias("pos"),
                    "bayar_id", "tgl", money_out("nominal").alias("nominal"))


# ------------------------------------------------------------------ posting
def _posted_purchases(spark: SparkSession, d: str) -> posting.Tables:
    hdr, lines = td.purchase_requests(spark, d)
    drugs = td.obat(spark, d)
    v, lines2 = admission.admit_purchases(hdr, lines, td.supplier(spark, d), drugs, AS_OF)
    return posting.post_purchases(v, hdr, lines2, drugs, _ledger(spark, d), td.hutang(spark, d), AS_OF)


@register("post_purchases")
def q_post_purchases(spark: SparkSession, d: str) -> DataFrame:
    """Admitted purchases posted: their BELI ledger rows, balances continuing the ledger."""
    led = _posted_purchases(spark, d)["stok_kartu"]
    return led.select("id", "obat_kode", "ref_type", "ref_id", "qty_in", "qty_out", "saldo")


@register("purchase_payables")
def q_purchase_payables(spark: SparkSession, d: str) -> DataFrame:
    """Payables created by posting the admitted purchases (unpaid part of total + tax)."""
    h = _posted_purchases(spark, d)["hutang_supplier"]
    return h.select("id", "pembelian_id", "supplier_kode", money_out("saldo").alias("saldo"))


@register("audit_rows")
def q_audit_rows(spark: SparkSession, d: str) -> DataFrame:
    a = _posted_purchases(spark, d)["audit_log"]
    return a.select("action", "entity", "entity_id", "detail")


def _posted_sales(spark: SparkSession, d: str) -> posting.Tables:
    hdr, lines = td.sale_requests(spark, d)
    drugs = td.obat(spark, d)
    v = admission.admit_sales(hdr, lines, drugs, td.pelanggan(spark, d), td.interaksi(spark, d), AS_OF,
                              mode="sequential")
    return posting.post_sales(v, hdr, lines, drugs, _ledger(spark, d), AS_OF)


@register("post_sales")
def q_post_sales(spark: SparkSession, d: str) -> DataFrame:
    """Sales admitted one after another, posted: drug stock afterwards."""
    return _posted_sales(spark, d)["m_obat"].select("kode", "stok")


@register("post_sales_headers")
def q_post_sales_headers(spark: SparkSession, d: str) -> DataFrame:
    """Headers of the posted sales with total, controlled flag and number of lines."""
    out = _posted_sales(spark, d)
    n = out["penjualan_item"].groupBy(F.col("penjualan_id").alias("id")).agg(F.count("*").alias("n_lines"))
    return out["penjualan"].join(n, "id").select("id", "no_nota", "jenis", "narkotika_psikotropika", "n_lines",
                                                 money_out("total").alias("total"))


@register("reverse_purchases")
def q_reverse_purchases(spark: SparkSession, d: str) -> DataFrame:
    """Reversal of every purchase: refused where a line's drug has less stock than the line."""
    h = td.hutang(spark, d)
    reqs = td.pembelian(spark, d).select(F.col("id").alias("pembelian_id"))
    out = posting.reverse_purchases(reqs, td.pembelian(spark, d), td.pembelian_item(spark, d), td.obat(spark, d),
                                    _ledger(spark, d), h, td.hutang_bayar(spark, d, h), AS_OF)
    return out["verdicts"].select("pembelian_id", "n_lines", "n_short", "first_short_drug", "accepted",
                                  F.coalesce("error", F.lit("")).alias("error"))


@register("assign_codes")
def q_assign_codes(spark: SparkSession, d: str) -> DataFrame:
    """Every customer re-entered without a code: repeatable PL + 6 hex codes."""
    cust = td.pelanggan(spark, d)
    req = cust.select(F.col("id").alias("req_id"), F.lit(None).cast("string").alias("kode"))
    out = posting.assign_codes(req, "kode", cust, "kode", "PL")
    return out.select("req_id", "kode")


# -------------------------------------------------------------- dimensions
@register("change_feed")
def q_change_feed(spark: SparkSession, d: str) -> DataFrame:
    """Drug table after a change feed of updates (absent kept, null written), deletes and inserts."""
    fields = ["nama", "produsen", "harga", "stok", "golongan"]
    out = changes.apply_changes(td.obat(spark, d), td.drug_changes(spark, d), "kode", fields)
    return out.select("kode", "nama", "produsen", money_out("harga").alias("harga"), "stok", "golongan")


@register("customer_change_feed")
def q_customer_change_feed(spark: SparkSession, d: str) -> DataFrame:
    """Customers after updates that set, clear (explicit null) or leave out the allergy."""
    out = changes.apply_changes(td.pelanggan(spark, d), td.customer_changes(spark, d), "kode",
                                ["nama", "alergi", "alamat"])
    return out.select("kode", "nama", "alergi", "alamat")


@register("change_verdicts")
def q_change_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdict of every change of a feed over all seven master tables, a third of it on one key."""
    out = changes.change_verdicts(td.master_changes(spark, d), td.master_tables(spark, d))
    return out.select("entity", "key", "op", "seq", "verdict", "error", "needs_code")


@register("masters_after_changes")
def q_masters_after_changes(spark: SparkSession, d: str) -> DataFrame:
    """Doctors, suppliers and staff after the accepted changes of that feed, one row a field."""
    out = changes.post_changes(td.master_changes(spark, d), td.master_tables(spark, d))
    rows = None
    for entity in ("m_dokter", "m_supplier", "m_karyawan"):
        key = changes.KEY[entity]
        x = out[entity].unpivot(key, changes.ALLOWED_UPDATE[entity], "field", "value") \
                       .select(F.lit(entity).alias("entity"), F.col(key).alias("key"), "field", "value")
        rows = x if rows is None else rows.unionByName(x)
    return rows


@register("cascade_delete")
def q_cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Deletes of the change feed's drugs: refused while referenced, else interactions go too."""
    dels = td.drug_changes(spark, d).filter(F.col("op") == "delete").select("kode")
    out = changes.cascade_delete_drugs(dels, td.obat(spark, d), td.interaksi(spark, d), td.penjualan_item(spark, d),
                                       td.pembelian_item(spark, d), td.ledger_movements(spark, d),
                                       cascade_sale_lines=True)
    return out["verdicts"].select("kode", "found", "n_sale_lines", "n_purchase_lines", "n_ledger_rows", "deleted")


# --------------------------------------------------------- functions and io
@register("json_fields")
def q_json_fields(spark: SparkSession, d: str) -> DataFrame:
    """JSON decode of the events' property documents."""
    e = td.raw(spark, d, "events").select("event_id", "props")
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@register("formula_lines")
def q_formula_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every formula's composition JSON as ingredient rows."""
    return rq.formula_lines(td.formula(spark, d))


@register("request_reader")
def q_request_reader(spark: SparkSession, d: str) -> DataFrame:
    """Sale request bodies parsed into typed lines with their item index."""
    _, lines = rq.read_requests(td.sale_request_bodies(spark, d), rq.SALE_REQUEST)
    return lines.select("req_id", "pos", "obat_kode", "qty", money_out("harga_jual").alias("harga_jual"))


@register("unit_price")
def q_unit_price(spark: SparkSession, d: str) -> DataFrame:
    """Unit price of every purchase line from its line total and quantity."""
    li = td.pembelian_item(spark, d)
    return li.select("id", "qty", money_out("harga_beli").alias("total"),
                     unit_price("harga_beli", "qty").cast("double").alias("unit_price"))


@register("display_number")
def q_display_number(spark: SparkSession, d: str) -> DataFrame:
    """Stock value of every drug written with '.' thousands separators."""
    o = td.obat(spark, d)
    return o.select("kode", display_number(F.round(F.col("stok") * F.col("harga"), 0)).alias("nilai"))


@register("csv_export")
def q_csv_export(spark: SparkSession, d: str) -> DataFrame:
    """Daily sales report written as quoted CRLF CSV, read back as text."""
    import uuid
    from dispensa.session import scratch_dir
    rep = reports.sales_by_day(td.penjualan(spark, d), dt.date(1990, 1, 1), dt.date(2030, 12, 31), AS_OF)
    sums = td.penjualan(spark, d).groupBy(F.to_date("tgl").alias("tgl")).agg(F.sum("total").alias("__t"))
    shown = rep.join(sums, "tgl").select(F.date_format("tgl", "yyyy-MM-dd").alias("Tanggal"),
                                         F.col("trx").alias("Transaksi"),
                                         display_number(F.round("__t", 0)).alias("Total"))
    path = scratch_dir(spark, f"csv-{uuid.uuid4().hex}")
    sinks.export_csv(shown, path, ["Tanggal", "Transaksi", "Total"])
    return sinks.read_csv_export(spark, path)


@register("page_text")
def q_page_text(spark: SparkSession, d: str) -> DataFrame:
    """Page texts of the image files among the recognised documents."""
    return pages.page_text(td.page_lines(spark, d))


@register("page_total")
def q_page_total(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_total(pages.page_text(td.page_lines(spark, d)))


# ---------------------------------------------------------------- streaming
def _orders_to_sales(df: DataFrame) -> DataFrame:
    return df.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("tgl"),
                     F.col("o_totalprice").cast("decimal(15,2)").alias("total"))


def _events_to_movements(df: DataFrame) -> DataFrame:
    rt = (F.when(F.col("event_type").isin("signup", "purchase"), "BELI")
           .when(F.col("event_type") == "error", "KOREKSI").otherwise("JUAL"))
    q = F.floor("value").cast("int")
    return df.select(F.col("event_id").cast("long").alias("id"), F.col("user_id").cast("string").alias("obat_kode"),
                     rt.alias("ref_type"), F.when(rt == "BELI", q).otherwise(0).alias("qty_in"),
                     F.when(rt != "BELI", q).otherwise(0).alias("qty_out"))


@register("stream_ledger")
def q_stream_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Ledger balances computed by a Structured Streaming query over the events source."""
    from dispensa.streaming import streams
    # a glob names the one file as a file-stream source (a deployment points
    # the stream at the directory where new files land)
    src = f"{d.rstrip('/')}/events[.]parquet"
    q, out = streams.ledger_stream(spark, src, td.raw(spark, d, "events").schema, _events_to_movements)
    q.awaitTermination()
    rows = streams.ledger_stream_rows(spark, out)
    return rows.select("id", "obat_kode", "ref_type", "qty_in", "qty_out", "saldo")


@register("stream_daily_sales")
def q_stream_daily_sales(spark: SparkSession, d: str) -> DataFrame:
    """Daily sale count and total added up from the batches of a streaming query."""
    from dispensa.streaming import streams
    src = f"{d.rstrip('/')}/orders[.]parquet"
    q, out = streams.daily_sales_stream(spark, src, td.raw(spark, d, "orders").schema, _orders_to_sales)
    q.awaitTermination()
    r = streams.daily_sales_result(spark, out)
    return r.select("tgl", F.col("trx").cast("long").alias("trx"), money_out("total").alias("total"))



# ------------------------------------------------------- typed scan, json sink
@register("typed_scan")
def q_typed_scan(spark: SparkSession, d: str) -> DataFrame:
    """The drug table written in its declared schema and read back by the typed scan."""
    import uuid
    from dispensa.session import scratch_dir
    from dispensa.sources.tables import conform, load
    base = scratch_dir(spark, f"tables-{uuid.uuid4().hex}")
    conform(td.obat(spark, d), "m_obat").write.parquet(f"{base}/m_obat")
    r = load(spark, base, "m_obat")
    return r.select("id", "kode", "nama", "produsen", money_out("harga").alias("harga"), "stok", "expired_date",
                    "golongan", "narkotika_psikotropika")


@register("json_export")
def q_json_export(spark: SparkSession, d: str) -> DataFrame:
    """Best sellers of the period written as JSON lines and read back."""
    import uuid
    from dispensa.session import scratch_dir
    path = scratch_dir(spark, f"json-{uuid.uuid4().hex}")
    sinks.export_json(q_top_sellers(spark, d), path)
    return spark.read.schema("obat_kode string, nama string, qty long, omzet double").json(path)
