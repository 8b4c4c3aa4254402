"""Set-wise admission of purchase and sale requests.

Requests arrive as two tables: headers (one row per request, ``req_id``)
and lines (``req_id``, ``pos`` = item index).  Every check is a column
expression or a join; verdicts come back as tables.

Sale admission has two modes:

* ``snapshot`` — every sale is judged against the opening stock (exact for a
  batch of one request, one pass);
* ``sequential`` — sales take effect one after another in ``req_id`` order: a
  refused sale uses no stock.  Solved exactly by bound tightening: the
  order-free checks are final; for the rest two running sums per drug over
  *earlier* sales — stock used by accepted sales (lower bound) and by accepted
  plus undecided sales (upper bound) — decide every line that is safe or
  failing under both bounds.  The earliest undecided sale always has equal
  bounds, so each round decides at least one sale; rounds repeat until none
  is undecided (no cap).  A round reads only rows that can still change a
  verdict or a stock error: what accepted sales took is carried in the rows
  after them, and a drug's rows behind its last row in doubt are left out.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispensa import model
from dispensa.functions.scalars import plus_one_year
from dispensa.operators.quality import ERROR_TYPE, RULES_PURCHASE, RULES_SALE, validate
from dispensa.operators.screening import interaction_hits
from dispensa.plans.prefix import WINDOW_ROWS, number_rows, running_mins, running_sums
from dispensa.plans.lineage import materialize, materialize_observed
from dispensa.session import ensure_checkpoint_dir


def _err(field: str | Column, msg: str | Column) -> Column:
    f = F.lit(field) if isinstance(field, str) else field
    m = F.lit(msg) if isinstance(msg, str) else msg
    return F.struct(f.alias("field"), m.alias("msg"))


def _blank(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


def _empty(c: Column) -> Column:
    """The reference's empty test on codes: null, '' and '0'."""
    return c.isNull() | c.cast("string").isin("", "0")


def _whole(c: Column) -> Column:
    """A count sent as number or text: its whole part; not a number: 0."""
    return F.coalesce(F.floor(c.cast("string").try_cast("double")).try_cast("int"), F.lit(0))


def _with_item_count(headers: DataFrame, lines: DataFrame) -> DataFrame:
    n = lines.groupBy("req_id").agg(F.count(F.lit(1)).alias("__n_items"))
    h = headers.join(n, "req_id", "left").withColumn("__n_items", F.coalesce(F.col("__n_items"), F.lit(0)))
    # the "items" rule reads the presence of at least one item
    return h.withColumn("items", F.when(F.col("__n_items") > 0, F.lit("present")))


# ---------------------------------------------------------------------- I2
def admit_purchases(headers: DataFrame, lines: DataFrame, suppliers: DataFrame, drugs: DataFrame,
                    as_of: dt.date) -> tuple[DataFrame, DataFrame]:
    """Purchase requests.  The first failure wins, in the order: header
    rules (all their errors), at least one line, supplier known, then per line
    in item order: required fields, ``qty >= 1``, ``harga_beli >= 0``, then
    drug existence in item order.  Blank ``tgl`` is ``as_of``; blank line
    expiry is ``tgl + 1 year`` (29 Feb → 1 Mar).

    Returns (verdicts per request, lines with defaults applied).
    """
    # verdicts and defaults read the lines, verdicts are read by every posting stage
    ensure_checkpoint_dir(headers.sparkSession)
    lines = materialize(lines, "purchase-request-lines")
    h = validate(_with_item_count(headers, lines), RULES_PURCHASE, out="__hdr_err")
    sup = suppliers.select(F.col("kode").alias("supplier_kode")).distinct().withColumn("__sup_ok", F.lit(True))
    h = h.join(sup, "supplier_kode", "left")

    li = lines
    fields = ("obat_kode", "batch_no", "qty", "harga_beli")
    bad = [_blank(F.col(f)) for f in fields]
    bad.append(_whole(F.col("qty")) <= 0)
    price = F.coalesce(F.col("harga_beli").cast("string").try_cast("double"), F.lit(0.0))
    bad.append(price < 0)
    expiry = F.trim(F.col("expired_date").cast("string"))
    bad.append(~_blank(expiry) & expiry.try_cast("date").isNull())
    messages = [*[f"{f} wajib" for f in fields], model.MSG_QTY_MIN, model.MSG_PRICE_NEG, model.MSG_DATE]
    # position and first failing check as one number: a minimum that needs no sort
    failing = F.coalesce(*[F.when(b, F.lit(i)) for i, b in enumerate(bad)])
    li = li.withColumn("__failing", F.col("pos").cast("long") * len(messages) + failing)
    known = drugs.select(F.col("kode").alias("obat_kode")).distinct().withColumn("__drug_ok", F.lit(True))
    li = li.join(known, "obat_kode", "left")
    per_req = li.groupBy("req_id").agg(
        F.min("__failing").alias("__first_line"),
        F.min(F.when(F.col("__drug_ok").isNull(), F.col("pos"))).alias("__first_missing"))
    h = h.join(per_req, "req_id", "left")

    nth = F.pmod(F.col("__first_line"), F.lit(len(messages)))
    item_field = lambda pos: F.concat(F.lit("items."), pos.cast("string"))
    bad_date = ~_blank(F.col("tgl")) & F.col("tgl").cast("string").try_cast("date").isNull()
    later = (F.when(bad_date, _err("tgl", model.MSG_DATE))
              .when(F.col("__n_items") == 0, _err("items", model.MSG_MIN_ITEM))
              .when(F.col("__sup_ok").isNull(), _err("supplier_kode", model.MSG_SUPPLIER_MISSING))
              .when(F.col("__first_line").isNotNull(), _err(
                  item_field(F.call_function("div", F.col("__first_line") - nth, F.lit(len(messages)))),
                  F.element_at(F.array(*[F.lit(x) for x in messages]), (nth + 1).cast("int"))))
              .when(F.col("__first_missing").isNotNull(),
                    _err(item_field(F.col("__first_missing")), model.MSG_DRUG_MISSING)))
    errors = F.when(F.size("__hdr_err") > 0, F.col("__hdr_err")) \
              .otherwise(F.when(later.isNotNull(), F.array(later)).otherwise(F.array().cast(ERROR_TYPE)))
    tgl = F.when(_blank(F.col("tgl")), F.lit(as_of)).otherwise(F.col("tgl").cast("string").try_cast("date"))
    verdict = h.select("req_id", tgl.alias("tgl_eff"), errors.cast(ERROR_TYPE).alias("errors")) \
               .withColumn("accepted", F.size("errors") == 0)
    verdict = materialize(verdict, "purchase-verdicts")

    exp_given = F.when(~_blank(F.trim(F.col("expired_date").cast("string"))),
                       F.trim(F.col("expired_date").cast("string")).try_cast("date"))
    out_lines = lines.join(verdict.select("req_id", "tgl_eff"), "req_id") \
                     .withColumn("expired_date", F.coalesce(exp_given, plus_one_year(F.col("tgl_eff")))) \
                     .withColumn("qty", _whole(F.col("qty"))) \
                     .withColumn("harga_beli", F.coalesce(
                         F.col("harga_beli").cast("string").try_cast(model.MONEY), F.lit(0).cast(model.MONEY))) \
                     .drop("tgl_eff")
    return verdict, out_lines


# ---------------------------------------------------------------------- I3
def _sale_headers(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Headers with ``__stage1``: the failures that refuse outright (rules, no
    item, missing doctor), null if none."""
    h = validate(_with_item_count(headers, lines), RULES_SALE, out="__hdr_err")
    needs_doc = F.col("jenis").isin("Resep", "Racik") & _empty(F.col("dokter_sip"))
    stage1 = (F.when(F.size("__hdr_err") > 0, F.col("__hdr_err"))
               .when(F.col("__n_items") == 0, F.array(_err("items", model.MSG_MIN_ITEM)))
               .when(needs_doc, F.array(_err("dokter_sip", model.MSG_DOCTOR))))
    return h.withColumn("__stage1", stage1.cast(ERROR_TYPE))


def _sale_lines(h: DataFrame, lines: DataFrame, drugs: DataFrame, customers: DataFrame, as_of: dt.date,
                earlier_expiry: DataFrame | None = None) -> DataFrame:
    """Lines with ``__line_errs`` (all but stock), ``__checkable`` (the drug is
    known) and the drug's opening stock ``__stok``."""
    d = drugs.select(F.col("kode").alias("obat_kode"), F.col("nama").alias("__nama"),
                     F.col("stok").alias("__stok"), F.col("expired_date").alias("__exp"),
                     F.col("golongan").isin(*model.CONTROLLED).alias("__ctl"))
    allergy = customers.filter(~_empty(F.col("kode"))) \
                       .select(F.col("kode").alias("pelanggan_kode"), F.col("alergi").alias("__alergi"))
    hs = h.select("req_id", "pelanggan_kode").join(allergy, "pelanggan_kode", "left")
    li = lines
    if earlier_expiry is not None:
        # a purchase earlier in the batch can bring the drug's expiry forward
        li = li.join(earlier_expiry, ["req_id", "obat_kode"], "left")
    # by request last: what is counted per request needs no shuffle of its own
    li = li.join(d, "obat_kode", "left").join(hs.select("req_id", "__alergi"), "req_id", "left")
    if earlier_expiry is not None:
        li = li.withColumn("__exp", F.least(F.col("__exp"), F.col("__pexp"))).drop("__pexp")
    field = F.concat(F.lit("items."), F.col("pos").cast("string"))
    invalid = _empty(F.col("obat_kode")) | (_whole(F.col("qty")) <= 0)
    missing = F.col("__nama").isNull() & F.col("__stok").isNull()
    a = F.col("__alergi")
    has_allergy = a.isNotNull() & (a != "") & (a != "0")
    allergic = has_allergy & (F.lower(a).contains(F.lower(F.col("obat_kode")))
                              | F.lower(a).contains(F.lower(F.coalesce(F.col("__nama"), F.lit("\u0000")))))
    expired = F.col("__exp").isNotNull() & (F.col("__exp") < F.lit(as_of))
    static = F.when(invalid, F.array(_err(field, model.MSG_ITEM_INVALID))) \
              .when(missing, F.array(_err(field, model.MSG_DRUG_MISSING))) \
              .otherwise(F.filter(F.array(F.when(expired, _err(field, model.MSG_EXPIRED)),
                                          F.when(allergic, _err(field, model.MSG_ALLERGY))),
                                  lambda x: x.isNotNull()))
    return li.withColumn("__line_errs", static.cast(ERROR_TYPE)) \
             .withColumn("__checkable", ~invalid & ~missing)


def _sale_static(headers: DataFrame, lines: DataFrame, drugs: DataFrame, customers: DataFrame,
                 inter: DataFrame, as_of: dt.date,
                 earlier_expiry: DataFrame | None = None, written: bool = False) -> tuple[DataFrame, DataFrame]:
    """Order-free part of sale admission: (header table with error counts,
    line table); the errors of both stages are final.  ``written``: the line
    table is written once, for callers that read it again."""
    h = _sale_headers(headers, lines).select("req_id", F.col("__stage1").isNotNull().alias("__refused1"))
    li = _sale_lines(headers, lines, drugs, customers, as_of, earlier_expiry).select(
        "req_id", "obat_kode", "qty", "__stok", "__checkable", F.size("__line_errs").alias("__n_errs"), "__ctl")
    if written:
        li = materialize(li, "admission-lines")
    # interaction errors: one per pair of lines (i < j) whose drugs form a
    # reported pair = count(a) × count(b) per basket; no pair emission
    cnt = lines.groupBy("req_id", "obat_kode").agg(F.count(F.lit(1)).alias("__c"))
    sev = inter.filter(F.col("tingkat").isin(*model.SEVERE)).select("obat1_kode", "obat2_kode", "tingkat")
    # merged, not broadcast: the sizes of derived pair tables are guessed too low
    c1 = cnt.join(sev.hint("merge"), cnt["obat_kode"] == sev["obat1_kode"]).select("req_id", "obat2_kode", "tingkat", "__c")
    c2 = cnt.select("req_id", F.col("obat_kode").alias("obat2_kode"), F.col("__c").alias("__c2"))
    pairs = c1.join(c2, ["req_id", "obat2_kode"]).groupBy("req_id").agg(
        F.sum(F.col("__c") * F.col("__c2")).alias("__n_inter"))

    per_req = li.groupBy("req_id").agg(
        F.sum("__n_errs").alias("__n_static"),
        F.bool_or(F.coalesce(F.col("__ctl"), F.lit(False))).alias("narkotika_psikotropika"))
    h = h.join(per_req, "req_id", "left").join(pairs, "req_id", "left") \
         .withColumn("__n_inter", F.coalesce(F.col("__n_inter"), F.lit(0)).cast("long")) \
         .withColumn("__n_static", F.coalesce(F.col("__n_static"), F.lit(0)).cast("long"))
    return h, li


def admit_sales(headers: DataFrame, lines: DataFrame, drugs: DataFrame, customers: DataFrame,
                inter: DataFrame, as_of: dt.date, mode: str = "snapshot",
                stock_rule: str = "line", purchases: DataFrame | None = None) -> DataFrame:
    """Sale requests → one verdict row per request.

    Columns: ``req_id, accepted, stage1_refused, n_line_errors,
    n_interaction_errors, n_stock_errors, narkotika_psikotropika, rounds``.
    ``stock_rule="line"`` checks each line against the stock reading (two
    lines of one drug can jointly oversell, as the reference); ``"sum"``
    checks the sale's total per drug.

    ``purchases`` (sequential mode only): admitted purchase lines
    ``(req_id, obat_kode, qty, expired_date)`` interleaved with the sales by
    ``req_id`` — the purchase at position k arrives just before the sale at k.
    They add stock at their position and bring a drug's expiry forward for
    the sales after them (a purchase never changes an earlier verdict).
    """
    return admit_batch(headers, lines, drugs, customers, inter, as_of, mode, stock_rule, purchases)["sales"]


def sale_errors(headers: DataFrame, lines: DataFrame, drugs: DataFrame, customers: DataFrame,
                inter: DataFrame, as_of: dt.date) -> DataFrame:
    """The error list of every refused sale, judged against opening stock:
    ``req_id, field, nth, msg, n``.

    A header failure ends the check.  Otherwise each line gives its errors
    (``nth`` counts them within the line: stock, expiry, allergy), and each two
    lines with a reported interaction give one message that names their drugs
    in line order.  Equal interaction messages are one row with their number
    ``n``: the lines of a pair's drugs are ranked together, and the ranks of
    one drug give how many lines of the other stand before it (no pairs of
    lines are made).
    """
    h = _sale_headers(headers, lines)
    one = F.lit(1).cast("long").alias("n")
    first = h.filter(F.col("__stage1").isNotNull()) \
             .select("req_id", F.posexplode("__stage1").alias("nth", "e"), one)
    lines = lines.join(h.filter(F.col("__stage1").isNull()).select("req_id"), "req_id", "left_semi")
    li = _sale_lines(h, lines, drugs, customers, as_of)
    field = F.concat(F.lit("items."), F.col("pos").cast("string"))
    short = F.col("__checkable") & (F.col("__stok").cast("long") < _whole(F.col("qty")).cast("long"))
    stock = F.when(short, F.array(_err(field, model.MSG_NO_STOCK))).otherwise(F.array().cast(ERROR_TYPE))
    of_lines = li.select("req_id", F.posexplode(F.concat(stock.cast(ERROR_TYPE), F.col("__line_errs"))).alias("nth", "e"), one)
    plain = first.unionByName(of_lines).select("req_id", F.col("e.field").alias("field"), "nth",
                                               F.col("e.msg").alias("msg"), "n")

    sides = F.array(*[F.struct(F.col(c).alias("obat_kode"), F.lit(c == "obat2_kode").alias("second"))
                      for c in ("obat1_kode", "obat2_kode")])
    members = interaction_hits(lines, inter, doc="req_id") \
        .select("req_id", "obat1_kode", "obat2_kode", "tingkat", F.explode(sides).alias("s")) \
        .select("req_id", "obat1_kode", "obat2_kode", "tingkat", "s.obat_kode", "s.second") \
        .join(lines.select("req_id", "obat_kode", "pos"), ["req_id", "obat_kode"])
    pair = ["req_id", "obat1_kode", "obat2_kode", "tingkat"]
    ranked = number_rows(members, ["pos"], name="__rank", keys=pair)
    n1, n2 = F.count(F.when(~F.col("second"), 1)), F.count(F.when(F.col("second"), 1))
    per = ranked.groupBy(*pair).agg((n1 * n2).alias("all"), F.call_function(
        "div", n2 * (n2 + 1), F.lit(2)).alias("own"), F.sum(F.when(F.col("second"), F.col("__rank"))).alias("ranks"))
    before = F.col("ranks") - F.col("own")

    def row(a: str, b: str, n: Column) -> Column:
        msg = F.concat(F.lit("Interaksi "), F.col(a), F.lit("-"), F.col(b), F.lit(": "), F.col("tingkat"))
        return F.struct(msg.alias("msg"), n.cast("long").alias("n"))

    both = F.array(row("obat1_kode", "obat2_kode", before), row("obat2_kode", "obat1_kode", F.col("all") - before))
    inter_rows = per.select("req_id", F.explode(F.filter(both, lambda x: x["n"] > 0)).alias("r")) \
        .select("req_id", F.lit("interaksi").alias("field"), F.lit(None).cast("int").alias("nth"), "r.msg", "r.n")
    return plain.unionByName(inter_rows)


# position of a document in the interleaved order: purchase k, sale k, reversal k
SLOT_PURCHASE, SLOT_SALE, SLOT_REVERSAL = 0, 1, 2


def _pos(req: Column, slot: int) -> Column:
    return req.cast("long") * 3 + slot


def _req_of(seq: Column, slot: int) -> Column:
    # seq - slot is a multiple of 3: whole division, exact for any long
    return F.call_function("div", seq - slot, F.lit(3))


def admit_batch(headers: DataFrame, lines: DataFrame, drugs: DataFrame, customers: DataFrame,
                inter: DataFrame, as_of: dt.date, mode: str = "snapshot", stock_rule: str = "line",
                purchases: DataFrame | None = None,
                reversals: DataFrame | None = None) -> dict[str, DataFrame | None]:
    """Sales, admitted purchases and purchase reversals in one arrival order.

    ``reversals`` (sequential mode only): lines ``(req_id, obat_kode, qty)``
    of the purchases to reverse, the reversal at position k arriving just
    after the sale at k.  A reversal passes when every line's drug still has
    at least the line's quantity (all lines or none, as J3); an accepted one
    takes that stock away from everything after it, so its verdict and the
    sales' verdicts are decided together.  Returns ``{"sales": verdicts,
    "reversals": verdicts or None}``.
    """
    earlier = None
    if mode == "sequential":
        # the request lines feed several plans of every round: written once
        ensure_checkpoint_dir(lines.sparkSession)
        lines = materialize(lines.select("req_id", "pos", "obat_kode", "qty"), "admission-request-lines")
        if purchases is not None:
            purchases = materialize(purchases.select("req_id", "obat_kode", "qty", "expired_date"),
                                    "admission-purchases")
            earlier = _earlier_purchase_expiry(lines, purchases)
    elif purchases is not None or reversals is not None:
        raise ValueError("purchases and reversals interleave only in sequential mode")
    h, li = _sale_static(headers, lines, drugs, customers, inter, as_of, earlier, mode == "sequential")
    qty = F.col("qty").cast("long")
    if stock_rule == "sum":
        # the sale's total per drug: an aggregate (combined map-side) joined back
        tot = li.groupBy("req_id", "obat_kode").agg(F.sum(qty).alias("__need"))
        li = li.join(tot, ["req_id", "obat_kode"], "left")
    else:
        li = li.withColumn("__need", qty)

    rev = None
    if mode == "snapshot":
        stock_fail = li.filter(F.col("__checkable") & (F.col("__stok").cast("long") < F.col("__need"))) \
                       .groupBy("req_id").agg(F.count(F.lit(1)).alias("__n_stock"))
        v = h.join(stock_fail, "req_id", "left").withColumn("__n_stock", F.coalesce("__n_stock", F.lit(0)))
        v = v.withColumn("rounds", F.lit(1))
    elif mode == "sequential":
        v, rev = _sequential(h, li, purchases, reversals, drugs)
    else:
        raise ValueError(mode)

    refused1 = F.col("__refused1")
    sales = v.select(
        "req_id",
        (~refused1 & (F.col("__n_static") == 0) & (F.col("__n_inter") == 0) & (F.col("__n_stock") == 0))
        .alias("accepted"),
        refused1.alias("stage1_refused"),
        F.when(refused1, 0).otherwise(F.col("__n_static")).cast("long").alias("n_line_errors"),
        F.when(refused1, 0).otherwise(F.col("__n_inter")).cast("long").alias("n_interaction_errors"),
        F.when(refused1, 0).otherwise(F.col("__n_stock")).cast("long").alias("n_stock_errors"),
        F.coalesce(F.col("narkotika_psikotropika"), F.lit(False)).alias("narkotika_psikotropika"),
        F.col("rounds").cast("int").alias("rounds"))
    return {"sales": sales, "reversals": rev}


def admit_reversals(reversals: DataFrame, drugs: DataFrame) -> DataFrame:
    """Purchase reversals one after another in ``req_id`` order; lines
    ``(req_id, line_id, obat_kode, qty)``.  Each is judged against the stock
    that the accepted ones before it left (all lines or none), so stock never
    falls below zero.  Returns ``req_id, accepted, n_short, first_short_drug``."""
    return _sequential(None, None, None, reversals, drugs)[1]


def _earlier_purchase_expiry(lines: DataFrame, purchases: DataFrame) -> DataFrame:
    """Per (sale, drug): the earliest expiry among purchases of the drug that
    arrive before the sale (a running minimum over the interleaved order)."""
    p = purchases.groupBy("obat_kode", _pos(F.col("req_id"), SLOT_PURCHASE).alias("__seq")) \
                 .agg(F.min("expired_date").alias("__e"))
    s = lines.select("obat_kode", _pos(F.col("req_id"), SLOT_SALE).alias("__seq")).distinct() \
             .withColumn("__e", F.lit(None).cast("date"))
    r = running_mins(p.unionByName(s), ["obat_kode"], ["__seq"], {"__pexp": F.col("__e")}, inclusive=False)
    return r.filter(F.col("__seq") % 3 == SLOT_SALE).select(
        _req_of(F.col("__seq"), SLOT_SALE).alias("req_id"), "obat_kode", "__pexp")


# a span of documents has at least this many rows; the place of what came before
SPAN_ROWS, MAX_SPANS = 1 << 18, 16
_BEFORE_ALL = -(1 << 63)


def _spans(use: DataFrame, stock_comes_in: bool) -> tuple[int, list[int]]:
    """Largest number of rows of one drug, and the positions that cut the
    documents into spans decided one after another (none: one span).

    Where drugs are asked for many times their stock, almost every row waits for
    those before it; decided in one go, each round would read them all.  A first
    span asks for about half the stock; the next ones find it known.  Spans double,
    as stock once used up decides at once; where purchases bring stock in they
    are equal.  Every cut gives the same verdicts."""
    asked = F.sum(F.when(F.col("st").isNull(), F.greatest(F.col("__take"), F.lit(0))))
    per = use.groupBy("obat_kode").agg(F.count(F.lit(1)).alias("n"), F.coalesce(asked, F.lit(0)).alias("asked"),
                                       F.coalesce(F.max("__avail"), F.lit(0)).alias("stock"))
    m = per.agg(F.max("n").alias("bound"), F.sum("n").alias("rows"), F.sum(F.col("asked").cast("double")).alias("asked"),
                F.sum(F.greatest(F.least("asked", "stock"), F.lit(0)).cast("double")).alias("met")).first()
    times = (m["asked"] or 0.0) / max(m["met"] or 0.0, 1.0)
    n = min((m["rows"] or 0) / SPAN_ROWS, 2 * times)
    if times < 2 or n < 2:
        return int(m["bound"] or 0), []
    if stock_comes_in:
        n = min(int(n), MAX_SPANS)
        shares = [i / n for i in range(1, n)]
    else:
        shares = [x for x in ((2 ** i - 1) / n for i in range(1, 64)) if x < 0.75]
    cuts = use.agg(F.percentile_approx("__seq", F.array(*[F.lit(x) for x in shares]), F.lit(10000))).first()[0]
    return int(m["bound"]), sorted(set(cuts))


def _decide(active: DataFrame, cols: list[str], bound: int) -> tuple[int, list[DataFrame]]:
    """Rounds over one span until every document is decided: their number, and
    the rows of refused documents that are short of stock, with what was left."""
    open_, taken = F.col("st").isNull(), F.col("__take")
    of_doc = Window.partitionBy("__seq")
    rounds, short, undecided = 0, [], True
    while True:
        # __ahead 0: every earlier row that takes stock is decided, __avail is exact
        sums = running_sums(active, ["obat_kode"], ["__seq"],
                            {"__acc": F.when(F.col("st") == 1, taken), "__und": F.when(open_, taken),
                             "__ahead": F.when(open_, F.abs(taken))}, inclusive=False, key_rows_bound=bound)
        doubt = (open_ | (F.col("st") == 0)) & (F.col("__avail") - F.col("__acc") - F.col("__und") < F.col("__need_max"))
        rows = sums.withColumn("__doubt", F.coalesce(doubt, F.lit(False)))
        if bound <= WINDOW_ROWS:
            # behind the drug's last row in doubt no row can change anything
            last = F.max(F.when(F.col("__doubt"), F.col("__seq"))).over(Window.partitionBy("obat_kode"))
            rows = rows.withColumn("__last", last).filter(F.col("__seq") <= F.col("__last"))
        rows = rows.filter(open_ | ((F.col("st") == 0) & F.col("__doubt"))).withColumn(
            "__avail", F.col("__avail") - F.col("__acc"))
        fails = F.bool_or(F.when(open_, F.col("__avail") < F.col("__need_max"))).over(of_doc)
        safe = F.bool_and(F.when(open_, F.col("__avail") - F.col("__und") >= F.col("__need_max"))).over(of_doc)
        rows = rows.withColumn("__fails", fails).withColumn("__safe", safe).withColumn(
            "st", F.when(~open_, F.col("st")).when(F.col("__fails"), F.lit(0))
            .when(F.coalesce(F.col("__safe"), F.lit(True)), F.lit(1)))
        # a refused document's row stays until its stock is exact, then only if short
        refused = F.coalesce(F.col("st") == 0, F.lit(False))
        rows = rows.filter(~refused | F.col("__doubt")).withColumn("__exact", refused & (F.col("__ahead") == 0))
        rows, m = materialize_observed(rows.select(*cols, "__exact"), "admission-round", {
            "undecided": F.count(F.when(open_, 1)), "waiting": F.count(F.when(refused & ~F.col("__exact"), 1))})
        rounds += undecided
        undecided = m["undecided"] > 0
        short.append(rows.filter(F.col("__exact")))
        active = rows.filter(~F.col("__exact")).drop("__exact")
        if not undecided and not m["waiting"]:
            break
    return rounds, short


def _sequential(h: DataFrame | None, li: DataFrame | None, purchases: DataFrame | None = None,
                reversals: DataFrame | None = None,
                drugs: DataFrame | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """Bound-tightening fixpoint over the documents in position order (``h``
    and ``li`` None: no sales)."""
    ensure_checkpoint_dir((reversals if h is None else h).sparkSession)
    # per (drug, document): quantity the document takes from the drug, largest
    # and smallest need of its lines (a line passes when stock covers its need,
    # so the largest one decides the pair), their number, the drug's stock
    # before the batch; st: 1 accepted, 0 refused, null undecided
    cols = ["obat_kode", "__seq", "__take", "__need_max", "__need_min", "__n", "__avail", "st"]
    parts = []
    if h is not None:
        # the order-free results are computed once and written
        h = materialize(h, "admission-headers")
        clean = (F.col("__n_static") == 0) & (F.col("__n_inter") == 0)
        judged = h.filter(~F.col("__refused1")).select("req_id", F.when(~clean, F.lit(0)).alias("st"))
        parts.append(li.filter("__checkable").select("req_id", "obat_kode", "qty", "__need", "__stok")
                     .repartition("req_id").groupBy("req_id", "obat_kode").agg(
            F.sum(F.col("qty").cast("long")).alias("__take"), F.max("__need").alias("__need_max"),
            F.min("__need").alias("__need_min"), F.count("__need").alias("__n"),
            F.first("__stok").cast("long").alias("__avail")).join(judged, "req_id")
            .withColumn("__seq", _pos(F.col("req_id"), SLOT_SALE)).select(*cols))
    if reversals is not None:
        line = F.col("line_id") if "line_id" in reversals.columns else F.lit(None)
        rev_lines = materialize(reversals.select("req_id", "obat_kode", F.col("qty").cast("long").alias("qty"),
                                                 line.cast("long").alias("line_id")), "admission-reversal-lines")
        stok = drugs.select(F.col("kode").alias("obat_kode"), F.col("stok").cast("long").alias("__avail"))
        parts.append(rev_lines.filter(F.col("req_id").isNotNull()).groupBy("obat_kode", "req_id").agg(
            F.sum("qty").alias("__take"), F.max("qty").alias("__need_max"), F.min("qty").alias("__need_min"),
            F.count("qty").alias("__n"))
            .join(stok, "obat_kode", "left").withColumn("__avail", F.coalesce(F.col("__avail"), F.lit(0)))
            .withColumn("__seq", _pos(F.col("req_id"), SLOT_REVERSAL))
            .withColumn("st", F.lit(None).cast("int")).select(*cols))
    if purchases is not None:
        # always-accepted stock-in rows
        none = F.lit(None).cast("long")
        parts.append(purchases.groupBy("obat_kode", "req_id").agg((-F.sum(F.col("qty").cast("long"))).alias("__take"))
                     .select("obat_kode", _pos(F.col("req_id"), SLOT_PURCHASE).alias("__seq"), "__take",
                             none.alias("__need_max"), none.alias("__need_min"), none.alias("__n"),
                             none.alias("__avail"), F.lit(1).alias("st")))
    use = materialize(reduce(DataFrame.unionByName, parts), "admission-use")
    # rows per drug: proven once, it picks the running-sum plan of every round
    bound, cuts = _spans(use, purchases is not None)
    rounds, short, carry = 0, [], None
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        span = use
        if hi is not None:
            span = span.filter(F.col("__seq").isNull() | (F.col("__seq") <= hi))
        if lo is not None:
            span = span.filter(F.col("__seq") > lo).unionByName(carry)
        n, lacking = _decide(span, cols, bound)
        rounds += n
        short += lacking
        if hi is not None:
            # what the documents so far took from each drug stands before the next span
            refused = reduce(DataFrame.unionByName, lacking).select("__seq").distinct()
            none = F.lit(None).cast("long")
            carry = materialize(
                span.filter(F.coalesce(F.col("st"), F.lit(1)) == 1).join(refused, "__seq", "left_anti")
                .groupBy("obat_kode").agg(F.sum("__take").alias("__take")).filter(F.col("__take") != 0)
                .select("obat_kode", F.lit(_BEFORE_ALL).alias("__seq"), "__take", none.alias("__need_max"),
                        none.alias("__need_min"), none.alias("__n"), none.alias("__avail"), F.lit(1).alias("st")),
                "admission-carry")

    # rows of refused documents that are short of stock, with what was left
    lack = reduce(DataFrame.unionByName, short)
    v = None
    if h is not None:
        sale = lack.filter(F.col("__seq") % 3 == SLOT_SALE).select(
            _req_of(F.col("__seq"), SLOT_SALE).alias("req_id"), "obat_kode", "__avail", "__need_min", "__n")
        all_lines = sale.filter(F.col("__avail") < F.col("__need_min")).select("req_id", "__n")
        need = li.filter("__checkable").select("req_id", "obat_kode", "__need")
        some = need.join(sale.filter(F.col("__avail") >= F.col("__need_min")), ["req_id", "obat_kode"]) \
                   .filter(F.col("__avail") < F.col("__need")).select("req_id", F.lit(1).cast("long").alias("__n"))
        n_stock = all_lines.unionByName(some).groupBy("req_id").agg(F.sum("__n").alias("__n_stock"))
        v = h.join(n_stock, "req_id", "left").withColumn("__n_stock", F.coalesce("__n_stock", F.lit(0)))
        v = v.withColumn("rounds", F.lit(rounds))

    rev = None
    if reversals is not None:
        left = lack.filter(F.col("__seq") % 3 == SLOT_REVERSAL).select(
            _req_of(F.col("__seq"), SLOT_REVERSAL).alias("req_id"), "obat_kode", "__avail")
        lacks = F.coalesce(F.col("__avail") < F.col("qty"), F.lit(False))
        refused = left.join(rev_lines, ["req_id", "obat_kode"], "left").groupBy("req_id").agg(
            F.sum(lacks.cast("long")).alias("n_short"),
            F.min_by("obat_kode", F.when(lacks, F.col("line_id"))).alias("first_short_drug"))
        rev = rev_lines.select("req_id").distinct().join(refused, "req_id", "left").select(
            "req_id", F.col("n_short").isNull().alias("accepted"),
            F.coalesce("n_short", F.lit(0)).alias("n_short"), "first_short_drug")
    return v, rev
