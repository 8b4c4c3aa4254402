"""Posting pipelines: purchases, sales, purchase reversal, payables, code
assignment, audit rows (J1–J4, J7, A5).

Each pipeline is a function from input tables to named new tables (snapshot
in, snapshot out), each planned when it is read.  Ledger rows of a batch take ids after the
current maximum, in document order, and balances continue from each drug's
last balance (E2 as opening of E1).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispensa import model
from dispensa.operators import ledger as L
from dispensa.operators.admission import admit_reversals
from dispensa.plans.prefix import number_rows
from dispensa.plans.lineage import materialize, materialize_observed
from dispensa.session import ensure_checkpoint_dir


class Tables(Mapping):
    """Named result tables, each planned when it is first read: a caller that
    reads one does not pay for the others."""

    def __init__(self, **makers: Callable[[], DataFrame]):
        self._makers = makers
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self):
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


# ---------------------------------------------------------------------- J7
def code_candidates(req_id: Column, attempt: Column, prefix: str, kind: str = "hex",
                    ts: Column | None = None) -> Column:
    """Repeatable code candidates in the reference's shapes: ``prefix`` + 6
    upper hex digits, or ``prefix`` + time stamp (+ 2 hex digits on retries).
    The hex digits come from md5 of the request id and attempt number instead
    of a random source, so a rerun assigns the same codes."""
    h = F.upper(F.md5(F.concat_ws(":", req_id.cast("string"), attempt.cast("string"))))
    if kind == "hex":
        return F.concat(F.lit(prefix), F.substring(h, 1, 6))
    fmt = {"ymdHis": "yyMMddHHmmss", "YmdHis": "yyyyMMddHHmmss"}[kind]
    stamp = F.date_format(ts, fmt)
    return F.concat(F.lit(prefix), stamp, F.when(attempt > 0, F.substring(h, 1, 2)).otherwise(F.lit("")))


def assign_codes(req: DataFrame, code_col: str, taken: DataFrame, taken_col: str, prefix: str,
                 kind: str = "hex", ts_col: str | None = None, id_col: str = "req_id",
                 attempts: int = 6) -> DataFrame:
    """A blank code gets the first of ``attempts`` candidates that is not
    taken, by a stored row, a code the batch brings along, or an earlier
    request (by id) of the batch.  Requests whose candidates are all taken get
    ``code`` null and ``code_error`` set.

    The one-by-one result is found in rounds: every open request claims its
    next candidate, a code goes to the lowest id that claims it, and who is
    refused or displaced claims the next.  Only open requests make candidates;
    a round is a written table, the open count its metric."""
    blank = F.col(code_col).isNull() | (F.trim(F.col(code_col)) == "")
    ts = F.col(ts_col) if ts_col else None
    carry = [id_col, *([ts_col] if ts_col else [])]
    ensure_checkpoint_dir(req.sparkSession)
    used = taken.select(F.trim(F.col(taken_col)).alias("__code")) \
        .unionByName(req.filter(~blank).select(F.trim(F.col(code_col)).alias("__code"))).distinct() \
        .withColumn("__used", F.lit(True))
    open_ = {"open": F.count(F.when(F.col("__open"), 1))}

    def claim(rows: DataFrame) -> DataFrame:
        """Each request's state after its claim; open ones made a new candidate."""
        rows = rows.withColumn("__code", F.when(F.col("__open"), code_candidates(
            F.col(id_col), F.col("__k"), prefix, kind, ts)).otherwise(F.col("__code")))
        rows = rows.join(used, "__code", "left")
        owner = rows.filter(~(F.col("__open") & F.col("__used").isNotNull())) \
            .groupBy("__code").agg(F.min(id_col).alias("__owner"))
        rows = rows.join(owner, "__code", "left")
        lost = (F.col("__open") & F.col("__used").isNotNull()) | (F.col("__owner") != F.col(id_col))
        k = F.when(lost, F.col("__k") + 1).otherwise(F.col("__k"))
        return rows.select(*carry, "__code", k.alias("__k"), lost.alias("__open"))

    def settle(rows: DataFrame) -> DataFrame:
        """Requests without a candidate left are closed without a code."""
        out = F.col("__open") & (F.col("__k") >= attempts)
        return rows.withColumn("__code", F.when(~out, F.col("__code"))).withColumn("__open", F.col("__open") & ~out)

    state = req.filter(blank).select(*carry, F.lit(None).cast("string").alias("__code"), F.lit(0).alias("__k"),
                                     F.lit(True).alias("__open"))
    while True:
        done = state.filter(F.col("__k") >= attempts)
        state, m = materialize_observed(settle(claim(state.filter(F.col("__k") < attempts))).unionByName(done),
                                        "codes", open_)
        if not m["open"]:
            break
    out = req.join(state.select(id_col, "__code"), id_col, "left")
    code = F.when(blank, F.col("__code")).otherwise(F.trim(F.col(code_col)))
    return out.withColumn(code_col, code) \
              .withColumn("code_error", F.when(F.col(code_col).isNull(), F.lit("Gagal generate kode"))) \
              .drop("__code")


# ---------------------------------------------------------------------- A5
def audit_rows(changes: DataFrame, action: str, entity: str, entity_id: Column, detail_cols: list[str],
               at: Column, user_id: Column | None = None) -> DataFrame:
    """A5: one audit row per change; ``detail`` is the JSON of the given
    fields, null when all of them are absent (an empty detail)."""
    st = F.struct(*[F.col(c) for c in detail_cols])
    detail = F.when(F.to_json(st) == "{}", F.lit(None)).otherwise(F.to_json(st))
    return changes.select(
        at.cast("timestamp_ntz").alias("tgl"),
        (user_id if user_id is not None else F.lit(None)).cast("int").alias("user_id"),
        F.lit(action).alias("action"), F.lit(entity).alias("entity"),
        entity_id.cast("string").alias("entity_id"), detail.alias("detail"),
        F.lit(None).cast("string").alias("ip"))


# ------------------------------------------------------------------ ledger
def _append_ledger(existing: DataFrame, mov: DataFrame, order: list[str], number: Column | None = None) -> DataFrame:
    """New ledger rows: ids after the current maximum in ``order``; balances
    continue from each drug's last balance.  ``number``: the rows' dense 1-based
    number in that order, where they already have one."""
    # the current ledger reduced to one opening balance per drug, materialised
    opening = materialize(L.latest_balance(existing).select("obat_kode", F.col("saldo").alias("opening")),
                          "ledger-opening")
    max_id = existing.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    numbered = number_rows(mov, order, name="__n") if number is None else mov.withColumn("__n", number)
    numbered = numbered.withColumn("id", (F.col("__n") + max_id).cast("long")).drop("__n")
    bal = L.ledger_balance(numbered, order=["id"], opening=opening)
    return bal


# ---------------------------------------------------------------------- J4
def payables_for(purchases: DataFrame, existing: DataFrame) -> DataFrame:
    """``saldo = max(0, total + pajak - bayar)``; a row only when > 0."""
    due = purchases.withColumn("saldo", F.greatest(F.lit(0), F.col("total") + F.col("pajak")
                                                   - F.coalesce(F.col("bayar"), F.lit(0))).cast(model.MONEY))
    due = due.filter(F.col("saldo") > 0)
    max_id = existing.agg(F.coalesce(F.max("id"), F.lit(-1))).scalar()
    due = number_rows(due, ["id"], name="__n")
    return due.select((F.col("__n") + max_id).cast("long").alias("id"), "supplier_kode",
                      F.col("id").alias("pembelian_id"), "saldo")


# ---------------------------------------------------------------------- J1
def post_purchases(verdicts: DataFrame, headers: DataFrame, lines: DataFrame, drugs: DataFrame,
                   ledger_rows: DataFrame, payables: DataFrame, as_of, purchases: DataFrame | None = None,
                   purchase_lines: DataFrame | None = None) -> Tables:
    """Admitted purchase requests → headers (total from lines), lines,
    drug stock and expiry, BELI ledger rows, payables, audit rows.

    ``purchases`` and ``purchase_lines`` are the stored tables: an invoice
    number they hold is taken, and new line ids follow their highest id.  A
    request whose number is taken (by a stored purchase or an earlier request)
    or that gets none is in ``refused`` and posts nothing."""
    ensure_checkpoint_dir(verdicts.sparkSession)
    # stage boundary: admitted requests and their lines are written once
    ok = materialize(verdicts.filter("accepted").select("req_id", "tgl_eff"), "purchases-ok")
    asked = headers.join(ok, "req_id").withColumn("__ts", F.col("tgl_eff").cast("timestamp_ntz"))
    stored = (purchases if purchases is not None else headers.limit(0)).select("no_faktur")
    coded = assign_codes(asked, "no_faktur", stored, "no_faktur", model.PREFIX_PURCHASE, "YmdHis", "__ts")
    first = coded.groupBy("no_faktur").agg(F.min("req_id").alias("__first"))
    known = stored.select(F.trim(F.col("no_faktur")).alias("no_faktur")).distinct().withColumn("__stored", F.lit(True))
    coded = coded.join(first, "no_faktur", "left").join(known, "no_faktur", "left")
    clash = F.col("__stored").isNotNull() | (F.col("__first") != F.col("req_id"))
    coded = materialize(coded.withColumn("error", F.coalesce(
        "code_error", F.when(clash, F.lit(model.MSG_NUMBER_TAKEN)))).drop("__first", "__stored"), "purchases-coded")
    refused = coded.filter(F.col("error").isNotNull()).select("req_id", "no_faktur", "error")
    coded = coded.filter(F.col("error").isNull()).drop("error")

    li = materialize(lines.join(coded.select("req_id"), "req_id", "left_semi"), "purchases-lines")
    totals = li.groupBy("req_id").agg(F.sum(F.col("qty") * F.col("harga_beli")).cast(model.MONEY).alias("total"))
    hdr = materialize(coded.join(totals, "req_id"), "purchases-headers")
    new_headers = hdr.select(F.col("req_id").alias("id"), "no_faktur", F.col("tgl_eff").alias("tgl"),
                             "supplier_kode", F.coalesce(F.col("pajak").try_cast(model.MONEY), F.lit(0))
                             .cast(model.MONEY).alias("pajak"), "total", "bayar")

    last = 0 if purchase_lines is None else purchase_lines.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]

    def new_lines() -> DataFrame:
        numbered = number_rows(li, ["req_id", "pos"], name="__n")
        return numbered.select((F.col("__n") + F.lit(last)).cast("long").alias("id"),
                               F.col("req_id").alias("pembelian_id"), "obat_kode", "batch_no", "expired_date",
                               "qty", F.col("harga_beli").cast(model.MONEY).alias("harga_beli"))

    def movements(rows: DataFrame) -> DataFrame:
        return L.purchase_movements(rows).withColumn("tgl", F.lit(None).cast("timestamp_ntz"))

    # stock needs quantities and expiry only, no line ids
    unnumbered = li.select(F.lit(None).cast("long").alias("id"), F.col("req_id").alias("pembelian_id"), "obat_kode",
                           "batch_no", "expired_date", "qty", "harga_beli")
    out = Tables(
        pembelian=lambda: new_headers.drop("bayar"), pembelian_item=new_lines,
        m_obat=lambda: L.apply_stock(drugs, movements(unnumbered), li.select("obat_kode", "expired_date")),
        stok_kartu=lambda: _append_ledger(ledger_rows, movements(out["pembelian_item"]), ["line_id"],
                                          F.col("line_id") - F.lit(last)),
        hutang_supplier=lambda: payables_for(new_headers, payables),
        audit_log=lambda: audit_rows(hdr, "CREATE", "pembelian", F.col("req_id"),
                                     ["no_faktur", "tgl", "supplier_kode", "pajak"], F.lit(str(as_of))),
        refused=lambda: refused)
    return out


# ---------------------------------------------------------------------- J2
def post_sales(verdicts: DataFrame, headers: DataFrame, lines: DataFrame, drugs: DataFrame,
               ledger_rows: DataFrame, as_of, price_from_catalog: bool = False) -> Tables:
    """Admitted sale requests → headers (controlled flag, total from
    lines), lines (missing price is 0 as in the reference, or the catalog
    price with ``price_from_catalog``), drug stock, JUAL ledger rows, audit."""
    ensure_checkpoint_dir(verdicts.sparkSession)
    ok = materialize(verdicts.filter("accepted").select("req_id", "narkotika_psikotropika"), "sales-ok")
    li = materialize(lines.join(ok.select("req_id"), "req_id", "left_semi"), "sales-lines")
    if price_from_catalog:
        cat = drugs.select(F.col("kode").alias("obat_kode"), F.col("harga").alias("__h"))
        li = li.join(cat, "obat_kode", "left").withColumn("harga_jual", F.coalesce("harga_jual", "__h")).drop("__h")
    else:
        li = li.withColumn("harga_jual", F.coalesce(F.col("harga_jual"), F.lit(0)))
    totals = li.groupBy("req_id").agg(F.sum(F.col("qty") * F.col("harga_jual")).cast(model.MONEY).alias("total"))
    hdr = headers.join(ok, "req_id").join(totals, "req_id")
    new_headers = hdr.select(F.col("req_id").alias("id"), "no_nota", F.col("tgl").cast("timestamp_ntz").alias("tgl"),
                             "jenis", "pelanggan_kode", "dokter_sip", "narkotika_psikotropika", "total")
    new_lines = li.select(F.col("line_id").alias("id"), F.col("req_id").alias("penjualan_id"), "obat_kode",
                          "batch_no", "qty", F.col("harga_jual").cast(model.MONEY).alias("harga_jual"), "dosis",
                          "etiket")
    mov = L.sale_movements(new_lines)
    return Tables(
        penjualan=lambda: new_headers, penjualan_item=lambda: new_lines, m_obat=lambda: L.apply_stock(drugs, mov),
        stok_kartu=lambda: _append_ledger(ledger_rows, mov, ["line_id"]),
        audit_log=lambda: audit_rows(new_headers, "CREATE", "penjualan", F.col("id"),
                                     ["no_nota", "tgl", "jenis", "pelanggan_kode", "dokter_sip"], F.lit(str(as_of))))


# ---------------------------------------------------------------------- J3
def reverse_purchases(requests: DataFrame, purchases: DataFrame, lines: DataFrame, drugs: DataFrame,
                      ledger_rows: DataFrame, payables: DataFrame, pays: DataFrame, as_of) -> Tables:
    """Reverse whole purchases, one after another by purchase id.  A
    purchase without lines is not found; one whose any line's drug has less
    stock left by the earlier ones than the line's quantity is refused (all or
    nothing).  Otherwise: stock down, BATAL_BELI ledger rows, and its lines,
    payables (all of them), their payments and the header go.  Drug expiry is
    not restored (as the reference)."""
    ensure_checkpoint_dir(requests.sparkSession)
    req = requests.select(F.col("pembelian_id")).distinct()
    li = lines.join(req, "pembelian_id", "left_semi")
    judged = admit_reversals(li.select(F.col("pembelian_id").alias("req_id"), F.col("id").alias("line_id"),
                                       "obat_kode", "qty"), drugs).withColumnRenamed("req_id", "pembelian_id")
    per = li.groupBy("pembelian_id").agg(F.count(F.lit(1)).alias("n_lines"))
    verdict = req.join(per, "pembelian_id", "left").join(judged, "pembelian_id", "left").select(
        "pembelian_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("n_short", F.lit(0)).cast("long").alias("n_short"), "first_short_drug",
        F.coalesce("accepted", F.lit(False)).alias("accepted")) \
        .withColumn("error", F.when(F.col("n_lines") == 0, F.lit("Not found"))
                    .when(F.col("n_short") > 0, F.lit(model.MSG_REVERSAL_STOCK)))
    verdict = materialize(verdict, "reversal-verdicts")
    ok = verdict.filter("accepted").select("pembelian_id")
    gone = li.join(ok, "pembelian_id", "left_semi")
    mov = L.reversal_movements(gone)
    gone_h = payables.join(ok, "pembelian_id", "left_semi").select(F.col("id").alias("hutang_id"))
    return Tables(
        verdicts=lambda: verdict,
        pembelian=lambda: purchases.join(ok.withColumnRenamed("pembelian_id", "id"), "id", "left_anti"),
        pembelian_item=lambda: lines.join(ok, "pembelian_id", "left_anti"),
        hutang_supplier=lambda: payables.join(ok, "pembelian_id", "left_anti"),
        hutang_supplier_bayar=lambda: pays.join(gone_h, "hutang_id", "left_anti"),
        m_obat=lambda: L.apply_stock(drugs, mov),
        stok_kartu=lambda: _append_ledger(ledger_rows, mov, ["line_id"]),
        audit_log=lambda: audit_rows(ok, "DELETE", "pembelian", F.col("pembelian_id"), [], F.lit(str(as_of))))
