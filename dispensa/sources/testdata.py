"""Views of the driver's test tables in the pharmacy schema.

The driver ships TPC-H-like tables (``part``, ``customer``, ``orders``,
``lineitem``, ``events``, ``documents``...).  These functions rename, cast
and shape their columns into the tables of ``dispensa.model`` as FIXTURES.md
§3 prescribes.  The one rule they apply is the choice of open payables in
``hutang`` (unpaid part of total + tax > 0), which makes the payments' input
table; request batches are shaped from rows by fixed key rules.  The same mapping is written
in DuckDB SQL in ``dispensa.checks.oracle_views`` for the correctness oracle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dispensa import model
from dispensa.plans.prefix import number_rows

AS_OF = dt.date(1998, 6, 15)          # "today" for sales, purchases, drugs
AS_OF_LEDGER = dt.date(2024, 1, 31)   # "today" for the ledger (events)

MONEY = model.MONEY


def raw(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def _money(c: Column) -> Column:
    return c.cast(MONEY)


def _golongan(p_type: Column) -> Column:
    # PROMO and LARGE stand for the two controlled classes
    return (F.when(p_type == "PROMO", "Psikotropika")
             .when(p_type == "LARGE", "Narkotika")
             .when(p_type == "MEDIUM", "OBT")
             .when(p_type == "STANDARD", "OK")
             .otherwise("OTC"))


def obat(spark: SparkSession, d: str) -> DataFrame:
    p = raw(spark, d, "part")
    gol = _golongan(F.col("p_type"))
    return p.select(
        F.col("p_partkey").cast("long").alias("id"),
        F.col("p_partkey").cast("string").alias("kode"),
        F.col("p_name").alias("nama"),
        F.col("p_brand").alias("produsen"),
        _money(F.col("p_retailprice")).alias("harga"),
        (F.col("p_size") * 20).cast("int").alias("stok"),
        F.date_add(F.lit(AS_OF), (F.pmod(F.col("p_partkey") * 37, F.lit(400)) - 40).cast("int")).alias("expired_date"),
        gol.alias("golongan"),
        gol.isin(*model.CONTROLLED).alias("narkotika_psikotropika"),
    )


def pelanggan(spark: SparkSession, d: str) -> DataFrame:
    c = raw(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    p = raw(spark, d, "part").select("p_partkey", "p_name")
    j = c.join(p, c.c_custkey == p.p_partkey, "left")
    return j.select(
        F.col("c_custkey").cast("long").alias("id"),
        F.col("c_custkey").cast("string").alias("kode"),
        F.col("c_name").alias("nama"),
        F.lit(None).cast("date").alias("tgl_lahir"),
        F.lit(None).cast("string").alias("jenis_kelamin"),
        F.when(F.pmod(F.col("c_custkey"), F.lit(10)) == 0, F.upper("p_name")).alias("alergi"),
        F.lit(None).cast("string").alias("kondisi_medis"),
        F.lit(None).cast("string").alias("no_hp"),
        F.col("c_mktsegment").alias("alamat"),
    )


def supplier(spark: SparkSession, d: str) -> DataFrame:
    s = raw(spark, d, "supplier")
    return s.select(
        F.col("s_suppkey").cast("long").alias("id"),
        F.col("s_suppkey").cast("string").alias("kode"),
        F.col("s_name").alias("nama"),
        F.lit(None).cast("string").alias("sertifikasi"),
        F.lit(None).cast("string").alias("alamat"),
        F.lit(None).cast("string").alias("kontak"),
    )


def penjualan(spark: SparkSession, d: str) -> DataFrame:
    o = raw(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").cast("long").alias("id"),
        F.concat(F.lit("PJ"), F.col("o_orderkey").cast("string")).alias("no_nota"),
        F.col("o_orderdate").alias("tgl"),
        F.when(F.col("o_orderstatus") == "O", "OTC").when(F.col("o_orderstatus") == "P", "Resep")
         .when(F.col("o_orderstatus") == "F", "Racik").alias("jenis"),
        F.col("o_custkey").cast("string").alias("pelanggan_kode"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("dokter_sip"),
        F.lit(False).alias("narkotika_psikotropika"),
        _money(F.col("o_totalprice")).alias("total"),
        F.lit(None).cast("int").alias("created_by"),
    )


def _line_ids(li: DataFrame) -> DataFrame:
    # (l_orderkey, l_linenumber) is not unique; number lines inside an order
    # over the full unique tuple.  One window per order (bounded: an order
    # has a handful of lines).
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return li.withColumn("__rn", F.row_number().over(w)) \
             .withColumn("__id", F.col("l_orderkey") * 100 + F.col("__rn"))


def penjualan_item(spark: SparkSession, d: str) -> DataFrame:
    li = raw(spark, d, "lineitem").filter(F.col("l_returnflag") != "R")
    li = _line_ids(li)
    return li.select(
        F.col("__id").cast("long").alias("id"),
        F.col("l_orderkey").cast("long").alias("penjualan_id"),
        F.col("l_partkey").cast("string").alias("obat_kode"),
        F.lit(None).cast("string").alias("batch_no"),
        F.col("l_quantity").cast("int").alias("qty"),
        _money(F.col("l_extendedprice")).alias("harga_jual"),
        F.lit(None).cast("string").alias("dosis"),
        F.lit(None).cast("string").alias("etiket"),
    )


def pembelian(spark: SparkSession, d: str, with_bayar: bool = False) -> DataFrame:
    o = raw(spark, d, "orders")
    cols = [
        F.col("o_orderkey").cast("long").alias("id"),
        F.concat(F.lit("PB"), F.col("o_orderkey").cast("string")).alias("no_faktur"),
        F.to_date("o_orderdate").alias("tgl"),
        F.pmod(F.col("o_orderkey"), F.lit(10)).cast("string").alias("supplier_kode"),
        _money(F.floor(F.col("o_totalprice") / 10)).alias("pajak"),
        _money(F.col("o_totalprice")).alias("total"),
    ]
    if with_bayar:
        cols.append(
            F.when(F.col("o_orderstatus") == "F",
                   _money(F.col("o_totalprice")) + _money(F.floor(F.col("o_totalprice") / 10)))
             .when(F.col("o_orderstatus") == "P", _money(F.floor(F.col("o_totalprice") / 2)))
             .otherwise(F.lit(0)).cast(MONEY).alias("bayar"))
    return o.select(*cols)


def pembelian_item(spark: SparkSession, d: str) -> DataFrame:
    li = raw(spark, d, "lineitem").filter(F.col("l_returnflag") == "R")
    li = _line_ids(li)
    return li.select(
        F.col("__id").cast("long").alias("id"),
        F.col("l_orderkey").cast("long").alias("pembelian_id"),
        F.col("l_partkey").cast("string").alias("obat_kode"),
        F.concat(F.lit("B"), F.col("l_linenumber").cast("string")).alias("batch_no"),
        F.to_date("l_shipdate").alias("expired_date"),
        F.col("l_quantity").cast("int").alias("qty"),
        _money(F.col("l_extendedprice")).alias("harga_beli"),
        F.lit(False).alias("cold_chain"),
        F.lit(None).cast("decimal(5,2)").alias("suhu_min"),
        F.lit(None).cast("decimal(5,2)").alias("suhu_max"),
    )


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all shuffle partitions: a few small files that are made
    into many rows would otherwise be one task's work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def interaksi(spark: SparkSession, d: str) -> DataFrame:
    p = raw(spark, d, "part").select("p_partkey")
    n = p.agg(F.count(F.lit(1))).scalar()               # scalar subquery: number of parts
    x = _spread(p, "p_partkey").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    x = x.withColumn("other", F.pmod(F.col("p_partkey") * 7 + F.col("k") * 13 + 1, n))
    x = x.filter(F.col("other") != F.col("p_partkey"))
    a = F.col("p_partkey").cast("string")
    b = F.col("other").cast("string")
    x = x.select(F.least(a, b).alias("obat1_kode"), F.greatest(a, b).alias("obat2_kode"),
                 F.pmod(F.col("p_partkey") + F.col("k"), F.lit(4)).alias("lvl"),
                 (F.col("p_partkey") * 5 + F.col("k")).alias("src"))
    g = x.groupBy("obat1_kode", "obat2_kode").agg(F.min("lvl").alias("lvl"), F.min("src").alias("id"))
    return g.select(
        F.col("id").cast("long").alias("id"), "obat1_kode", "obat2_kode",
        F.element_at(F.array(*[F.lit(t) for t in ("contraindicated", "major", "moderate", "minor")]),
                     (F.col("lvl") + 1).cast("int")).alias("tingkat"),
        F.lit(None).cast("string").alias("keterangan"),
    )


def ledger_movements(spark: SparkSession, d: str) -> DataFrame:
    """Stock movements without balances (``saldo`` null): events as ledger rows."""
    e = raw(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    rt = (F.when(F.col("event_type").isin("signup", "purchase"), "BELI")
           .when(F.col("event_type") == "error", "KOREKSI").otherwise("JUAL"))
    q = F.floor("value").cast("int")
    return e.select(
        F.col("event_id").cast("long").alias("id"),
        F.col("ts").alias("tgl"),
        F.col("user_id").cast("string").alias("obat_kode"),
        F.lit(None).cast("string").alias("batch_no"),
        rt.alias("ref_type"),
        F.lit(None).cast("long").alias("ref_id"),
        F.when(rt == "BELI", q).otherwise(0).alias("qty_in"),
        F.when(rt != "BELI", q).otherwise(0).alias("qty_out"),
        F.lit(None).cast("long").alias("saldo"),
        F.col("event_type").alias("keterangan"),
    )


def hutang(spark: SparkSession, d: str) -> DataFrame:
    """Open payables of the mapped purchases, numbered from 0 by purchase id."""
    p = pembelian(spark, d, with_bayar=True)
    due = p.withColumn("saldo", F.greatest(F.lit(0), F.col("total") + F.col("pajak") - F.col("bayar")).cast(MONEY))
    due = due.filter(F.col("saldo") > 0)
    due = number_rows(due, ["id"], name="hid", start=0)
    return due.select(F.col("hid").cast("long").alias("id"), "supplier_kode",
                      F.col("id").alias("pembelian_id"), "saldo")


def hutang_bayar(spark: SparkSession, d: str, payables: DataFrame) -> DataFrame:
    """Payment requests: purchase events spread over the open payables."""
    e = raw(spark, d, "events").filter(F.col("event_type") == "purchase")
    m = payables.agg(F.floor(F.count(F.lit(1)) / 50)).scalar()   # scalar subquery
    return e.select(
        F.col("event_id").cast("long").alias("id"),
        F.pmod(F.col("event_id"), F.greatest(m, F.lit(1))).cast("long").alias("hutang_id"),
        F.to_date("ts").alias("tgl"),
        F.round(F.col("value") * 400, 2).cast(MONEY).alias("nominal"),
        F.lit(None).cast("string").alias("metode"),
        F.lit(None).cast("string").alias("keterangan"),
    )


def page_lines(spark: SparkSession, d: str) -> DataFrame:
    """Recognised text lines per page file: (name, line_no, text)."""
    doc = raw(spark, d, "documents").select("doc_id", "text")
    name = F.concat(F.lit("p"), F.col("doc_id").cast("string"),
                    F.when(F.pmod(F.col("doc_id"), F.lit(4)) < 3, F.lit(".jpg")).otherwise(F.lit(".txt")))
    return doc.select(name.alias("name"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))


def formula(spark: SparkSession, d: str) -> DataFrame:
    """Compound formulas: one per order, ``komposisi`` as JSON text."""
    li = raw(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                          "l_quantity", "l_extendedprice", "l_shipdate")
    li = _line_ids(li)
    comp = F.struct(F.col("__rn").alias("pos"),
                    F.struct(F.col("l_partkey").cast("string").alias("obat_kode"),
                             F.col("l_quantity").alias("qty"), F.lit("tab").alias("satuan")).alias("v"))
    g = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(comp)).alias("c"))
    return g.select(
        F.col("l_orderkey").cast("long").alias("id"),
        F.concat(F.lit("FR"), F.col("l_orderkey").cast("string")).alias("kode"),
        F.concat(F.lit("Formula "), F.col("l_orderkey").cast("string")).alias("nama"),
        F.to_json(F.transform("c", lambda x: x["v"])).alias("komposisi"),
    )


def drug_requests(spark: SparkSession, d: str) -> DataFrame:
    """Drug insert requests as raw text fields (all strings, as a JSON body
    of strings would arrive), made from ``part``; some fields are written in
    shapes the rules refuse (long code, blank name, signed stock, unpadded
    date, class outside the list)."""
    p = raw(spark, d, "part")
    k = F.col("p_partkey")
    exp = F.date_add(F.lit(AS_OF), (F.pmod(k * 37, F.lit(400)) - 40).cast("int"))
    return p.select(
        k.cast("long").alias("id"),
        F.when(F.pmod(k, F.lit(19)) == 0, F.repeat(F.col("p_name"), 6)).otherwise(k.cast("string")).alias("kode"),
        F.when(F.pmod(k, F.lit(17)) == 0, F.lit("")).otherwise(F.col("p_name")).alias("nama"),
        F.col("p_brand").alias("produsen"),
        F.col("p_retailprice").cast("string").alias("harga"),
        F.when(F.pmod(k, F.lit(11)) == 0, F.concat(F.lit("-"), F.col("p_size").cast("string")))
         .otherwise(F.col("p_size").cast("string")).alias("stok"),
        F.when(F.pmod(k, F.lit(13)) == 0, F.date_format(exp, "yyyy-M-d"))
         .otherwise(F.date_format(exp, "yyyy-MM-dd")).alias("expired_date"),
        F.when(F.pmod(k, F.lit(7)) == 0, F.col("p_type")).otherwise(_golongan(F.col("p_type"))).alias("golongan"),
    )


def master_requests(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Insert requests of the other master tables as raw text fields, with an
    ``id`` each: customers and staff from ``customer``, suppliers and doctors
    from ``supplier``, formulas from ``part``.  Some fields are written in
    shapes the rules refuse (blank or long names, unpadded dates, values
    outside a list, long phone numbers)."""
    c, s, p = (raw(spark, d, t) for t in ("customer", "supplier", "part"))

    def every(key: str, n: int, bad: Column, good: Column) -> Column:
        return F.when(F.pmod(F.col(key), F.lit(n)) == 0, bad).otherwise(good)

    born = F.date_add(F.lit(AS_OF), (-F.pmod(F.col("c_custkey") * 41, F.lit(20000))).cast("int"))
    return {
        "pelanggan": c.select(
            F.col("c_custkey").cast("long").alias("id"), F.col("c_custkey").cast("string").alias("kode"),
            every("c_custkey", 17, F.lit(""), F.col("c_name")).alias("nama"),
            every("c_custkey", 13, F.date_format(born, "yyyy-M-d"), F.date_format(born, "yyyy-MM-dd")).alias("tgl_lahir"),
            every("c_custkey", 7, F.lit("X"), every("c_custkey", 2, F.lit("L"), F.lit("P"))).alias("jenis_kelamin"),
            every("c_custkey", 11, F.repeat(F.col("c_custkey").cast("string"), 31), F.lit(None).cast("string")).alias("no_hp"),
            F.col("c_mktsegment").alias("alamat")),
        "karyawan": c.select(
            F.col("c_custkey").cast("long").alias("id"), F.col("c_custkey").cast("string").alias("kode"),
            F.col("c_name").alias("nama"), every("c_custkey", 5, F.lit(""), F.col("c_mktsegment")).alias("jabatan"),
            every("c_custkey", 3, F.col("c_mktsegment"), F.lit("kasir")).alias("level_akses")),
        "supplier": s.select(
            F.col("s_suppkey").cast("long").alias("id"), F.col("s_suppkey").cast("string").alias("kode"),
            every("s_suppkey", 5, F.repeat("s_name", 20), F.col("s_name")).alias("nama"),
            every("s_suppkey", 7, F.repeat("s_name", 8), F.lit(None).cast("string")).alias("kontak")),
        "dokter": s.select(
            F.col("s_suppkey").cast("long").alias("id"),
            every("s_suppkey", 3, F.repeat("s_name", 8), F.col("s_suppkey").cast("string")).alias("sip"),
            every("s_suppkey", 4, F.lit(None).cast("string"), F.col("s_name")).alias("nama")),
        "formula": p.select(
            F.col("p_partkey").cast("long").alias("id"),
            every("p_partkey", 6, F.repeat(F.col("p_name"), 40), F.col("p_name")).alias("nama"),
            every("p_partkey", 9, F.repeat(F.col("p_name"), 30), F.lit(None).cast("string")).alias("dokter_sip")),
    }


def interaction_requests(spark: SparkSession, d: str) -> DataFrame:
    """Interaction insert requests: part × five offsets, unsorted, self
    pairs and repeated pairs included."""
    p = raw(spark, d, "part").select("p_partkey")
    n = p.agg(F.count(F.lit(1))).scalar()
    x = _spread(p, "p_partkey").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    other = F.pmod(F.col("p_partkey") * 7 + F.col("k") * 13 + 1, n)
    lvl = F.element_at(F.array(*[F.lit(t) for t in ("contraindicated", "major", "moderate", "minor")]),
                       (F.pmod(F.col("p_partkey") + F.col("k"), F.lit(4)) + 1).cast("int"))
    return x.select((F.col("p_partkey") * 5 + F.col("k")).cast("long").alias("id"),
                    F.col("p_partkey").cast("string").alias("obat1_kode"),
                    other.cast("string").alias("obat2_kode"), lvl.alias("tingkat"),
                    F.lit(None).cast("string").alias("keterangan"))


def typed_drug_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Drug fields as typed in a purchase form, one per purchase line:
    "CODE - NAME", a bare code, a bare name (in capitals), or unknown text."""
    li = pembelian_item(spark, d).select("id", "obat_kode")
    o = obat(spark, d).select(F.col("kode").alias("obat_kode"), "nama")
    j = li.join(o, "obat_kode", "left")
    form = F.pmod(F.col("id"), F.lit(4))
    text = (F.when(form == 0, F.concat_ws(" - ", "obat_kode", "nama"))
             .when(form == 1, F.concat(F.lit(" "), F.col("obat_kode"), F.lit(" ")))
             .when(form == 2, F.upper("nama"))
             .otherwise(F.concat(F.lit("X"), F.col("obat_kode"))))
    return j.select("id", text.alias("obat_input"))


def purchase_requests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Purchase requests (headers, lines) from the mapped purchases: header
    fields as text; the second line of each invoice comes with a blank expiry."""
    h = pembelian(spark, d, with_bayar=True)
    headers = h.select(F.col("id").alias("req_id"), "no_faktur", F.date_format("tgl", "yyyy-MM-dd").alias("tgl"),
                       "supplier_kode", F.col("pajak").cast("string").alias("pajak"), "bayar")
    li = pembelian_item(spark, d)
    pos = (F.col("id") - F.col("pembelian_id") * 100 - 1).cast("int")
    lines = li.select(F.col("pembelian_id").alias("req_id"), pos.alias("pos"), "obat_kode", "batch_no",
                      F.when(pos == 1, F.lit("")).otherwise(F.date_format("expired_date", "yyyy-MM-dd"))
                       .alias("expired_date"),
                      "qty", "harga_beli", "cold_chain", "suhu_min", "suhu_max")
    return headers, lines


def sale_requests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sale requests (headers, lines) from the mapped sales."""
    s = penjualan(spark, d)
    headers = s.select(F.col("id").alias("req_id"), "no_nota",
                       F.date_format("tgl", "yyyy-MM-dd HH:mm:ss").alias("tgl"), "jenis", "pelanggan_kode",
                       "dokter_sip")
    li = penjualan_item(spark, d)
    pos = (F.col("id") - F.col("penjualan_id") * 100 - 1).cast("int")
    lines = li.select(F.col("penjualan_id").alias("req_id"), pos.alias("pos"), F.col("id").alias("line_id"),
                      "obat_kode", "qty", "harga_jual", "batch_no", "dosis", "etiket")
    return headers, lines


def drug_changes(spark: SparkSession, d: str) -> DataFrame:
    """Change feed on drugs (kode, op, seq, payload JSON) made from ``part``:
    by key mod 5 — update of the name, update setting the maker to null,
    delete, insert of a new key (key + number of parts), none; keys mod 15 = 0
    get a second update (price), keys mod 15 = 2 are re-inserted after the
    delete."""
    p = raw(spark, d, "part")
    k = F.col("p_partkey")
    n = p.agg(F.count(F.lit(1))).scalar()
    r = F.pmod(k, F.lit(5))
    gol = _golongan(F.col("p_type"))
    full = F.to_json(F.struct(F.col("p_name").alias("nama"), F.col("p_retailprice").cast("string").alias("harga"),
                              F.col("p_size").cast("string").alias("stok"), gol.alias("golongan")))
    first = p.filter(r != 4).select(
        F.when(r == 3, (k + n).cast("string")).otherwise(k.cast("string")).alias("kode"),
        F.when(r <= 1, F.lit("update")).when(r == 2, F.lit("delete")).otherwise(F.lit("insert")).alias("op"),
        F.lit(1).cast("long").alias("seq"),
        F.when(r == 0, F.to_json(F.struct(F.upper("p_name").alias("nama"))))
         .when(r == 1, F.lit('{"produsen":null}'))
         .when(r == 2, F.lit("{}")).otherwise(full).alias("payload"))
    second = p.filter(F.pmod(k, F.lit(15)).isin(0, 2)).select(
        k.cast("string").alias("kode"),
        F.when(F.pmod(k, F.lit(15)) == 0, F.lit("update")).otherwise(F.lit("insert")).alias("op"),
        F.lit(2).cast("long").alias("seq"),
        F.when(F.pmod(k, F.lit(15)) == 0, F.lit('{"harga":"1.00"}')).otherwise(full).alias("payload"))
    return first.unionByName(second)


def sale_request_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Sale requests as JSON bodies (header fields + ``items`` list), one per
    sale with lines."""
    hdr, lines = sale_requests(spark, d)
    it = F.struct(F.col("pos"), F.struct("obat_kode", "qty", "harga_jual", "batch_no", "dosis", "etiket").alias("v"))
    items = lines.groupBy("req_id").agg(F.sort_array(F.collect_list(it)).alias("__it")) \
                 .select("req_id", F.transform("__it", lambda x: x["v"]).alias("items"))
    j = hdr.join(items, "req_id")
    return j.select("req_id", F.to_json(F.struct("no_nota", "tgl", "jenis", "pelanggan_kode", "dokter_sip",
                                                 "items")).alias("body"))


def customer_changes(spark: SparkSession, d: str) -> DataFrame:
    """Change feed on customers (kode, op, seq, payload JSON), all updates, by
    key mod 4: set an allergy, clear it with an explicit null, rename (allergy
    absent from the body), none."""
    c = raw(spark, d, "customer").select("c_custkey", "c_name")
    r = F.pmod(F.col("c_custkey"), F.lit(4))
    return c.filter(r != 3).select(
        F.col("c_custkey").cast("string").alias("kode"), F.lit("update").alias("op"),
        F.lit(1).cast("long").alias("seq"),
        F.when(r == 0, F.lit('{"alergi":"PARACETAMOL"}'))
         .when(r == 1, F.lit('{"alergi":null}'))
         .otherwise(F.to_json(F.struct(F.upper("c_name").alias("nama")))).alias("payload"))


def dokter(spark: SparkSession, d: str) -> DataFrame:
    s = raw(spark, d, "supplier")
    return s.select(F.col("s_suppkey").cast("string").alias("sip"), F.col("s_name").alias("nama"),
                    F.lit(None).cast("string").alias("spesialisasi"),
                    F.lit("RS").alias("fasilitas_kesehatan"))


def karyawan(spark: SparkSession, d: str) -> DataFrame:
    c = raw(spark, d, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("kode"), F.col("c_name").alias("nama"),
                    F.col("c_mktsegment").alias("jabatan"), F.lit("kasir").alias("level_akses"))


def formula_keys(spark: SparkSession, d: str) -> DataFrame:
    o = raw(spark, d, "orders")
    return o.select(F.concat(F.lit("FR"), F.col("o_orderkey").cast("string")).alias("kode"))


MASTERS = ["m_obat", "m_pelanggan", "m_dokter", "m_supplier", "m_karyawan", "m_formula_racik", "interaksi_obat"]


def master_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The stored tables that ``master_changes`` changes."""
    return {"m_obat": obat(spark, d), "m_pelanggan": pelanggan(spark, d), "m_dokter": dokter(spark, d),
            "m_supplier": supplier(spark, d), "m_karyawan": karyawan(spark, d),
            "m_formula_racik": formula_keys(spark, d), "interaksi_obat": interaksi(spark, d)}


def master_changes(spark: SparkSession, d: str) -> DataFrame:
    """One change per event over all seven master tables, in event order; a
    third of them on one key, the rest by user.  Bodies vary: whole, without a
    name, outside a list, explicit null, unknown field only, broken JSON."""
    n = raw(spark, d, "part").agg(F.count(F.lit(1))).scalar()
    e, u = F.col("event_id"), F.col("user_id")
    q = F.floor(e / 7).cast("long")
    ev = raw(spark, d, "events").select(
        e.cast("long").alias("seq"),
        F.element_at(F.array(*[F.lit(x) for x in MASTERS]), (F.pmod(e, F.lit(7)) + 1).cast("int")).alias("entity"),
        q.alias("q"), F.pmod(F.floor(q / 15), F.lit(5)).alias("v"),
        F.when(F.pmod(q, F.lit(3)) == 0, F.lit(7)).otherwise(u).cast("long").alias("k"))
    pair, v, k, o = F.col("entity") == "interaksi_obat", F.col("v"), F.col("k"), F.pmod(F.col("q"), F.lit(5))
    op = F.when(o <= 1, F.lit("insert")).when(o <= 3, F.lit("update")).otherwise(F.lit("delete"))
    text, seq = k.cast("string"), F.col("seq").cast("string")
    whole = F.concat(F.lit('{"nama":"'), F.when(v == 3, F.lit("")).otherwise(F.concat(F.lit("N"), seq)),
                     F.lit('","harga":"'), text, F.lit('.50","stok":"5","golongan":"'),
                     F.when(v == 4, F.lit("X")).otherwise(F.lit("OTC")),
                     F.lit('","jenis_kelamin":"L","jabatan":"staf","level_akses":"'),
                     F.when(v == 4, F.lit("X")).otherwise(F.lit("kasir")), F.lit('"}'))
    both = F.concat(F.lit('{"obat1_kode":"'), text, F.lit('","obat2_kode":"'),
                    F.when(v == 3, k).otherwise(F.pmod(k * 7 + F.pmod(F.col("q"), F.lit(7)) * 13 + 1, n)).cast("string"),
                    F.lit('","tingkat":"'), F.when(v == 4, F.lit("X")).otherwise(F.lit("major")), F.lit('"}'))
    some = F.when(v == 0, F.concat(F.lit('{"nama":"U'), seq, F.lit('","keterangan":"baru"}'))) \
            .when(v == 1, F.lit('{"nama":null,"tingkat":null}')).when(v == 2, F.lit('{"lain":"x"}')) \
            .when(v == 3, F.lit('{"nama":')) \
            .otherwise(F.lit('{"produsen":null,"alergi":null,"alamat":null,"spesialisasi":null,'
                             '"jabatan":"kepala","petunjuk":null,"tingkat":"minor"}'))
    return ev.select(
        "entity",
        F.when((o <= 1) & (F.pmod(F.col("q"), F.lit(17)) == 0), F.lit(" "))
         .when(pair & (o > 1), (k * 5 + F.pmod(F.floor(F.col("q") / 5), F.lit(5))).cast("string"))
         .when(F.col("entity") == "m_formula_racik", F.concat(F.lit("FR"), text)).otherwise(text).alias("key"),
        op.alias("op"), "seq",
        F.when((o <= 1) & pair, both).when(o <= 1, whole).when(o <= 3, some).otherwise(F.lit("{}")).alias("payload"))
