"""Table schemas and fixed domains of the pharmacy data model.

Money is ``decimal(15,2)``; sale and ledger times are ``timestamp_ntz``
(wall clock, no zone); drug codes are strings compared byte-wise.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the reference's declared domains, labels
# and limits for results to match; they are stated here as plain text in the
# reference's own declaration order (enum order matters for sorting).
# ---------------------------------------------------------------------------
GOLONGAN = ["OTC", "OBT", "OK", "Psikotropika", "Narkotika"]      # drug class
CONTROLLED = ["Psikotropika", "Narkotika"]                         # controlled drug classes
JENIS = ["OTC", "Resep", "Racik"]                                  # sale type
TINGKAT = ["minor", "moderate", "major", "contraindicated"]        # interaction level
SEVERE = ["contraindicated", "major"]                              # levels that refuse a sale
REF_TYPE = ["BELI", "JUAL", "RETUR_IN", "RETUR_OUT", "KOREKSI", "RACIK_IN", "RACIK_OUT",
            "BATAL_BELI"]                                          # ledger movement kind (+ reversal)
JENIS_KELAMIN = ["L", "P"]
LEVEL_AKSES = ["farmasi", "kasir", "gudang", "admin"]
ROLE = ["admin", "apoteker", "kasir", "gudang", "owner"]
KAS_JENIS = ["KAS", "BANK"]
# validator domains (accept NONE, which the table enum does not)
GOLONGAN_RULE = ["NONE", "OTC", "OBT", "OK", "Psikotropika", "Narkotika"]
JENIS_RULE = ["NONE", "OTC", "Resep", "Racik"]

EXPIRY_EXPIRED = "KADALUARSA"
EXPIRY_NEAR = "HAMPIR KADALUARSA"
EXPIRY_SAFE = "AMAN"
PAYABLE_OPEN = "HUTANG"
PAYABLE_PAID = "LUNAS"

# parameter defaults and limits: (default, low, high)
LIMIT_LIST = (20, 1, 200)
LIMIT_INTERACTIONS = (50, 1, 500)
LIMIT_STOCK_CARD = (200, 1, 500)
LIMIT_TOP = (10, 1, 100)
EXPIRY_DAYS = (30, 1, 365)
LOW_STOCK = 5

# code prefixes for generated keys
PREFIX_DRUG = "OB"
PREFIX_CUSTOMER = "PL"
PREFIX_DOCTOR = "DR"
PREFIX_SUPPLIER = "SP"
PREFIX_STAFF = "KY"
PREFIX_FORMULA = "FR"
PREFIX_PURCHASE = "PB"
PREFIX_SALE = "PJ"

# error messages of the admission checks (reference wording)
MSG_ITEM_INVALID = "obat_kode/qty tidak valid"
MSG_DRUG_MISSING = "Obat tidak ditemukan"
MSG_NO_STOCK = "Stok tidak cukup"
MSG_EXPIRED = "Obat kadaluarsa"
MSG_ALLERGY = "Alergi pasien terdeteksi"
MSG_MIN_ITEM = "Minimal 1 item"
MSG_DOCTOR = "Wajib untuk resep/racik"
MSG_SUPPLIER_MISSING = "Supplier tidak ditemukan"
MSG_QTY_MIN = "qty minimal 1"
MSG_PRICE_NEG = "harga_beli tidak boleh negatif"
MSG_PAY_POSITIVE = "Harus > 0"
MSG_PAY_NOT_FOUND = "Not found"
MSG_PAY_OVER = "Lebih besar dari saldo hutang"
MSG_REVERSAL_STOCK = "Tidak bisa hapus: stok sudah terpakai"
MSG_NUMBER_TAKEN = "no_faktur sudah dipakai"  # own wording: a unique-key violation
MSG_DATE = "Format tanggal tidak valid"  # own wording: a value that is no date
MSG_PAIR_SAME = "Obat tidak boleh sama"

MONEY = T.DecimalType(15, 2)

OBAT = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("kode", T.StringType(), False),
    T.StructField("nama", T.StringType(), False),
    T.StructField("produsen", T.StringType(), True),
    T.StructField("harga", MONEY, False),
    T.StructField("stok", T.IntegerType(), False),
    T.StructField("expired_date", T.DateType(), True),
    T.StructField("golongan", T.StringType(), False),
    T.StructField("narkotika_psikotropika", T.BooleanType(), False),
])

PELANGGAN = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("kode", T.StringType(), False),
    T.StructField("nama", T.StringType(), False),
    T.StructField("tgl_lahir", T.DateType(), True),
    T.StructField("jenis_kelamin", T.StringType(), True),
    T.StructField("alergi", T.StringType(), True),
    T.StructField("kondisi_medis", T.StringType(), True),
    T.StructField("no_hp", T.StringType(), True),
    T.StructField("alamat", T.StringType(), True),
])

SUPPLIER = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("kode", T.StringType(), False),
    T.StructField("nama", T.StringType(), False),
    T.StructField("sertifikasi", T.StringType(), True),
    T.StructField("alamat", T.StringType(), True),
    T.StructField("kontak", T.StringType(), True),
])

INTERAKSI = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("obat1_kode", T.StringType(), False),
    T.StructField("obat2_kode", T.StringType(), False),
    T.StructField("tingkat", T.StringType(), False),
    T.StructField("keterangan", T.StringType(), True),
])

PEMBELIAN = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("no_faktur", T.StringType(), False),
    T.StructField("tgl", T.DateType(), False),
    T.StructField("supplier_kode", T.StringType(), False),
    T.StructField("pajak", MONEY, False),
    T.StructField("total", MONEY, False),
])

PEMBELIAN_ITEM = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("pembelian_id", T.LongType(), False),
    T.StructField("obat_kode", T.StringType(), False),
    T.StructField("batch_no", T.StringType(), False),
    T.StructField("expired_date", T.DateType(), True),
    T.StructField("qty", T.IntegerType(), False),
    T.StructField("harga_beli", MONEY, False),
    T.StructField("cold_chain", T.BooleanType(), False),
    T.StructField("suhu_min", T.DecimalType(5, 2), True),
    T.StructField("suhu_max", T.DecimalType(5, 2), True),
])

PENJUALAN = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("no_nota", T.StringType(), False),
    T.StructField("tgl", T.TimestampNTZType(), False),
    T.StructField("jenis", T.StringType(), False),
    T.StructField("pelanggan_kode", T.StringType(), True),
    T.StructField("dokter_sip", T.StringType(), True),
    T.StructField("narkotika_psikotropika", T.BooleanType(), False),
    T.StructField("total", MONEY, False),
    T.StructField("created_by", T.IntegerType(), True),
])

PENJUALAN_ITEM = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("penjualan_id", T.LongType(), False),
    T.StructField("obat_kode", T.StringType(), False),
    T.StructField("batch_no", T.StringType(), True),
    T.StructField("qty", T.IntegerType(), False),
    T.StructField("harga_jual", MONEY, False),
    T.StructField("dosis", T.StringType(), True),
    T.StructField("etiket", T.StringType(), True),
])

STOK_KARTU = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("tgl", T.TimestampNTZType(), False),
    T.StructField("obat_kode", T.StringType(), False),
    T.StructField("batch_no", T.StringType(), True),
    T.StructField("ref_type", T.StringType(), False),
    T.StructField("ref_id", T.LongType(), True),
    T.StructField("qty_in", T.IntegerType(), False),
    T.StructField("qty_out", T.IntegerType(), False),
    T.StructField("saldo", T.LongType(), True),
    T.StructField("keterangan", T.StringType(), True),
])

HUTANG = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("supplier_kode", T.StringType(), False),
    T.StructField("pembelian_id", T.LongType(), True),
    T.StructField("saldo", MONEY, False),
])

HUTANG_BAYAR = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("hutang_id", T.LongType(), False),
    T.StructField("tgl", T.DateType(), False),
    T.StructField("nominal", MONEY, False),
    T.StructField("metode", T.StringType(), True),
    T.StructField("keterangan", T.StringType(), True),
])

AUDIT_LOG = T.StructType([
    T.StructField("tgl", T.TimestampNTZType(), False),
    T.StructField("user_id", T.IntegerType(), True),
    T.StructField("action", T.StringType(), False),
    T.StructField("entity", T.StringType(), False),
    T.StructField("entity_id", T.StringType(), True),
    T.StructField("detail", T.StringType(), True),
    T.StructField("ip", T.StringType(), True),
])

SCHEMAS = {
    "m_obat": OBAT, "m_pelanggan": PELANGGAN, "m_supplier": SUPPLIER,
    "interaksi_obat": INTERAKSI, "pembelian": PEMBELIAN, "pembelian_item": PEMBELIAN_ITEM,
    "penjualan": PENJUALAN, "penjualan_item": PENJUALAN_ITEM, "stok_kartu": STOK_KARTU,
    "hutang_supplier": HUTANG, "hutang_supplier_bayar": HUTANG_BAYAR, "audit_log": AUDIT_LOG,
}
