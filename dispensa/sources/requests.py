"""A2 request-batch reader: JSON request bodies → typed headers + lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SALE_ITEM = T.StructType([
    T.StructField("obat_kode", T.StringType()), T.StructField("qty", T.IntegerType()),
    T.StructField("harga_jual", T.DecimalType(15, 2)), T.StructField("batch_no", T.StringType()),
    T.StructField("dosis", T.StringType()), T.StructField("etiket", T.StringType()),
])
SALE_REQUEST = T.StructType([
    T.StructField("no_nota", T.StringType()), T.StructField("tgl", T.StringType()),
    T.StructField("jenis", T.StringType()), T.StructField("pelanggan_kode", T.StringType()),
    T.StructField("dokter_sip", T.StringType()), T.StructField("items", T.ArrayType(SALE_ITEM)),
])
PURCHASE_ITEM = T.StructType([
    T.StructField("obat_kode", T.StringType()), T.StructField("batch_no", T.StringType()),
    T.StructField("expired_date", T.StringType()), T.StructField("qty", T.IntegerType()),
    T.StructField("harga_beli", T.DecimalType(15, 2)), T.StructField("cold_chain", T.BooleanType()),
    T.StructField("suhu_min", T.DecimalType(5, 2)), T.StructField("suhu_max", T.DecimalType(5, 2)),
])
PURCHASE_REQUEST = T.StructType([
    T.StructField("no_faktur", T.StringType()), T.StructField("tgl", T.StringType()),
    T.StructField("supplier_kode", T.StringType()), T.StructField("pajak", T.StringType()),
    T.StructField("bayar", T.DecimalType(15, 2)), T.StructField("items", T.ArrayType(PURCHASE_ITEM)),
])
FORMULA_ITEM = T.ArrayType(T.StructType([
    T.StructField("obat_kode", T.StringType()), T.StructField("qty", T.DoubleType()),
    T.StructField("satuan", T.StringType()),
]))


def read_requests(df: DataFrame, schema: T.StructType, body: str = "body",
                  id_col: str = "req_id") -> tuple[DataFrame, DataFrame]:
    """Parse ``body`` with ``schema``; headers keep every non-item field,
    lines are the exploded ``items`` with their 0-based index ``pos``."""
    parsed = df.select(F.col(id_col), F.from_json(F.col(body), schema).alias("__r"))
    head_fields = [f.name for f in schema.fields if f.name != "items"]
    headers = parsed.select(id_col, *[F.col(f"__r.{f}").alias(f) for f in head_fields])
    lines = parsed.select(id_col, F.posexplode(F.col("__r.items")).alias("pos", "__it")) \
                  .select(id_col, "pos", "__it.*")
    return headers, lines


def formula_lines(formulas: DataFrame, col: str = "komposisi") -> DataFrame:
    """A formula's ``komposisi`` JSON list as one row per ingredient."""
    x = formulas.select("kode", F.posexplode(F.from_json(F.col(col), FORMULA_ITEM)).alias("pos", "__c"))
    return x.select("kode", "pos", "__c.obat_kode", "__c.qty", "__c.satuan")
