"""Screening joins: missing references, drug interactions in a basket,
patient allergy, code-or-name resolution (C7a, C8, C9, C10, D11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispensa import model


def missing_refs(df: DataFrame, col: str, dim: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``col`` names no row of ``dim`` (anti join;
    null references are not checked)."""
    k = dim.select(F.col(key).alias("__k"))
    return df.filter(F.col(col).isNotNull()).join(k, F.col(col) == k["__k"], "left_anti")


def basket(lines: DataFrame, doc: str = "penjualan_id") -> DataFrame:
    """Distinct drugs of each document."""
    return lines.select(doc, "obat_kode").distinct()


def interaction_hits(lines: DataFrame, inter: DataFrame, doc: str = "penjualan_id",
                     levels: list[str] = model.SEVERE) -> DataFrame:
    """Interacting drug pairs inside one basket, reported levels only.

    The interaction table keeps each unordered pair once, sorted by bytes.
    Instead of pairing every two lines of a basket, each basket drug meets
    the interactions where it is the first of the pair (an equi-join on the
    drug), and the partner is kept only when the same basket holds it
    (a semi join on document and partner).  Work is lines × interaction
    degree, never basket size squared.
    """
    b = basket(lines, doc)
    sev = inter.filter(F.col("tingkat").isin(*levels)).select("obat1_kode", "obat2_kode", "tingkat")
    # the equi-join keeps only basket drugs that head a reported interaction
    cand = b.join(sev, b["obat_kode"] == sev["obat1_kode"]).select(doc, "obat1_kode", "obat2_kode", "tingkat")
    partner = b.select(F.col(doc).alias("__d"), F.col("obat_kode").alias("__p"))
    return cand.join(partner, (cand[doc] == partner["__d"]) & (cand["obat2_kode"] == partner["__p"]),
                     "left_semi")


def allergy_hits(sales: DataFrame, lines: DataFrame, customers: DataFrame, drugs: DataFrame,
                 doc: str = "penjualan_id") -> DataFrame:
    """Sale lines whose drug code or drug name occurs (case-insensitive)
    in the patient's allergy text; empty text and "0" are no allergy, and a
    customer code "0" is no customer."""
    cust = customers.select(F.col("kode").alias("pelanggan_kode"), "alergi") \
                    .filter((F.col("kode") != "0") & F.col("alergi").isNotNull() & (F.col("alergi") != "") & (F.col("alergi") != "0"))
    s = sales.select(F.col("id").alias(doc), "pelanggan_kode").join(cust, "pelanggan_kode")
    li = lines.select(F.col("id").alias("line_id"), doc, "obat_kode").join(s, doc)
    d = drugs.select(F.col("kode").alias("obat_kode"), F.col("nama").alias("__nama"))
    j = li.join(d, "obat_kode")
    a = F.lower(F.col("alergi"))
    hit = a.contains(F.lower(F.col("obat_kode"))) | a.contains(F.lower(F.col("__nama")))
    return j.filter(hit).select(doc, "line_id", "obat_kode", "pelanggan_kode", "alergi")


def resolve(inputs: DataFrame, input_col: str, dim: DataFrame, key: str = "kode",
            name: str = "nama") -> DataFrame:
    """Turn typed text into a key.  ``"CODE - NAME"`` keeps the part
    before ``" - "``; text equal to a code (case-insensitive) is kept as
    typed; else a name match (case-insensitive) gives that drug's code, the
    last in listing order when names repeat; else the row is invalid
    (``resolved`` null, ``valid`` false)."""
    t = F.trim(F.col(input_col))
    t = F.when(t.contains(" - "), F.trim(F.split(t, " - ", 2).getItem(0))).otherwise(t)
    x = inputs.withColumn("__t", t)
    codes = dim.groupBy(F.upper(F.col(key)).alias("__uk")).agg(F.lit(True).alias("__code_hit"))
    names = dim.filter(F.col(name).isNotNull()) \
               .groupBy(F.lower(F.col(name)).alias("__ln")).agg(F.max(F.col(key)).alias("__by_name"))
    x = x.join(codes, F.upper(x["__t"]) == codes["__uk"], "left") \
         .join(names, F.lower(x["__t"]) == names["__ln"], "left")
    nonblank = x["__t"] != ""
    resolved = (F.when(nonblank & F.col("__code_hit").isNotNull(), F.col("__t"))
                 .when(nonblank & F.col("__by_name").isNotNull(), F.col("__by_name")))
    return x.withColumn("resolved", resolved).withColumn("valid", resolved.isNotNull()) \
            .drop("__t", "__uk", "__code_hit", "__ln", "__by_name")
