"""Listing, search and lookup operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispensa import model
from dispensa.functions.scalars import clamp, page_offset
from dispensa.operators.reports import ts_on_days

DRUG_SEARCH_COLS = ["kode", "nama", "produsen", "harga", "golongan", "stok", "expired_date"]


def name_order(name: str = "nama", key: str = "kode") -> list[Column]:
    """case-insensitive name order with the unique key as tie-break."""
    return [F.lower(F.col(name)), F.col(key)]


def list_page(df: DataFrame, cols: Sequence[str] | None, order: Sequence[Column | str],
              limit=None, page=None, limits: tuple[int, int, int] = model.LIMIT_LIST) -> DataFrame:
    """B2 + F1: projection, order, one page (``offset = (page-1) * limit``).

    ``limit`` is clamped to the endpoint's bounds; the order must end in a
    unique key so that pages do not overlap.
    """
    lim = clamp(limit, *limits)
    out = df.select(*cols) if cols else df
    return out.orderBy(*order).offset(page_offset(lim, page)).limit(lim)


def like_ci(c: str | Column, pattern: str) -> Column:
    """Case-insensitive LIKE; ``%`` and ``_`` inside the user text stay live."""
    col = F.col(c) if isinstance(c, str) else c
    return F.lower(col).like(pattern.lower())


def search(df: DataFrame, q: str | None, cols: Sequence[str] = ("kode", "nama"),
           project: Sequence[str] | None = DRUG_SEARCH_COLS, limit=None, page=None,
           name: str = "nama", key: str = "kode") -> DataFrame:
    """B1: ``kode LIKE %q% OR nama LIKE %q%`` (case-insensitive), by name,
    one page.  A blank ``q`` is the plain listing (B2) with all columns."""
    text = (q or "").strip()
    if text == "":
        return list_page(df, None, name_order(name, key), limit, page)
    pattern = f"%{text}%"
    cond = None
    for c in cols:
        cond = like_ci(c, pattern) if cond is None else (cond | like_ci(c, pattern))
    return list_page(df.filter(cond), project, name_order(name, key), limit, page)


def lookup(df: DataFrame, keys: DataFrame, key: str, key_col: str | None = None) -> DataFrame:
    """Look up many keys at once; every requested key comes back, with
    ``found`` false and nulls when absent."""
    kc = key_col or key
    k = keys.select(F.col(kc).alias("__req")).distinct()
    hit = df.withColumn("__hit", F.lit(True))
    j = k.join(hit, k["__req"] == hit[key], "left")
    return j.withColumn("found", F.coalesce(F.col("__hit"), F.lit(False))) \
            .drop("__hit").withColumnRenamed("__req", "requested")


def lookup_in(df: DataFrame, keys: DataFrame, key: str, key_col: str | None = None) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys`` (``IN (...)`` as a semi join)."""
    kc = key_col or key
    k = keys.select(F.col(kc).alias("__req"))
    return df.join(k, df[key] == k["__req"], "left_semi")


def sales_list(sales: DataFrame, tgl=None, tgl_from=None, tgl_to=None, limit=None, page=None) -> DataFrame:
    """Sales with date options by precedence — exact day, both bounds,
    from only, to only, none; newest id first; one page."""
    def blank(x):
        return x is None or (isinstance(x, str) and x.strip() == "")

    s = sales
    if not blank(tgl):
        s = s.filter(ts_on_days("tgl", tgl, tgl))
    elif not blank(tgl_from) and not blank(tgl_to):
        s = s.filter(ts_on_days("tgl", tgl_from, tgl_to))
    elif not blank(tgl_from):
        s = s.filter(ts_on_days("tgl", tgl_from, None))
    elif not blank(tgl_to):
        s = s.filter(ts_on_days("tgl", None, tgl_to))
    cols = ["id", "no_nota", "tgl", "jenis", "pelanggan_kode", "dokter_sip", "narkotika_psikotropika", "total"]
    return list_page(s, cols, [F.desc("id")], limit, page)


def row_contains(df: DataFrame, cols: Sequence[str], q: str | None) -> DataFrame:
    """Keep rows whose displayed text contains ``q`` (lower-cased
    substring over the row's cells joined by a space)."""
    text = (q or "").lower()
    if text == "":
        return df
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    return df.filter(F.lower(F.concat_ws(" ", *cells)).contains(F.lit(text)))


def stock_report(drugs: DataFrame) -> DataFrame:
    """Every drug's code, name, class, stock and expiry, by name."""
    return drugs.select("kode", "nama", "golongan", "stok", "expired_date").orderBy(*name_order())


def customer_report(customers: DataFrame) -> DataFrame:
    """Every customer's listing fields, by name."""
    return customers.select("kode", "nama", "tgl_lahir", "jenis_kelamin", "no_hp", "alamat") \
                    .orderBy(*name_order())
