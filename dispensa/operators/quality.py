"""Data-quality operators: rule validator, interaction-pair admission,
unique-key, reference-integrity and domain reports (I1, I4, I6, I7, I8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dispensa import model
from dispensa.functions.scalars import is_digits, is_numeric, sorted_pair, strict_date

ERROR_TYPE = T.ArrayType(T.StructType([T.StructField("field", T.StringType()),
                                       T.StructField("msg", T.StringType())]))

# Rule sets of the reference's write endpoints (fixed values).
RULES_DRUG = {
    "kode": "nullable|max:50",
    "nama": "required|max:255",
    "produsen": "nullable|max:255",
    "harga": "required|numeric|min:0",
    "stok": "required|integer|min:0",
    "expired_date": "nullable|date",
    "golongan": "required|in:NONE,OTC,OBT,OK,Psikotropika,Narkotika",
}
RULES_CUSTOMER = {
    "kode": "nullable|max:50",
    "nama": "required|max:150",
    "tgl_lahir": "nullable|date",
    "jenis_kelamin": "nullable|in:L,P",
    "no_hp": "nullable|max:30",
    "alamat": "nullable|max:255",
}
RULES_DOCTOR = {"sip": "nullable|max:100", "nama": "required|max:150", "spesialisasi": "nullable|max:150",
                "fasilitas_kesehatan": "nullable|max:150"}
RULES_SUPPLIER = {"kode": "nullable|max:50", "nama": "required|max:200", "sertifikasi": "nullable|max:200",
                  "alamat": "nullable", "kontak": "nullable|max:100"}
RULES_STAFF = {"kode": "nullable|max:50", "nama": "required|max:150", "jabatan": "required|max:100",
               "level_akses": "required|in:farmasi,kasir,gudang,admin"}
RULES_FORMULA = {"kode": "nullable|max:50", "nama": "required|max:150", "dokter_sip": "nullable|max:100",
                 "komposisi": "nullable", "petunjuk": "nullable", "standar": "nullable"}
RULES_INTERACTION = {
    "obat1_kode": "required",
    "obat2_kode": "required",
    "tingkat": "required|in:minor,moderate,major,contraindicated",
    "keterangan": "nullable",
}
RULES_PURCHASE = {"no_faktur": "nullable|max:100", "tgl": "nullable|date", "supplier_kode": "required",
                  "pajak": "nullable|numeric", "items": "required"}
RULES_SALE = {"no_nota": "nullable|max:100", "tgl": "nullable", "jenis": "required|in:NONE,OTC,Resep,Racik",
              "pelanggan_kode": "nullable", "dokter_sip": "nullable", "items": "required"}


def _num_text(x: float) -> str:
    # how a float parameter prints in the messages: 0.0 → "0", 1.5 → "1.5"
    return str(int(x)) if float(x).is_integer() else repr(float(x))


def _err(field: str, msg: str | Column) -> Column:
    m = F.lit(msg) if isinstance(msg, str) else msg
    return F.struct(F.lit(field).alias("field"), m.alias("msg"))


def _rule(field: str, name: str, param: str | None, v: Column, dtype: T.DataType) -> Column | None:
    is_str = isinstance(dtype, (T.StringType, T.NullType))
    empty = v.isNull() | (v.cast("string") == "") if is_str else v.isNull()
    if name == "required":
        return F.when(empty, _err(field, f"{field} wajib diisi"))
    if name == "nullable":
        return None
    present = ~empty
    if name == "max":
        if not is_str:
            return None
        return F.when(present & (F.char_length(v) > int(param)), _err(field, f"{field} maksimal {int(param)} karakter"))
    if name == "numeric":
        if not is_str:
            return None
        return F.when(present & ~is_numeric(v), _err(field, f"{field} harus numerik"))
    if name == "integer":
        if isinstance(dtype, T.IntegralType):
            return None
        if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
            ok = (v >= 0) & (v == F.floor(v))
        else:
            ok = is_digits(v)
        return F.when(present & ~ok, _err(field, f"{field} harus integer"))
    if name == "min":
        lo = float(param)
        num = v.try_cast("double") if is_str else v.cast("double")
        numeric = is_numeric(v) if is_str else F.lit(True)
        return F.when(present & numeric & (num < lo), _err(field, f"{field} minimal {_num_text(lo)}"))
    if name == "date":
        if not is_str:
            return None
        return F.when(present & ~strict_date(v), _err(field, f"{field} harus tanggal (YYYY-MM-DD)"))
    if name == "in":
        opts = [o.strip() for o in (param or "").split(",")]
        return F.when(present & ~v.cast("string").isin(*opts),
                      _err(field, f"{field} harus salah satu dari: " + ",".join(opts)))
    return None


def validate(df: DataFrame, rules: dict[str, str], out: str = "errors") -> DataFrame:
    """Apply ``field → "rule|rule:param"`` rules row-wise.

    Every failure is kept, several per field, in rule order; an absent field
    reads as null.  Empty (null or '') fails only ``required``.  The result is
    ``df`` plus ``errors: array<struct<field, msg>>`` (empty when valid).
    """
    checks: list[Column] = []
    for field, spec in rules.items():
        if field in df.columns:
            v, dtype = F.col(field), df.schema[field].dataType
        else:
            v, dtype = F.lit(None).cast("string"), T.StringType()
        for rule in spec.split("|"):
            name, _, param = rule.partition(":")
            c = _rule(field, name, param or None, v, dtype)
            if c is not None:
                checks.append(c)
    if not checks:
        return df.withColumn(out, F.array().cast(ERROR_TYPE))
    return df.withColumn(out, F.filter(F.array(*checks), lambda x: x.isNotNull()).cast(ERROR_TYPE))


def body_errors(body: Column, rules: dict[str, str], given: dict[str, Column] | None = None) -> Column:
    """I1 on a body read as ``map<string,string>``: the same checks as
    ``validate``, as one expression; ``given`` replaces single fields."""
    checks: list[Column] = []
    for field, spec in rules.items():
        v = (given or {}).get(field, F.try_element_at(body, F.lit(field)))
        for rule in spec.split("|"):
            name, _, param = rule.partition(":")
            c = _rule(field, name, param or None, v, T.StringType())
            if c is not None:
                checks.append(c)
    return F.filter(F.array(*checks), lambda x: x.isNotNull()).cast(ERROR_TYPE)


def admit_interactions(req: DataFrame, existing: DataFrame | None = None, order: str = "id") -> DataFrame:
    """I4: interaction requests — rules, the two drugs must differ, the pair
    is stored sorted (byte order); a pair already stored, or requested
    earlier in the batch, is refused (unique pair)."""
    v = validate(req, RULES_INTERACTION)
    a, b = sorted_pair("obat1_kode", "obat2_kode")
    v = v.withColumn("errors", F.when(
        (F.size("errors") == 0) & (F.col("obat1_kode") == F.col("obat2_kode")),
        F.array(_err("pair", model.MSG_PAIR_SAME))).otherwise(F.col("errors")))
    v = v.withColumn("p1", a).withColumn("p2", b)
    ok = F.size("errors") == 0
    # first valid request of each pair wins (aggregate, not a per-pair window)
    first = v.filter(ok).groupBy("p1", "p2").agg(F.min(order).alias("__first"))
    # merged, not broadcast: the table of pairs grows with the requests, and its
    # size is guessed too low where the requests are made from fewer rows
    v = v.join(first.hint("merge"), ["p1", "p2"], "left")
    dup = ok & (F.col(order) != F.col("__first"))
    if existing is not None:
        ex = existing.select(F.col("obat1_kode").alias("p1"), F.col("obat2_kode").alias("p2")) \
                     .distinct().withColumn("__exists", F.lit(True))
        v = v.join(ex, ["p1", "p2"], "left")
        dup = dup | (ok & F.col("__exists").isNotNull())
    v = v.withColumn("errors", F.when(dup, F.array(_err("pair", "Pasangan sudah ada"))).otherwise(F.col("errors")))
    return v.withColumn("accepted", F.size("errors") == 0).drop("__first", "__exists")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values held by more than one row, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def duplicate_report(checks: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """I6 summary: one row per declared unique key with the number of its
    values that more than one row holds (a key with a null part is free)."""
    parts = []
    for name, (df, keys) in checks.items():
        parts.append(duplicates(df.select(*keys).dropna(), keys)
                     .agg(F.count(F.lit(1)).alias("n_duplicates")).withColumn("unique_key", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("unique_key", "n_duplicates")


def orphans(child: DataFrame, fk: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose non-null foreign key has no parent row."""
    p = parent.select(F.col(key).alias("__pk"))
    return child.filter(F.col(fk).isNotNull()).join(p, F.col(fk) == p["__pk"], "left_anti")


def orphan_report(checks: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """I7 summary: one row per declared reference with its orphan count."""
    parts = []
    for name, (child, fk, parent, key) in checks.items():
        parts.append(orphans(child.select(fk), fk, parent.select(key), key)
                     .agg(F.count(F.lit(1)).alias("n_orphans")).withColumn("fk", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("fk", "n_orphans")


def out_of_domain(df: DataFrame, col: str, domain: Sequence[str]) -> DataFrame:
    """I8: rows whose non-null ``col`` is outside the declared domain."""
    return df.filter(F.col(col).isNotNull() & ~F.col(col).isin(*domain))


def domain_report(checks: dict[str, tuple[DataFrame, str, Sequence[str]]]) -> DataFrame:
    """I8 summary: per checked column, the number of values outside its domain."""
    parts = []
    for name, (df, col, dom) in checks.items():
        parts.append(out_of_domain(df.select(col), col, dom)
                     .agg(F.count(F.lit(1)).alias("n_bad")).withColumn("check", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("check", "n_bad")
