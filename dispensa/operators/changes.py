"""Dimension maintenance from change feeds (J6) and deletes with cascade.

A change is ``(key, op, seq, payload)`` with ``op`` in insert / update /
delete and ``payload`` the raw JSON body.  Reading the body as
``map<string,string>`` keeps "field absent" apart from "field set to null":
an update writes a field only when its key is present, and writes null when
the value is null.  Changes of a key apply in ``seq`` order:

* an insert is refused while the key exists (unique key), so the accepted
  insert is the first one after the key's last delete (or the first one at
  all when the key did not exist);
* the last accepted insert or delete resets the row (insert: the body's
  fields, absent ones null; delete: no row);
* updates after that reset apply field by field, the latest present value
  winning; updates of a missing row do nothing.

Everything is per-key aggregation (``max``, ``min_by``, ``max_by``) and
joins: a key with a huge number of changes is combined map-side, never
gathered into one array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dispensa import model
from dispensa.operators import quality
from dispensa.plans.lineage import materialize
from dispensa.plans.prefix import running_last
from dispensa.session import ensure_checkpoint_dir

MAP = T.MapType(T.StringType(), T.StringType())

# fields a change may set, per entity (fixed values of the reference)
ALLOWED_UPDATE = {
    "m_obat": ["nama", "produsen", "harga", "stok", "expired_date", "golongan"],
    "m_pelanggan": ["nama", "tgl_lahir", "jenis_kelamin", "alergi", "kondisi_medis", "no_hp", "alamat"],
    "m_dokter": ["nama", "spesialisasi", "fasilitas_kesehatan"],
    "m_supplier": ["nama", "sertifikasi", "alamat", "kontak"],
    "m_karyawan": ["nama", "jabatan", "level_akses"],
    "m_formula_racik": ["nama", "dokter_sip", "petunjuk", "standar", "komposisi"],
}
PAIRS = "interaksi_obat"
KEY = {"m_obat": "kode", "m_pelanggan": "kode", "m_dokter": "sip", "m_supplier": "kode", "m_karyawan": "kode",
       "m_formula_racik": "kode"}
RULES = {"m_obat": quality.RULES_DRUG, "m_pelanggan": quality.RULES_CUSTOMER, "m_dokter": quality.RULES_DOCTOR,
         "m_supplier": quality.RULES_SUPPLIER, "m_karyawan": quality.RULES_STAFF,
         "m_formula_racik": quality.RULES_FORMULA, PAIRS: quality.RULES_INTERACTION}
# columns an update may not set to null, and columns with a closed list of values
NOT_NULL = {"m_obat": ["nama", "harga", "stok", "golongan"], "m_pelanggan": ["nama"], "m_dokter": ["nama"],
            "m_supplier": ["nama"], "m_karyawan": ["nama", "jabatan", "level_akses"], "m_formula_racik": ["nama"]}
DOMAIN = {"m_obat": {"golongan": model.GOLONGAN}, "m_pelanggan": {"jenis_kelamin": ["L", "P"]},
          "m_karyawan": {"level_akses": model.LEVEL_AKSES}, PAIRS: {"tingkat": model.TINGKAT}}


def apply_changes(base: DataFrame, changes: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """New snapshot of ``base`` (columns ``key`` + ``fields``) after the
    change feed.  Values are cast to the base column types; one that is
    no value of its type becomes null and ends nothing else."""
    types = {f: base.schema[f].dataType for f in fields}
    # the parsed feed is read by three aggregations: written once
    ensure_checkpoint_dir(changes.sparkSession)
    ch = materialize(changes.select(F.col(key), "op", "seq", F.from_json("payload", MAP).alias("m")),
                     "change-feed")

    dels = ch.groupBy(key).agg(F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("__last_del"))
    exists0 = base.select(F.col(key)).distinct().withColumn("__exists0", F.lit(True))
    c2 = ch.join(dels, key).join(exists0, key, "left")
    after_del = F.col("seq") > F.coalesce(F.col("__last_del"), F.lit(None).cast("long"))
    cand = (F.col("op") == "insert") & (F.col("__last_del").isNull() | after_del)
    ins = c2.groupBy(key).agg(
        F.first("__last_del").alias("__last_del"), F.first("__exists0").alias("__exists0"),
        F.min(F.when(cand, F.col("seq"))).alias("__ins_seq"),
        F.min_by("m", F.when(cand, F.col("seq"))).alias("__ins_m"))
    # the first insert after the last delete is refused only when the key
    # existed before the batch and was never deleted
    ok_ins = F.col("__ins_seq").isNotNull() & (F.col("__last_del").isNotNull() | F.col("__exists0").isNull())
    ins = ins.withColumn("__ins_seq", F.when(ok_ins, F.col("__ins_seq"))) \
             .withColumn("__ins_m", F.when(ok_ins, F.col("__ins_m"))) \
             .withColumn("__reset", F.greatest("__last_del", "__ins_seq")) \
             .withColumn("__reset_is_ins", F.col("__ins_seq").isNotNull() & (F.col("__reset") == F.col("__ins_seq")))

    c3 = ch.filter(F.col("op") == "update").join(ins.select(key, "__reset"), key)
    c3 = c3.filter(F.col("__reset").isNull() | (F.col("seq") > F.col("__reset")))
    aggs = []
    for f in fields:
        present = F.map_contains_key("m", F.lit(f))
        aggs.append(F.max_by(F.col("m")[f], F.when(present, F.col("seq"))).alias(f"__u_{f}"))
        aggs.append(F.bool_or(present).alias(f"__h_{f}"))
    upd = c3.groupBy(key).agg(*aggs)

    b = base.select(key, *fields).withColumn("__in_base", F.lit(True))
    j = b.join(ins, key, "full_outer").join(upd, key, "left")
    exists_after = (F.when(F.col("__reset").isNull(), F.col("__in_base").isNotNull())
                     .otherwise(F.col("__reset_is_ins")))
    cols = [F.col(key)]
    for f in fields:
        from_ins = F.col("__ins_m")[f].try_cast(types[f])
        start = F.when(F.col("__reset_is_ins"), from_ins).otherwise(F.col(f))
        val = F.when(F.coalesce(F.col(f"__h_{f}"), F.lit(False)), F.col(f"__u_{f}").try_cast(types[f])).otherwise(start)
        cols.append(val.alias(f))
    return j.filter(exists_after).select(*cols)


def _by_entity(parts: dict[str, Column], otherwise: Column) -> Column:
    out = None
    for entity, c in parts.items():
        hit = F.col("entity") == entity
        out = F.when(hit, c) if out is None else out.when(hit, c)
    return out.otherwise(otherwise)


def _update_error(entity: str, body: Column) -> Column:
    """Message of the first value of an update that its column cannot hold."""
    out = []
    for f in NOT_NULL.get(entity, []):
        out.append(F.when(F.map_contains_key(body, F.lit(f)) & F.try_element_at(body, F.lit(f)).isNull(),
                          F.lit(f"{f} tidak boleh kosong")))
    for f, domain in DOMAIN.get(entity, {}).items():
        v = F.try_element_at(body, F.lit(f))
        out.append(F.when(v.isNotNull() & ~v.isin(*domain), F.lit(f"{f} harus salah satu dari: " + ",".join(domain))))
    return F.coalesce(*out, F.lit(None).cast("string"))


def change_verdicts(feed: DataFrame, stored: dict[str, DataFrame]) -> DataFrame:
    """A verdict for every change of a feed over all seven master tables.

    ``feed`` has ``entity, key, op, seq, payload``; ``stored`` maps an entity
    to its table (with its key column of ``KEY``; interactions with ``id``,
    ``obat1_kode``, ``obat2_kode``).  An entity without a table is an empty one.

    Changes of a row take effect in ``seq`` order, ties by op and payload; of
    rows equal in all of these one takes effect first.  A body is read as text
    values; one that is no JSON object reads as empty.  Per change:

    * insert: ``refused`` with the first broken rule, or when the key (of
      interactions the sorted pair) exists at that moment, else ``accepted``.
      A null or blank key asks for a new one (``needs_code``) and clashes with none;
    * update: ``no_changes`` when no field of ``ALLOWED_UPDATE`` is in the body
      (whether or not the row exists), else ``not_found`` when the row does not
      exist at that moment, else ``refused`` when a value is null in a column
      that must hold one or outside its list, else ``accepted``;
    * delete: ``accepted`` when the row exists, else ``not_found``;
    * any other op, and any other entity: ``refused``.

    Updates and deletes whose key is no path segment (``[A-Za-z0-9_-]+``, of
    interactions digits) find nothing.  Interactions are updated and deleted by
    id; the ids of pairs inserted by the feed itself are not known to it.
    References are not looked at here (``cascade_delete_drugs``).

    Whether a row exists is a state: an accepted insert and a delete set it, an
    insert into an existing row sets it to what it is, all else leaves it.  So
    every change is a function that is constant or the identity, and
    ``running_last`` carries them in range blocks; stored rows come first in
    their key.  For pairs the first delete of the stored id is a change of the
    pair as well: until it the pair is taken, so it too is constant.
    """
    ensure_checkpoint_dir(feed.sparkSession)
    trimmed = F.trim(F.col("key"), F.lit(" \t\n\r\x0b\x00"))
    body = F.coalesce(F.from_json("payload", MAP), F.create_map().cast(MAP))
    c = feed.select("entity", "key", "op", F.col("seq").cast("long").alias("seq"), "payload")
    c = c.withColumn("__m", body).withColumn("__code", F.when(trimmed != "", trimmed))

    m, pair = F.col("__m"), F.col("entity") == PAIRS
    rules = {e: quality.body_errors(m, r, {KEY[e]: F.col("__code")} if e in KEY else None) for e, r in RULES.items()}
    a, b = F.try_element_at(m, F.lit("obat1_kode")), F.try_element_at(m, F.lit("obat2_kode"))
    first_error = F.try_element_at(_by_entity(rules, F.array().cast(quality.ERROR_TYPE)), F.lit(1))["msg"]
    insert_error = F.coalesce(first_error, F.when(pair & (a == b), F.lit(model.MSG_PAIR_SAME)))
    given = {e: F.arrays_overlap(F.map_keys(m), F.array(*[F.lit(f) for f in fs])) for e, fs in ALLOWED_UPDATE.items()}
    given[PAIRS] = F.try_element_at(m, F.lit("tingkat")).isNotNull() | F.map_contains_key(m, F.lit("keterangan"))
    is_insert, is_update, is_delete = (F.col("op") == o for o in ("insert", "update", "delete"))
    route = F.when(pair, F.col("key").rlike(r"\A[0-9]+\z")).otherwise(F.col("key").rlike(r"\A[A-Za-z0-9_-]+\z"))
    c = c.select(
        "entity", "key", "op", "seq", "payload",
        F.when(is_insert & pair, F.least(a, b)).when(is_insert, F.col("__code"))
         .when(pair, F.regexp_replace("key", r"\A0+(?=[0-9])", "")).otherwise(F.col("key")).alias("__s1"),
        F.when(is_insert & pair, F.greatest(a, b)).alias("__s2"),
        F.when(is_insert, insert_error)
         .when(is_update, _by_entity({e: _update_error(e, m) for e in RULES}, F.lit(None).cast("string"))).alias("__error"),
        F.coalesce(_by_entity(given, F.lit(False)), F.lit(False)).alias("__given"),
        F.coalesce(route, F.lit(False)).alias("__route"),
        (is_insert & ~pair & F.col("entity").isin(*KEY) & F.col("__code").isNull()).alias("needs_code"))
    known = F.coalesce(F.col("entity").isin(*RULES), F.lit(False))
    effect = F.when(known & is_insert & F.col("__error").isNull() & ~F.col("needs_code"), F.lit(1)) \
              .when(known & is_delete & F.col("__route"), F.lit(0))
    c = materialize(c.withColumn("needs_code", F.coalesce("needs_code", F.lit(False)))
                     .withColumn("__phase", F.lit(1)).withColumn("__effect", effect), "change-feed")

    def event(df: DataFrame, entity: str, s1: Column, s2: Column, seq: Column, phase: int, value: int) -> DataFrame:
        # a row that is no change of the feed itself; phase 0 is before all changes, 2 a marker among them
        return df.select(F.lit(entity).alias("entity"), s1.cast("string").alias("__s1"),
                         s2.cast("string").alias("__s2"), seq.cast("long").alias("seq"),
                         F.lit(phase).alias("__phase"), F.lit(value).alias("__effect"))

    null = F.lit(None)
    events = c
    touched = c.select("entity", "__s1", "__s2").distinct()
    for entity, key in KEY.items():
        if entity in stored:
            here = touched.filter((F.col("entity") == entity) & F.col("__s1").isNotNull()).select(F.col("__s1").alias(key))
            rows = stored[entity].select(key).join(here, key, "left_semi").distinct()
            events = events.unionByName(event(rows, entity, F.col(key), null, null, 0, 1), allowMissingColumns=True)
    if PAIRS in stored:
        pairs = stored[PAIRS].select("id", F.least("obat1_kode", "obat2_kode").alias("p1"),
                                     F.greatest("obat1_kode", "obat2_kode").alias("p2"))
        mine = touched.filter(F.col("entity") == PAIRS)
        ids = mine.filter(F.col("__s2").isNull()).select(F.col("__s1").try_cast("long").alias("id")).distinct()
        named = mine.filter(F.col("__s2").isNotNull()).select(F.col("__s1").alias("p1"), F.col("__s2").alias("p2"))
        gone = c.filter(pair & is_delete & F.col("__route")) \
                .groupBy(F.col("__s1").try_cast("long").alias("id")) \
                .agg(F.min(F.struct("seq", "op", "payload")).alias("__at"))
        by_id = pairs.join(ids, "id", "left_semi")
        by_pair = pairs.join(named, ["p1", "p2"], "left_semi")
        freed = by_pair.join(gone, "id").select("p1", "p2", "__at.*")
        for rows in (event(by_id, PAIRS, F.col("id"), null, null, 0, 1),
                     event(by_pair, PAIRS, F.col("p1"), F.col("p2"), null, 0, 1)):
            events = events.unionByName(rows, allowMissingColumns=True)
        mark = freed.select(F.lit(PAIRS).alias("entity"), F.col("p1").alias("__s1"), F.col("p2").alias("__s2"), "seq",
                            "op", "payload", F.lit(2).alias("__phase"), F.lit(0).alias("__effect"))
        events = events.unionByName(mark, allowMissingColumns=True)
    # stored rows first, then changes and markers by their place
    events = events.withColumn("__first", F.when(F.col("__phase") == 0, F.lit(0)).otherwise(F.lit(1)))
    run = running_last(events, ["entity", "__s1", "__s2"], ["__first", "seq", "op", "payload"],
                       {"__before": F.col("__effect")}, inclusive=False)
    run = run.filter(F.col("__phase") == 1)

    exists = F.coalesce(F.col("__before") == 1, F.lit(False)) & ~F.col("needs_code")
    is_insert, is_update, is_delete = (F.coalesce(F.col("op") == o, F.lit(False)) for o in ("insert", "update", "delete"))
    taken = F.when(F.col("entity") == PAIRS, F.lit("Pasangan sudah ada")).otherwise(F.lit("Kode sudah ada"))
    known = F.coalesce(F.col("entity").isin(*RULES), F.lit(False))
    error = F.when(~known | ~(is_insert | is_update | is_delete), F.lit("Not supported")) \
             .when(is_insert & F.col("__error").isNotNull(), F.col("__error")) \
             .when(is_insert & exists, taken) \
             .when(~is_insert & ~F.col("__route"), F.lit("Not found")) \
             .when(is_update & ~F.col("__given"), F.lit("No changes")) \
             .when(~is_insert & ~exists, F.lit("Not found")) \
             .when(is_update & F.col("__error").isNotNull(), F.col("__error")).otherwise(F.lit(""))
    verdict = F.when(F.col("error") == "", F.lit("accepted")).when(F.col("error") == "No changes", F.lit("no_changes")) \
               .when(F.col("error") == "Not found", F.lit("not_found")).otherwise(F.lit("refused"))
    return run.withColumn("error", error).withColumn("verdict", verdict) \
              .select("entity", "key", "op", "seq", "payload", "verdict", "error", "needs_code")


def post_changes(feed: DataFrame, stored: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``verdicts`` of the feed, written once, and the new snapshot of each
    stored table with a code key after its accepted changes (key and the fields
    of ``ALLOWED_UPDATE`` that the table has; inserts that need a code wait for one)."""
    verdicts = materialize(change_verdicts(feed, stored), "change-verdicts")
    out = {"verdicts": verdicts}
    ok = verdicts.filter((F.col("verdict") == "accepted") & ~F.col("needs_code"))
    for entity, key in KEY.items():
        if entity in stored:
            mine = ok.filter(F.col("entity") == entity) \
                     .select(F.trim(F.col("key"), F.lit(" \t\n\r\x0b\x00")).alias(key), "op", "seq", "payload")
            fields = [f for f in ALLOWED_UPDATE[entity] if f in stored[entity].columns]
            if fields:
                out[entity] = apply_changes(stored[entity], mine, key, fields)
    return out


def cascade_delete_drugs(deletes: DataFrame, drugs: DataFrame, interactions: DataFrame, sale_lines: DataFrame,
                         purchase_lines: DataFrame, ledger_rows: DataFrame,
                         cascade_sale_lines: bool = False) -> dict[str, DataFrame]:
    """J8 for drugs: a delete is refused while purchase lines, ledger rows
    (and sale lines unless ``cascade_sale_lines``, the dump's rule) refer to
    the drug; an allowed delete also removes the drug's interactions (and its
    sale lines when cascading)."""
    req = deletes.select(F.col("kode")).distinct()

    def refs(df: DataFrame, col: str, name: str) -> DataFrame:
        return df.join(req, df[col] == req["kode"], "left_semi").groupBy(F.col(col).alias("kode")) \
                 .agg(F.count(F.lit(1)).alias(name))

    v = req.join(refs(sale_lines, "obat_kode", "n_sale_lines"), "kode", "left") \
           .join(refs(purchase_lines, "obat_kode", "n_purchase_lines"), "kode", "left") \
           .join(refs(ledger_rows, "obat_kode", "n_ledger_rows"), "kode", "left") \
           .join(drugs.select("kode").withColumn("__found", F.lit(True)), "kode", "left")
    for c in ("n_sale_lines", "n_purchase_lines", "n_ledger_rows"):
        v = v.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("long"))
    blocked = (F.col("n_purchase_lines") > 0) | (F.col("n_ledger_rows") > 0)
    if not cascade_sale_lines:
        blocked = blocked | (F.col("n_sale_lines") > 0)
    v = v.withColumn("found", F.col("__found").isNotNull()).drop("__found") \
         .withColumn("deleted", F.col("found") & ~blocked)
    gone = v.filter("deleted").select("kode")
    inter_left = interactions.join(gone.withColumnRenamed("kode", "obat1_kode"), "obat1_kode", "left_anti") \
                             .join(gone.withColumnRenamed("kode", "obat2_kode"), "obat2_kode", "left_anti")
    out = {"verdicts": v, "m_obat": drugs.join(gone, "kode", "left_anti"), "interaksi_obat": inter_left}
    if cascade_sale_lines:
        out["penjualan_item"] = sale_lines.join(gone.withColumnRenamed("kode", "obat_kode"), "obat_kode", "left_anti")
    return out
