"""DuckDB oracle SQL per registered query (same column names and types).

Money is summed exactly as DECIMAL and returned as DOUBLE rounded to cents;
counts and quantities are BIGINT; days are DATE.
"""

from __future__ import annotations

from dispensa.checks.oracle_views import AS_OF, with_views

PERIOD_FROM = "DATE '1996-01-01'"
PERIOD_TO = AS_OF


def _money(expr: str) -> str:
    return f"CAST(round({expr}, 2) AS DOUBLE)"


ORACLE: dict[str, str] = {}

ORACLE["top_sellers"] = with_views(f"""
SELECT i.obat_kode, o.nama, CAST(sum(i.qty) AS BIGINT) AS qty, {_money('sum(i.qty * i.harga_jual)')} AS omzet
FROM penjualan p JOIN penjualan_item i ON i.penjualan_id = p.id JOIN obat o ON o.kode = i.obat_kode
WHERE CAST(p.tgl AS DATE) BETWEEN {PERIOD_FROM} AND {PERIOD_TO}
GROUP BY i.obat_kode, o.nama
ORDER BY qty DESC, i.obat_kode LIMIT 10""", "penjualan", "penjualan_item", "obat")

_SALE_DAY = "CAST(tgl AS DATE)"

ORACLE["top_sellers_7d"] = with_views(f"""
SELECT i.obat_kode, o.nama, CAST(sum(i.qty) AS BIGINT) AS qty, {_money('sum(i.qty * i.harga_jual)')} AS omzet
FROM penjualan p JOIN penjualan_item i ON i.penjualan_id = p.id JOIN obat o ON o.kode = i.obat_kode
WHERE CAST(p.tgl AS DATE) BETWEEN {AS_OF} - 6 AND {AS_OF}
GROUP BY i.obat_kode, o.nama
ORDER BY qty DESC, i.obat_kode LIMIT 5""", "penjualan", "penjualan_item", "obat")

ORACLE["sales_summary"] = with_views(f"""
SELECT CAST(count(*) AS BIGINT) AS trx, {_money('coalesce(sum(total), 0)')} AS total
FROM penjualan WHERE {_SALE_DAY} BETWEEN {PERIOD_FROM} AND {PERIOD_TO}""", "penjualan")

ORACLE["sales_by_day"] = with_views(f"""
SELECT {_SALE_DAY} AS tgl, CAST(count(*) AS BIGINT) AS trx, {_money('sum(total)')} AS total
FROM penjualan WHERE {_SALE_DAY} BETWEEN {PERIOD_FROM} AND {PERIOD_TO}
GROUP BY 1 ORDER BY 1""", "penjualan")

ORACLE["sales_this_month"] = with_views(f"""
SELECT {_SALE_DAY} AS tgl, CAST(count(*) AS BIGINT) AS trx, {_money('sum(total)')} AS total
FROM penjualan WHERE {_SALE_DAY} BETWEEN date_trunc('month', {AS_OF}) AND {AS_OF}
GROUP BY 1 ORDER BY 1""", "penjualan")

ORACLE["top_sellers_clamped"] = ORACLE["top_sellers"].removesuffix("LIMIT 10") + "LIMIT 100"

ORACLE["sales_by_type"] = with_views(f"""
SELECT jenis, CAST(count(*) AS BIGINT) AS trx, {_money('sum(total)')} AS total
FROM penjualan WHERE {_SALE_DAY} BETWEEN {PERIOD_FROM} AND {PERIOD_TO}
GROUP BY jenis ORDER BY list_position(['OTC', 'Resep', 'Racik'], jenis)""", "penjualan")

ORACLE["sales_7d"] = with_views(f"""
SELECT {_SALE_DAY} AS d, {_money('sum(total)')} AS total
FROM penjualan WHERE tgl >= CAST({AS_OF} - 6 AS TIMESTAMP) GROUP BY 1 ORDER BY 1""", "penjualan")

ORACLE["purchases_7d"] = with_views(f"""
SELECT tgl AS d, {_money('sum(total)')} AS total
FROM pembelian WHERE tgl >= {AS_OF} - 6 GROUP BY 1 ORDER BY 1""", "pembelian")

ORACLE["day_kpis"] = with_views(f"""
SELECT s.today_penjualan_count, s.today_penjualan_total, p.today_pembelian_total, l.low_stock_count
FROM (SELECT CAST(count(*) AS BIGINT) AS today_penjualan_count,
             {_money('coalesce(sum(total), 0)')} AS today_penjualan_total
      FROM penjualan WHERE {_SALE_DAY} = {AS_OF}) s,
     (SELECT {_money('coalesce(sum(total), 0)')} AS today_pembelian_total FROM pembelian WHERE tgl = {AS_OF}) p,
     (SELECT CAST(count(*) AS BIGINT) AS low_stock_count FROM obat WHERE stok <= 20) l""",
    "penjualan", "pembelian", "obat")

ORACLE["recent_sales"] = with_views(f"""
SELECT id, no_nota, {_money('total')} AS total, tgl FROM penjualan ORDER BY id DESC LIMIT 5""", "penjualan")

ORACLE["lowest_stock"] = with_views("""
SELECT kode, nama, stok FROM obat WHERE stok <= 20 ORDER BY stok, lower(nama), kode LIMIT 5""", "obat")

ORACLE["purchase_list"] = with_views(f"""
SELECT p.id, p.no_faktur, p.tgl, p.supplier_kode, {_money('p.pajak')} AS pajak, {_money('p.total')} AS total,
       {_money('coalesce(h.saldo, 0)')} AS saldo,
       CASE WHEN coalesce(h.saldo, 0) > 0 THEN 'HUTANG' ELSE 'LUNAS' END AS status
FROM pembelian p LEFT JOIN hutang h ON h.pembelian_id = p.id
ORDER BY p.id DESC, saldo LIMIT 200 OFFSET 200""", "pembelian", "hutang")

ORACLE["purchase_report"] = with_views(f"""
SELECT p.id, p.no_faktur, p.tgl, p.supplier_kode, {_money('p.pajak')} AS pajak, {_money('p.total')} AS total,
       i.id AS item_id, i.obat_kode, i.batch_no, i.qty, {_money('i.harga_beli')} AS harga_beli,
       {_money('i.qty * i.harga_beli')} AS subtotal
FROM pembelian p JOIN pembelian_item i ON i.pembelian_id = p.id
WHERE p.tgl BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'
ORDER BY p.tgl, p.id, i.id""", "pembelian", "pembelian_item")

ORACLE["purchase_totals"] = with_views(f"""
SELECT pembelian_id, id AS item_id, CAST(grouping(pembelian_id, id) AS INTEGER) AS level,
       CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(qty) AS BIGINT) AS qty,
       {_money('sum(qty * harga_beli)')} AS subtotal
FROM pembelian_item GROUP BY ROLLUP (pembelian_id, id)""", "pembelian_item")

ORACLE["payables"] = with_views(f"""
SELECT h.id, h.supplier_kode, p.no_faktur, p.tgl, {_money('p.total + p.pajak')} AS tagihan,
       {_money('h.saldo')} AS saldo
FROM hutang h JOIN pembelian p ON p.id = h.pembelian_id WHERE h.saldo > 0
ORDER BY p.tgl, h.id""", "hutang", "pembelian")

ORACLE["sale_detail"] = with_views(f"""
SELECT p.id, p.no_nota, CAST(row_number() OVER (PARTITION BY p.id ORDER BY i.id) - 1 AS INTEGER) AS pos,
       i.id AS item_id, i.obat_kode, o.nama AS obat_nama, i.qty, {_money('i.harga_jual')} AS harga_jual
FROM penjualan p JOIN penjualan_item i ON i.penjualan_id = p.id JOIN obat o ON o.kode = i.obat_kode""",
    "penjualan", "penjualan_item", "obat")

ORACLE["expiry_watch"] = with_views(f"""
SELECT a.id AS item_id, a.obat_kode, a.batch_no, b.nama, a.expired_date,
       CAST(datediff('day', {AS_OF}, a.expired_date) AS BIGINT) AS sisa_hari,
       CASE WHEN datediff('day', {AS_OF}, a.expired_date) < 0 THEN 'KADALUARSA'
            WHEN datediff('day', {AS_OF}, a.expired_date) <= 30 THEN 'HAMPIR KADALUARSA' ELSE 'AMAN' END AS status
FROM pembelian_item a JOIN obat b ON a.obat_kode = b.kode
WHERE a.expired_date <= {AS_OF} + 30
ORDER BY a.expired_date, a.id""", "pembelian_item", "obat")

_OBAT_ALL = ("id, kode, nama, produsen, CAST(round(harga, 2) AS DOUBLE) AS harga, stok, expired_date, golongan, "
             "narkotika_psikotropika")

ORACLE["drug_search"] = with_views(f"""
SELECT kode, nama, produsen, {_money('harga')} AS harga, golongan, stok, expired_date FROM obat
WHERE lower(kode) LIKE lower('%Re_%') OR lower(nama) LIKE lower('%Re_%')
ORDER BY lower(nama), kode LIMIT 200 OFFSET 0""", "obat")

ORACLE["drug_page"] = with_views(f"""
SELECT {_OBAT_ALL} FROM obat ORDER BY lower(nama), kode LIMIT 200 OFFSET 400""", "obat")

ORACLE["purchase_detail"] = with_views(f"""
SELECT p.id, p.no_faktur, CASE WHEN i.id IS NOT NULL THEN
         CAST(row_number() OVER (PARTITION BY p.id ORDER BY i.id) - 1 AS INTEGER) END AS pos,
       i.obat_kode, i.batch_no, i.expired_date, i.qty, {_money('i.harga_beli')} AS harga_beli
FROM pembelian p LEFT JOIN pembelian_item i ON i.pembelian_id = p.id""", "pembelian", "pembelian_item")

ORACLE["supplier_page"] = with_views("""
SELECT kode, nama, CAST(NULL AS VARCHAR) AS sertifikasi, CAST(NULL AS VARCHAR) AS alamat, CAST(NULL AS VARCHAR) AS kontak
FROM supp ORDER BY lower(nama), kode LIMIT 50 OFFSET 50""", "supp")

ORACLE["customer_page"] = with_views("""
SELECT kode, nama, tgl_lahir, jenis_kelamin, no_hp, alamat FROM pelanggan
ORDER BY lower(nama), kode LIMIT 200 OFFSET 200""", "pelanggan")

ORACLE["sales_list"] = with_views(f"""
SELECT id, no_nota, tgl, jenis, pelanggan_kode, dokter_sip, narkotika_psikotropika, {_money('total')} AS total
FROM penjualan WHERE CAST(tgl AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'
ORDER BY id DESC LIMIT 200 OFFSET 200""", "penjualan")

ORACLE["row_filter"] = with_views("""
SELECT kode, nama, golongan, stok, expired_date FROM obat
WHERE contains(lower(concat_ws(' ', coalesce(kode, ''), coalesce(nama, ''), coalesce(golongan, ''),
                               coalesce(CAST(stok AS VARCHAR), ''), coalesce(CAST(expired_date AS VARCHAR), ''))),
               'psiko')""", "obat")

ORACLE["lookup_keys"] = with_views("""
SELECT k.requested, c.kode, c.nama, c.alergi, c.kode IS NOT NULL AS found
FROM (SELECT DISTINCT pelanggan_kode AS requested FROM penjualan) k
LEFT JOIN pelanggan c ON c.kode = k.requested""", "penjualan", "pelanggan")

ORACLE["bulk_lookup"] = with_views("""
SELECT kode, nama, stok, expired_date, golongan FROM obat
WHERE kode IN (SELECT obat_kode FROM pembelian_item)""", "obat", "pembelian_item")

ORACLE["stock_report"] = with_views("""
SELECT kode, nama, golongan, stok, expired_date FROM obat ORDER BY lower(nama), kode""", "obat")

ORACLE["customer_report"] = with_views("""
SELECT kode, nama, tgl_lahir, jenis_kelamin, no_hp, alamat FROM pelanggan ORDER BY lower(nama), kode""",
    "pelanggan")

_LEDGER_SALDO = ("CAST(sum(CAST(qty_in AS BIGINT) - qty_out) OVER (PARTITION BY obat_kode ORDER BY id "
                 "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)")

ORACLE["ledger_balance"] = with_views(f"""
SELECT id, obat_kode, ref_type, qty_in, qty_out, {_LEDGER_SALDO} AS saldo FROM ledger""", "ledger")

ORACLE["latest_balance"] = with_views(f"""
SELECT obat_kode, arg_max(saldo, id) AS saldo, max(id) AS last_id
FROM (SELECT id, obat_kode, {_LEDGER_SALDO} AS saldo FROM ledger) GROUP BY obat_kode""", "ledger")

ORACLE["stock_card"] = with_views(f"""
SELECT l.obat_kode, o.nama, o.stok AS stok_obat, o.expired_date AS obat_expired_date, l.row_no, l.id, l.ref_type,
       l.qty_in, l.qty_out, l.saldo
FROM (SELECT id, obat_kode, ref_type, qty_in, qty_out, {_LEDGER_SALDO} AS saldo,
             CAST(row_number() OVER (PARTITION BY obat_kode ORDER BY id) AS BIGINT) AS row_no FROM ledger) l
JOIN obat o ON o.kode = l.obat_kode
WHERE l.row_no > 20 AND l.row_no <= 40""", "ledger", "obat")

ORACLE["ledger_from_documents"] = with_views("""
SELECT line_id, ref_type, ref_id, obat_kode, qty_in, qty_out,
       CAST(sum(CAST(qty_in AS BIGINT) - qty_out) OVER (PARTITION BY obat_kode ORDER BY line_id, ref_type
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS saldo
FROM (SELECT id AS line_id, 'BELI' AS ref_type, pembelian_id AS ref_id, obat_kode, qty AS qty_in, 0 AS qty_out
      FROM pembelian_item
      UNION ALL
      SELECT id, 'JUAL', penjualan_id, obat_kode, 0, qty FROM penjualan_item)""",
    "pembelian_item", "penjualan_item")

ORACLE["doc_totals"] = with_views(f"""
SELECT penjualan_id, {_money('sum(qty * harga_jual)')} AS total, CAST(count(*) AS BIGINT) AS n_lines
FROM penjualan_item GROUP BY penjualan_id""", "penjualan_item")

ORACLE["stock_apply"] = with_views("""
SELECT o.kode, CAST(o.stok + coalesce(m.delta, 0) AS INTEGER) AS stok,
       CASE WHEN e.exp IS NULL THEN o.expired_date WHEN o.expired_date IS NULL THEN e.exp
            ELSE least(o.expired_date, e.exp) END AS expired_date
FROM obat o
LEFT JOIN (SELECT obat_kode, sum(qin) - sum(qout) AS delta FROM (
             SELECT obat_kode, qty AS qin, 0 AS qout FROM pembelian_item
             UNION ALL SELECT obat_kode, 0, qty FROM penjualan_item) GROUP BY obat_kode) m ON m.obat_kode = o.kode
LEFT JOIN (SELECT obat_kode, min(expired_date) AS exp FROM pembelian_item GROUP BY obat_kode) e
       ON e.obat_kode = o.kode""", "obat", "pembelian_item", "penjualan_item")

ORACLE["controlled_flag"] = with_views("""
SELECT i.penjualan_id, bool_or(o.golongan IN ('Psikotropika', 'Narkotika')) AS narkotika_psikotropika
FROM penjualan_item i JOIN obat o ON o.kode = i.obat_kode GROUP BY i.penjualan_id""", "penjualan_item", "obat")

ORACLE["interaction_hits"] = with_views("""
SELECT DISTINCT a.penjualan_id, x.obat1_kode, x.obat2_kode, x.tingkat
FROM penjualan_item a JOIN penjualan_item b ON a.penjualan_id = b.penjualan_id AND a.obat_kode < b.obat_kode
JOIN interaksi x ON x.obat1_kode = a.obat_kode AND x.obat2_kode = b.obat_kode
WHERE x.tingkat IN ('major', 'contraindicated')""", "penjualan_item", "interaksi")

ORACLE["allergy_hits"] = with_views("""
SELECT i.penjualan_id, i.id AS line_id, i.obat_kode, p.pelanggan_kode, c.alergi
FROM penjualan_item i JOIN penjualan p ON p.id = i.penjualan_id JOIN pelanggan c ON c.kode = p.pelanggan_kode
JOIN obat o ON o.kode = i.obat_kode
WHERE c.kode <> '0' AND c.alergi IS NOT NULL AND c.alergi <> '' AND c.alergi <> '0'
  AND (contains(lower(c.alergi), lower(i.obat_kode)) OR contains(lower(c.alergi), lower(o.nama)))""",
    "penjualan_item", "penjualan", "pelanggan", "obat")

ORACLE["resolve_codes"] = with_views("""
SELECT t.id, t.obat_input,
       CASE WHEN t.t <> '' AND c.uk IS NOT NULL THEN t.t WHEN t.t <> '' AND n.k IS NOT NULL THEN n.k END AS resolved,
       (CASE WHEN t.t <> '' AND c.uk IS NOT NULL THEN t.t WHEN t.t <> '' AND n.k IS NOT NULL THEN n.k END)
         IS NOT NULL AS valid
FROM (SELECT id, obat_input,
             CASE WHEN contains(trim(obat_input), ' - ') THEN trim(split_part(trim(obat_input), ' - ', 1))
                  ELSE trim(obat_input) END AS t FROM typed_inputs) t
LEFT JOIN (SELECT DISTINCT upper(kode) AS uk FROM obat) c ON upper(t.t) = c.uk
LEFT JOIN (SELECT lower(nama) AS ln, max(kode) AS k FROM obat WHERE nama IS NOT NULL GROUP BY 1) n
       ON lower(t.t) = n.ln""", "typed_inputs", "obat")

ORACLE["missing_refs"] = with_views("""
SELECT id, obat_input FROM typed_inputs
WHERE obat_input IS NOT NULL AND obat_input NOT IN (SELECT kode FROM obat)""", "typed_inputs", "obat")

_NUMERIC_RE = "'\\s*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\\s*'"

ORACLE["validate_rows"] = with_views(f"""
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY fo, ro) - 1 AS INTEGER) AS pos, field, msg FROM (
  SELECT id, 1 AS fo, 1 AS ro, 'kode' AS field, 'kode maksimal 50 karakter' AS msg FROM drug_requests
   WHERE kode <> '' AND length(kode) > 50
  UNION ALL SELECT id, 2, 1, 'nama', 'nama wajib diisi' FROM drug_requests WHERE nama IS NULL OR nama = ''
  UNION ALL SELECT id, 2, 2, 'nama', 'nama maksimal 255 karakter' FROM drug_requests
   WHERE nama <> '' AND length(nama) > 255
  UNION ALL SELECT id, 3, 1, 'produsen', 'produsen maksimal 255 karakter' FROM drug_requests
   WHERE produsen <> '' AND length(produsen) > 255
  UNION ALL SELECT id, 4, 1, 'harga', 'harga wajib diisi' FROM drug_requests WHERE harga IS NULL OR harga = ''
  UNION ALL SELECT id, 4, 2, 'harga', 'harga harus numerik' FROM drug_requests
   WHERE harga <> '' AND NOT regexp_full_match(harga, {_NUMERIC_RE})
  UNION ALL SELECT id, 4, 3, 'harga', 'harga minimal 0' FROM drug_requests
   WHERE harga <> '' AND regexp_full_match(harga, {_NUMERIC_RE}) AND TRY_CAST(trim(harga) AS DOUBLE) < 0
  UNION ALL SELECT id, 5, 1, 'stok', 'stok wajib diisi' FROM drug_requests WHERE stok IS NULL OR stok = ''
  UNION ALL SELECT id, 5, 2, 'stok', 'stok harus integer' FROM drug_requests
   WHERE stok <> '' AND NOT regexp_full_match(stok, '[0-9]+')
  UNION ALL SELECT id, 5, 3, 'stok', 'stok minimal 0' FROM drug_requests
   WHERE stok <> '' AND regexp_full_match(stok, {_NUMERIC_RE}) AND TRY_CAST(trim(stok) AS DOUBLE) < 0
  UNION ALL SELECT id, 6, 1, 'expired_date', 'expired_date harus tanggal (YYYY-MM-DD)' FROM drug_requests
   WHERE expired_date <> ''
     AND coalesce(strftime(try_strptime(expired_date, '%Y-%m-%d'), '%Y-%m-%d') <> expired_date, true)
  UNION ALL SELECT id, 7, 1, 'golongan', 'golongan wajib diisi' FROM drug_requests
   WHERE golongan IS NULL OR golongan = ''
  UNION ALL SELECT id, 7, 2, 'golongan', 'golongan harus salah satu dari: NONE,OTC,OBT,OK,Psikotropika,Narkotika'
   FROM drug_requests WHERE golongan <> ''
     AND golongan NOT IN ('NONE', 'OTC', 'OBT', 'OK', 'Psikotropika', 'Narkotika')
)""", "drug_requests")

ORACLE["validate_masters"] = f"""
WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS id, c_custkey AS k, c_name AS nama, c_mktsegment AS seg,
                  {AS_OF} - CAST(c_custkey * 41 % 20000 AS INTEGER) AS born FROM customer),
cr AS (SELECT id, CASE WHEN k % 17 = 0 THEN '' ELSE nama END AS nama,
              CASE WHEN k % 13 = 0 THEN strftime(born, '%Y-%-m-%-d') ELSE strftime(born, '%Y-%m-%d') END AS tgl_lahir,
              CASE WHEN k % 7 = 0 THEN 'X' WHEN k % 2 = 0 THEN 'L' ELSE 'P' END AS jk,
              CASE WHEN k % 11 = 0 THEN repeat(CAST(k AS VARCHAR), 31) END AS no_hp FROM c),
st AS (SELECT id, CASE WHEN k % 5 = 0 THEN '' ELSE seg END AS jabatan,
              CASE WHEN k % 3 = 0 THEN seg ELSE 'kasir' END AS akses FROM c),
s AS (SELECT CAST(s_suppkey AS BIGINT) AS id, s_suppkey AS k, s_name AS nama FROM supplier),
e AS (
  SELECT 'pelanggan' AS entity, id, 1 AS o, 'nama' AS field, 'nama wajib diisi' AS msg FROM cr WHERE nama = ''
  UNION ALL SELECT 'pelanggan', id, 2, 'nama', 'nama maksimal 150 karakter' FROM cr WHERE length(nama) > 150
  UNION ALL SELECT 'pelanggan', id, 3, 'tgl_lahir', 'tgl_lahir harus tanggal (YYYY-MM-DD)' FROM cr
   WHERE coalesce(strftime(try_strptime(tgl_lahir, '%Y-%m-%d'), '%Y-%m-%d') <> tgl_lahir, true)
  UNION ALL SELECT 'pelanggan', id, 4, 'jenis_kelamin', 'jenis_kelamin harus salah satu dari: L,P' FROM cr
   WHERE jk NOT IN ('L', 'P')
  UNION ALL SELECT 'pelanggan', id, 5, 'no_hp', 'no_hp maksimal 30 karakter' FROM cr WHERE length(no_hp) > 30
  UNION ALL SELECT 'karyawan', id, 1, 'jabatan', 'jabatan wajib diisi' FROM st WHERE jabatan = ''
  UNION ALL SELECT 'karyawan', id, 2, 'level_akses', 'level_akses harus salah satu dari: farmasi,kasir,gudang,admin'
   FROM st WHERE akses NOT IN ('farmasi', 'kasir', 'gudang', 'admin')
  UNION ALL SELECT 'supplier', id, 1, 'nama', 'nama maksimal 200 karakter' FROM s
   WHERE k % 5 = 0 AND length(nama) * 20 > 200
  UNION ALL SELECT 'supplier', id, 2, 'kontak', 'kontak maksimal 100 karakter' FROM s
   WHERE k % 7 = 0 AND length(nama) * 8 > 100
  UNION ALL SELECT 'dokter', id, 1, 'sip', 'sip maksimal 100 karakter' FROM s WHERE k % 3 = 0 AND length(nama) * 8 > 100
  UNION ALL SELECT 'dokter', id, 2, 'nama', 'nama wajib diisi' FROM s WHERE k % 4 = 0
  UNION ALL SELECT 'formula', CAST(p_partkey AS BIGINT), 1, 'nama', 'nama maksimal 150 karakter' FROM part
   WHERE length(p_name) * CASE WHEN p_partkey % 6 = 0 THEN 40 ELSE 1 END > 150
  UNION ALL SELECT 'formula', CAST(p_partkey AS BIGINT), 2, 'dokter_sip', 'dokter_sip maksimal 100 karakter' FROM part
   WHERE p_partkey % 9 = 0 AND length(p_name) * 30 > 100)
SELECT entity, id, CAST(row_number() OVER (PARTITION BY entity, id ORDER BY o) - 1 AS INTEGER) AS pos, field, msg FROM e"""

ORACLE["admit_interactions"] = with_views("""
SELECT id, p1, p2, tingkat, err IS NULL AS accepted, coalesce(err, '') AS error FROM (
  SELECT id, p1, p2, tingkat,
         CASE WHEN base_err IS NOT NULL THEN base_err
              WHEN id <> min(CASE WHEN base_err IS NULL THEN id END) OVER (PARTITION BY p1, p2)
                THEN 'Pasangan sudah ada' END AS err
  FROM (SELECT id, least(obat1_kode, obat2_kode) AS p1, greatest(obat1_kode, obat2_kode) AS p2, tingkat,
               CASE WHEN obat1_kode IS NULL OR obat1_kode = '' THEN 'obat1_kode wajib diisi'
                    WHEN obat2_kode IS NULL OR obat2_kode = '' THEN 'obat2_kode wajib diisi'
                    WHEN tingkat IS NULL OR tingkat = '' THEN 'tingkat wajib diisi'
                    WHEN tingkat NOT IN ('minor', 'moderate', 'major', 'contraindicated')
                      THEN 'tingkat harus salah satu dari: minor,moderate,major,contraindicated'
                    WHEN obat1_kode = obat2_kode THEN 'Obat tidak boleh sama' END AS base_err
        FROM interaction_requests))""", "interaction_requests")

ORACLE["duplicates"] = with_views("""
SELECT pembelian_id, batch_no, CAST(count(*) AS BIGINT) AS n FROM pembelian_item
GROUP BY 1, 2 HAVING count(*) > 1""", "pembelian_item")


def _orphan(name: str, child: str, fk: str, parent: str, key: str) -> str:
    return (f"SELECT '{name}' AS fk, CAST(count(*) AS BIGINT) AS n_orphans FROM {child} "
            f"WHERE {fk} IS NOT NULL AND {fk} NOT IN (SELECT {key} FROM {parent})")




def _unique(name: str, table: str, keys: str) -> str:
    some = " AND ".join(f"{k} IS NOT NULL" for k in keys.split(", "))
    return (f"SELECT '{name}' AS unique_key, CAST(count(*) AS BIGINT) AS n_duplicates FROM "
            f"(SELECT 1 FROM {table} WHERE {some} GROUP BY {keys} HAVING count(*) > 1)")


ORACLE["duplicate_keys"] = with_views("\nUNION ALL\n".join([
    _unique("m_obat.kode", "obat", "kode"), _unique("m_pelanggan.kode", "pelanggan", "kode"),
    _unique("m_supplier.kode", "supp", "kode"),
    _unique("m_formula_racik.kode", "(SELECT DISTINCT l_orderkey AS kode FROM lineitem)", "kode"),
    _unique("interaksi_obat.obat1_kode,obat2_kode", "interaksi", "obat1_kode, obat2_kode"),
    _unique("pembelian.no_faktur", "pembelian", "no_faktur"), _unique("penjualan.no_nota", "penjualan", "no_nota"),
    _unique("request.kode", "drug_requests", "kode"), _unique("request.nama", "drug_requests", "nama"),
]), "obat", "pelanggan", "supp", "interaksi", "pembelian", "penjualan", "drug_requests")

ORACLE["orphans"] = with_views("\nUNION ALL\n".join([
    _orphan("penjualan_item.obat_kode", "penjualan_item", "obat_kode", "obat", "kode"),
    _orphan("penjualan_item.penjualan_id", "penjualan_item", "penjualan_id", "penjualan", "id"),
    _orphan("penjualan.pelanggan_kode", "penjualan", "pelanggan_kode", "pelanggan", "kode"),
    _orphan("pembelian_item.obat_kode", "pembelian_item", "obat_kode", "obat", "kode"),
    _orphan("pembelian_item.pembelian_id", "pembelian_item", "pembelian_id", "pembelian", "id"),
    _orphan("pembelian.supplier_kode", "pembelian", "supplier_kode", "supp", "kode"),
    _orphan("interaksi_obat.obat1_kode", "interaksi", "obat1_kode", "obat", "kode"),
    _orphan("interaksi_obat.obat2_kode", "interaksi", "obat2_kode", "obat", "kode"),
    _orphan("stok_kartu.obat_kode", "ledger", "obat_kode", "obat", "kode"),
    _orphan("hutang_supplier.supplier_kode", "hutang", "supplier_kode", "supp", "kode"),
    _orphan("hutang_supplier.pembelian_id", "hutang", "pembelian_id", "pembelian", "id"),
    _orphan("hutang_supplier_bayar.hutang_id", "bayar", "hutang_id", "hutang", "id"),
]), "penjualan_item", "obat", "penjualan", "pelanggan", "pembelian_item", "pembelian", "supp", "interaksi",
    "ledger", "bayar", "hutang")


def _domain(name: str, table: str, col: str, dom: list[str]) -> str:
    vals = ", ".join(f"'{v}'" for v in dom)
    return (f"SELECT '{name}' AS check, CAST(count(*) AS BIGINT) AS n_bad FROM {table} "
            f"WHERE {col} IS NOT NULL AND {col} NOT IN ({vals})")


from dispensa import model as _m  # noqa: E402

ORACLE["out_of_domain"] = with_views("\nUNION ALL\n".join([
    _domain("m_obat.golongan", "obat", "golongan", _m.GOLONGAN),
    _domain("request.golongan", "drug_requests", "golongan", _m.GOLONGAN),
    _domain("penjualan.jenis", "penjualan", "jenis", _m.JENIS),
    _domain("interaksi_obat.tingkat", "interaksi", "tingkat", _m.TINGKAT),
    _domain("stok_kartu.ref_type", "ledger", "ref_type", _m.REF_TYPE),
]), "obat", "drug_requests", "penjualan", "interaksi", "ledger")

ORACLE["admit_purchases"] = with_views("""
SELECT p.id AS req_id, err_msg IS NULL AS accepted, CAST(CASE WHEN err_msg IS NULL THEN 0 ELSE 1 END AS BIGINT)
       AS n_errors, err_field AS error_field, err_msg AS error_msg
FROM (SELECT p.id,
        CASE WHEN n.n IS NULL THEN 'items' WHEN s.kode IS NULL THEN 'supplier_kode'
             WHEN m.first_missing IS NOT NULL THEN 'items.' || CAST(m.first_missing AS VARCHAR) END AS err_field,
        CASE WHEN n.n IS NULL THEN 'items wajib diisi' WHEN s.kode IS NULL THEN 'Supplier tidak ditemukan'
             WHEN m.first_missing IS NOT NULL THEN 'Obat tidak ditemukan' END AS err_msg
      FROM pembelian p
      LEFT JOIN (SELECT pembelian_id, count(*) AS n FROM pembelian_item GROUP BY 1) n ON n.pembelian_id = p.id
      LEFT JOIN supp s ON s.kode = p.supplier_kode
      LEFT JOIN (SELECT i.pembelian_id, min(CAST(i.id - i.pembelian_id * 100 - 1 AS INTEGER)) AS first_missing
                 FROM pembelian_item i LEFT JOIN obat o ON o.kode = i.obat_kode WHERE o.kode IS NULL GROUP BY 1) m
             ON m.pembelian_id = p.id) p""", "pembelian", "pembelian_item", "supp", "obat")

ORACLE["default_expiry"] = with_views("""
SELECT i.pembelian_id AS req_id, CAST(i.id - i.pembelian_id * 100 - 1 AS INTEGER) AS pos, i.obat_kode,
       CASE WHEN i.id - i.pembelian_id * 100 - 1 = 1 THEN
              CASE WHEN month(p.tgl) = 2 AND day(p.tgl) = 29 THEN make_date(year(p.tgl) + 1, 3, 1)
                   ELSE CAST(p.tgl + INTERVAL 1 YEAR AS DATE) END
            ELSE i.expired_date END AS expired_date
FROM pembelian_item i JOIN pembelian p ON p.id = i.pembelian_id""", "pembelian_item", "pembelian")

ORACLE["admit_sales_snapshot"] = with_views(f"""
SELECT h.req_id,
       (NOT stage1 AND coalesce(le.n_static, 0) = 0 AND coalesce(pi.n_inter, 0) = 0
        AND coalesce(le.n_stock, 0) = 0) AS accepted,
       stage1 AS stage1_refused,
       CAST(CASE WHEN stage1 THEN 0 ELSE coalesce(le.n_static, 0) END AS BIGINT) AS n_line_errors,
       CAST(CASE WHEN stage1 THEN 0 ELSE coalesce(pi.n_inter, 0) END AS BIGINT) AS n_interaction_errors,
       CAST(CASE WHEN stage1 THEN 0 ELSE coalesce(le.n_stock, 0) END AS BIGINT) AS n_stock_errors,
       coalesce(le.narko, false) AS narkotika_psikotropika
FROM (SELECT p.id AS req_id,
             (n.n IS NULL OR (p.jenis IN ('Resep', 'Racik') AND (p.dokter_sip IS NULL OR p.dokter_sip IN ('', '0'))))
               AS stage1
      FROM penjualan p LEFT JOIN (SELECT penjualan_id, count(*) AS n FROM penjualan_item GROUP BY 1) n
           ON n.penjualan_id = p.id) h
LEFT JOIN (
  SELECT i.penjualan_id AS req_id,
         sum(CASE WHEN i.obat_kode IS NULL OR i.obat_kode IN ('', '0') OR i.qty <= 0 THEN 1
                  WHEN o.kode IS NULL THEN 1
                  ELSE (CASE WHEN o.expired_date < {AS_OF} THEN 1 ELSE 0 END)
                     + (CASE WHEN c.alergi IS NOT NULL AND c.alergi <> '' AND c.alergi <> '0'
                              AND (contains(lower(c.alergi), lower(i.obat_kode))
                                   OR contains(lower(c.alergi), lower(o.nama))) THEN 1 ELSE 0 END) END) AS n_static,
         sum(CASE WHEN i.obat_kode NOT IN ('', '0') AND i.qty > 0 AND o.kode IS NOT NULL AND o.stok < i.qty THEN 1 ELSE 0 END)
           AS n_stock,
         bool_or(coalesce(o.golongan IN ('Psikotropika', 'Narkotika'), false)) AS narko
  FROM penjualan_item i JOIN penjualan p ON p.id = i.penjualan_id
  LEFT JOIN pelanggan c ON c.kode = p.pelanggan_kode AND c.kode <> '0' LEFT JOIN obat o ON o.kode = i.obat_kode
  GROUP BY 1) le ON le.req_id = h.req_id
LEFT JOIN (
  SELECT a.penjualan_id AS req_id, count(*) AS n_inter
  FROM penjualan_item a JOIN penjualan_item b ON a.penjualan_id = b.penjualan_id AND a.id < b.id
  JOIN interaksi x ON x.obat1_kode = least(a.obat_kode, b.obat_kode) AND x.obat2_kode = greatest(a.obat_kode, b.obat_kode)
  WHERE x.tingkat IN ('major', 'contraindicated') GROUP BY 1) pi ON pi.req_id = h.req_id""",
    "penjualan", "penjualan_item", "pelanggan", "obat", "interaksi")

# Sales one by one, by id: rows 'd:<drug>' hold the stock left, rows 's:<id>' the short lines of a sale.
_SALE_CTES = {
    "li": f"""SELECT i.penjualan_id, i.id, i.obat_kode, i.qty,
               NOT (i.obat_kode IS NULL OR i.obat_kode IN ('', '0') OR i.qty <= 0) AND o.kode IS NOT NULL AS checkable,
               coalesce(o.golongan IN ('Psikotropika', 'Narkotika'), false) AS narko,
               CASE WHEN i.obat_kode IS NULL OR i.obat_kode IN ('', '0') OR i.qty <= 0 OR o.kode IS NULL THEN 1
                    ELSE CAST(coalesce(o.expired_date < {AS_OF}, false) AS INTEGER)
                       + CAST(coalesce(c.alergi NOT IN ('', '0') AND (contains(lower(c.alergi), lower(i.obat_kode))
                              OR contains(lower(c.alergi), lower(o.nama))), false) AS INTEGER) END AS n_static
               FROM penjualan_item i JOIN penjualan p ON p.id = i.penjualan_id
               LEFT JOIN pelanggan c ON c.kode = p.pelanggan_kode AND c.kode <> '0'
               LEFT JOIN obat o ON o.kode = i.obat_kode""",
    "pairs": """SELECT a.penjualan_id, count(*) AS n FROM penjualan_item a
               JOIN penjualan_item b ON a.penjualan_id = b.penjualan_id AND a.id < b.id
               JOIN interaksi x ON x.obat1_kode = least(a.obat_kode, b.obat_kode)
                    AND x.obat2_kode = greatest(a.obat_kode, b.obat_kode)
               WHERE x.tingkat IN ('major', 'contraindicated') GROUP BY 1""",
    "h": """SELECT p.id, l.n IS NULL OR coalesce(p.jenis IN ('Resep', 'Racik')
                     AND (p.dokter_sip IS NULL OR p.dokter_sip IN ('', '0')), false) AS stage1,
               coalesce(l.n_static, 0) AS n_static, coalesce(x.n, 0) AS n_inter, coalesce(l.narko, false) AS narko
               FROM penjualan p LEFT JOIN (SELECT penjualan_id, count(*) AS n, sum(n_static) AS n_static,
                                                  bool_or(narko) AS narko FROM li GROUP BY 1) l ON l.penjualan_id = p.id
               LEFT JOIN pairs x ON x.penjualan_id = p.id""",
    "sl": """SELECT dense_rank() OVER (ORDER BY h.id) AS step, h.id, li.obat_kode, li.qty,
               h.n_static = 0 AND h.n_inter = 0 AS ok
               FROM li JOIN h ON h.id = li.penjualan_id AND NOT h.stage1 WHERE li.checkable""",
    "run(key, step, val) USING KEY (key)": """
  SELECT 'd:' || kode, CAST(0 AS BIGINT), CAST(stok AS BIGINT) FROM obat
  UNION
  SELECT * FROM (
    WITH l AS (SELECT sl.*, d.val AS stok, d.key AS key FROM sl JOIN recurring.run d ON d.key = 'd:' || sl.obat_kode
               WHERE sl.step = (SELECT max(step) + 1 FROM run)),
    v AS (SELECT step, id, count(*) FILTER (WHERE stok < qty) AS n_short FROM l GROUP BY 1, 2)
    SELECT 's:' || id, step, n_short FROM v
    UNION ALL
    SELECT l.key, l.step, CAST(min(l.stok) - sum(l.qty) AS BIGINT) FROM l, v WHERE l.ok AND v.n_short = 0 GROUP BY 1, 2)"""}


def _sales_in_order(body: str) -> str:
    sql = with_views(body, "penjualan", "penjualan_item", "pelanggan", "obat", "interaksi", extra=_SALE_CTES)
    # the steps read sl again and again: computed once
    return "WITH RECURSIVE " + sql[len("WITH "):].replace("\nsl AS (", "\nsl AS MATERIALIZED (")


ORACLE["admit_sales_sequential"] = _sales_in_order("""
SELECT h.id AS req_id, NOT stage1 AND n_static = 0 AND n_inter = 0 AND coalesce(r.val, 0) = 0 AS accepted,
       stage1 AS stage1_refused, CAST(CASE WHEN stage1 THEN 0 ELSE n_static END AS BIGINT) AS n_line_errors,
       CAST(CASE WHEN stage1 THEN 0 ELSE n_inter END AS BIGINT) AS n_interaction_errors,
       CAST(CASE WHEN stage1 THEN 0 ELSE coalesce(r.val, 0) END AS BIGINT) AS n_stock_errors,
       narko AS narkotika_psikotropika
FROM h LEFT JOIN run r ON r.key = 's:' || h.id""")

ORACLE["post_sales"] = _sales_in_order("""
SELECT o.kode, CAST(r.val AS INTEGER) AS stok FROM obat o JOIN run r ON r.key = 'd:' || o.kode""")

ORACLE["post_sales_headers"] = _sales_in_order(f"""
SELECT h.id, p.no_nota, p.jenis, h.narko AS narkotika_psikotropika, t.n_lines, {_money('t.total')} AS total
FROM h JOIN penjualan p ON p.id = h.id LEFT JOIN run r ON r.key = 's:' || h.id
JOIN (SELECT penjualan_id, CAST(count(*) AS BIGINT) AS n_lines, sum(qty * coalesce(harga_jual, 0)) AS total
      FROM penjualan_item GROUP BY 1) t ON t.penjualan_id = h.id
WHERE NOT stage1 AND n_static = 0 AND n_inter = 0 AND coalesce(r.val, 0) = 0""")

ORACLE["sale_errors"] = with_views(f"""
SELECT req_id, field, nth, msg, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT id AS req_id, 'items' AS field, 0 AS nth, 'items wajib diisi' AS msg FROM h WHERE no_items
  UNION ALL SELECT id, 'dokter_sip', 0, 'Wajib untuk resep/racik' FROM h WHERE NOT no_items AND no_doctor
  UNION ALL SELECT req_id, 'items.' || pos, 0, CASE WHEN bad THEN 'obat_kode/qty tidak valid' ELSE 'Obat tidak ditemukan' END
   FROM li WHERE bad OR missing
  UNION ALL SELECT req_id, 'items.' || pos, 0, 'Stok tidak cukup' FROM li WHERE NOT bad AND NOT missing AND short
  UNION ALL SELECT req_id, 'items.' || pos, CAST(short AS INTEGER), 'Obat kadaluarsa'
   FROM li WHERE NOT bad AND NOT missing AND old
  UNION ALL SELECT req_id, 'items.' || pos, CAST(short AS INTEGER) + CAST(old AS INTEGER), 'Alergi pasien terdeteksi'
   FROM li WHERE NOT bad AND NOT missing AND allergic
  UNION ALL SELECT a.req_id, 'interaksi', NULL, 'Interaksi ' || a.obat_kode || '-' || b.obat_kode || ': ' || x.tingkat
   FROM li a JOIN li b ON a.req_id = b.req_id AND a.pos < b.pos
   JOIN interaksi x ON x.obat1_kode = least(a.obat_kode, b.obat_kode) AND x.obat2_kode = greatest(a.obat_kode, b.obat_kode)
   WHERE x.tingkat IN ('major', 'contraindicated'))
GROUP BY 1, 2, 3, 4""", "penjualan", "penjualan_item", "pelanggan", "obat", "interaksi", extra={
    "h": """SELECT p.*, NOT EXISTS (SELECT 1 FROM penjualan_item i WHERE i.penjualan_id = p.id) AS no_items,
             coalesce(p.jenis IN ('Resep', 'Racik') AND (p.dokter_sip IS NULL OR p.dokter_sip IN ('', '0')), false)
               AS no_doctor FROM penjualan p""",
    "li": f"""SELECT i.penjualan_id AS req_id, row_number() OVER (PARTITION BY i.penjualan_id ORDER BY i.id) - 1 AS pos,
             i.obat_kode, i.obat_kode IS NULL OR i.obat_kode IN ('', '0') OR i.qty <= 0 AS bad, o.kode IS NULL AS missing,
             o.stok < i.qty AS short, coalesce(o.expired_date < {AS_OF}, false) AS old,
             coalesce(c.alergi NOT IN ('', '0') AND (contains(lower(c.alergi), lower(i.obat_kode))
                      OR contains(lower(c.alergi), lower(o.nama))), false) AS allergic
             FROM penjualan_item i JOIN h ON h.id = i.penjualan_id AND NOT no_items AND NOT no_doctor
             LEFT JOIN pelanggan c ON c.kode = h.pelanggan_kode AND c.kode <> '0'
             LEFT JOIN obat o ON o.kode = i.obat_kode"""})

_PAY_CTES = {
    "pay": """SELECT b.id, b.hutang_id, b.nominal,
               row_number() OVER (PARTITION BY b.hutang_id ORDER BY b.id) AS k
        FROM bayar b JOIN hutang h ON h.id = b.hutang_id""",
    "run": """
  SELECT hutang_id, k, id, nominal, saldo_after, accepted FROM (
    SELECT h.id AS hutang_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS id,
           CAST(NULL AS DECIMAL(15,2)) AS nominal, CAST(h.saldo AS DECIMAL(15,2)) AS saldo_after,
           CAST(NULL AS BOOLEAN) AS accepted FROM hutang h)
  UNION ALL
  SELECT r.hutang_id, p.k, p.id, p.nominal,
         CAST(CASE WHEN p.nominal > 0 AND p.nominal <= r.saldo_after THEN r.saldo_after - p.nominal
                   ELSE r.saldo_after END AS DECIMAL(15,2)),
         p.nominal > 0 AND p.nominal <= r.saldo_after
  FROM run r JOIN pay p ON p.hutang_id = r.hutang_id AND p.k = r.k + 1""",
}


def _with_recursive(body: str, *views: str) -> str:
    sql = with_views(body, *views, extra=_PAY_CTES)
    return "WITH RECURSIVE " + sql[len("WITH "):]


ORACLE["post_payments"] = _with_recursive(f"""
SELECT id, hutang_id, {_money('nominal')} AS nominal, accepted,
       CASE WHEN NOT (nominal > 0) THEN 'Harus > 0' WHEN NOT accepted THEN 'Lebih besar dari saldo hutang' ELSE '' END
         AS error, {_money('saldo_after')} AS saldo_after
FROM run WHERE k > 0
UNION ALL
SELECT b.id, b.hutang_id, {_money('b.nominal')}, false,
       CASE WHEN NOT (b.nominal > 0) THEN 'Harus > 0' ELSE 'Not found' END, NULL
FROM bayar b WHERE b.hutang_id NOT IN (SELECT id FROM hutang)""", "hutang", "bayar")

ORACLE["payable_detail"] = _with_recursive(f"""
SELECT h.id, h.supplier_kode, {_money('r.saldo_after')} AS saldo,
       CASE WHEN b.id IS NOT NULL THEN row_number() OVER (PARTITION BY h.id ORDER BY b.id) - 1 END AS pos,
       b.id AS bayar_id, b.tgl, {_money('b.nominal')} AS nominal
FROM hutang h JOIN (SELECT hutang_id, arg_max(saldo_after, k) AS saldo_after FROM run GROUP BY 1) r
  ON r.hutang_id = h.id
LEFT JOIN (SELECT * FROM bayar WHERE id IN (SELECT id FROM run WHERE k > 0 AND accepted)) b
  ON b.hutang_id = h.id""", "hutang", "bayar")

ORACLE["payable_balances"] = _with_recursive(f"""
SELECT h.id, h.pembelian_id, {_money('r.saldo_after')} AS saldo
FROM hutang h JOIN (SELECT hutang_id, arg_max(saldo_after, k) AS saldo_after FROM run GROUP BY 1) r
  ON r.hutang_id = h.id""", "hutang", "bayar")

# purchases admitted (every line valid here; supplier known, drugs known, at least one line)
_OK_PURCHASES = """
SELECT p.* FROM pembelian p
WHERE EXISTS (SELECT 1 FROM pembelian_item i WHERE i.pembelian_id = p.id)
  AND p.supplier_kode IN (SELECT kode FROM supp)
  AND NOT EXISTS (SELECT 1 FROM pembelian_item i WHERE i.pembelian_id = p.id
                  AND i.obat_kode NOT IN (SELECT kode FROM obat))"""

ORACLE["post_purchases"] = with_views(f"""
SELECT m.id, m.obat_kode, 'BELI' AS ref_type, m.ref_id, m.qty_in, 0 AS qty_out,
       CAST(coalesce(o.opening, 0) + sum(CAST(m.qty_in AS BIGINT)) OVER (PARTITION BY m.obat_kode ORDER BY m.id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS saldo
FROM (SELECT CAST((SELECT max(id) FROM ledger) + row_number() OVER (ORDER BY i.id) AS BIGINT) AS id,
             i.obat_kode, i.pembelian_id AS ref_id, i.qty AS qty_in
      FROM pembelian_item i WHERE i.pembelian_id IN (SELECT id FROM okp)) m
LEFT JOIN (SELECT obat_kode, sum(CAST(qty_in AS BIGINT) - qty_out) AS opening FROM ledger GROUP BY 1) o
       ON o.obat_kode = m.obat_kode""",
    "ledger", "pembelian", "pembelian_item", "supp", "obat", extra={"okp": _OK_PURCHASES})

ORACLE["purchase_payables"] = with_views(f"""
SELECT CAST((SELECT max(id) FROM hutang) + row_number() OVER (ORDER BY x.id) AS BIGINT) AS id,
       x.id AS pembelian_id, x.supplier_kode, {_money('x.saldo')} AS saldo
FROM (SELECT p.id, p.supplier_kode,
             greatest(0, CAST(t.total AS DECIMAL(15,2)) + p.pajak - p.bayar) AS saldo
      FROM okp p JOIN (SELECT pembelian_id, sum(qty * harga_beli) AS total FROM pembelian_item GROUP BY 1) t
        ON t.pembelian_id = p.id) x
WHERE x.saldo > 0""", "hutang", "pembelian", "pembelian_item", "supp", "obat", extra={"okp": _OK_PURCHASES})

ORACLE["audit_rows"] = with_views("""
SELECT 'CREATE' AS action, 'pembelian' AS entity, CAST(id AS VARCHAR) AS entity_id,
       CAST(json_object('no_faktur', no_faktur, 'tgl', strftime(tgl, '%Y-%m-%d'), 'supplier_kode', supplier_kode,
                        'pajak', CAST(pajak AS VARCHAR)) AS VARCHAR) AS detail
FROM okp""", "pembelian", "pembelian_item", "supp", "obat", extra={"okp": _OK_PURCHASES})

# One step per purchase, by id: rows 'd:<drug>' hold the stock left, rows 'p:<id>' the verdicts.
ORACLE["reverse_purchases"] = "WITH RECURSIVE " + with_views("""
SELECT p.id AS pembelian_id, CAST(coalesce(c.n_lines, 0) AS BIGINT) AS n_lines,
       CAST(coalesce(r.n_short, 0) AS BIGINT) AS n_short, r.first_short AS first_short_drug,
       coalesce(r.val = 1, false) AS accepted,
       CASE WHEN coalesce(c.n_lines, 0) = 0 THEN 'Not found'
            WHEN r.n_short > 0 THEN 'Tidak bisa hapus: stok sudah terpakai' ELSE '' END AS error
FROM pembelian p LEFT JOIN (SELECT pembelian_id, count(*) AS n_lines FROM pembelian_item GROUP BY 1) c
     ON c.pembelian_id = p.id
LEFT JOIN run r ON r.key = 'p:' || p.id""", "pembelian", "pembelian_item", "obat", extra={
    "pl": """SELECT dense_rank() OVER (ORDER BY pembelian_id) AS step, pembelian_id, id, obat_kode, qty
             FROM pembelian_item""",
    "run(key, step, val, n_short, first_short) USING KEY (key)": """
  SELECT 'd:' || kode, CAST(0 AS BIGINT), CAST(stok AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM obat
  UNION
  SELECT * FROM (
    WITH l AS (SELECT pl.*, coalesce(d.val, 0) AS stok, d.key AS key
               FROM pl LEFT JOIN recurring.run d ON d.key = 'd:' || pl.obat_kode
               WHERE pl.step = (SELECT max(step) + 1 FROM run)),
    v AS (SELECT step, pembelian_id, count(*) FILTER (WHERE stok < qty) AS n_short,
                 arg_min(obat_kode, id) FILTER (WHERE stok < qty) AS first_short FROM l GROUP BY 1, 2)
    SELECT 'p:' || pembelian_id, step, CAST(n_short = 0 AS BIGINT), n_short, first_short FROM v
    UNION ALL
    SELECT l.key, l.step, CAST(min(l.stok) - sum(l.qty) AS BIGINT), NULL, NULL FROM l, v
    WHERE v.n_short = 0 AND l.key IS NOT NULL GROUP BY 1, 2)"""})[len("WITH "):].replace("\npl AS (", "\npl AS MATERIALIZED (")

ORACLE["assign_codes"] = with_views("""
SELECT c.id AS req_id, g.code AS kode FROM pelanggan c LEFT JOIN got g ON g.req_id = c.id""", "pelanggan", extra={
    "cand": """SELECT c.id AS req_id, k,
                 'PL' || upper(substr(md5(CAST(c.id AS VARCHAR) || ':' || CAST(k AS VARCHAR)), 1, 6)) AS code
               FROM pelanggan c, range(6) t(k)""",
    "free": "SELECT * FROM cand WHERE code NOT IN (SELECT kode FROM pelanggan)",
    "first1": "SELECT req_id, arg_min(code, k) AS code, min(k) AS k FROM free GROUP BY 1",
    "own1": "SELECT code, min(req_id) AS owner FROM first1 GROUP BY 1",
    "won": "SELECT f.req_id, f.code FROM first1 f JOIN own1 o ON o.code = f.code AND o.owner = f.req_id",
    "lost": "SELECT f.req_id, f.k AS k0 FROM first1 f JOIN own1 o ON o.code = f.code AND o.owner <> f.req_id",
    "retry": """SELECT fr.req_id, fr.k, fr.code FROM free fr JOIN lost l ON l.req_id = fr.req_id
                WHERE fr.k > l.k0 AND fr.code NOT IN (SELECT code FROM won)""",
    "second2": "SELECT req_id, arg_min(code, k) AS code FROM retry GROUP BY 1",
    "own2": "SELECT code, min(req_id) AS owner FROM second2 GROUP BY 1",
    "got": """SELECT req_id, code FROM won UNION ALL
              SELECT s.req_id, s.code FROM second2 s JOIN own2 o ON o.code = s.code AND o.owner = s.req_id""",
})

# change feed, written as the fold's closed form: last delete, first accepted
# insert after it, then the latest present value of each field
_CF_FIELDS = ["nama", "produsen", "harga", "stok", "golongan"]


def _cf_field(f: str) -> str:
    typ = {"harga": "DECIMAL(15,2)", "stok": "INTEGER"}.get(f, "VARCHAR")
    return (f"CASE WHEN u.h_{f} THEN CAST(u.v_{f} AS {typ}) "
            f"WHEN r.reset_is_ins THEN CAST(json_extract_string(r.ins_payload, '$.{f}') AS {typ}) "
            f"ELSE b.{f} END AS {f}")


ORACLE["change_feed"] = with_views(f"""
SELECT kode, nama, produsen, {_money('harga')} AS harga, stok, golongan FROM (
  SELECT coalesce(b.kode, r.kode) AS kode, {", ".join(_cf_field(f) for f in _CF_FIELDS)},
         CASE WHEN r.reset IS NULL THEN b.kode IS NOT NULL ELSE r.reset_is_ins END AS keep
  FROM obat b
  FULL OUTER JOIN rs r ON r.kode = b.kode
  LEFT JOIN upd u ON u.kode = coalesce(b.kode, r.kode)) WHERE keep""", "obat", "drug_changes", extra={
    "dl": "SELECT kode, max(CASE WHEN op = 'delete' THEN seq END) AS last_del FROM drug_changes GROUP BY 1",
    "ins": """SELECT c.kode, d.last_del, min(c.seq) AS ins_seq, arg_min(c.payload, c.seq) AS ins_payload
              FROM drug_changes c JOIN dl d ON d.kode = c.kode
              WHERE c.op = 'insert' AND (d.last_del IS NULL OR c.seq > d.last_del) GROUP BY 1, 2""",
    "rs": """SELECT d.kode, d.last_del,
                    CASE WHEN d.last_del IS NOT NULL OR d.kode NOT IN (SELECT kode FROM obat) THEN i.ins_seq END
                      AS ins_seq,
                    i.ins_payload,
                    greatest(d.last_del, CASE WHEN d.last_del IS NOT NULL OR d.kode NOT IN (SELECT kode FROM obat)
                                              THEN i.ins_seq END) AS reset,
                    coalesce(CASE WHEN d.last_del IS NOT NULL OR d.kode NOT IN (SELECT kode FROM obat)
                                  THEN i.ins_seq END = greatest(d.last_del, CASE WHEN d.last_del IS NOT NULL
                                  OR d.kode NOT IN (SELECT kode FROM obat) THEN i.ins_seq END), false) AS reset_is_ins
             FROM dl d LEFT JOIN ins i ON i.kode = d.kode""",
    "upd": "SELECT c.kode, " + ", ".join(
        f"arg_max(json_extract_string(c.payload, '$.{f}'), c.seq) FILTER (WHERE list_contains(json_keys(c.payload), '{f}')) AS v_{f}, "
        f"coalesce(bool_or(list_contains(json_keys(c.payload), '{f}')), false) AS h_{f}" for f in _CF_FIELDS) + """
              FROM drug_changes c JOIN rs r ON r.kode = c.kode
              WHERE c.op = 'update' AND (r.reset IS NULL OR c.seq > r.reset) GROUP BY 1""",
})

ORACLE["cascade_delete"] = with_views("""
SELECT r.kode, o.kode IS NOT NULL AS found,
       CAST(coalesce(s.n, 0) AS BIGINT) AS n_sale_lines, CAST(coalesce(pi.n, 0) AS BIGINT) AS n_purchase_lines,
       CAST(coalesce(l.n, 0) AS BIGINT) AS n_ledger_rows,
       o.kode IS NOT NULL AND coalesce(pi.n, 0) = 0 AND coalesce(l.n, 0) = 0 AS deleted
FROM (SELECT DISTINCT kode FROM drug_changes WHERE op = 'delete') r
LEFT JOIN obat o ON o.kode = r.kode
LEFT JOIN (SELECT obat_kode, count(*) AS n FROM penjualan_item GROUP BY 1) s ON s.obat_kode = r.kode
LEFT JOIN (SELECT obat_kode, count(*) AS n FROM pembelian_item GROUP BY 1) pi ON pi.obat_kode = r.kode
LEFT JOIN (SELECT obat_kode, count(*) AS n FROM ledger GROUP BY 1) l ON l.obat_kode = r.kode""",
    "drug_changes", "obat", "penjualan_item", "pembelian_item", "ledger")

ORACLE["json_fields"] = "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events"

ORACLE["formula_lines"] = """
SELECT 'FR' || CAST(l_orderkey AS VARCHAR) AS kode,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
            l_extendedprice, l_shipdate) - 1 AS INTEGER) AS pos,
       CAST(l_partkey AS VARCHAR) AS obat_kode, l_quantity AS qty, 'tab' AS satuan
FROM lineitem"""

ORACLE["request_reader"] = with_views(f"""
SELECT penjualan_id AS req_id, CAST(id - penjualan_id * 100 - 1 AS INTEGER) AS pos, obat_kode, qty,
       {_money('harga_jual')} AS harga_jual FROM penjualan_item""", "penjualan_item")

ORACLE["unit_price"] = with_views("""
SELECT id, qty, CAST(round(harga_beli, 2) AS DOUBLE) AS total,
       CASE WHEN qty > 0 AND harga_beli >= 0 THEN
         ((2 * CAST(harga_beli * 100 AS BIGINT) + qty) // (2 * qty)) / 100.0 END AS unit_price
FROM pembelian_item""", "pembelian_item")

ORACLE["display_number"] = with_views("""
SELECT kode, replace(format('{:,}', CAST(round(stok * harga, 0) AS BIGINT)), ',', '.') AS nilai FROM obat""",
    "obat")

ORACLE["csv_export"] = with_views("""
SELECT strftime(CAST(tgl AS DATE), '%Y-%m-%d') AS Tanggal, CAST(count(*) AS VARCHAR) AS Transaksi,
       replace(format('{:,}', CAST(round(sum(total), 0) AS BIGINT)), ',', '.') AS Total
FROM penjualan GROUP BY CAST(tgl AS DATE)""", "penjualan")

_WS = ("[\\t\\n\\x{0B}\\f\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
       "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]")

_PAGES = f"""
SELECT CAST(row_number() OVER (ORDER BY name) AS BIGINT) AS page_no, name,
       regexp_replace(coalesce(t, ''), '^{_WS}+|{_WS}+$', '', 'g') AS text
FROM (SELECT name, string_agg(CASE WHEN text <> '' THEN text END, chr(10) ORDER BY line_no) AS t
      FROM page_lines WHERE lower(regexp_extract(name, '\\.([^.]*)$', 1)) IN ('jpg', 'jpeg', 'png', 'bmp')
      GROUP BY name)"""

ORACLE["page_text"] = with_views(f"""
SELECT page_no, name, text, CAST(length(text) AS BIGINT) AS n_chars FROM ({_PAGES})""", "page_lines")

ORACLE["page_total"] = with_views(f"""
SELECT CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS total_chars, CAST(count(*) AS BIGINT) AS n_pages
FROM ({_PAGES})""", "page_lines")

ORACLE["stream_ledger"] = ORACLE["ledger_balance"]

ORACLE["stream_daily_sales"] = with_views(f"""
SELECT CAST(tgl AS DATE) AS tgl, CAST(count(*) AS BIGINT) AS trx, {_money('sum(total)')} AS total
FROM penjualan GROUP BY 1""", "penjualan")

ORACLE["typed_scan"] = with_views(f"""SELECT {_OBAT_ALL} FROM obat""", "obat")
ORACLE["json_export"] = ORACLE["top_sellers"]

ORACLE["customer_change_feed"] = with_views("""
SELECT c.kode,
       CASE WHEN u.h_nama THEN u.v_nama ELSE c.nama END AS nama,
       CASE WHEN u.h_alergi THEN u.v_alergi ELSE c.alergi END AS alergi,
       CASE WHEN u.h_alamat THEN u.v_alamat ELSE c.alamat END AS alamat
FROM pelanggan c LEFT JOIN (
  SELECT kode, """ + ", ".join(
      f"arg_max(json_extract_string(payload, '$.{f}'), seq) FILTER (WHERE list_contains(json_keys(payload), '{f}'))"
      f" AS v_{f}, coalesce(bool_or(list_contains(json_keys(payload), '{f}')), false) AS h_{f}"
      for f in ("nama", "alergi", "alamat")) + """
  FROM customer_changes WHERE op = 'update' GROUP BY kode) u ON u.kode = c.kode""",
    "pelanggan", "customer_changes")

# Verdicts: the state before a change of a code is the last accepted insert or
# delete before it (a refused insert leaves an existing row); a stored pair is
# taken until its id is first deleted, then from the first valid insert on.
_VERDICTS = {
    "body": """SELECT *, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) ELSE CAST('{}' AS JSON) END AS b,
                      trim(key) AS code FROM master_changes""",
    "checked": """SELECT *, CASE
        WHEN op <> 'insert' THEN NULL
        WHEN entity = 'interaksi_obat' THEN CASE
          WHEN b->>'$.tingkat' NOT IN ('minor', 'moderate', 'major', 'contraindicated')
            THEN 'tingkat harus salah satu dari: minor,moderate,major,contraindicated'
          WHEN b->>'$.obat1_kode' = b->>'$.obat2_kode' THEN 'Obat tidak boleh sama' END
        WHEN coalesce(b->>'$.nama', '') = '' THEN 'nama wajib diisi'
        WHEN entity = 'm_obat' AND b->>'$.golongan' NOT IN ('NONE', 'OTC', 'OBT', 'OK', 'Psikotropika', 'Narkotika')
          THEN 'golongan harus salah satu dari: NONE,OTC,OBT,OK,Psikotropika,Narkotika'
        WHEN entity = 'm_karyawan' AND b->>'$.level_akses' NOT IN ('farmasi', 'kasir', 'gudang', 'admin')
          THEN 'level_akses harus salah satu dari: farmasi,kasir,gudang,admin' END AS bad,
      CASE entity WHEN 'm_obat' THEN list_has_any(json_keys(b), ['nama', 'produsen', 'harga', 'stok', 'expired_date', 'golongan'])
        WHEN 'm_pelanggan' THEN list_has_any(json_keys(b), ['nama', 'tgl_lahir', 'jenis_kelamin', 'alergi', 'kondisi_medis', 'no_hp', 'alamat'])
        WHEN 'm_dokter' THEN list_has_any(json_keys(b), ['nama', 'spesialisasi', 'fasilitas_kesehatan'])
        WHEN 'm_supplier' THEN list_has_any(json_keys(b), ['nama', 'sertifikasi', 'alamat', 'kontak'])
        WHEN 'm_karyawan' THEN list_has_any(json_keys(b), ['nama', 'jabatan', 'level_akses'])
        WHEN 'm_formula_racik' THEN list_has_any(json_keys(b), ['nama', 'dokter_sip', 'petunjuk', 'standar', 'komposisi'])
        ELSE b->>'$.tingkat' IS NOT NULL OR list_contains(json_keys(b), 'keterangan') END AS given
      FROM body""",
    "stored": """SELECT 'm_obat' AS entity, CAST(p_partkey AS VARCHAR) AS code FROM part
      UNION ALL SELECT 'm_pelanggan', CAST(c_custkey AS VARCHAR) FROM customer
      UNION ALL SELECT 'm_karyawan', CAST(c_custkey AS VARCHAR) FROM customer
      UNION ALL SELECT 'm_dokter', CAST(s_suppkey AS VARCHAR) FROM supplier
      UNION ALL SELECT 'm_supplier', CAST(s_suppkey AS VARCHAR) FROM supplier
      UNION ALL SELECT 'm_formula_racik', 'FR' || o_orderkey FROM orders""",
    "codes": """SELECT c.*, coalesce(last_value(CASE WHEN c.op = 'delete' THEN 0
                      WHEN c.op = 'insert' AND c.bad IS NULL THEN 1 END IGNORE NULLS)
                      OVER (PARTITION BY c.entity, c.code ORDER BY c.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                    CASE WHEN s.code IS NOT NULL THEN 1 ELSE 0 END) = 1 AND c.code <> '' AS here
      FROM checked c LEFT JOIN stored s ON s.entity = c.entity AND s.code = c.code
      WHERE c.entity <> 'interaksi_obat'""",
    "freed": """SELECT CAST(code AS BIGINT) AS id, min(seq) AS at FROM checked
                WHERE entity = 'interaksi_obat' AND op = 'delete' GROUP BY 1""",
    "pairs": """SELECT c.*, least(b->>'$.obat1_kode', b->>'$.obat2_kode') AS p1,
                       greatest(b->>'$.obat1_kode', b->>'$.obat2_kode') AS p2
                FROM checked c WHERE entity = 'interaksi_obat' AND op = 'insert'""",
    "open": """SELECT p.*, i.id IS NULL OR f.at < p.seq AS is_open
               FROM pairs p LEFT JOIN interaksi i ON i.obat1_kode = p.p1 AND i.obat2_kode = p.p2
               LEFT JOIN freed f ON f.id = i.id""",
    "verdicts": """SELECT entity, key, op, seq, payload, b, err,
        CASE WHEN err = '' THEN 'accepted' WHEN err = 'No changes' THEN 'no_changes'
             WHEN err = 'Not found' THEN 'not_found' ELSE 'refused' END AS verdict,
        op = 'insert' AND entity <> 'interaksi_obat' AND trim(key) = '' AS needs_code
      FROM (
        SELECT entity, key, op, seq, payload, b, CASE
          WHEN op = 'insert' THEN CASE WHEN bad IS NOT NULL THEN bad WHEN here THEN 'Kode sudah ada' ELSE '' END
          WHEN op = 'update' AND NOT given THEN 'No changes'
          WHEN NOT here THEN 'Not found'
          WHEN op = 'update' AND list_contains(json_keys(b), 'nama') AND b->>'$.nama' IS NULL
            THEN 'nama tidak boleh kosong' ELSE '' END AS err
        FROM codes
        UNION ALL
        SELECT entity, key, op, seq, payload, b, CASE WHEN bad IS NOT NULL THEN bad
          WHEN coalesce(is_open, false) AND seq = min(CASE WHEN is_open AND bad IS NULL THEN seq END) OVER (PARTITION BY p1, p2)
            THEN '' ELSE 'Pasangan sudah ada' END FROM open
        UNION ALL
        SELECT c.entity, c.key, c.op, c.seq, c.payload, c.b, CASE
          WHEN c.op = 'update' AND NOT c.given THEN 'No changes'
          WHEN i.id IS NULL OR f.at < c.seq THEN 'Not found' ELSE '' END
        FROM checked c LEFT JOIN interaksi i ON i.id = CAST(c.code AS BIGINT) LEFT JOIN freed f ON f.id = i.id
        WHERE c.entity = 'interaksi_obat' AND c.op <> 'insert')""",
}

ORACLE["change_verdicts"] = with_views(
    "SELECT entity, key, op, seq, verdict, err AS error, needs_code FROM verdicts",
    "master_changes", "interaksi", extra=_VERDICTS)

ORACLE["masters_after_changes"] = with_views("""
SELECT a.entity, a.code AS key, a.field,
       CASE WHEN u.code IS NOT NULL THEN u.v WHEN l.seq IS NOT NULL THEN l.b->>('$.' || a.field) ELSE t.value END AS value
FROM (SELECT x.entity, x.code, f.field
      FROM (SELECT DISTINCT entity, code FROM (SELECT entity, code FROM base UNION ALL SELECT entity, code FROM done)) x
      JOIN (SELECT DISTINCT entity, field FROM base) f ON f.entity = x.entity) a
LEFT JOIN last l ON l.entity = a.entity AND l.code = a.code
LEFT JOIN base t ON t.entity = a.entity AND t.code = a.code AND t.field = a.field
LEFT JOIN upd u ON u.entity = a.entity AND u.code = a.code AND u.field = a.field
WHERE CASE WHEN l.seq IS NULL THEN t.code IS NOT NULL ELSE l.op = 'insert' END""",
    "master_changes", "interaksi", extra={**_VERDICTS,
    "base": """SELECT entity, code, field, value FROM (
        SELECT 'm_dokter' AS entity, CAST(s_suppkey AS VARCHAR) AS code,
               unnest(['nama', 'spesialisasi', 'fasilitas_kesehatan']) AS field, unnest([s_name, NULL, 'RS']) AS value FROM supplier
        UNION ALL SELECT 'm_supplier', CAST(s_suppkey AS VARCHAR),
               unnest(['nama', 'sertifikasi', 'alamat', 'kontak']), unnest([s_name, NULL, NULL, NULL]) FROM supplier
        UNION ALL SELECT 'm_karyawan', CAST(c_custkey AS VARCHAR),
               unnest(['nama', 'jabatan', 'level_akses']), unnest([c_name, c_mktsegment, 'kasir']) FROM customer)""",
    "done": "SELECT *, trim(key) AS code FROM verdicts WHERE verdict = 'accepted' AND trim(key) <> ''"
            " AND entity IN ('m_dokter', 'm_supplier', 'm_karyawan')",
    "last": """SELECT entity, code, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(b, seq) AS b FROM done
               WHERE op <> 'update' GROUP BY 1, 2""",
    "upd": """SELECT d.entity, d.code, f.field, arg_max(struct_pack(v := d.b->>('$.' || f.field)), d.seq).v AS v
              FROM done d JOIN (SELECT DISTINCT entity, field FROM base) f ON f.entity = d.entity
              LEFT JOIN last l ON l.entity = d.entity AND l.code = d.code
              WHERE d.op = 'update' AND (l.seq IS NULL OR d.seq > l.seq) AND list_contains(json_keys(d.b), f.field)
              GROUP BY 1, 2, 3"""})
