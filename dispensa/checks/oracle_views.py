"""DuckDB forms of the test-table views of ``dispensa.sources.testdata``.

The oracle queries in ``dispensa.checks.oracle_sql`` run on the raw driver
tables (pre-registered as views in DuckDB).  Each mapped view is a CTE here;
``with_views`` prefixes a query with the CTEs it names, in dependency order.
"""

from __future__ import annotations

AS_OF = "DATE '1998-06-15'"
AS_OF_LEDGER = "DATE '2024-01-31'"

_GOLONGAN = ("CASE p_type WHEN 'PROMO' THEN 'Psikotropika' WHEN 'LARGE' THEN 'Narkotika' "
             "WHEN 'MEDIUM' THEN 'OBT' WHEN 'STANDARD' THEN 'OK' ELSE 'OTC' END")

_LINE_RN = ("row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, "
            "l_quantity, l_extendedprice, l_shipdate)")

VIEWS: dict[str, tuple[list[str], str]] = {
    "obat": ([], f"""
        SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_partkey AS VARCHAR) AS kode, p_name AS nama,
               p_brand AS produsen, CAST(p_retailprice AS DECIMAL(15,2)) AS harga,
               CAST(p_size * 20 AS INTEGER) AS stok,
               {AS_OF} + CAST((p_partkey * 37) % 400 - 40 AS INTEGER) AS expired_date,
               {_GOLONGAN} AS golongan,
               ({_GOLONGAN}) IN ('Psikotropika', 'Narkotika') AS narkotika_psikotropika
        FROM part"""),
    "pelanggan": ([], """
        SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_custkey AS VARCHAR) AS kode, c_name AS nama,
               CASE WHEN c_custkey % 10 = 0 THEN upper(p_name) END AS alergi,
               c_mktsegment AS alamat, CAST(NULL AS VARCHAR) AS jenis_kelamin, CAST(NULL AS VARCHAR) AS no_hp,
               CAST(NULL AS DATE) AS tgl_lahir
        FROM customer LEFT JOIN part ON p_partkey = c_custkey"""),
    "supp": ([], """
        SELECT CAST(s_suppkey AS BIGINT) AS id, CAST(s_suppkey AS VARCHAR) AS kode, s_name AS nama
        FROM supplier"""),
    "penjualan": ([], """
        SELECT CAST(o_orderkey AS BIGINT) AS id, 'PJ' || CAST(o_orderkey AS VARCHAR) AS no_nota,
               o_orderdate AS tgl,
               CASE o_orderstatus WHEN 'O' THEN 'OTC' WHEN 'P' THEN 'Resep' WHEN 'F' THEN 'Racik' END AS jenis,
               CAST(o_custkey AS VARCHAR) AS pelanggan_kode,
               CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS dokter_sip,
               false AS narkotika_psikotropika,
               CAST(o_totalprice AS DECIMAL(15,2)) AS total
        FROM orders"""),
    "penjualan_item": ([], f"""
        SELECT CAST(l_orderkey * 100 + {_LINE_RN} AS BIGINT) AS id, CAST(l_orderkey AS BIGINT) AS penjualan_id,
               CAST(l_partkey AS VARCHAR) AS obat_kode, CAST(NULL AS VARCHAR) AS batch_no,
               CAST(l_quantity AS INTEGER) AS qty, CAST(l_extendedprice AS DECIMAL(15,2)) AS harga_jual
        FROM lineitem WHERE l_returnflag <> 'R'"""),
    "pembelian": ([], """
        SELECT CAST(o_orderkey AS BIGINT) AS id, 'PB' || CAST(o_orderkey AS VARCHAR) AS no_faktur,
               CAST(o_orderdate AS DATE) AS tgl, CAST(o_orderkey % 10 AS VARCHAR) AS supplier_kode,
               CAST(floor(o_totalprice / 10) AS DECIMAL(15,2)) AS pajak,
               CAST(o_totalprice AS DECIMAL(15,2)) AS total,
               CAST(CASE o_orderstatus
                    WHEN 'F' THEN CAST(o_totalprice AS DECIMAL(15,2)) + CAST(floor(o_totalprice / 10) AS DECIMAL(15,2))
                    WHEN 'P' THEN CAST(floor(o_totalprice / 2) AS DECIMAL(15,2))
                    ELSE 0 END AS DECIMAL(15,2)) AS bayar
        FROM orders"""),
    "pembelian_item": ([], f"""
        SELECT CAST(l_orderkey * 100 + {_LINE_RN} AS BIGINT) AS id, CAST(l_orderkey AS BIGINT) AS pembelian_id,
               CAST(l_partkey AS VARCHAR) AS obat_kode, 'B' || CAST(l_linenumber AS VARCHAR) AS batch_no,
               CAST(l_shipdate AS DATE) AS expired_date, CAST(l_quantity AS INTEGER) AS qty,
               CAST(l_extendedprice AS DECIMAL(15,2)) AS harga_beli
        FROM lineitem WHERE l_returnflag = 'R'"""),
    "interaksi": ([], """
        SELECT CAST(min(src) AS BIGINT) AS id, obat1_kode, obat2_kode,
               CASE min(lvl) WHEN 0 THEN 'contraindicated' WHEN 1 THEN 'major' WHEN 2 THEN 'moderate'
                    ELSE 'minor' END AS tingkat
        FROM (
          SELECT least(CAST(p_partkey AS VARCHAR), CAST(o AS VARCHAR)) AS obat1_kode,
                 greatest(CAST(p_partkey AS VARCHAR), CAST(o AS VARCHAR)) AS obat2_kode,
                 (p_partkey + k) % 4 AS lvl, p_partkey * 5 + k AS src
          FROM (SELECT p_partkey, k, (p_partkey * 7 + k * 13 + 1) % n AS o
                FROM part, range(5) t(k), (SELECT count(*) AS n FROM part) c)
          WHERE o <> p_partkey)
        GROUP BY obat1_kode, obat2_kode"""),
    "ledger": ([], """
        SELECT CAST(event_id AS BIGINT) AS id, ts AS tgl, CAST(user_id AS VARCHAR) AS obat_kode,
               CASE WHEN event_type IN ('signup', 'purchase') THEN 'BELI'
                    WHEN event_type = 'error' THEN 'KOREKSI' ELSE 'JUAL' END AS ref_type,
               CASE WHEN event_type IN ('signup', 'purchase') THEN CAST(floor(value) AS INTEGER) ELSE 0 END AS qty_in,
               CASE WHEN event_type IN ('signup', 'purchase') THEN 0 ELSE CAST(floor(value) AS INTEGER) END AS qty_out,
               event_type AS keterangan
        FROM events"""),
    "hutang": (["pembelian"], """
        SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS id, supplier_kode,
               id AS pembelian_id, saldo
        FROM (SELECT id, supplier_kode,
                     CAST(greatest(0, total + pajak - bayar) AS DECIMAL(15,2)) AS saldo
              FROM pembelian) WHERE saldo > 0"""),
    "bayar": (["hutang"], """
        SELECT CAST(event_id AS BIGINT) AS id,
               CAST(event_id % greatest((SELECT floor(count(*) / 50) FROM hutang), 1) AS BIGINT) AS hutang_id,
               CAST(ts AS DATE) AS tgl, CAST(round(value * 400, 2) AS DECIMAL(15,2)) AS nominal
        FROM events WHERE event_type = 'purchase'"""),
    "page_lines": ([], """
        SELECT 'p' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 4 < 3 THEN '.jpg' ELSE '.txt' END AS name,
               CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no,
               unnest(string_split(text, chr(10))) AS text
        FROM documents"""),
    "typed_inputs": (["pembelian_item", "obat"], """
        SELECT i.id, CASE i.id % 4 WHEN 0 THEN concat_ws(' - ', i.obat_kode, o.nama)
                                   WHEN 1 THEN ' ' || i.obat_kode || ' '
                                   WHEN 2 THEN upper(o.nama) ELSE 'X' || i.obat_kode END AS obat_input
        FROM pembelian_item i LEFT JOIN obat o ON o.kode = i.obat_kode"""),
    "drug_requests": ([], f"""
        SELECT CAST(p_partkey AS BIGINT) AS id,
               CASE WHEN p_partkey % 19 = 0 THEN repeat(p_name, 6) ELSE CAST(p_partkey AS VARCHAR) END AS kode,
               CASE WHEN p_partkey % 17 = 0 THEN '' ELSE p_name END AS nama,
               p_brand AS produsen, CAST(p_retailprice AS VARCHAR) AS harga,
               CASE WHEN p_partkey % 11 = 0 THEN '-' || CAST(p_size AS VARCHAR) ELSE CAST(p_size AS VARCHAR) END AS stok,
               CASE WHEN p_partkey % 13 = 0
                    THEN strftime({AS_OF} + CAST((p_partkey * 37) % 400 - 40 AS INTEGER), '%Y-%-m-%-d')
                    ELSE strftime({AS_OF} + CAST((p_partkey * 37) % 400 - 40 AS INTEGER), '%Y-%m-%d') END
                 AS expired_date,
               CASE WHEN p_partkey % 7 = 0 THEN p_type ELSE {_GOLONGAN} END AS golongan
        FROM part"""),
    "interaction_requests": ([], """
        SELECT CAST(p_partkey * 5 + k AS BIGINT) AS id, CAST(p_partkey AS VARCHAR) AS obat1_kode,
               CAST((p_partkey * 7 + k * 13 + 1) % n AS VARCHAR) AS obat2_kode,
               CASE (p_partkey + k) % 4 WHEN 0 THEN 'contraindicated' WHEN 1 THEN 'major' WHEN 2 THEN 'moderate'
                    ELSE 'minor' END AS tingkat
        FROM part, range(5) t(k), (SELECT count(*) AS n FROM part) c"""),
    "customer_changes": ([], """
        SELECT CAST(c_custkey AS VARCHAR) AS kode, 'update' AS op, CAST(1 AS BIGINT) AS seq,
               CASE c_custkey % 4 WHEN 0 THEN '{"alergi":"PARACETAMOL"}' WHEN 1 THEN '{"alergi":null}'
                    ELSE json_object('nama', upper(c_name))::VARCHAR END AS payload
        FROM customer WHERE c_custkey % 4 <> 3"""),
    "master_changes": ([], """
        SELECT entity, seq, op,
               CASE WHEN o <= 1 AND q % 17 = 0 THEN ' '
                    WHEN entity = 'interaksi_obat' AND o > 1 THEN CAST(k * 5 + (q // 5) % 5 AS VARCHAR)
                    WHEN entity = 'm_formula_racik' THEN 'FR' || k ELSE CAST(k AS VARCHAR) END AS key,
               CASE WHEN o <= 1 AND entity = 'interaksi_obat' THEN
                      '{"obat1_kode":"' || k || '","obat2_kode":"'
                      || CASE WHEN v = 3 THEN k ELSE (k * 7 + (q % 7) * 13 + 1) % (SELECT count(*) FROM part) END
                      || '","tingkat":"' || CASE WHEN v = 4 THEN 'X' ELSE 'major' END || '"}'
                    WHEN o <= 1 THEN
                      '{"nama":"' || CASE WHEN v = 3 THEN '' ELSE 'N' || seq END || '","harga":"' || k
                      || '.50","stok":"5","golongan":"' || CASE WHEN v = 4 THEN 'X' ELSE 'OTC' END
                      || '","jenis_kelamin":"L","jabatan":"staf","level_akses":"'
                      || CASE WHEN v = 4 THEN 'X' ELSE 'kasir' END || '"}'
                    WHEN o = 4 THEN '{}'
                    WHEN v = 0 THEN '{"nama":"U' || seq || '","keterangan":"baru"}'
                    WHEN v = 1 THEN '{"nama":null,"tingkat":null}'
                    WHEN v = 2 THEN '{"lain":"x"}'
                    WHEN v = 3 THEN '{"nama":'
                    ELSE '{"produsen":null,"alergi":null,"alamat":null,"spesialisasi":null,'
                         || '"jabatan":"kepala","petunjuk":null,"tingkat":"minor"}' END AS payload
        FROM (SELECT CAST(event_id AS BIGINT) AS seq, event_id // 7 AS q, (event_id // 7) % 5 AS o,
                     (event_id // 7 // 15) % 5 AS v,
                     CASE WHEN (event_id // 7) % 3 = 0 THEN 7 ELSE user_id END AS k,
                     CASE (event_id // 7) % 5 WHEN 0 THEN 'insert' WHEN 1 THEN 'insert' WHEN 4 THEN 'delete'
                          ELSE 'update' END AS op,
                     ['m_obat', 'm_pelanggan', 'm_dokter', 'm_supplier', 'm_karyawan', 'm_formula_racik',
                      'interaksi_obat'][event_id % 7 + 1] AS entity
              FROM events)"""),
    "drug_changes": ([], f"""
        SELECT CASE WHEN p_partkey % 5 = 3 THEN CAST(p_partkey + (SELECT count(*) FROM part) AS VARCHAR)
                    ELSE CAST(p_partkey AS VARCHAR) END AS kode,
               CASE WHEN p_partkey % 5 <= 1 THEN 'update' WHEN p_partkey % 5 = 2 THEN 'delete' ELSE 'insert' END AS op,
               CAST(1 AS BIGINT) AS seq,
               CASE p_partkey % 5 WHEN 0 THEN json_object('nama', upper(p_name))::VARCHAR
                    WHEN 1 THEN '{{"produsen":null}}' WHEN 2 THEN '{{}}'
                    ELSE json_object('nama', p_name, 'harga', CAST(p_retailprice AS VARCHAR),
                                     'stok', CAST(p_size AS VARCHAR), 'golongan', {_GOLONGAN})::VARCHAR END AS payload
        FROM part WHERE p_partkey % 5 <> 4
        UNION ALL
        SELECT CAST(p_partkey AS VARCHAR), CASE WHEN p_partkey % 15 = 0 THEN 'update' ELSE 'insert' END,
               CAST(2 AS BIGINT),
               CASE WHEN p_partkey % 15 = 0 THEN '{{"harga":"1.00"}}'
                    ELSE json_object('nama', p_name, 'harga', CAST(p_retailprice AS VARCHAR),
                                     'stok', CAST(p_size AS VARCHAR), 'golongan', {_GOLONGAN})::VARCHAR END
        FROM part WHERE p_partkey % 15 IN (0, 2)"""),
}


def _order(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(sql: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH <views...>, <extra...> <sql>``; ``extra`` CTEs come after the views."""
    parts = [f"{n} AS ({VIEWS[n][1]}\n)" for n in _order(list(names))]
    for k, v in (extra or {}).items():
        parts.append(f"{k} AS ({v}\n)")
    if not parts:
        return sql
    return "WITH " + ",\n".join(parts) + "\n" + sql
