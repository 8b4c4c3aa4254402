"""Change verdicts against a plain one-by-one replay."""

import json
import random

import pytest

from dispensa.operators import changes, quality
from dispensa.plans.prefix import running_last
from pyspark.sql import functions as F

SCHEMA = "entity string, key string, op string, seq long, payload string"
STAFF = {"nama": "A", "jabatan": "staf", "level_akses": "kasir"}


def replay(feed, staff, pairs):
    """Verdicts in order, one change after another, on plain sets."""
    staff, ids, taken = set(staff), {i: p for i, p in pairs}, {p for _, p in pairs}
    out = []
    for entity, key, op, seq, payload in sorted(feed, key=lambda r: (r[3], r[2], r[4])):
        try:
            body = json.loads(payload)
            body = body if isinstance(body, dict) else {}
        except (TypeError, ValueError):
            body = {}
        if entity == "m_karyawan":
            code = (key or "").strip()
            if op == "insert":
                ok = (all(body.get(f) for f in STAFF) and body["level_akses"] in ("farmasi", "kasir", "gudang", "admin")
                      and len(code) <= 50)
                v = "accepted" if ok and code not in staff else "refused"
                if v == "accepted" and code:
                    staff.add(code)
            elif op == "update":
                null = any(f in body and body[f] is None for f in STAFF)
                v = ("no_changes" if not set(body) & set(STAFF) else "not_found" if key not in staff
                     else "refused" if null else "accepted")
            else:
                v = "accepted" if key in staff else "not_found"
                staff.discard(key)
        else:
            if op == "insert":
                a, b = body.get("obat1_kode"), body.get("obat2_kode")
                ok = a and b and a != b and body.get("tingkat") == "major"
                p = tuple(sorted((a or "", b or "")))
                v = "accepted" if ok and p not in taken else "refused"
                if v == "accepted":
                    taken.add(p)
            elif op == "update":
                v = ("no_changes" if body.get("tingkat") is None and "keterangan" not in body
                     else "accepted" if int(key) in ids else "not_found")
            else:
                v = "accepted" if int(key) in ids else "not_found"
                taken.discard(ids.pop(int(key), None))
        out.append((entity, key, op, seq, payload, v))
    return sorted(out, key=str)


def random_feed(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        op = rnd.choice(["insert", "insert", "update", "delete"])
        if rnd.random() < 0.5:
            key = "k0" if rnd.random() < 0.4 else rnd.choice(["k1", "k2", "k3", "", " "])
            if op != "insert":
                key = key.strip() or "k9"
            body = rnd.choice([json.dumps(STAFF), json.dumps({**STAFF, "level_akses": "X"}), '{"nama":"B"}',
                               '{"nama":null}', '{"lain":1}', "{", "[1]", None])
            rows.append(("m_karyawan", key, op, i, body))
        else:
            a, b = rnd.choice("1234"), rnd.choice("1234")
            body = (json.dumps({"obat1_kode": a, "obat2_kode": b, "tingkat": rnd.choice(["major", "X"])})
                    if op == "insert" else rnd.choice(['{"tingkat":"minor"}', '{"tingkat":null}', '{"keterangan":null}']))
            rows.append(("interaksi_obat", "" if op == "insert" else str(rnd.randrange(5)), op, i, body))
    rnd.shuffle(rows)
    return rows


def tables(spark):
    pairs = [(0, ("1", "2")), (1, ("1", "3")), (2, ("3", "4"))]
    return {"m_karyawan": spark.createDataFrame([("k0", "Z", "x", "admin"), ("k2", "Y", "x", "admin")],
                                                "kode string, nama string, jabatan string, level_akses string"),
            "interaksi_obat": spark.createDataFrame([(i, *p) for i, p in pairs],
                                                    "id long, obat1_kode string, obat2_kode string")}, pairs


@pytest.mark.parametrize("seed", [1, 2])
def test_verdicts_match_replay(spark, seed):
    stored, pairs = tables(spark)
    feed = random_feed(400, seed)
    got = changes.change_verdicts(spark.createDataFrame(feed, SCHEMA), stored)
    rows = [(r.entity, r.key, r.op, r.seq, r.payload, r.verdict) for r in got.collect()]
    assert sorted(rows, key=str) == replay(feed, {"k0", "k2"}, pairs)


def test_odd_changes_and_empty_tables(spark):
    feed = spark.createDataFrame([
        ("m_karyawan", "a b", "delete", 1, "{}"), ("m_karyawan", None, "insert", 1, json.dumps(STAFF)),
        ("m_karyawan", None, "update", 2, '{"nama":"x"}'), ("nichts", "1", "insert", 1, "{}"),
        ("m_karyawan", "1", None, 1, "{}"), (None, None, None, None, None),
        ("m_karyawan", "7", "insert", 5, json.dumps(STAFF)), ("m_karyawan", "7", "insert", 5, json.dumps(STAFF)),
        ("interaksi_obat", "x", "delete", 1, "{}"), ("m_karyawan", "k" * 51, "insert", 1, json.dumps(STAFF)),
    ], SCHEMA)
    got = sorted((str(r.key), str(r.op), r.verdict, r.needs_code) for r in changes.change_verdicts(feed, {}).collect())
    assert got == sorted([
        ("a b", "delete", "not_found", False), ("None", "insert", "accepted", True), ("None", "update", "not_found", False),
        ("1", "insert", "refused", False), ("1", "None", "refused", False), ("None", "None", "refused", False),
        ("7", "insert", "accepted", False), ("7", "insert", "refused", False), ("x", "delete", "not_found", False),
        ("k" * 51, "insert", "refused", False)])
    assert changes.change_verdicts(feed.limit(0), tables(spark)[0]).count() == 0


def test_snapshot_takes_accepted_changes_only(spark):
    stored, _ = tables(spark)
    feed = spark.createDataFrame([
        ("m_karyawan", "k0", "update", 1, '{"nama":null}'), ("m_karyawan", "k0", "update", 2, '{"jabatan":"neu"}'),
        ("m_karyawan", " k1 ", "insert", 3, json.dumps(STAFF)), ("m_karyawan", "k2", "delete", 4, "{}"),
        ("m_karyawan", "k2", "insert", 5, '{"nama":"B"}')], SCHEMA)
    got = changes.post_changes(feed, stored)["m_karyawan"].collect()
    assert sorted(tuple(r) for r in got) == [("k0", "Z", "neu", "admin"), ("k1", "A", "staf", "kasir")]


def test_running_last_over_blocks_equals_one_window(spark):
    rnd = random.Random(3)
    rows = [("h" if rnd.random() < 0.5 else None if rnd.random() < 0.2 else "c", i,
             rnd.choice([None, None, None, 0, 1])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o long, x int")
    got = running_last(df, ["g"], ["o"], {"y": F.col("x")}, inclusive=False, blocks=7).collect()
    state, want = {}, {}
    for g, o, x in rows:
        want[o] = state.get(g)
        state[g] = state.get(g) if x is None else x
    assert {r.o: r.y for r in got} == want


def test_body_errors_equal_validate(spark):
    body = {"nama": "x" * 151, "jabatan": "", "level_akses": "X"}
    df = spark.createDataFrame([(body,)], "m map<string,string>")
    one = df.select(quality.body_errors(F.col("m"), quality.RULES_STAFF).alias("e")).first().e
    cols = df.select(*[F.col("m")[f].alias(f) for f in body])
    assert one == quality.validate(cols, quality.RULES_STAFF).first().errors
