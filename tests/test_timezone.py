"""Results do not depend on the session time zone (wall-clock timestamp_ntz data)."""

from dispensa.queries import REGISTRY

from .conftest import SF_SMALL


def _rows(spark, name):
    return sorted(tuple(r) for r in REGISTRY[name](spark, SF_SMALL).collect())


def test_day_results_equal_across_session_zones(spark):
    names = ["sales_by_day", "day_kpis", "sales_list", "stream_daily_sales", "default_expiry"]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        utc = {n: _rows(spark, n) for n in names}
        spark.conf.set("spark.sql.session.timeZone", "Asia/Jakarta")
        jkt = {n: _rows(spark, n) for n in names}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert utc == jkt
