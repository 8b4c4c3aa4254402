"""Every registered query against its DuckDB oracle (row multiset equality)."""

import pytest

from dispensa.checks.compare import compare_one, duck
from dispensa.checks.oracle_sql import ORACLE
from dispensa.queries import REGISTRY

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_oracle(spark, con, name):
    r = compare_one(spark, con, name, REGISTRY[name], ORACLE.get(name), SF_SMALL)
    if ORACLE.get(name) is None:
        assert r["rows"] >= 0
        return
    assert r["cols"], r
    assert r["values"], r


def test_entry_runs(spark):
    import importlib.util
    import os
    spec = importlib.util.spec_from_file_location(
        "spark_entry", os.path.join(os.path.dirname(os.path.dirname(__file__)), "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    df = m.entry(spark)
    assert df.count() > 0
    assert set(m.oracle_sql()) <= set(m.queries())
