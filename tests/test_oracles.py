"""Every registered query against its DuckDB oracle on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as ENTRY  # noqa: E402
from check_oracles import canon, duck  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = sorted(ENTRY.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = ENTRY.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = ENTRY.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    res = con.execute(sql)
    a, ac = canon(df.columns, rows)
    b, bc = canon([d[0] for d in res.description], res.fetchall())
    assert ac == bc
    assert len(a) == len(b)
    assert a == b


def test_entry_smoke(spark):
    df = ENTRY.entry(spark)
    assert df.count() >= 0 and df.columns == ["event_id", "entity_id", "longitude", "latitude", "ts_ms", "seq"]
