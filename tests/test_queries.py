from collections import Counter

import duckdb
import pytest
from helpers import DATA, HAVE_DATA

import __spark_entry__
from fluxcube.queries import ORACLES, QUERIES

pytestmark = pytest.mark.skipif(not HAVE_DATA, reason="no tables")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def bag(frame):
    def plain(v):
        if v is None or v != v:
            return None
        return str(v)[:10] if hasattr(v, "year") else float(v) if not isinstance(v, (str, bool)) else v

    return Counter(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert bag(got) == bag(want)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and set(df.columns) == {"area", "time", "variable", "value"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
