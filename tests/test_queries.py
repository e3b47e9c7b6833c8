"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tidewater.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "0" if v == 0 else f"{v:.7g}" if not math.isnan(v) else "nan"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    found = duck.execute(catalog.ORACLES[name])
    have = [c[0] for c in found.description]
    assert sorted(have) == names
    place = [have.index(c) for c in names]
    assert got == sorted(tuple(plain(r[i]) for i in place) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - {"scenario_forecast", "sig_all_configured", "signals_backtest", "signals_total_score"}))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
