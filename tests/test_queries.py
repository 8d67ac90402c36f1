"""Every core query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
CORE = {n: f for n, f in entry.queries().items() if not (n[0] == "p" and n[1:2].isdigit()) or n.startswith(("p1_", "p7_"))}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, con, name):
    df = CORE[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql:
        got = con.execute(sql)
        names = [x[0] for x in got.description]
        assert sorted(names) == cols
        assert rows == sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in got.fetchall())
