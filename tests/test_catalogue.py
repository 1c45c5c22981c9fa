"""Every registered query outside the training-data subpackage against its SQL, on the smallest shared tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from millrace.plans import catalogue

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
SQL = catalogue.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(map(plain, v.values()))
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="the shared tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    assert len(columns) == len(set(columns))
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in SQL:
        r = duck.execute(SQL[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == columns
        want = sorted((tuple(plain(x[names.index(c)]) for c in columns) for x in r.fetchall()), key=repr)
        assert got == want
