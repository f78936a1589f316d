"""Every query of the roster against its SQL on the smallest tables."""

import glob
import os

import pytest

from ratersight.plans import catalog

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(frame, columns):
    own = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in own.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equal(spark, con, name):
    want = con.execute(catalog.ORACLE_SQL[name]).df()
    got = catalog.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)
