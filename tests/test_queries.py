"""Every query of the core against its SQL, on the smallest test data where they are there."""

import glob
import os

import duckdb
import pytest

from lexweave.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: round(v, 6) if isinstance(v, float) else str(v) if v is not None and not isinstance(v, int) else v
    return sorted((tuple(cell(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    df = catalogue.queries()[name](spark, SF)
    got = df.collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        return
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    found = c.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(found.fetchall(), columns) == rows(got, df.columns)
