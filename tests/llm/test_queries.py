"""Every query of the subpackage on the smallest test data where they are there; p5_found against its SQL."""

import os

import duckdb
import pytest

from lexweave.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
COLUMNS = {
    "p1_found": "qa_id_a qa_id_b", "p2_found": "rec_table rec_id start_pos end_pos", "p3_found": "result_id defect", "p5_found": "rec_table rec_id", "p6_found": "rec_table rec_id", "p8_found": "doc_id item_id", "p9_found": "doc_id subject_id",
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in COLUMNS:
        assert df.columns == COLUMNS[name].split() and len(rows) == len(set(rows))
        assert all(t in ("string", "bigint") for _, t in df.dtypes)
    if name == "p5_found":
        c = duckdb.connect()
        for t in ("legal_sections", "text_units"):
            c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
        assert sorted(c.execute(queries.oracle_sql()[name]).fetchall()) == sorted(rows)
