"""Rows of the audit workbook's sheets."""

import duckdb

from ledgerloom import plans

COLUMNS = ["line_id", "match_status", "severity", "tax_status"]


def test_each_line_has_its_shipment_match_and_its_tax_status(spark, sf_dir):
    name = "r39_r53_sheet_rows"
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{sf_dir}/lineitem.parquet'")
    want = con.execute(plans.ORACLE[name])
    assert [c[0] for c in want.description] == COLUMNS
    df = plans.QUERIES[name](spark, sf_dir)
    assert df.columns == COLUMNS
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == con.cursor().execute("select count(*) from lineitem").fetchone()[0]
    assert {r[1:] for r in rows} == {("PARTIAL", "AMBER", "NOT_ASSESSED"), ("NO_REF", "ZERO", "NOT_ASSESSED")}
    assert sorted(rows) == sorted(want.fetchall())
