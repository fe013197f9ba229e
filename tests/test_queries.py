"""Every registered query of the library against its SQL in DuckDB; those without SQL have tests of their own."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from ledgerloom import plans

ROWS_ONLY = {"f30_mask_pii", "f1_f7_sequence_ratio", "j11_j12_exact_lanes", "j13_w2_fuzzy_lanes", "j19_j20_fuzzy_ids", "f35_repository_scan", "m1_isolation_scores"}


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v.isoformat() if isinstance(v, datetime.date) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"create view {file[:-8]} as select * from '{sf_dir}/{file}'")
    return con


def test_each_query_is_held_against_sql():
    assert set(plans.QUERIES) - set(plans.ORACLE) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = plans.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(([plain(v) for v in r] for r in df.select(*columns).collect()), key=str)
    assert got
    if name in plans.ORACLE:
        want = duck.execute("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({plans.ORACLE[name]})").fetchall()
        assert got == sorted(([plain(v) for v in r] for r in want), key=str)
