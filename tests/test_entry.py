from __future__ import annotations

import pytest

import __spark_entry__ as entry
from shelfwork.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = entry.queries()[name](spark, folder)
    want = con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    pick = lambda cols, rows: sorted(tuple(repr(round(r[cols.index(c)], 9) if isinstance(r[cols.index(c)], float) else r[cols.index(c)]) for c in order) for r in rows)
    assert pick(got.columns, [tuple(r) for r in got.collect()]) == pick(want.columns, want.fetchall())
